"""Columns over texts and lines: splitting, context, fences, entropy, decoding."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def lines(text: Column) -> Column:
    r"""Lines split at ``\n``, trailing empty ones kept; an empty text is one empty line."""
    return F.split(text, "\n", -1)


def explode_lines(files: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row a line, with ``line_no`` from 1 and ``line``; the text itself is dropped."""
    cols = keep if keep is not None else [c for c in files.columns if c != text]
    return files.select(*cols, F.posexplode(lines(F.col(text))).alias("_pos", "line")).withColumn("line_no", F.col("_pos") + 1).drop("_pos")


def fence_ranges(ls: Column) -> Column:
    """``array<struct<a,b>>`` of fenced blocks: a closing fence has its opener's character; an unclosed one ranges nowhere."""
    zero = F.struct(
        F.lit(0).alias("n"), F.lit("").alias("mark"), F.lit(0).alias("open"), F.array().cast("array<struct<a:int,b:int>>").alias("out")
    )

    def step(acc: Column, line: Column) -> Column:
        n = acc["n"] + 1
        mark = F.regexp_extract(line, r"^\s*(```|~~~)", 1)
        closes = (acc["mark"] != "") & (mark == acc["mark"])
        opens = (acc["mark"] == "") & (mark != "")
        return F.struct(
            n.alias("n"),
            F.when(closes, "").when(opens, mark).otherwise(acc["mark"]).alias("mark"),
            F.when(opens, n).otherwise(acc["open"]).alias("open"),
            F.when(closes, F.concat(acc["out"], F.array(F.struct(acc["open"].alias("a"), n.alias("b"))))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(ls, zero, step)["out"]


def front_matter_end(ls: Column, most: int = 100) -> Column:
    """Number of the line that ends the front matter, 0 if there is none."""
    head = F.transform(F.slice(ls, 2, most - 1), lambda x: F.trim(F.regexp_replace(x, r"\r$", "")))
    at = F.array_position(head, F.lit("---"))
    return F.when((F.trim(F.regexp_replace(F.element_at(ls, 1), r"\r$", "")) == "---") & (at > 0), at.cast("int") + 1).otherwise(0)


FEW_CHARACTERS = 256


def _by_runs(symbols: Column) -> Column:
    """Sum of k log k over the numbers k of equal symbols of an array: the symbols are sorted and the runs followed."""

    def run(acc: Column, c: Column) -> Column:
        k = F.when(acc["c"] == c, acc["k"]).otherwise(0.0)
        return F.struct(c.alias("c"), (k + 1).alias("k"), (acc["s"] + (k + 1) * F.log2(k + 1) - F.when(k > 0, k * F.log2(k)).otherwise(0.0)).alias("s"))

    return F.aggregate(F.sort_array(symbols), F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("s")), run)["s"]


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over code points, rounded to 4 places; 0 for an empty text, null for null.

    With few distinct characters the text is shortened by each of them once,
    which takes byte searches only; with many (Chinese, say) its characters are
    sorted and their runs counted.
    """
    every = F.filter(F.split(text, ""), lambda c: c != "")
    chars = F.array_distinct(every)
    n = F.length(text).cast("double")

    def part(acc: Column, c: Column) -> Column:
        k = (F.octet_length(text) - F.octet_length(F.replace(text, c, F.lit("")))) / F.octet_length(c)
        return acc + k * F.log2(k)

    few = (F.octet_length(text) == F.length(text)) | (F.size(chars) <= FEW_CHARACTERS)  # ASCII has few
    total = F.when(few, F.aggregate(chars, F.lit(0.0), part)).otherwise(_by_runs(every))
    return F.when(text.isNull(), None).when(F.length(text) == 0, 0.0).otherwise(F.round(F.log2(n) - total / n, 4))


def byte_entropy(content: Column) -> Column:
    """Shannon entropy in bits over bytes, rounded to 4 places; 0 for no bytes, null for null."""
    n = F.octet_length(content).cast("double")
    total = _by_runs(F.regexp_extract_all(F.hex(content), F.lit(".."), F.lit(0)))
    return F.when(content.isNull(), None).when(n == 0, 0.0).otherwise(F.round(F.log2(n) - total / n, 4))


def any_contains(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def tagged(xs: Column, tag: str, value: object, name: str, fn: Callable[[Column], Column] | None = None) -> Column:
    """Array of (tag, value of ``fn``) for each entry; a lambda with defaults would be taken for one of two arguments."""
    return F.transform(xs, lambda x: F.struct(F.lit(value).alias(tag), (fn(x) if fn else x).alias(name)))


def pinned(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a column that is computed once a row, however often it is used: the optimizer doesn't merge across a generator."""
    return df.select("*", F.explode(F.array(expr)).alias(name))
