"""Decode operators: hidden characters, confusables, encodings, entropy findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import entropy, explode_lines, pinned, tagged
from siltstone.sources.packages import LOCKFILES, for_engine

# Code points.
BIDI = "‪-‮⁦-⁩"
ZERO_WIDTH = "​‌‍⁠﻿᠎"
CONFUSABLE = ("аеорсухіјѕԁɡոνωАВЕ", "aeopcyxijsdgnvwABE")
DANGER_WORDS = "eval|exec|system|bash|curl|wget|/bin/sh|powershell|import os"
# Entropy thresholds (critical, high, medium) and those of texts rich in CJK or prose.
ENTROPY = (7.0, 6.0, 5.5)
ENTROPY_CJK = (7.5, 6.5, 6.0)
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"


def readable(b: Column) -> Column:
    """Bytes as text if more than five characters and a letter come out, else null."""
    t = F.when(F.is_valid_utf8(b.cast("string")), b.cast("string"))
    return F.when((F.length(t) > 5) & t.rlike("[A-Za-z]"), t)


def base64_text(s: Column) -> Column:
    return readable(F.try_to_binary(s, F.lit("base64")))


def hex_text(s: Column) -> Column:
    return readable(F.unhex(s))


def rot13(s: Column) -> Column:
    a = "abcdefghijklmnopqrstuvwxyz"
    b = a[13:] + a[:13]
    return F.translate(s, a + a.upper(), b + b.upper())


def strip_hidden(s: Column) -> Column:
    return F.regexp_replace(s, f"[{BIDI}{ZERO_WIDTH}]", "")


def normalise_confusables(s: Column) -> Column:
    return F.translate(s, *CONFUSABLE)


def hidden_characters(f: DataFrame) -> DataFrame:
    """Per file with any: counts of direction marks, zero-width characters and confusables, and the cleaned length."""
    t = F.col("text")
    count = lambda cls: F.length(t) - F.length(F.regexp_replace(t, f"[{cls}]", ""))
    return (
        f.select("file_id", count(BIDI).alias("n_bidi"), count(ZERO_WIDTH).alias("n_zero_width"), count(CONFUSABLE[0]).alias("n_confusable"), F.length(strip_hidden(t)).alias("clean_length"))
        .where("n_bidi + n_zero_width + n_confusable > 0")
    )


SPACE = r"[\s\x1c-\x1f]"
# possessive, as Java recurses once an entry otherwise and a long array exhausts the stack
HEX_ARRAY = rf"(?U)\w{SPACE}*+={SPACE}*+\[{SPACE}*+(?:0x[0-9a-fA-F]{{2}}{SPACE}*+,?+{SPACE}*+)++\]"


def array_text(s: Column) -> Column:
    """Bytes of an array of eight or more without zeros as text, if more than ten characters and a letter come out, else null."""
    b = F.regexp_extract_all(s, F.lit("0x([0-9a-fA-F]{2})"), F.lit(1))
    t = F.make_valid_utf8(F.unhex(F.array_join(F.filter(b, lambda x: x != "00"), "")).cast("string"))
    bare = F.regexp_replace(t, rf"(?U)^{SPACE}++|{SPACE}++\z", "")
    return F.when((F.size(b) >= 8) & (F.length(bare) > 10) & t.rlike(r"\p{L}"), t)


def decoded_arrays(src: DataFrame) -> DataFrame:
    """Hex arrays over any number of lines, at the line where they begin."""
    t = F.col("text")
    newlines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    x = src.where(t.rlike(HEX_ARRAY))
    x = pinned(x, "_between", F.transform(F.split(t, HEX_ARRAY, -1), newlines))
    x = pinned(x, "_found", F.regexp_extract_all(t, F.lit(HEX_ARRAY), F.lit(0)))
    step = lambda a, v: F.struct((a["n"] + v["_gap"] + newlines(v["_m"])).alias("n"), F.concat(a["at"], F.array(a["n"] + v["_gap"])).alias("at"))
    pairs = F.arrays_zip(F.slice("_between", F.lit(1), F.size("_found")).alias("_gap"), F.col("_found").alias("_m"))
    at = F.aggregate(pairs, F.struct(F.lit(1).alias("n"), F.array().cast("array<int>").alias("at")), step, lambda a: a["at"])
    x = x.select("file_id", F.explode(F.arrays_zip(at.alias("line_no"), F.col("_found").alias("m"))).alias("d"))
    x = x.select("file_id", "d.line_no", F.lit("hex_array").alias("technique"), array_text(F.col("d.m")).alias("decoded"))
    return x.where("decoded IS NOT NULL")


def decoded_lines(f: DataFrame) -> DataFrame:
    """``file_id, line_no, technique, decoded``: base64, hex, percent and escape runs and hex arrays that decode to readable text, and ROT13 literals."""
    src = for_engine(f, "deobfuscation").where(~F.col("name").isin(*LOCKFILES))
    rows = explode_lines(src.select("file_id", "text"))
    line = F.col("line")
    finds = {
        "base64": (r"(?:^|[^A-Za-z0-9+/])([A-Za-z0-9+/]{16,}={0,2})(?![A-Za-z0-9+/=])", 1, base64_text),
        "hex_escape": (r"((?:\\x[0-9a-fA-F]{2}){8,})", 1, lambda s: hex_text(F.replace(s, F.lit("\\x"), F.lit("")))),
        "percent": (r"((?:%[0-9a-fA-F]{2}){8,})", 1, lambda s: hex_text(F.replace(s, F.lit("%"), F.lit("")))),
        "rot13_decode": (r"(?iud)codecs\.decode\s*\(\s*[\"']([^\"']{10,})[\"'](?=.*rot.?13)", 1, rot13),
        "rot13_call": (r"(?iud)rot13\s*\(\s*[\"']([^\"']{10,})[\"']", 1, rot13),
        "hex_list": (r"((?:0x[0-9a-fA-F]{2}\s*,\s*){7,}0x[0-9a-fA-F]{2})", 1, lambda s: hex_text(F.regexp_replace(s, r"0x|\s|,", ""))),
    }
    parts = [
        tagged(F.regexp_extract_all(line, F.lit(p), F.lit(g)), "technique", k, "decoded", fn)
        for k, (p, g, fn) in finds.items()
    ]
    return (
        rows.where(line.rlike(r"[A-Za-z0-9+/]{16}|\\x[0-9a-fA-F]{2}|%[0-9a-fA-F]{2}|0x[0-9a-fA-F]{2}|(?iud:rot.?13)"))
        .select("file_id", "line_no", F.explode(F.concat(*parts)).alias("d"))
        .select("file_id", "line_no", F.regexp_replace("d.technique", "^rot13_.*", "rot13").alias("technique"), "d.decoded")
        .where("decoded IS NOT NULL")
        .unionByName(decoded_arrays(src))
    )


USAGE = {
    "compression": r"zlib\.decompress|gzip\.decompress|gunzip|zlib\.inflate",
    "rot13": r"rot_?13|codecs\.(?:de|en)code\([^)]*rot",
    "string_concat": r"(?:chr\(\d+\)\s*\+\s*){2,}chr\(\d+\)|['\"]ev['\"]\s*\+\s*['\"]al['\"]|['\"]ex['\"]\s*\+\s*['\"]ec['\"]|String\.fromCharCode\(",
    "bytes_literal": r"\w+\s*=\s*b['\"][A-Za-z0-9+/=]{32,}['\"]",
}


def technique_usage(f: DataFrame) -> DataFrame:
    """Files per technique whose code shows it."""
    src = for_engine(f, "deobfuscation")
    k = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in USAGE.items()]))
    return src.select("file_id", F.explode(k).alias("technique"))


def assembled_fragments(f: DataFrame) -> DataFrame:
    """``file_id, decoded``: three or more part/chunk/seg variables, joined in the order of their names, that decode as base64.

    The last assignment of a name wins.
    """
    p = r"((?:part|chunk|seg)\w*)\s*=\s*[\"']([A-Za-z0-9+/=]{4,})[\"']"
    t = F.col("text")
    names, vals = (F.regexp_extract_all(t, F.lit(p), F.lit(g)) for g in (1, 2))
    pairs = F.array_sort(F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("n"), F.element_at(F.filter(F.zip_with(names, vals, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda z: z["a"] == n), -1)["b"].alias("v"))))
    return (
        f.where(t.rlike(r"(?:part|chunk|seg)\w*\s*=\s*[\"']")).select("file_id", pairs.alias("p")).where(F.size("p") >= 3)
        .select("file_id", base64_text(F.array_join(F.transform("p", lambda x: x["v"]), "")).alias("decoded")).where("decoded IS NOT NULL")
    )


def cjk_heavy(text: Column, ext: Column) -> Column:
    share = (F.length(text) - F.length(F.regexp_replace(text, f"[{CJK}]", ""))) / F.length(text)
    return ext.isin("md", "txt") | ((F.length(text) >= 10) & (share > 0.3))


def entropy_findings(f: DataFrame) -> DataFrame:
    """``file_id, rule_id, value``: file entropy (001 critical, 002 high), suspicious lines (003 three or more: their mean; 004 exactly one)."""
    src = for_engine(f, "entropy").where(F.length("text") > 0).withColumn("heavy", cjk_heavy(F.col("text"), F.col("ext")))
    limit = lambda k: F.when(F.col("heavy"), F.lit(ENTROPY_CJK[k])).otherwise(F.lit(ENTROPY[k]))
    whole = pinned(src, "value", entropy(F.col("text"))).select("file_id", "heavy", "value")
    whole = whole.select("file_id", F.when(F.col("value") > limit(0), "ENTROPY_001").when(F.col("value") > limit(1), "ENTROPY_002").alias("rule_id"), "value").where("rule_id IS NOT NULL")
    ln = explode_lines(src.select("file_id", "heavy", "text")).withColumn("s", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).where(F.length("s") >= 20)
    # a line's entropy can't exceed the logarithm of its length
    ln = pinned(ln.where(F.log2(F.length("s")) > limit(1)), "value", entropy(F.col("s")))
    ln = ln.where((F.col("value") > limit(0)) | ((F.col("value") > limit(1)) & (F.length("s") > 50)))
    by = ln.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("value"))
    by = by.where("n <> 2").select("file_id", F.when(F.col("n") >= 3, "ENTROPY_003").otherwise("ENTROPY_004").alias("rule_id"), "value")
    return whole.unionByName(by)


def long_strings(f: DataFrame) -> DataFrame:
    """``file_id, found, value``: quoted runs of 64 characters or more whose entropy exceeds the medium threshold."""
    src = for_engine(f, "entropy").where(~F.col("name").isin(*LOCKFILES))
    found = F.regexp_extract_all("text", F.lit(r"[\"']([A-Za-z0-9+/=_\-]{64,})[\"']"), F.lit(1))
    s = src.where(F.col("text").rlike(r"[A-Za-z0-9+/=_\-]{64}")).select("file_id", F.explode(found).alias("found"))
    return pinned(s, "value", entropy(F.col("found"))).where(F.col("value") > ENTROPY[2])
