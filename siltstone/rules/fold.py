"""Fold a rule pack into one projection, with a literal gate before it; and the pack as SQL.

Patterns are literals in the plan, so each is compiled once a task. A file is
searched with a pattern only if it holds one of the literals without which the
pattern can't match (found from the pattern's own syntax); the gate costs one
substring search a literal and changes no result.
"""

from __future__ import annotations

import re
import re._parser as sre
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 32
JAVA = "(?iud)"


def needed(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match of the pattern holds at least one; None if there are none to name."""

    def walk(seq) -> list[str] | None:
        best: list[str] | None = None
        run = ""

        def offer(c: list[str] | None) -> None:
            nonlocal best
            if c and (best is None or min(map(len, c)) > min(map(len, best))):
                best = c

        for op, arg in [*seq, (None, None)]:
            if op is sre.LITERAL and chr(arg).isascii():
                run += chr(arg).lower()
                continue
            if run:
                offer([run])
            run = ""
            if op is sre.SUBPATTERN:
                offer(walk(arg[3]))
            elif op is sre.BRANCH:
                parts = [walk(b) for b in arg[1]]
                offer([x for p in parts for x in p] if all(parts) else None)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                offer(walk(arg[2]))
        return best if best and min(map(len, best)) >= 2 else None

    return walk(sre.parse(pattern))


def folded(text: Column) -> Column:
    """Lower case, with the two letters that case folding maps to ASCII."""
    return F.translate(F.lower(text), "\u017f\u212a", "sk")


def literal(v: object) -> str:
    """A value as Spark SQL; packs are folded as text, as building them call by call takes seconds."""
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(v)


def gate(low: str, patterns: list[str]) -> Column:
    """Numbers of the patterns that may match a text; ``low`` names a column that holds it as ``folded``."""
    parts = []
    for k, p in enumerate(patterns):
        n = needed(p)
        parts.append(f"{k}" if n is None else "CASE WHEN " + " OR ".join(f"contains({low}, {literal(x)})" for x in n) + f" THEN {k} END")
    return F.expr(chunks(parts))


def chunks(parts: list[str]) -> str:
    arrays = [f"array_compact(array({', '.join(parts[i : i + CHUNK])}))" for i in range(0, len(parts), CHUNK)]
    return arrays[0] if len(arrays) == 1 else f"concat({', '.join(arrays)})"


def hits(line: str, patterns: list[str], flags: str = JAVA) -> Column:
    """Numbers of the patterns that match the line of that name, in order."""
    return F.expr(chunks([f"CASE WHEN rlike({line}, {literal(flags + p)}) THEN {k} END" for k, p in enumerate(patterns)]))


def first_hit(line: str, patterns: list[str], flags: str = JAVA) -> Column:
    """Number of the first pattern that matches, null if none does."""
    return F.expr("CASE " + " ".join(f"WHEN rlike({line}, {literal(flags + p)}) THEN {k}" for k, p in enumerate(patterns)) + " END")


def pick(values: list, ix: str) -> Column:
    return F.expr(f"element_at(array({', '.join(literal(v) for v in values)}), {ix} + 1)")


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


# --- SQL


def quote(s: object) -> str:
    return "'" + s.replace("'", "''") + "'" if isinstance(s, str) else str(s)


def re2(p: str) -> str:
    return p.replace("(?<![a-zA-Z0-9_])", "(?:^|[^a-zA-Z0-9_])")


def looks_around(p: str) -> bool:
    """Whether RE2 has no such pattern, so that SQL can't hold it."""
    return re.search(r"\(\?<?[=!]", re2(p)) is not None


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A CTE of literal rows."""
    body = ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"
