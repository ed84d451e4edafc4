"""Path and digest normalisation shared by the change operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column, backslashes: bool = False) -> Column:
    r"""Drop ``./`` segments (leading or inner); optionally turn ``\`` into ``/``."""
    p = F.replace(path, F.lit("\\"), F.lit("/")) if backslashes else path
    return F.regexp_replace(p, r"(^|(?<=/))(?:\./+)+", "")


def clean_dir(path: Column) -> Column:
    """Drop trailing slashes."""
    return F.regexp_replace(path, r"(?<=.)/+$", "")
