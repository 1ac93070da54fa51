"""Text functions: strip, two tokenisers, tags and LIKE patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Blanks of any kind off both ends; trim() would only take spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def folded(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def tokens(c: Column) -> Column:
    """Lower-cased runs without blanks."""
    return F.filter(F.split(folded(c), BLANK), lambda t: t != "")


def tag_list(c: Column) -> Column:
    """Lower-cased tags: cut at commas, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.lower(strip(t))), lambda t: t != "")


def name_key(c: Column) -> Column:
    """Lower-cased, blanks collapsed: what makes two products the same."""
    return F.lower(F.regexp_replace(strip(c), BLANK, " "))


def like_literal(pattern: str) -> str:
    """A pattern in which % and _ stay wildcards and a backslash before anything but them or a backslash is itself."""
    pairs = pattern.replace("\\\\", "\0")
    return re.sub(r"\\(?![%_])", lambda m: "\\\\", pairs).replace("\0", "\\\\")


def like_pattern(c: Column) -> Column:
    """As like_literal, of a column."""
    pairs = F.replace(c, F.lit("\\\\"), F.lit("\0"))
    return F.replace(F.regexp_replace(pairs, r"\\(?![%_])", r"\\\\"), F.lit("\0"), F.lit("\\\\"))


def has(c: Column, part: str | Column) -> Column:
    """c ILIKE '%part%'. A part without wildcards becomes a plain search in the lower-cased value."""
    if isinstance(part, str):
        return F.ilike(c, F.lit(f"%{like_literal(part)}%")) if re.search(r"[%_\\]", part) else F.lower(c).contains(part.lower())
    return F.when(part.rlike(r"[%_\\]"), F.ilike(c, F.concat(F.lit("%"), like_pattern(part), F.lit("%")))).otherwise(F.lower(c).contains(F.lower(part)))
