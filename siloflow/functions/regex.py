"""Pattern matching with code-point offsets, as column expressions.

Java counts UTF-16 units, so offsets never come from its matcher: matches and the gaps between them
are cut out as strings, and their lengths in code points are added up. Patterns must not match the
empty string. DIALECT makes Java read character classes, cases and line ends as Unicode does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIALECT = "(?Ud)"
FOUND = "array<struct<start:int,end:int,text:string>>"


def _compiled(pattern: str | Column) -> Column:
    return F.lit(DIALECT + pattern) if isinstance(pattern, str) else F.concat(F.lit(DIALECT), pattern)


def matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """The text of every match (or of one group of it), in order."""
    return F.regexp_extract_all(text, _compiled(pattern), F.lit(group))


def found(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,end,text>> of every match, zero-based, end exclusive; null text has none."""
    pairs = F.zip_with(
        matches(text, pattern),
        F.split(text, _compiled(pattern), -1),
        lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("m")),
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text")))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out")))

    return F.coalesce(F.aggregate(pairs, empty, step, lambda acc: acc["out"]), F.array().cast(FOUND))


def found_group(text: Column, pattern: str, group: int) -> Column:
    """Like ``found`` for a group that ends where the match ends."""
    whole = found(text, pattern)
    return F.zip_with(
        whole,
        F.coalesce(matches(text, pattern, group), F.array().cast("array<string>")),
        lambda w, g: F.struct((w["end"] - F.length(g)).alias("start"), w["end"].alias("end"), g.alias("text")),
    )


def whole(text: Column, pattern: str) -> Column:
    """Whether the pattern matches the whole text."""
    return text.rlike(f"{DIALECT}\\A(?:{pattern})\\z")


def has(text: Column, pattern: str) -> Column:
    return text.rlike(DIALECT + pattern)


def n_digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def cut_out(text: Column, start: Column, end: Column) -> Column:
    """The code points from start to end, zero-based, end exclusive."""
    return F.substring(text, start + 1, end - start)
