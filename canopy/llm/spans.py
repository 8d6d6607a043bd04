"""Places of matches and cut texts as column expressions, at a cost that stays near the length of the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256  # numbers that one step appends to an array
CHUNK = 4096  # characters of a piece that cut() looks into


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running totals of an array of numbers from 0 up, by blocks: an array that grows by one costs its length each time."""
    none = F.expr("cast(array() as array<int>)")

    def run(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        step = lambda s, x: bind(combine(s["at"], x), lambda at: F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out")))
        return F.aggregate(part, start, step, lambda s: s["out"])

    def blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))

        def joined(p: Column) -> Column:
            totals = F.transform(p, lambda part: F.aggregate(part, F.lit(0), combine))
            before = run(F.concat(F.array(F.lit(0)), totals), F.lit(0))
            return F.flatten(F.zip_with(p, F.slice(before, F.lit(1), F.size(p)), run))

        return bind(parts, joined)

    return bind(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(none))


def positions(text: Column, pattern: str | Column, near: int = 0) -> Column:
    """array<struct<start, end, found, before, after>> of the pattern's matches from left to right.

    before and after: the text between this match and its neighbours, at most `near` characters of it.
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.struct(F.regexp_extract_all(text, rx, F.lit(0)).alias("found"), F.split(text, rx, -1).alias("between"))

    def placed(s: Column) -> Column:
        sizes = F.transform(s["found"], lambda f, i: F.length(f) + F.length(F.get(s["between"], i)))

        def one(end: Column, i: Column) -> Column:
            found = F.get(s["found"], i)
            sides = [F.right(F.get(s["between"], i), F.lit(near)).alias("before"), F.left(F.get(s["between"], i + 1), F.lit(near)).alias("after")] if near else []
            return F.struct((end - F.length(found)).alias("start"), end.alias("end"), found.alias("found"), *sides)

        return F.transform(scan(sizes), one)

    return bind(parts, placed)


def chunked(text: Column) -> Column:
    """The text in pieces of CHUNK characters, for cut()."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda i: F.substring(text, i * CHUNK + 1, F.lit(CHUNK)))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from start up to end, from chunked()."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor((end - 1) / CHUNK).cast("int")
    return F.when(end > start, F.substring(F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(0))), ""), start - first * CHUNK + 1, end - start)).otherwise(F.lit(""))
