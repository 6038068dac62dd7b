"""Running values, unions of spans and replacement inside a row, in Spark's own functions.

Spark's array functions carry no state but ``aggregate``'s, and an array that grows
inside ``aggregate`` is copied at each step. Everything here goes by blocks of :data:`BLOCK`
values or :data:`CHUNK` characters, so what is copied at each step is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a running block.
BLOCK = 256
#: Code points of a piece that a text is cut into.
CHUNK = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """The running ``op`` over an array of ints, each value included; ``zero`` is its neutral value."""

    def grown(xs: Column, first: Column) -> Column:
        """first, then the running values from it: one more than xs has."""
        return F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def by_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), op))
        pairs = F.arrays_zip(blocks.alias("block"), F.slice(grown(totals, F.lit(zero)), 1, F.size(blocks)).alias("first"))
        return F.flatten(F.transform(pairs, lambda p: F.slice(grown(p["block"], p["first"]), 2, F.size(p["block"]))))

    def cut(xs: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        return F.transform(places, lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))

    return let(values, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(let(cut(xs), by_blocks)))


def joined_spans(spans: Column) -> Column:
    """Spans (structs with kind, start, end) by start, those that overlap made one, with the first one's kind."""
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    def union(s: Column, tops: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(tops, i - 1)))

        def one(firsts: Column) -> Column:
            last = lambda k: F.coalesce(F.get(firsts, k + 1), F.size(s)) - 1
            return F.transform(firsts, lambda i, k: F.struct(F.get(s, i)["start"].alias("start"), F.get(tops, last(k)).alias("end"), F.get(s, i)["kind"].alias("kind")))

        return let(opens, one)

    def whole(s: Column) -> Column:
        tops = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), 0)
        return F.when(F.size(s) > 0, let(tops, lambda t: union(s, t))).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))

    return let(F.array_sort(order), whole)


def overlay(text: Column, spans: Column, fill: Callable[[Column], Column]) -> Column:
    """``text`` with each of its disjoint, ordered spans replaced by ``fill(span)``."""

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        """Code points a to b: of one chunk, or the end of one, whole ones and the start of another."""
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        head = F.substring(F.get(chunks, i), a % CHUNK + 1, F.lit(CHUNK))
        tail = F.coalesce(F.substring(F.get(chunks, j), F.lit(1), b % CHUNK), F.lit(""))
        across = F.concat(head, F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), tail)
        return F.when(b <= a, F.lit("")).when(i == j, F.substring(F.get(chunks, i), a % CHUNK + 1, b - a)).otherwise(across)

    def put(chunks: Column, xs: Column) -> Column:
        from_ = lambda k: F.coalesce(F.get(xs, k - 1)["end"], F.lit(0))
        parts = F.transform(xs, lambda x, k: F.concat(piece(chunks, from_(k), x["start"]), fill(x)))
        return F.concat(F.array_join(parts, ""), piece(chunks, from_(F.size(xs)), F.length(text)))

    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return let(cut, lambda chunks: let(spans, lambda xs: put(chunks, xs)))
