"""Positions of pattern matches with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POSITIONS = "array<struct<start:int,end:int>>"
_CHUNK = 64


def matches(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, match), in code points, end exclusive.

    The stretches between the matches and the matches themselves are read off in turn;
    their lengths add up to the positions. The pattern must not match the empty string.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    between = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.arrays_zip(between.alias("gap"), found.alias("match"))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,match:string>>>").alias("done"), none.alias("chunk"))

    def add(state, pair):  # in chunks, so that no long list is copied for each match
        begin = state["at"] + pair["gap"]
        end = begin + F.length(pair["match"])
        item = F.array(F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("match")))
        full = F.size(state["chunk"]) >= _CHUNK
        return F.struct(end.alias("at"), F.when(full, F.concat(state["done"], F.array(state["chunk"]))).otherwise(state["done"]).alias("done"),
                        F.when(full, item).otherwise(F.concat(state["chunk"], item)).alias("chunk"))

    walked = F.aggregate(F.slice(pairs, 1, F.size(found)), start, add, lambda state: F.concat(F.flatten(state["done"]), state["chunk"]))
    return F.when(F.size(found) > 0, walked).otherwise(none)


def described(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")
