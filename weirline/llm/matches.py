"""Positions of all matches of a pattern, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int>>"


def match_spans(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points, end exclusive.

    What stands between matches comes from ``split``, the matches themselves from
    ``regexp_extract_all``; their lengths add up to positions. ``keep`` is an array
    of booleans, one per match. Texts without a match take one look at the pattern.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(matches, gaps, lambda m, g: F.struct(g.alias("gap"), F.length(m).alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(state: Column, step: Column) -> Column:
        begin = state["at"] + step["gap"]
        end = begin + step["size"]
        span = F.struct(begin.alias("start"), end.alias("end"))
        grown = F.when(step["size"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span)))
        return F.struct(F.coalesce(end, state["at"]).alias("at"), grown.cast(SPANS).alias("spans"))

    spans = F.aggregate(steps, start, add, lambda state: state["spans"])
    if keep is not None:
        spans = F.transform(
            F.filter(F.arrays_zip(spans.alias("span"), keep.alias("kept")), lambda s: s["kept"]), lambda s: s["span"]
        )
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))
