"""Pattern spans in texts with built-in expressions only.

Java's matcher gives the texts between matches (split) and the matches themselves (extract all);
running sums of their lengths give each match's place, in code points. Patterns must not match
the empty string. They are written so that the matcher neither recurses nor rescans a long run:
possessive repeats where nothing later could need what they took, and a look-behind that lets a
run be tried at its front or right after the match before only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A kind of span: its regular expression, and what a match must also satisfy."""

    kind: str
    regex: str | Column
    passes: Callable[[Column], Column] | None = None
    #: A plain expression that is false for most texts without a match; None tries all texts.
    hint: Callable[[Column], Column] | None = None


_SPAN = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"


def spans_of(text: Column, pattern: Pattern) -> Column:
    """The spans of a pattern: structs of start, end (exclusive), kind and value, in order."""
    regex = F.lit(pattern.regex) if isinstance(pattern.regex, str) else pattern.regex
    between = F.split(text, regex, F.lit(-1))
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    step = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda gap, value: (F.length(gap) + F.length(value)).cast("long"))
    # Only numbers are carried along, so many matches in one text stay cheap.
    ends = F.aggregate(step, F.array(F.lit(0).cast("long")), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    placed = F.zip_with(F.slice(ends, F.lit(2), F.size(matches)), matches, lambda end, value: F.struct(
        (end - F.length(value)).alias("start"), end.alias("end"), F.lit(pattern.kind).alias("kind"), value.alias("value")))
    nothing = F.array().cast(_SPAN)
    kept = F.filter(placed, lambda s: pattern.passes(s["value"])) if pattern.passes else placed
    return F.when(pattern.hint(text), kept).otherwise(nothing) if pattern.hint else kept


def joined(spans: Column, order: tuple[str, ...]) -> Column:
    """``kind:start:end`` of each span by start, then kind as in ``order``, comma-joined."""
    rank = F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
