"""Spans of regular-expression matches as native column expressions.

Offsets are code points, ends exclusive.  A match's end is the length of all
pieces between the matches (the text split at the pattern) and of all matches
up to it: a running sum, built by doubling, so n matches take n log n steps.
Patterns must not match the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "struct<start:int,end:int,value:string>"
EMPTY = f"cast(array() as array<{FIELDS}>)"
#: Characters kept before a match where its surroundings are wanted.
BEFORE = 40
AROUND = "struct<start:int,end:int,value:string,before:string,after:string>"


def quoted(pattern: str) -> str:
    """A regular expression as a Spark SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Doublings of a running fold: enough for 2**27 elements.
DOUBLINGS = 27


def running(array: str, fields: str, combine: str) -> str:
    """SQL for the running fold of an array of structs.

    Element i becomes the fold of elements 0..i under the associative
    `combine`, an expression of y (earlier) and x (later), either struct of
    `fields`; each doubling combines every element with the one 2**k before it.
    """
    shifted = "concat(array_repeat(cast(null as " + fields + "), shiftleft(1, k)), slice(a, 1, size(a) - shiftleft(1, k)))"
    return f"aggregate(sequence(0, {DOUBLINGS}), {array}, (a, k) -> case when shiftleft(1, k) < size(a) then zip_with(a, {shifted}, (x, y) -> case when y is null then x else {combine} end) else a end)"


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once and names it in `body`."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def span_sql(text: str, pattern: str, gate: str | None = None, around: bool = False) -> str:
    """SQL for array<struct<start, end, value>> of the leftmost non-overlapping matches in the column `text`.

    `gate` is a cheap pattern found in every text that has a match; texts
    without it skip the scan.  `around` adds before and after: the last BEFORE
    characters between the last match and this one, and the character after it
    ('' at the text's end or where the next match begins).
    """
    p, kind = quoted(pattern), AROUND if around else FIELDS
    pieces = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, v) -> named_struct('g', g, 'v', v))"
    if around:
        found = let(pieces, "q", f"zip_with(q, slice(q, 2, size(q)), (m, f) -> named_struct('start', 0, 'end', char_length(m.g) + char_length(m.v), 'value', m.v, 'before', right(m.g, {BEFORE}), 'after', left(f.g, 1)))")
    else:
        found = f"transform({pieces}, m -> named_struct('start', 0, 'end', char_length(m.g) + char_length(m.v), 'value', m.v))"
    rest = ", 'before', {0}.before, 'after', {0}.after" if around else ""
    ends = running(f"filter({found}, m -> m.value is not null)", kind, f"named_struct('start', 0, 'end', x.end + y.end, 'value', x.value{rest.format('x')})")
    made = f"transform({ends}, m -> named_struct('start', m.end - char_length(m.value), 'end', m.end, 'value', m.value{rest.format('m')}))"
    return f"case when {text} rlike {quoted(gate or pattern)} then {made} else cast(array() as array<{kind}>) end"


def apart(spans: str, others: list[str], fields: str = FIELDS) -> str:
    """SQL for those of the `spans` that overlap none of the other arrays' spans, by start.

    All are sorted together; a running largest end of the others before and a
    running smallest start of those after decide, in n log n steps.
    """
    kind = f"struct<start:int,end:int,top:int,next:int,span:{fields}>"
    ours = f"transform({spans}, m -> named_struct('start', m.start, 'end', m.end, 'top', -1, 'next', {2**31 - 1}, 'span', m))"
    theirs = [f"transform({o}, m -> named_struct('start', m.start, 'end', m.end, 'top', m.end, 'next', m.start, 'span', cast(null as {fields})))" for o in others]
    every = f"array_sort(concat({', '.join([ours, *theirs])}), (a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1 else 0 end)"
    ahead = running(every, kind, "named_struct('start', x.start, 'end', x.end, 'top', greatest(x.top, y.top), 'next', x.next, 'span', x.span)")
    back = running(f"reverse({ahead})", kind, "named_struct('start', x.start, 'end', x.end, 'top', x.top, 'next', least(x.next, y.next), 'span', x.span)")
    # A span of the others with the same start stands before or after; both sides tell of it, as no span is empty.
    free = f"transform(filter(reverse({back}), m -> m.span is not null and m.top <= m.start and m.next >= m.end), m -> m.span)"
    none = " and ".join(f"size({o}) = 0" for o in others)
    return f"case when size({spans}) = 0 or ({none}) then {spans} else {free} end"


def joined(spans: str, kind: str) -> str:
    """SQL for the strings kind:start:end of an array of spans."""
    return f"transform({spans}, m -> concat('{kind}:', m.start, ':', m.end))"


def expr(sql: str) -> Column:
    return F.expr(sql)
