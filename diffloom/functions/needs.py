"""Cheap necessary conditions of patterns: strings that their own literals put into every match.

A pattern's text decides, so a changed rule changes its condition with it.  All
strings are lower case, and so must be what is tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from os.path import commonprefix
from re import _constants as op
from re import _parser as parser

#: What counts as i or s without regard to case and is no i or s in lower case; the last is a dotted capital I, lowered.
ODD_CASE = ("\u0131", "\u017f", "i\u0307")


def _needed(parts, literal: str = "") -> list:
    """What a match of a parsed pattern, with `literal` before it, must hold, all of it: strings, and tuples of such lists of which one is enough."""
    out = []
    for kind, value in [*parts, (None, None)]:
        if kind is op.LITERAL:
            literal += chr(value).lower()
            continue
        # A group goes on with the literal that stands right before it.
        if kind is op.BRANCH:
            ways = tuple(_needed(way, literal) for way in value[1])
            out += [ways] if all(ways) else [literal] if literal else []
        elif kind is op.SUBPATTERN:
            out += _needed(value[3], literal)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            out += _needed(value[2], literal)
        elif literal:
            out.append(literal)
        literal = ""
    return out


def _long(needed: list) -> list:
    """Without strings of one or two characters, which are in almost any text."""
    out = []
    for part in needed:
        if isinstance(part, str):
            out += [part] if len(part) > 2 else []
        elif all(ways := tuple(map(_long, part))):
            out.append(ways)
    return out


def _shortest(part) -> int:
    return len(part) if isinstance(part, str) else min(max(map(_shortest, way)) for way in part)


def _condition(needed: list) -> str:
    """Python source of the test, rarer (longer) strings first."""
    said = lambda part: f"{part!r} in t" if isinstance(part, str) else "(" + " or ".join(_condition(way) for way in part) + ")"
    return "(" + " and ".join(said(part) for part in sorted(needed, key=_shortest, reverse=True)) + ")" if needed else "True"


def possible(pattern: str) -> Callable[[str], bool]:
    """A test that every lower-case text passes which the pattern matches, whatever the engine; letters of ODD_CASE must be folded."""
    return eval(f"lambda t: {_condition(_long(_needed(parser.parse(pattern))))}")  # noqa: S307  made from our own patterns


def _one_of(needed: list) -> set[str]:
    """Strings of which every match holds one at least."""
    best = max(needed, key=_shortest)
    return {best} if isinstance(best, str) else set().union(*map(_one_of, best))


def may_match(d, col: str, patterns: Iterable[str]) -> str:
    """SQL: false only for text that none of the patterns matches; the text is lowered once and scanned for plain strings."""
    has = lambda text: f"contains(l, {d.text(text)})"
    strings, rare = set(ODD_CASE), set()
    for pattern in patterns:
        needed = _needed(parser.parse(pattern))
        if not _long(needed):
            return "true"
        chosen = _one_of(_long(needed))
        if len(shared := commonprefix(sorted(chosen))) > 4:
            chosen = {shared}
        if min(map(len, chosen)) > 3:
            strings |= chosen
        else:  # short words are part of others: the pattern's single characters must be there, too
            rare.add("(" + " and ".join(["(" + " or ".join(map(has, sorted(chosen))) + ")", *(has(s) for s in sorted({s for s in needed if isinstance(s, str)} - chosen))]) + ")")
    strings = {s for s in strings if not any(o in s and o != s for o in strings)}
    return f"exists(array(lower({col})), l -> {' or '.join([*map(has, sorted(strings)), *sorted(rare)])})"
