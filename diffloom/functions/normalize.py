"""Text normalisation and decoding that Spark has no built-in for, in Arrow batches."""

from __future__ import annotations

import base64
import binascii
import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules
from .needs import possible

_CONTROLS = re.compile(rules.CONTROLS)
#: Combining characters, the usual ones first: a class with any above FFFF is slow.
_ACCENTS = re.compile("[\u0300-\u034e\u0350-\u036f]+")
_MARKS = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.combining(c)) + "]+")
_RARE_MARKS = re.compile("[" + "".join(c for c in map(chr, range(0x10000, sys.maxunicode + 1)) if unicodedata.combining(c)) + "]+")
_FOLD = str.maketrans(rules.HOMOGLYPH_PAIRS)
_FOLDED = re.compile("[" + "".join(rules.HOMOGLYPH_PAIRS) + "]")
_LEET = str.maketrans(rules.LEET)
#: For plain ASCII one table does what _CONTROLS does, with or without the digits.
_ASCII = {c: None for c in range(128) if _CONTROLS.match(chr(c))}
_ASCII_LEET = _ASCII | _LEET
_BASE64 = re.compile(rules.BASE64)
_INJECTIONS = [re.compile(p, re.IGNORECASE) for _, p, _ in rules.INJECTIONS]
_COMMENT = re.compile(rules.COMMENT, re.DOTALL)


def _folded(text: str) -> str:
    """What both forms share: entities resolved, invisible characters and accents gone, lower case, look-alikes folded."""
    text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _CONTROLS.sub("", text))
        for marks in (_ACCENTS, _MARKS, _RARE_MARKS):
            if text.isascii():
                break
            if marks is not _RARE_MARKS or max(text) > "\uffff":
                text = marks.sub("", text)
    if text.isascii():
        return text.lower().translate(_ASCII)
    text = text.lower()
    return text.translate(_FOLD) if _FOLDED.search(text) else text


def _form(folded: str, leet: bool) -> str:
    """The form that is scanned: white space single, digits read as letters where asked for."""
    if leet:
        if folded.isascii():
            folded = folded.translate(_ASCII_LEET)
        else:
            for digit, letter in rules.LEET.items():
                folded = folded.replace(digit, letter)
    return " ".join(folded.split())


def normalized(text: str | None, leet: bool = False) -> str:
    """Entities resolved, invisible characters and accents gone, lower case, look-alikes folded, white space single."""
    return _form(_folded(text or ""), leet)


def decoded(text: str | None) -> list[str]:
    """Readable payloads of base64 candidates; a candidate may run across white space."""
    out = []
    for found in _BASE64.findall(text or ""):
        packed = "".join(found.split())
        if len(packed) >= 16:
            try:
                plain = base64.b64decode(packed).decode("utf-8", "ignore")
            except (binascii.Error, ValueError):
                continue
            if len(plain) >= 8 and any(map(str.isalpha, plain)):
                out.append(plain)
    return out


def embedded(text: str | None) -> list[str]:
    """Bodies of HTML and markdown comments, in order."""
    if not text or ("<!--" not in text and "[//]:" not in text):
        return []
    bodies = (a or b for a, b in _COMMENT.findall(text))
    return [b.strip() for b in bodies if b]


def variants(text: str | None) -> list[tuple[str, str]]:
    """(kind, normalised text): raw and leet forms of the text, its payloads and its comments."""
    sources = [("", text)] + [("b64", t) for t in decoded(text)] + [("comment", t) for t in embedded(text)]
    out = []
    for kind, t in sources:
        folded = _folded(t or "")
        out.append((kind or "raw", _form(folded, False)))
        out.append((f"{kind}_leet" if kind else "leet", _form(folded, True)))
    return [(k, n) for k, n in out if n]


_POSSIBLE = [possible(p) for _, p, _ in rules.INJECTIONS]


def _dotted(norm: str) -> str:
    return norm if norm.isascii() else norm.replace("\u0131", "i")


def suspects(text: str | None) -> list[tuple[int, int, int, str]]:
    """(place among the text's variants, pattern, line, norm) of the variants that a pattern may match.

    line: the first whose own normalised form matches the pattern, else 1.
    """
    out, lines, folded, before = [], {}, [], None
    for vord, (kind, norm) in enumerate(variants(text)):
        if norm == before:  # a leet form like its plain one finds the same, and later
            continue
        seen, leet, before = _dotted(norm), kind.endswith("leet"), norm
        for number, may in enumerate(_POSSIBLE):
            if may(seen):
                if leet not in lines:
                    folded = folded or [_folded(line) for line in (text or "").splitlines()]
                    lines[leet] = [_form(line, leet) for line in folded]
                at = (i for i, line in enumerate(lines[leet], 1) if line and may(_dotted(line)) and _INJECTIONS[number].search(line))
                out.append((vord, number, next(at, 1), norm))
    return out


#: Rows of texts that are looked at before what was found in them goes on.
_AT_ONCE = 256


def suspect_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """suspects() of the last column, each with the row's other columns."""
    for batch in batches:
        for start in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(start, _AT_ONCE)
            found = [(i, *s) for i, text in enumerate(part.column(part.num_columns - 1).to_pylist()) for s in suspects(text)]
            if not found:
                continue
            row, vord, number, line, norm = zip(*found)
            kept = part.take(pa.array(row, pa.int32()))
            made = [pa.array(vord, pa.int32()), pa.array(number, pa.int32()), pa.array(line, pa.int32()), pa.array(norm, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *made], [*batch.schema.names[:-1], "vord", "pattern", "line", "norm"])


@F.pandas_udf(T.StringType())
def normalize_udf(texts: pd.Series) -> pd.Series:
    return texts.map(normalized, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalize_leet_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: normalized(t, True), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def base64_udf(texts: pd.Series) -> pd.Series:
    return texts.map(decoded)


@F.pandas_udf(T.ArrayType(T.StructType().add("kind", T.StringType()).add("norm", T.StringType())))
def variants_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"kind": k, "norm": n} for k, n in variants(t)])
