"""Byte-level BPE encoding and decoding with the tiktoken library.

Ranks come from a local file.  Texts longer than `piece_chars` are first cut at
safe boundaries, where the split pattern always begins a new match, so the ids
are those of the whole text: where a run of white space begins (no match goes
from other characters into white space), and before a punctuation mark after a
letter or digit of a large script (no match goes from letters or digits into
marks).  A run of RUN_CHARS white-space characters and more, on which the
library's matcher would exhaust its stack, is matched here by its known rule:
all of it at the end of the text, all but its last character before something
else; the match then goes through the library's merges.  A stretch without
such a boundary stays whole.  Ids decode to raw bytes.

Null texts count as empty: no ids, and the hashes of no bytes.  Repeated rows
each give a row; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, trimmed

#: White space as the split pattern knows it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTER = "A-Za-z0-9\\u00c0-\\u00d6\\u00d8-\\u00f6\\u0400-\\u0481\\u05d0-\\u05ea\\u0620-\\u063f\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3"
MARK = "!-&(-/:-@\\[-`{-~\\u3001\\u3002\\uff01\\uff0c\\uff1a\\uff1b\\uff1f"
SAFE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[{LETTER}])(?=[{MARK}])")
PIECE_CHARS, RUN_CHARS = 1 << 16, 1 << 12
RUN = re.compile(f"[{WHITE}]{{{RUN_CHARS},}}")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tokenizer of a rank file, loaded once in each Python worker."""
    import tiktoken

    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text at safe boundaries into parts of about `size` characters."""
    lo = 0
    while len(text) - lo > size:
        cut = SAFE.search(text, lo + size - 1)
        if cut is None:
            break
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:] if lo else text


def _encode_piece(enc, text: str) -> list[int]:
    """Ids of a piece whose long white-space runs are matched here."""
    out, at = [], 0
    for run in RUN.finditer(text):
        if run.start() > at:
            out += enc.encode_ordinary(text[at : run.start()])
        at = run.end() if run.end() == len(text) else run.end() - 1
        out += enc._encode_single_piece(text[run.start() : at])
    return out + enc.encode_ordinary(text[at:]) if at < len(text) else out


def encode(enc, text: str | None, size: int = PIECE_CHARS) -> list[int]:
    if not text:
        return []
    if len(text) <= min(size, PIECE_CHARS):
        return enc.encode_ordinary(text)
    return [i for part in pieces(text, size) for i in _encode_piece(enc, part)]


def decode(enc, ids: list[int]) -> bytes:
    return enc.decode_bytes(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep: tuple[str, ...] = (), piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(id, keep, n_tokens, ids_sha256, decoded_sha256, round_trip[, token_ids]) of each row of docs.

    round_trip tells that the decoded bytes are those of the text.
    """
    source = text_batches(docs).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)])
    kinds = [f.dataType.simpleString() for f in source.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, coded, back, same, kept = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = encode(enc, text, piece_chars)
                    raw = decode(enc, ids)
                    packed = np.array(ids, "<u4")
                    n.append(len(ids))
                    coded.append(hashlib.sha256(packed.tobytes()).hexdigest())
                    back.append(hashlib.sha256(raw).hexdigest())
                    same.append(raw == (text or "").encode("utf-8"))
                    if keep_ids:
                        kept.append(packed.astype(np.int32))
                columns = [part.column(0), *[part.column(2 + i) for i in range(len(keep))], pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())]
                names = ["id", *[f"_k{i}" for i in range(len(keep))], "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kinds[0]}" + "".join(f", _k{i} {kinds[2 + i]}" for i in range(len(keep)))
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + (", token_ids array<int>" if keep_ids else "")
    out = source.mapInArrow(trimmed(run), schema)
    return out.select(F.col("id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[c for c in out.columns if c != "id" and not c.startswith("_k")])
