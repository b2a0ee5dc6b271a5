"""Token-id files in Simple-8b word-aligned coding.

Each 64-bit word carries a selector in its top four bits and, in the lower 60,
as many ids of one width as the selector says; an id of more than 60 bits is an
escape: its word points into a list of raw values kept beside the payload.  Ids
are cut into blocks of BLOCK ids whose word offsets are kept, so that blocks
decode on their own and a decoder handles all words of one selector at once.

The file format is a Parquet container with one row for each segment (whole
documents of about SEGMENT ids): shard, segment, shard_start, n_ids, doc_ids,
doc_lens, block_offsets, escapes, payload.  Spark's commit protocol writes it,
so a lost executor never leaves half a shard behind.  Documents are in
ascending id order over shards, segments and within a segment (null ids first).
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, text_batches, trimmed
from .textscan import same_words, scan

#: (values in a word, bits of each), by selector; selector 15 is the escape.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
BLOCK = 16384
SEGMENT = 1 << 16
_U = np.uint64


_SHORT = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    if len(values) and values.max() < 1 << 16:
        return _SHORT[values.astype(np.int64)]
    out = np.zeros(len(values), np.uint8)
    left = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = left >= (_U(1) << _U(step))
        out[big] += step
        left[big] >>= _U(step)
    return out + (left > 0)


def _pack_block(values: np.ndarray, escapes: list[int]) -> np.ndarray:
    """Words of one block: the greedy choice takes the selector of most values at each place."""
    n = len(values)
    bits = _bits(values)
    best = np.full(n, ESCAPE, np.uint8)
    take = np.ones(n, np.int64)
    widest, width = bits, 1  # widest[i]: most bits of the next `width` values
    for selector in range(len(SELECTORS) - 1, -1, -1):
        count, size = SELECTORS[selector]
        while width < count:
            step = min(width, count - width)
            if len(widest) <= step:
                widest = widest[:0]
            else:
                widest = np.maximum(widest[:-step], widest[step:])
            width += step
        fits = np.flatnonzero(widest <= size)
        if not len(fits):  # nor does any selector of more values and fewer bits
            break
        best[fits] = selector
        take[fits] = count
    jumps, at, i = take.tolist(), [], 0
    while i < n:
        at.append(i)
        i += jumps[i]
    at = np.array(at, np.int64)
    chosen = best[at]
    words = chosen.astype(np.uint64) << _U(60)
    for selector in np.unique(chosen):
        rows = np.flatnonzero(chosen == selector)
        if selector == ESCAPE:
            words[rows] |= np.arange(len(escapes), len(escapes) + len(rows), dtype=np.uint64)
            escapes.extend(values[at[rows]].tolist())
            continue
        count, size = SELECTORS[selector]
        got = values[at[rows][:, None] + np.arange(count)]
        words[rows] |= np.bitwise_or.reduce(got << (np.arange(count, dtype=np.uint64) * _U(size)), axis=1)
    return words


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[int], list[int]]:
    """Payload, word offset of each block, and escaped values of an id sequence."""
    values = np.ascontiguousarray(values, np.uint64)
    words, offsets, escapes, total = [], [], [], 0
    for lo in range(0, len(values), block):
        part = _pack_block(values[lo : lo + block], escapes)
        offsets.append(total)
        words.append(part)
        total += len(part)
    return (np.concatenate(words) if words else np.zeros(0, np.uint64)).astype("<u8").tobytes(), offsets, escapes


def unpack(payload: bytes, escapes=(), first_word: int = 0, last_word: int | None = None) -> np.ndarray:
    """The ids of the words first_word..last_word; block offsets give those of a block."""
    words = np.frombuffer(payload, "<u8")[first_word:last_word]
    selector = (words >> _U(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS] + [1, 1])[selector] if len(words) else np.zeros(0, np.int64)
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    low = words & ((_U(1) << _U(60)) - _U(1))
    for k in np.unique(selector):
        rows = np.flatnonzero(selector == k)
        if k == ESCAPE:
            out[start[rows]] = np.array(escapes, np.uint64)[low[rows].astype(np.int64)]
            continue
        count, size = SELECTORS[k]
        mask = (_U(1) << _U(size)) - _U(1)
        out[start[rows][:, None] + np.arange(count)] = (low[rows][:, None] >> (np.arange(count, dtype=np.uint64) * _U(size))) & mask
    return out


def unpack_blocks(payload: bytes, escapes, offsets) -> Iterator[np.ndarray]:
    """The ids of each block in turn; a block's words are all that is decoded at a time."""
    for lo, hi in zip(offsets, [*offsets[1:], len(payload) // 8]):
        yield unpack(payload, escapes, lo, hi)


class WordEncoder:
    """Ids of whole texts from a tokenizer that drops white space and never joins text across it.

    Such a tokenizer gives the text's ids as the ids of its white-space words
    in order, so each distinct word goes through the library once; a bounded
    table keeps the words seen so far, with their bytes, which every hit is
    compared with.  Texts that may hold one of the tokenizer's added tokens
    (their first two characters stand in it), or two different words of one
    hash, go through the library whole.
    """

    def __init__(self, tokenizer, keep: int = 2_000_000):
        self.tokenizer, self.keep = tokenizer, keep
        pieces = tokenizer.get_vocab(with_added_tokens=False)
        self.marks = sorted({t.content[:2] for t in tokenizer.get_added_tokens_decoder().values()})
        self.ends = np.zeros(max(pieces.values()) + 1, bool)
        self.ends[[i for t, i in pieces.items() if t.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.first, self.size, self.at, self.length = (np.zeros(0, np.int64) for _ in range(4))
        self.ids = np.zeros(0, np.uint32)
        self.bytes = np.zeros(0, np.uint8)

    def _rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter((i for r in rows for i in r), np.uint32, int(size.sum())), size

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters only: each is one unit with one end mark, so one call does."""
        flat = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        edge = np.flatnonzero(self.ends[flat]) + 1
        if len(edge) != len(words) or edge[-1] != len(flat):
            return self._rows(words)
        return flat, np.diff(np.concatenate([[0], edge]))

    def _learn(self, key: np.ndarray, words: list[bytes]) -> None:
        """key: sorted new keys, words: their bytes in that order."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = np.fromiter((w.isalpha() for w in texts), bool, len(texts))
        size, first = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        known, new = len(self.ids), [self.ids]
        for rows, make in ((np.flatnonzero(plain), self._letters), (np.flatnonzero(~plain), self._rows)):
            for lo in range(0, len(rows), 4096):
                some = rows[lo : lo + 4096]
                flat, n = make([texts[i] for i in some])
                size[some], first[some] = n, known + np.cumsum(n) - n
                new.append(flat)
                known += len(flat)
        self.ids = np.concatenate(new)
        length = np.fromiter(map(len, words), np.int64, len(words))
        at = len(self.bytes) + np.cumsum(length) - length
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        spot = np.searchsorted(self.key, key)
        self.key = np.insert(self.key, spot, key)
        self.first, self.size = np.insert(self.first, spot, first), np.insert(self.size, spot, size)
        self.at, self.length = np.insert(self.at, spot, at), np.insert(self.length, spot, length)

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids of each row) for runs of rows."""
        marked = np.zeros(len(column), bool)
        for mark in self.marks:
            marked |= pc.fill_null(pc.match_substring(column, mark), False).to_numpy(zero_copy_only=False)
        for part in scan(column, lower=False, limit=1 << 21):
            h, length = part.hashes(), part.end - part.start
            key, at, back = np.unique(h, return_index=True, return_inverse=True)
            spot = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
            missing = self.key[spot] != key if len(self.key) else np.ones(len(key), bool)
            if missing.any():
                full = len(self.key) + int(missing.sum()) > self.keep
                if full:  # the table starts anew, with this run's words
                    self._reset()
                    missing[:] = True
                self._learn(key[missing], [part.data[part.start[i] : part.end[i]].tobytes() for i in at[missing].tolist()])
                spot = np.searchsorted(self.key, key)
            of = spot[back]
            first, size = self.first[of], self.size[of]
            total = np.cumsum(size)
            ids = self.ids[np.repeat(first - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]
            edge = np.concatenate([[0], total])[part.first_word()]
            other = np.flatnonzero(~same_words(part.data, part.start, length, self.bytes, self.at[of], self.length[of]))
            whole = marked[part.lo : part.hi].copy()
            whole[np.searchsorted(part.first_word(), other, "right") - 1] = True
            if whole.any():
                rows = [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                for i in np.flatnonzero(whole).tolist():
                    rows[i] = self._rows([column[part.lo + i].as_py() or ""])[0]
                ids, edge = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            yield ids, np.diff(edge)


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    from tokenizers import Tokenizer

    return WordEncoder(Tokenizer.from_file(path))


_SCHEMA = "shard int, segment int, shard_start long, n_ids long, doc_ids array<long>, doc_lens array<long>, block_offsets array<int>, escapes array<long>, payload binary"
_ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("block_offsets", pa.list_(pa.int32())), ("escapes", pa.list_(pa.int64())), ("payload", pa.binary())])


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenize whole texts, append end_id to each document and write the files in ascending id order.

    Null texts are empty and hold only end_id.  Rows of one id stay together,
    ordered by text.  The ids are the library's with add_special_tokens=False:
    an added token that stands in a text counts as the one id the library gives.
    """
    source = text_batches(docs).select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        ids, lens, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, before, held
            payload, offsets, escapes = pack(np.concatenate(parts))
            row = {"shard": shard, "segment": segment, "shard_start": before, "n_ids": held, "doc_ids": list(ids), "doc_lens": list(lens), "block_offsets": offsets, "escapes": escapes, "payload": payload}
            segment, before, held = segment + 1, before + held, 0
            ids.clear(), lens.clear(), parts.clear()
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            names, row = batch.column(0).to_pylist(), 0
            for flat, sizes in encoder.encode(batch.column(1)):
                at = 0
                for size in sizes.tolist():
                    parts.append(np.append(flat[at : at + size], np.uint32(end_id)))
                    ids.append(names[row])
                    lens.append(size + 1)
                    held += size + 1
                    at, row = at + size, row + 1
                    if held >= SEGMENT:
                        yield flush()
        if held:
            yield flush()

    files = source.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(trimmed(run), _SCHEMA)
    files.write.mode("overwrite").parquet(out)
    return out


def read_token_files(spark, out: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, token_ids]) of each document, decoded from the files.

    start counts the ids of all documents before it; the shards' totals (one
    number for each file) are added up on the driver.
    """
    files = spark.read.schema(_SCHEMA).parquet(out)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    bases, total = [], 0
    for row in totals:
        bases.append((row["shard"], total))
        total += row["n"]
    base = F.broadcast(spark.createDataFrame(bases, "shard int, base long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.concatenate([np.zeros(0, np.uint64), *unpack_blocks(row["payload"], row["escapes"], row["block_offsets"])])
                lens = np.array(row["doc_lens"], np.int64)
                edge = np.concatenate([[0], np.cumsum(lens)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(edge[:-1] + row["shard_start"] + row["base"]), pa.array(lens), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(edge[:-1], edge[1:])], pa.list_(pa.int64())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", token_ids array<long>" if keep_ids else "")
    return files.join(base, "shard").select("doc_ids", "doc_lens", "block_offsets", "escapes", "payload", "shard_start", "base").mapInArrow(trimmed(run), schema)


def round_trip(docs: DataFrame, path: str, out: str | None = None, **options) -> DataFrame:
    """Write the token files of docs (by default below the shared folder) and read them back."""
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return read_token_files(spark, write_token_files(docs, path, out, **options))
