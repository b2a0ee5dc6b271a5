"""Subword-lattice language model: marginal document probability over all segmentations.

The pieces are those of an existing SentencePiece vocabulary with its scores (a
piece of rank r weighs 1 / (r + 10), byte pieces come after all others).  They
are re-estimated by expectation steps over the words of the training rows: at
most `steps` of them, ended early when a tenth of the training words' uses,
set aside for that, gains less than 0.2 % of its log probability.  The final
weights keep the vocabulary's own with the share `vocabulary_share`, whatever
the size of the corpus.  A word with its leading space is a lattice over bytes: an
edge for each piece that matches and one for each single byte.  The forward
recursion in log space adds up all segmentations.  No piece crosses a space, so
a text's probability is the product over its words and one end.  Words of any
length are scored whole: those of BATCH_BYTES bytes and more one by one, with
the edges found block by block, the others together by length.

Beside the model's score stands a smoothed word-unigram base score from the
same training rows.  The word table grows with the corpus and is never
broadcast: the HEAD most frequent words (a fixed bound) travel with the code,
all other words meet the table in a shuffle join.  Words are told apart by two
independent 64-bit hashes.

Null text counts as empty: only the end is scored.  Null ids are never held
out.  Repeated rows count and are scored each.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, text_batches, trimmed
from .textscan import mix, scan

HEAD = 1 << 18
BATCH_BYTES, BLOCK = 2048, 1 << 15
GATHER_ROWS, GATHER_BYTES = 40_000, 1 << 22
STEPS, VOCABULARY_SHARE = 3, 0.05
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64
_SLOTS = 1 << 20


class Lattice:
    """Pieces as byte strings with a leading space for the word mark; ids 0..255 are single bytes."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, logp
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.sorted_keys, self.sorted_ids = keys[order], order
        self.longest = max(map(len, pieces))
        self.table = np.full(_SLOTS, -1, np.int32)
        self.table[(mix(keys) >> _U(44)).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)
        self.keys = keys
        self.shadowed = np.flatnonzero(self.table[(mix(keys) >> _U(44)).astype(np.int64)] != np.arange(len(keys)))
        self.shadow_keys, at = np.unique(keys[self.shadowed], return_index=True)
        self.shadow_ids = self.shadowed[at]
        self.crowded = np.zeros(_SLOTS, bool)  # slots that more than one piece wants
        self.crowded[(mix(self.shadow_keys) >> _U(44)).astype(np.int64)] = True

    @staticmethod
    def _key(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_P) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each key, -1 where none."""
        flat = h.ravel()
        slot = (mix(flat) >> _U(44)).astype(np.int64)
        got = self.table[slot]
        got = np.where((got >= 0) & (self.keys[got] == flat), got, -1)
        if len(self.shadow_keys):
            lost = np.flatnonzero((got < 0) & self.crowded[slot])
            spot = np.minimum(np.searchsorted(self.shadow_keys, flat[lost]), len(self.shadow_keys) - 1)
            hit = self.shadow_keys[spot] == flat[lost]
            got[lost[hit]] = self.shadow_ids[spot[hit]]
        return got.reshape(h.shape)

    def edges(self, block: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece id starting at each place of each row (or -1)."""
        out, h = [], np.zeros(block.shape, np.uint64)
        wide = block.astype(np.uint64) + _U(1)
        for n in range(1, min(self.longest, block.shape[1]) + 1):
            places = block.shape[1] - n + 1
            h = h[:, :places] * _P + wide[:, n - 1 :]
            out.append(self.find(h) if n > 1 else block.astype(np.int32))
        return out

    def forward(self, edges: list[np.ndarray], length: int) -> np.ndarray:
        """alpha[:, j]: log probability of the first j bytes over all segmentations."""
        rows = edges[0].shape[0]
        alpha = np.full((rows, length + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, length + 1):
            terms = []
            for n in range(1, min(len(edges), j) + 1):
                ids = edges[n - 1][:, j - n]
                terms.append(np.where(ids >= 0, alpha[:, j - n] + self.logp[ids], -np.inf))
            t = np.stack(terms)
            top = t.max(0)
            alpha[:, j] = top + np.log(np.exp(t - top).sum(0))
        return alpha

    def backward(self, edges: list[np.ndarray], length: int) -> np.ndarray:
        rows = edges[0].shape[0]
        beta = np.full((rows, length + 1), -np.inf)
        beta[:, length] = 0
        for i in range(length - 1, -1, -1):
            terms = []
            for n in range(1, min(len(edges), length - i) + 1):
                ids = edges[n - 1][:, i]
                terms.append(np.where(ids >= 0, beta[:, i + n] + self.logp[ids], -np.inf))
            t = np.stack(terms)
            top = t.max(0)
            beta[:, i] = top + np.log(np.exp(t - top).sum(0))
        return beta

    def _edges_of(self, word: np.ndarray) -> Iterator[tuple[int, list[list[int]]]]:
        """(first place, for each length the piece ids starting there and after) of one long word, block by block."""
        for lo in range(0, len(word), BLOCK):
            part = word[None, lo : lo + BLOCK + self.longest - 1]
            places = min(BLOCK, len(word) - lo)
            yield lo, [e[0, :places].tolist() for e in self.edges(part)]

    def sweep(self, word: np.ndarray) -> np.ndarray:
        """alpha of one long word: log probability of its first j bytes over all segmentations.

        Places pass on what has reached them, so only matching edges are touched.
        """
        n, logp, exp, log = len(word), self.logp.tolist(), math.exp, math.log
        alpha = np.empty(n + 1)
        reach: list[list[float]] = [[] for _ in range(self.longest + 1)]  # what arrives at the next places
        reach[0].append(0.0)
        for lo, edges in self._edges_of(word):
            for i in range(len(edges[0])):
                terms = reach.pop(0)
                reach.append([])
                top = max(terms)
                here = top + log(sum([exp(t - top) for t in terms])) if len(terms) > 1 else top
                alpha[lo + i] = here
                for k, ids in enumerate(edges):
                    if i < len(ids) and ids[i] >= 0:
                        reach[k].append(here + logp[ids[i]])
        top = max(reach[0])
        alpha[n] = top + log(sum(exp(t - top) for t in reach[0]))
        return alpha

    def _uses_of(self, word: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected uses of each piece in one long word, and its log probability."""
        alpha, out, exp, logp = self.sweep(word), np.zeros(len(self.pieces)), math.exp, self.logp.tolist()
        total, n = float(alpha[-1]), len(word)
        beta = [0.0] * self.longest  # beta of the places after the present one
        beta[1:] = [-math.inf] * (self.longest - 1)
        for lo in reversed(range(0, n, BLOCK)):
            places = min(BLOCK, n - lo)
            ids = [e[0].tolist() for e in self.edges(word[None, lo : lo + BLOCK + self.longest - 1])]
            for i in range(places - 1, -1, -1):
                terms = []
                for k, at in enumerate(ids):
                    if i < len(at) and at[i] >= 0 and beta[k] > -math.inf:
                        t = beta[k] + logp[at[i]]
                        terms.append(t)
                        out[at[i]] += exp(alpha[lo + i] + t - total)
                top = max(terms)
                beta.insert(0, top + math.log(sum([exp(t - top) for t in terms])))
                beta.pop()
        return out, total

    def score(self, words: pa.Array) -> np.ndarray:
        """Log probability (natural) of each word, all segmentations added up."""
        out = np.zeros(len(words))
        for rows, block in blocks(words):
            out[rows] = self.sweep(block[0])[-1] if block.shape[1] > BATCH_BYTES else self.forward(self.edges(block), block.shape[1])[:, -1]
        return out

    def expected(self, words: pa.Array, *counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Expected uses of each piece when each word occurs `counts` times, for each of the counts, and the words' log probabilities."""
        out, total = [np.zeros(len(self.pieces)) for _ in counts], np.zeros(len(words))
        for rows, block in blocks(words):
            if block.shape[1] > BATCH_BYTES:
                uses, total[rows] = self._uses_of(block[0])
                for o, c in zip(out, counts):
                    o += uses * c[rows[0]]
                continue
            edges, length = self.edges(block), block.shape[1]
            alpha, beta = self.forward(edges, length), self.backward(edges, length)
            total[rows] = alpha[:, -1]
            for n, ids in enumerate(edges, 1):
                row, at = np.nonzero(ids >= 0)
                hit = ids[row, at]
                p = np.exp(alpha[row, at] + self.logp[hit] + beta[row, at + n] - alpha[row, -1])
                for o, c in zip(out, counts):
                    o += np.bincount(hit, p * c[rows][row], len(o))
        return out, total


def blocks(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, bytes) of the words with their leading space, grouped by length; those of BATCH_BYTES bytes and more alone."""
    from .textscan import buffers

    data, offsets = buffers(words)
    size = np.diff(offsets)
    for length in np.unique(size[size < BATCH_BYTES]).tolist():
        rows = np.flatnonzero(size == length)
        step = max(1, 40_000 // (length + 1))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            block = np.full((len(some), length + 1), 0x20, np.uint8)
            block[:, 1:] = data[offsets[some][:, None] + np.arange(length)]
            yield some, block
    for row in np.flatnonzero(size >= BATCH_BYTES):
        yield np.array([row]), np.concatenate([[np.uint8(0x20)], data[offsets[row] : offsets[row + 1]]])[None]


def gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHER_ROWS, size: int = GATHER_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches put together to about `rows` rows or `size` bytes: words are grouped by length, and small groups cost as much as large ones."""
    held, n, b = [], 0, 0
    for batch in batches:
        held, n, b = [*held, batch], n + batch.num_rows, b + batch.nbytes
        if n >= rows or b >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, b = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a SentencePiece model (256 single bytes first) and their starting log weights."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks: dict[bytes, float] = {bytes([b]): float("inf") for b in range(256)}
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or "▁" in text[1:]:
            continue
        raw = text.replace("▁", " ").encode()
        ranks[raw] = min(ranks.get(raw, float("inf")), -model.get_score(i))
    last = max(r for r in ranks.values() if r != float("inf"))
    weight = np.array([1 / ((last + 1 if r == float("inf") else r) + 10) for r in ranks.values()])
    return list(ranks), np.log(weight / weight.sum())


def word_table(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """(h, g, word, c, dev, seen): every distinct word of the corpus with its training count, the part of it set aside, and its count in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train, aside = (batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (1, 2))
            keys, others, counts, flats, sizes = [], [], [], [], []
            for part in scan(batch.column(0), limit=1 << 21):
                h, g = part.hashes(), part.hashes(1)
                key, at, back = np.unique(h ^ mix(g), return_index=True, return_inverse=True)
                use = [np.repeat(flags[part.lo : part.hi], part.counts) for flags in (train, aside)]
                counts.append(np.stack([np.bincount(back, u, len(key)).astype(np.int64) for u in use] + [np.bincount(back, minlength=len(key))]))
                keys.append(h[at])
                others.append(g[at])
                start, size = part.start[at], (part.end - part.start)[at]
                total = np.cumsum(size)
                flats.append(part.data[np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)])
                sizes.append(size)
            if not keys or not sum(map(len, keys)):
                continue
            h, g, size, flat = (np.concatenate(x) for x in (keys, others, sizes, flats))
            start = np.cumsum(size) - size
            _, at, back = np.unique(h ^ mix(g), return_index=True, return_inverse=True)
            sums = [np.bincount(back, c).astype(np.int64) for c in np.concatenate(counts, axis=1)]
            start, size = start[at], size[at]
            total = np.cumsum(size)
            text = flat[np.repeat(start - (total - size), size) + np.arange(total[-1])]
            offsets = np.concatenate([[0], total]).astype(np.int64)
            words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(g[at].view(np.int64)), words, *map(pa.array, sums)], ["h", "g", "word", "c", "dev", "seen"])

    learned = ~held_out("id", folds, fold)
    aside = F.pmod(F.xxhash64(F.lit("aside"), F.col("id").cast("string"), "text"), F.lit(10)) == 0
    rows = docs.select("text", learned.alias("train"), (learned & aside).alias("aside"))
    words = rows.mapInArrow(trimmed(run), "h long, g long, word binary, c long, dev long, seen long")
    return words.groupBy("h", "g", "word").agg(F.sum("c").alias("c"), F.sum("dev").alias("dev"), F.sum("seen").alias("seen"))


def train(words: DataFrame, ends: int, path: str, steps: int = STEPS, vocabulary_share: float = VOCABULARY_SHARE) -> tuple[Lattice, float, list[float]]:
    """Re-estimated lattice, the end's log probability, and the log probability (natural) of the words set aside before each step.

    A step is one pass over the word table; what reaches the driver is one row for each piece at most.
    """
    pieces, start = vocabulary(path)
    base, logp, final, uses, seen = np.exp(start), start, start, np.zeros(len(pieces)), []
    for _ in range(steps):

        def run(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            lattice, all_uses, part_uses, gain = Lattice(vocabulary(path)[0], logp), 0.0, 0.0, 0.0
            for batch in gathered(batches):
                c, dev = (batch.column(k).to_numpy().astype(float) for k in (1, 2))
                (every, part), total = lattice.expected(batch.column(0), c, c - dev)
                all_uses, part_uses, gain = all_uses + every, part_uses + part, gain + float((total * dev).sum())
            if isinstance(all_uses, np.ndarray):
                used = np.flatnonzero(all_uses)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(all_uses[used], gain)), pa.array(np.append(part_uses[used], 0.0))], ["piece", "uses", "part"])

        got = words.filter("c > 0").select("word", "c", "dev").mapInArrow(trimmed(run), "piece int, uses double, part double").groupBy("piece").agg(F.sum("uses").alias("uses"), F.sum("part").alias("part")).collect()
        uses, part = np.zeros(len(pieces)), np.zeros(len(pieces))
        gain = 0.0
        for row in got:
            if row["piece"] < 0:
                gain = row["uses"]
            else:
                uses[row["piece"]], part[row["piece"]] = row["uses"], row["part"]
        seen.append(gain)
        if not uses.sum():
            break
        whole = lambda n: (1 - vocabulary_share) * n / max(n.sum(), 1e-300) + vocabulary_share * base
        final = np.log(whole(uses))
        if len(seen) > 1 and not seen[-1] > seen[-2] * 0.998:
            break
        logp = np.log(whole(part)) if part.sum() else final
    tokens = float(uses.sum())
    end = (ends + 0.1) / (tokens + ends + 0.1)
    return Lattice(pieces, final + np.log(1 - end) if tokens else final), float(np.log(end)), seen


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words seen so often that at most `most` are; found from counts by size class, without a sort."""
    size = F.floor(F.log2("seen") * 16)
    left, least = most, None
    for row in words.filter("seen > 0").groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("size")).collect():
        left -= row["k"]
        if left < 0:
            break
        least = row["size"]
    return words.filter(F.lit(False)) if least is None else words.filter((F.col("seen") > 0) & (size >= least))


def score_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, head: int = HEAD) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs."""
    rows = text_batches(docs).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    words = cut(word_table(rows, folds, fold))
    ends = rows.filter(~held_out("id", folds, fold)).count()
    sums = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n_train, distinct = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    lattice, end_logp, _ = train(words, ends, path)
    logp = lattice.logp

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Lattice(vocabulary(path)[0], logp)
        for batch in gathered(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(scorer.score(batch.column(2)) / np.log(10))], ["h", "g", "c", "seen", "lp"])

    scored = cut(words.select("h", "g", "word", "c", "seen").mapInArrow(trimmed(score_words), "h long, g long, c long, seen long, lp double"))
    top = frequent(scored, head).toArrow()
    order = np.argsort(top["h"].to_numpy())
    head_h, head_g, head_c, head_lp = (top[k].to_numpy()[order] for k in ("h", "g", "c", "lp"))
    floor = n_train + 0.5 * (distinct + 1)
    base_of = lambda c: np.log10((c + 0.5) / floor)
    head_base = base_of(head_c)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in scan(batch.column(1)):
                h, g, rows_n = part.hashes().view(np.int64), part.hashes(1).view(np.int64), part.hi - part.lo
                row = np.repeat(np.arange(rows_n), part.counts)
                spot = np.minimum(np.searchsorted(head_h, h), max(len(head_h) - 1, 0))
                hit = (head_h[spot] == h) & (head_g[spot] == g) if len(head_h) else np.zeros(len(h), bool)
                use, where = spot[hit], row[hit]
                sums = [np.bincount(where, v, rows_n) if len(use) else np.zeros(rows_n) for v in (head_base[use], head_lp[use], head_c[use] > 0)]
                rest, counts = pa.StructArray.from_arrays([pa.array(h[~hit]), pa.array(g[~hit])], ["h", "g"]), np.bincount(row[~hit], minlength=rows_n)
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), rest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows_n), pa.array(part.counts.astype(np.int64)), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), tail], ["id", "n", "known", "base", "lp", "tail"])
                at += rows_n

    split = cut(rows.mapInArrow(trimmed(parts), f"id {kind}, n long, known long, base double, lp double, tail array<struct<h:long,g:long>>").withColumn("row", F.monotonically_increasing_id()))
    looked = split.select("row", F.inline("tail")).join(scored.select("h", "g", "c", F.col("lp").alias("word_lp")), ["h", "g"])
    looked = looked.select("row", F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("n"), (F.col("c") > 0).cast("long").alias("known"), F.log10((F.col("c") + 0.5) / F.lit(float(floor))).alias("base"), F.col("word_lp").alias("lp"))
    whole = split.select("row", "id", "n", "known", "base", "lp").unionByName(looked)
    out = whole.groupBy("row").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in ("n", "known", "base", "lp")])
    end_base, end_score = float(base_of(ends)), end_logp / np.log(10)
    return out.select(
        F.col("id").alias(id_col),
        held_out("id", folds, fold).alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + end_base).alias("base_score"),
        (F.col("lp") + float(end_score)).alias("score"),
    )
