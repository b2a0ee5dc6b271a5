"""Quality classification by co-training two views.

The content view sees only the text (hashed byte n-grams and text statistics);
the metadata view sees only source, language and length.  In each round both
classifiers score every row that has no label, anywhere in the table; each
passes the `exchange` rows of each class it is surest of, of all rows, to the
other as training rows (rows of one margin, such as copies, count once).  At
the end both are calibrated on held-back labelled rows and their calibrated
log-odds are added (the prior's once): the views are taken as independent given
the class.

Labelled rows are a bounded sample (`per_class`, a parameter); rows that have a
label are never passed on.  Features are made where the texts are, one task
fits both views from them, and only weights and the ids passed on reach the
driver.  Scoring covers every row and whole texts.  Null or empty text scores
by what the features of an empty text say; rows of null id are scored too but
never passed on; null labels are no labels; a table without labels of both
classes gives every row the share of good labels (0.5 without any).  Of
repeated labels of an id the largest counts; of several texts of a labelled id
each is learned.  Other columns are never read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_ids, cut, text_batches, trimmed
from .linear import bounded_sample, decision, fit_logistic, fit_platt, histogram, pack_rows, sigmoid, unpack_rows
from .textscan import scan

ORDERS = (2, 3)
SIZE = 1 << 12
STATS = 10
META = 256
PER_CLASS, ROUNDS, EXCHANGE, SURE = 1200, 3, 60, 0.9


def text_statistics(column: pa.Array) -> np.ndarray:
    """Ten numbers about each whole text, most of them shares."""
    out = np.zeros((len(column), STATS), np.float32)
    for part in scan(column, limit=1 << 19):
        n = part.hi - part.lo
        rows = np.repeat(np.arange(n), part.counts)
        h = part.hashes()
        size = (part.end - part.start).astype(np.float64)
        words = np.maximum(part.counts, 1)
        length = np.maximum(np.diff(part.bounds), 1)
        byte_row = np.repeat(np.arange(n), np.diff(part.bounds))
        share = lambda flags: np.bincount(byte_row, flags, n) / length
        data = part.data
        letters = ((data >= 97) & (data <= 122)) | (data >= 128)
        symbols = (data > 32) & ~letters & ~((data >= 48) & (data <= 57))
        order = np.lexsort((h, rows))
        new = np.ones(len(h), bool)
        if len(h):
            new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
        unique = np.bincount(rows[order], new, n)
        again = np.zeros(len(h), bool)
        if len(h) > 1:
            again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        mean = np.bincount(rows, size, n) / words
        values = [unique / words, np.bincount(rows, again, n) / words, mean / 10, np.bincount(rows, size > 20, n) / words, share(letters), share(symbols), share((data >= 48) & (data <= 57)), share(data == 10) * 10, np.log1p(part.counts) / 8, part.counts < 30]
        out[part.lo : part.hi] = np.stack(values, 1)
    return out


def content_features(column: pa.Array) -> np.ndarray:
    return np.hstack([histogram(column, ORDERS, SIZE), text_statistics(column)])


def meta_slots(source: list, lang: list, chars: list) -> np.ndarray:
    """Hashed slots of source, language, their pair, and the length's power of two."""
    import zlib

    rows = []
    for s, g, c in zip(source, lang, chars):
        size = -1 if c is None else int(np.log2(max(c, 0) + 1))
        keys = (f"s:{s}", f"l:{g}", f"c:{size}", f"sc:{s}:{size // 2}")
        rows.append([zlib.crc32(k.encode()) % META for k in keys])
    return np.array(rows, np.int64).reshape(-1, 4)


def meta_features(slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(slots), META), np.float32)
    np.add.at(out, (np.arange(len(slots))[:, None], slots), 1)
    return out


@dataclass
class CoTrained:
    """Both views' weights, offsets and calibrations, and how many rows the rounds passed on."""

    prior: float
    views: list[tuple] = field(default_factory=list)
    exchanged: list[int] = field(default_factory=list)

    def margins(self, text: pa.Array, source: list, lang: list, chars: list) -> tuple[np.ndarray, np.ndarray]:
        (cw, cb, _, _), (mw, mb, _, _) = self.views
        content = decision(text, cw[:SIZE, None], np.array([cb]), ORDERS)[:, 0] + text_statistics(text) @ cw[SIZE:]
        return content, mw[meta_slots(source, lang, chars)].sum(1) + mb

    def combine(self, margins: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        probs = [np.clip(sigmoid(a * m + b), 1e-6, 1 - 1e-6) for m, (_, _, a, b) in zip(margins, self.views)]
        prior = np.clip(self.prior, 1e-3, 1 - 1e-3)  # each view's odds hold the prior; it counts once
        odds = sum(np.log(p / (1 - p)) for p in probs) - (len(probs) - 1) * np.log(prior / (1 - prior))
        return sigmoid(odds), probs


def fit_views(views: list[np.ndarray], y: np.ndarray, held: np.ndarray, given: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
    """(weights, offset, calibration) of each view from its labelled rows that aren't held back and the rows passed to it.

    All rows passed on weigh half as much together as the labelled rows of a class.
    """
    if any(len(set(y[m].tolist())) < 2 for m in (held, ~held)):
        held = np.zeros(len(y), bool)
    check = held if held.any() else np.ones(len(y), bool)
    t, out = y[~held], []
    weight = np.where(t > 0, 0.5 / max((t > 0).sum(), 1), 0.5 / max((t == 0).sum(), 1))
    for x, (extra, labels) in zip(views, given):
        w, b = fit_logistic(np.vstack([x[~held], extra]), np.concatenate([t, labels]), np.concatenate([weight, np.full(len(labels), 0.25 / max(len(labels), 1))]))
        out.append((w, b, *fit_platt(x[check] @ w + b, np.where(y[check] > 0, 1, -1))))
    return out


def surest(margin: np.ndarray, most: int, sure: float = SURE) -> list[tuple[float, np.ndarray]]:
    """For labels 1 and 0: the rows of the `most` largest (smallest) margins that are sure enough, one row for each margin."""
    least = math.log(sure / (1 - sure))
    out = []
    for label, m in ((1.0, margin), (0.0, -margin)):
        _, first = np.unique(-np.round(m, 6), return_index=True)
        first = first[:most]
        out.append((label, first[m[first] >= least]))
    return out


def _inputs(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """(id, text, source, lang, chars)"""
    text = docs[text_col].cast("string")
    return text_batches(docs).select(docs[id_col].alias("id"), text.alias("text"), docs[source_col].cast("string").alias("source"), docs[lang_col].cast("string").alias("lang"), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("chars"))


def _plain(batch: pa.RecordBatch, at: int) -> list:
    """Text, source, language and length, which stand from column `at` on."""
    return [batch.column(at), *[batch.column(at + k).to_pylist() for k in (1, 2, 3)]]


def _featured(rows: DataFrame) -> DataFrame:
    """rows (key, role, y, held, text, source, lang, chars) with both views' features in place of the last four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text, *meta = _plain(part, 4)
                slots = pa.array(list(meta_slots(*meta)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(4)], *pack_rows(content_features(text)), slots], ["key", "role", "y", "held", "places", "filled", "slots"])

    return rows.select("key", "role", "y", "held", "text", "source", "lang", "chars").mapInArrow(trimmed(run), "key string, role int, y double, held boolean, places binary, filled binary, slots array<long>")


def _fit(rows: DataFrame) -> list[tuple]:
    """fit_views in one task, from featured rows of role -1 (labelled), 0 or 1 (passed to that view)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if table.num_rows:
            table = table.sort_by([("role", "ascending"), ("key", "ascending")])
            views = [unpack_rows(table["places"], table["filled"], SIZE + STATS), meta_features(np.array(table["slots"].to_pylist()))]
            role, y, held = (table[c].to_numpy() for c in ("role", "y", "held"))
            lab = role < 0
            fitted = fit_views([x[lab] for x in views], y[lab], held[lab].astype(bool), [(x[role == k], y[role == k]) for k, x in enumerate(views)])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted)], pa.binary())], ["model"])

    return pickle.loads(rows.repartition(1).mapInArrow(trimmed(run), "model binary").collect()[0]["model"])


def _candidates(pool: DataFrame, model: CoTrained, most: int, sure: float) -> DataFrame:
    """(view, label, margin, key): each task's surest rows; the surest of all are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [{}, {}]  # margin -> key
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column(0).to_pylist(), object)
            order = np.argsort(keys, kind="stable")  # of equal margins the smallest key is taken, however rows are dealt
            keys = keys[order]
            for k, margin in enumerate(model.margins(*_plain(batch, 1))):
                margin = np.round(margin[order], 6)
                for _, rows in surest(margin, most, sure):
                    for r in rows.tolist():
                        m, key = float(margin[r]), keys[r]
                        kept[k][m] = min(key, kept[k].get(m, key))
                if len(kept[k]) > 8 * most:
                    order = sorted(kept[k])
                    kept[k] = {m: kept[k][m] for m in {*order[:most], *order[-most:]}}
        rows = [(k, m, key) for k in (0, 1) for m, key in kept[k].items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=pa.schema([("view", pa.int32()), ("margin", pa.float64()), ("key", pa.string())]))

    return pool.select("key", "text", "source", "lang", "chars").mapInArrow(trimmed(run), "view int, margin double, key string")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", per_class: int = PER_CLASS, rounds: int = ROUNDS, exchange: int = EXCHANGE, sure: float = SURE) -> CoTrained:
    """Fit on about per_class labelled rows of each class; every round looks through all unlabelled rows."""
    rows = _inputs(docs, id_col, text_col, source_col, lang_col)
    rows = rows.withColumn("key", F.concat_ws(" ", F.col("id").cast("string"), F.xxhash64("text", "source", "lang").cast("string")))
    known = labels.select(labels[id_col].alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    known = cut(known)
    sample, most, counts = bounded_sample(known, "y", per_class, "id", "labelled")
    total = sum(counts.values())
    if len(counts) < 2:
        return CoTrained(counts.get(1, 0) / total if total else 0.5)
    chosen = F.broadcast(sample.limit(most).withColumnRenamed("id", "_id"))  # at most 4 * per_class rows
    labelled = rows.join(chosen, rows["id"] == chosen["_id"]).dropDuplicates(["key"])
    held = F.pmod(F.xxhash64(F.lit("held"), F.col("id").cast("string")), F.lit(4)) == 0
    taught = cut(_featured(labelled.withColumn("role", F.lit(-1)).withColumn("y", F.col("y").cast("double")).withColumn("held", held)))
    share = taught.agg(F.avg("y").alias("p"), F.min("y").alias("a"), F.max("y").alias("b")).first()
    if share["a"] == share["b"]:
        return CoTrained(counts.get(1, 0) / total)
    pool = by_ids(rows.filter("id is not null"), known.select("id"), "id", "left_anti")
    model, given = CoTrained(share["p"]), [set(), set()]
    for _ in range(rounds):
        model.views = _fit(taught)
        most = exchange + max(map(len, given))
        found = cut(_candidates(pool, model, most, sure))
        least, passed = math.log(sure / (1 - sure)), []
        for k in (0, 1):
            for label, sign in ((1.0, 1), (0.0, -1)):
                once = found.filter((F.col("view") == k) & (F.col("margin") * sign >= least)).groupBy("margin").agg(F.min("key").alias("key"))
                best = once.orderBy(F.col("margin") * -sign).limit(most).collect()
                new = [r["key"] for r in best if r["key"] not in given[1 - k]][:exchange]
                given[1 - k].update(new)
                passed += [(key, 1 - k, label) for key in new]
        model.exchanged.append(len(passed))
        if not passed:
            break
        chosen = F.broadcast(docs.sparkSession.createDataFrame(passed, "_key string, role int, y double"))
        taught = cut(taught.union(_featured(rows.join(chosen, rows["key"] == chosen["_key"]).dropDuplicates(["key", "role"]).withColumn("held", F.lit(False)))))
    model.views = _fit(taught)
    return model


def score_quality(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(id, content_score, meta_score, score, good) of each row of docs, all scores in 0..1."""
    rows = _inputs(docs, id_col, text_col, source_col, lang_col).withColumnRenamed("id", "_id")
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if model.views:
                score, (content, meta) = model.combine(model.margins(*_plain(batch, 1)))
            else:
                score = content = meta = np.full(batch.num_rows, model.prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.float64()), pa.array(meta, pa.float64()), pa.array(score, pa.float64()), pa.array(score >= 0.5, pa.bool_())], ["_id", "content_score", "meta_score", "score", "good"])

    return rows.mapInArrow(trimmed(run), f"_id {kind}, content_score double, meta_score double, score double, good boolean").withColumnRenamed("_id", id_col)
