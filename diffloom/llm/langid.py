"""Hierarchical language identification: family first, then one-versus-one SVMs inside it.

Training uses a bounded sample of labelled rows (`per_language` rows of each
language at most on average and MOST_ROWS in all, at least 8 of each language,
chosen by a hash of the id); every language of the training rows is learned.
Features are hashed byte n-grams of the whole lower-cased text, made where the
texts are; one task fits the model from them, and only the weights reach the
driver.  Families of known languages are fixed values; a language not listed is
a family of its own.

Null text or text without a letter gives `und` with score 0.  Rows with null
lang teach nothing but are predicted.  No labelled row at all: every text is
`und`.  Other columns are never read.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_batches, trimmed
from .linear import bounded_sample, decision, fit_platt, fit_svms, histogram, pack_rows, sigmoid, unpack_rows

#: Language families.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "gd", "cy", "br"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "indo-iranian": ["hi", "ur", "bn", "mr", "ne", "gu", "pa", "fa", "ku", "ps"],
    "semitic": ["ar", "he", "mt", "am"],
    "sinitic": ["zh", "yue"],
}
ORDERS = (1, 2, 3)
SIZE = 1 << 13
PER_LANGUAGE, MOST_ROWS = 500, 6000


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), f"only:{lang}")


@dataclass
class Model:
    """Columns of weights: one for each family against the rest, then one for each pair in a family."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    platt: list[tuple[float, float]] = field(default_factory=list)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(column)
        if self.weights is None:
            only = [m for ms in self.members.values() for m in ms]
            return np.array([only[0] if only else "und"] * n, object), np.full(n, 1.0 if only else 0.0)
        margin = decision(column, self.weights, self.bias, ORDERS)
        prob = np.stack([sigmoid(a * margin[:, k] + b) for k, (a, b) in enumerate(self.platt)], 1)
        nf = len(self.families) if len(self.families) > 1 else 0
        if nf:
            share = prob[:, :nf] / np.maximum(prob[:, :nf].sum(1, keepdims=True), 1e-12)
            family, sure = share.argmax(1), share.max(1)
        else:
            family, sure = np.zeros(n, int), np.ones(n)
        lang, score = np.empty(n, object), np.zeros(n)
        for f, name in enumerate(self.families):
            rows, langs = np.flatnonzero(family == f), self.members[name]
            if len(langs) == 1:
                lang[rows], score[rows] = langs[0], sure[rows]
                continue
            votes = np.zeros((len(rows), len(langs)))  # one vote a pair; probabilities break ties
            for k, (owner, a, b) in enumerate(self.pairs):
                if owner == name:
                    p = prob[rows, nf + k]
                    votes[:, langs.index(a)] += (p >= 0.5) + 0.01 * p
                    votes[:, langs.index(b)] += (p < 0.5) + 0.01 * (1 - p)
            best = votes.argmax(1)
            lang[rows] = np.array(langs, object)[best]
            own = np.ones(len(rows))
            for k, (owner, a, b) in enumerate(self.pairs):
                if owner == name:
                    p = prob[rows, nf + k]
                    own = np.where(best == langs.index(a), np.minimum(own, p), np.where(best == langs.index(b), np.minimum(own, 1 - p), own))
            score[rows] = sure[rows] * own
        return lang, np.clip(score, 0, 1)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """Fit to the histograms x of a bounded number of rows."""
    known = sorted(set(langs))
    members: dict[str, list[str]] = {}
    for lang in known:
        members.setdefault(family_of(lang), []).append(lang)
    families = sorted(members)
    model = Model(families, members)
    if len(known) < 2:
        return model
    y = np.array(langs, object)
    fam = np.array([family_of(v) for v in langs], object)
    weights, bias = [], []

    def add(rows, sides: np.ndarray) -> None:
        some = x[rows]
        w, b = fit_svms(some, sides)
        margins = some @ w.astype(np.float32) + b
        model.platt.extend(fit_platt(margins[:, k], sides[:, k]) for k in range(sides.shape[1]))
        weights.append(w)
        bias.append(b)

    if len(families) > 1:
        add(slice(None), np.stack([np.where(fam == name, 1.0, -1.0) for name in families], 1))
    for name in families:
        for a, b in itertools.combinations(members[name], 2):
            rows = np.flatnonzero((y == a) | (y == b))
            add(rows, np.where(y[rows] == a, 1.0, -1.0)[:, None])
            model.pairs.append((name, a, b))
    model.weights, model.bias = np.hstack(weights), np.concatenate(bias)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fold.

    The sample's histograms, of a fixed number of places, meet in one task,
    which fits the model; its bound is most_rows, or 8 rows a language.
    """
    rows = text_batches(docs).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.filter(~held_out("id", folds, fold) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample, most, counts = bounded_sample(rows, "lang", per_language, "id", "language", most_rows)
    if not counts:
        return fit(np.zeros((0, SIZE), np.float32), [])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *pack_rows(histogram(part.column(2), ORDERS, SIZE))], ["key", "lang", "places", "filled"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if table.num_rows:
            table = table.sort_by([("key", "ascending"), ("lang", "ascending")]).combine_chunks()
            model = fit(unpack_rows(table["places"], table["filled"], SIZE), table["lang"].to_pylist())
            del table
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    key = F.concat_ws(" ", F.col("id").cast("string"), F.xxhash64("text").cast("string")).alias("key")
    made = sample.select(key, "lang", "text").mapInArrow(trimmed(features), "key string, lang string, places binary, filled binary")
    found = made.limit(most).repartition(1).mapInArrow(trimmed(learn), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(np.zeros((0, SIZE), np.float32), [])


def _identified(docs: DataFrame, model: Model, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(_id, lang_pred, score, _k0..): the prediction beside the kept columns under names of their own."""
    spread = text_batches(docs).select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"), *[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)])
    fields = [f.dataType.simpleString() for f in spread.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            lang, score = model.predict(text)
            letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang = np.where(letter, lang, "und")
            extra = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(lang == "und", 0.0, score), pa.float64()), *extra], ["_id", "lang_pred", "score", *[f"_k{i}" for i in range(len(extra))]])

    schema = f"_id {fields[0]}, lang_pred string, score double" + "".join(f", _k{i} {fields[2 + i]}" for i in range(len(keep)))
    return spread.mapInArrow(trimmed(run), schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row of docs; only the text is an input."""
    return _identified(docs, model, id_col, text_col, ()).withColumnRenamed("_id", id_col)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1) -> DataFrame:
    """(id, held_out, lang_pred, score) of each row of docs."""
    model = train(docs, id_col, text_col, lang_col, folds, fold)
    out = identify(docs, model, id_col, text_col)
    return out.select(id_col, held_out(id_col, folds, fold).alias("held_out"), "lang_pred", "score")


def accept_languages(docs: DataFrame, model: Model, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows of no learned language (`und` or a score below min_score); lang becomes the prediction.

    The columns of docs come back in their order and types.
    """
    rest = [c for c in docs.columns if c not in (id_col, lang_col)]
    out = _identified(docs, model, id_col, text_col, tuple(rest)).filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    names = {id_col: "_id", lang_col: "lang_pred"} | {c: f"_k{i}" for i, c in enumerate(rest)}
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns])
