"""Text and feature models on Spark ML, with the few corrections that match the usual conventions.

TF-IDF: idf = ln((1 + n) / (1 + df)) + 1 and unit length.  Scaling divides by
the population deviation, a constant column by 1.  Logistic regression with
C = 1 is Spark's with regParam = 1 / n and no standardisation.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a token is in patches and in issue texts.
PATCH_TOKEN = r"(?U)\b\w+\b|[+\-@=#]"
ISSUE_TOKEN = r"(?U)\b\w\w+\b"
MAX_ITER = 1000


#: Partitions of rows of a few numbers each that are fitted again and again: every task of every step reports to the driver.
FEW = 24


def few(rows: DataFrame) -> DataFrame:
    """rows of a few numbers each, made once and kept (memory, then disk) in a number of partitions that does not grow with them."""
    return rows.repartition(FEW, "patch_id").persist(StorageLevel.MEMORY_AND_DISK)


def _terms(rows: DataFrame, column: str, token: str, ngrams: int) -> DataFrame:
    """rows with their 1..ngrams token sequences in place of the text."""
    rows = RegexTokenizer(inputCol=column, outputCol="_tok", gaps=False, pattern=token, toLowercase=True).transform(rows.withColumn(column, F.coalesce(column, F.lit(""))))
    for n in range(1, ngrams + 1):
        rows = NGram(n=n, inputCol="_tok", outputCol=f"_g{n}").transform(rows)
    made = [f"_g{n}" for n in range(1, ngrams + 1)]
    return rows.withColumn("_terms", F.concat(*made)).drop("_tok", column, *made)


def _weighted(rows: DataFrame, idf: list[float], out: str) -> DataFrame:
    """Unit vectors of counts times idf; a term of weight 0 plays no part."""
    rows = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_w").transform(rows)
    return Normalizer(p=2.0, inputCol="_w", outputCol=out).transform(rows).drop("_tf", "_w")


def _idf(n: float, df: float) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def tfidf(train: DataFrame, rows: DataFrame, column: str, token: str, out: str, size: int = 5000, ngrams: int = 2, train_if: str | None = None) -> DataFrame:
    """rows, without the text, with a unit TF-IDF vector of 1..ngrams token sequences, fitted on train.

    train_if: the condition by which train was taken from rows; the counts
    then come from the vectors that are kept anyway.
    """
    seen = _terms(train, column, token, ngrams)
    model = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=size).fit(seen)
    rows = model.transform(_terms(rows, column, token, ngrams)).drop("_terms").persist(StorageLevel.MEMORY_AND_DISK)
    counted = rows.filter(train_if) if train_if else model.transform(seen)
    n, df = counted.agg(F.count(F.lit(1)), Summarizer.numNonZeros(F.col("_tf"))).first()
    return _weighted(rows, [_idf(n, k) for k in df] if n else [1.0] * len(model.vocabulary), out)


def tfidf_folds(rows: DataFrame, group: str, column: str, token: str, out: str, size: int = 5000, ngrams: int = 2):
    """rows with term counts, and prepare(value, part): part with TF-IDF vectors fitted on all rows of other groups.

    Terms are counted once by group, so the vocabulary of a fold is what the
    totals less its own group's counts rank first; equal counts go by the term.
    A vector holds the terms of all folds, those of other folds with weight 0.
    """
    rows = rows.filter(F.col(group).isNotNull())
    values = _values(rows, group)
    terms = _terms(rows, column, token, ngrams)
    by = terms.select(group, F.explode("_terms").alias("t")).groupBy("t").agg(*[F.count(F.when(F.col(group) == v, 1)).alias(f"n{i}") for i, v in enumerate(values)], F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    chosen = {v: [r[0] for r in by.select("t", (F.col("n") - F.col(f"n{i}")).alias("k")).filter("k > 0").orderBy(F.desc("k"), "t").limit(size).collect()] for i, v in enumerate(values)}
    by.unpersist()
    vocabulary = sorted(set().union(*chosen.values())) or [""]
    place = {t: i for i, t in enumerate(vocabulary)}
    rows = CountVectorizerModel.from_vocabulary(vocabulary, "_terms", "_tf").transform(terms).drop("_terms").persist(StorageLevel.MEMORY_AND_DISK)
    held = {r[0]: (r[1], r[2].toArray()) for r in rows.groupBy(group).agg(F.count(F.lit(1)), Summarizer.numNonZeros(F.col("_tf"))).collect()}  # a vector for each of the at most MOST_GROUPS groups
    n, df = sum(k for k, _ in held.values()), sum(v for _, v in held.values())

    def prepare(value, part: DataFrame) -> DataFrame:
        idf = [0.0] * len(vocabulary)
        for t in chosen[value]:
            idf[place[t]] = _idf(n - held[value][0], df[place[t]] - held[value][1][place[t]])
        return _weighted(part, idf, out)

    return rows, prepare


def scaled(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with columns centred and divided by train's population deviation (1 where constant)."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return rows.withColumns({c: (F.col(c) - F.lit(stats[f"m_{c}"] or 0.0)) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})


def stack(rows: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(rows)


def logistic(train: DataFrame, rows: DataFrame, features: str = "features", label: str = "label", c: float = 1.0) -> DataFrame:
    """rows with the probability of label 1; a training set of one class predicts its share."""
    share = train.agg(F.avg(label), F.count(F.lit(1))).first()
    if share[0] is None or share[0] in (0.0, 1.0):
        return rows.withColumn("score", F.lit(float(share[0] or 0.0)))
    model = LogisticRegression(featuresCol=features, labelCol=label, elasticNetParam=0.0, standardization=False, regParam=1.0 / (c * share[1]), maxIter=MAX_ITER)
    return model.fit(train).transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 6)).drop("rawPrediction", "probability", "prediction")


def multinomial(train: DataFrame, rows: DataFrame, label: str, features: str = "features") -> DataFrame:
    """rows with predicted class index of an integer label."""
    n = train.count()
    model = LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", elasticNetParam=0.0, standardization=False, regParam=1.0 / max(n, 1), maxIter=MAX_ITER)
    return model.fit(train).transform(rows).withColumn("predicted", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "prediction")


def coefficients(train: DataFrame, features: str = "features", label: str = "label", c: float = 1.0) -> list[float]:
    """The fitted weights of logistic(); zeros where train has one class."""
    share = train.agg(F.avg(label), F.count(F.lit(1))).first()
    width = len(train.select(vector_to_array(features).alias("v")).first()["v"])
    if share[0] in (0.0, 1.0):
        return [0.0] * width
    model = LogisticRegression(featuresCol=features, labelCol=label, elasticNetParam=0.0, standardization=False, regParam=1.0 / (c * share[1]), maxIter=MAX_ITER)
    return [float(v) for v in model.fit(train).coefficients]


#: Groups a leave-one-out run may have: each is a fit of its own, so their number must not grow with the data.
MOST_GROUPS = 200
#: Folds that are fitted beside each other.
AT_ONCE = 4


def _values(rows: DataFrame, group: str) -> list:
    values = sorted(r[0] for r in rows.select(group).distinct().limit(MOST_GROUPS + 2).collect() if r[0] is not None)
    if len(values) > MOST_GROUPS:
        raise ValueError(f"{group} has more than {MOST_GROUPS} values to leave out; put them into folds first")
    return values


def leave_one_out(rows: DataFrame, group: str, also: str | None = None, features: str = "features", prepare=None) -> DataFrame:
    """Scores of each group's rows from a model of all other groups (`also`: and of no shared value of that column).

    prepare: makes features of (group, part of rows) where they must be fitted
    on each fold's own training rows; such rows are kept by the caller.  The
    loop runs over groups, at most MOST_GROUPS; each fit is distributed.
    """
    if also:  # the groups that share the value, in one exchange for all folds; a null is shared with nobody
        shared = Window.partitionBy(also, F.when(F.col(also).isNull(), F.col("patch_id")))
        rows = rows.withColumn("_shared", F.when(F.col(also).isNotNull(), F.collect_set(group).over(shared)).otherwise(F.array()))
    if not prepare:
        rows = few(rows.select("patch_id", group, "label", features, *(["_shared"] if also else [])))

    def fold(value) -> DataFrame | None:
        test = rows.filter(F.col(group) == value)
        train = rows.filter(F.col(group) != value)
        if also:
            train = train.filter(~F.array_contains("_shared", F.lit(value)))
        classes = train.agg(F.min("label"), F.max("label")).first()
        if classes[0] == classes[1]:
            return None
        if prepare:
            train, test = prepare(value, train), prepare(value, test)
        return logistic(train, test, features).select("patch_id", "score").withColumn("fold", F.lit(str(value)))

    out = None
    with ThreadPoolExecutor(AT_ONCE) as pool:  # the steps of one fit are short and wait for each other
        for part in pool.map(inheritable_thread_target(rows.sparkSession)(fold), _values(rows, group)):
            if part is not None:
                out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.limit(0).select("patch_id", F.lit(0.0).alias("score"), F.lit("").alias("fold"))


def folds(rows: DataFrame, group: str, k: int, seed: str) -> DataFrame:
    """(group, fold): groups in k near-equal folds by md5 order."""
    names = rows.select(group).distinct()
    return names.select(group, F.ntile(k).over(Window.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string"))))).alias("fold"))


def prior(train: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows with their key's mean label in train, the global mean where unseen."""
    overall = train.agg(F.avg("label")).first()[0] or 0.0
    table = train.groupBy(key).agg(F.avg("label").alias("score"))
    return rows.join(table, key, "left").withColumn("score", F.coalesce("score", F.lit(overall)))
