"""Metrics on tiny arrays and against plain Python."""

import math
import random

import pytest

from diffloom.operators import learn, metrics

SCHEMA = "model string, id long, instance_id long, submission string, label int, score double"


def scored(spark, rows):
    return spark.createDataFrame([("m", i, g, "s", y, float(p)) for i, (g, y, p) in enumerate(rows)], SCHEMA)


def pair_auc(rows):
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_counts_pairs(spark):
    rng = random.Random(3)
    rows = [(i % 7, rng.randint(0, 1), rng.randint(0, 9) / 10) for i in range(120)]
    df = scored(spark, rows).cache()
    assert metrics.roc_auc(df).first().auc == pytest.approx(pair_auc([(y, p) for _, y, p in rows]), abs=1e-8)
    groups = [[(y, p) for i, y, p in rows if i == k] for k in range(7)]
    own = [pair_auc(g) for g in groups if len({y for y, _ in g}) == 2]
    got = metrics.within_auc(df).first()
    assert (got.n_instances, got.within_auc) == (len(own), pytest.approx(sum(own) / len(own), abs=1e-8))
    ordered = sorted(enumerate(rows), key=lambda r: (-r[1][2], r[0]))
    tp = fp = 0
    pos, best, first = sum(y for _, y, _ in rows), 0.0, None
    neg = len(rows) - pos
    for _, (_, y, _) in ordered:
        tp, fp = tp + y, fp + 1 - y
        if fp <= 0.05 * neg:
            best = tp / (tp + fp)
        if first is None and tp >= 0.8 * pos:
            first = 100 * fp / len(rows)
    assert metrics.precision_at_fpr(df).first().precision == pytest.approx(best)
    assert metrics.fp_per_100_at_recall(df).first().fp_per_100 == pytest.approx(first)


def test_within_auc_skips_single_class(spark):
    df = scored(spark, [(1, 1, 0.9), (1, 0, 0.1), (2, 1, 0.5), (2, 1, 0.4)])
    row = metrics.within_auc(df).first()
    assert (row.within_auc, row.n_instances) == (1.0, 1)
    empty = metrics.within_auc(scored(spark, [(1, 1, 0.5)])).first()
    assert (empty.within_auc, empty.n_instances) == (0.0, 0)
    assert metrics.precision_at_fpr(scored(spark, [(1, 1, 0.5)])).first().precision == 0.0
    assert metrics.fp_per_100_at_recall(scored(spark, [(1, 1, 0.5)])).first().fp_per_100 == 0.0


@pytest.mark.parametrize(("k", "n", "low", "high"), [(21, 36, 42.20, 72.86), (22, 36, 44.86, 75.22), (5, 14, 16.34, 61.24), (1, 16, 1.11, 28.33), (0, 37, 0.0, 9.41), (186, 5123, 3.15, 4.18), (0, 0, 0.0, 0.0)])
def test_wilson(spark, k, n, low, high):
    row = metrics.wilson(spark.createDataFrame([(k, n)], "k long, n long")).first()
    assert (round(100 * row.ci_low, 2), round(100 * row.ci_high, 2)) == (low, high)


def test_classification_zero_division(spark):
    row = metrics.classification(scored(spark, [(1, 1, 0.1), (1, 0, 0.1)])).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.5, 0.0, 0.0, 0.0)


def test_average_precision(spark):
    df = scored(spark, [(1, 1, 0.9), (1, 0, 0.8), (1, 1, 0.7), (1, 0, 0.1)])
    assert metrics.pr_auc(df).first().ap == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_tfidf_weights(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a c")], "patch_id long, t string")
    out = learn.tfidf(rows, rows, "t", r"\w+", "v", size=10, ngrams=1).orderBy("patch_id").collect()
    a, b = math.log(3 / 3) + 1, math.log(3 / 2) + 1
    assert sorted(round(x, 6) for x in out[0].v.toArray() if x) == sorted(round(x / math.hypot(a, b), 6) for x in (a, b))


def test_scaling_leaves_constants(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert sorted((r.x, r.y) for r in learn.scaled(rows, rows, ["x", "y"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_bootstrap_on_resampled_rows(spark):
    """Against the same md5 draws in plain Python, rows repeated as often as their instance is drawn."""
    import hashlib

    rng = random.Random(11)
    rows = [(i % 9, rng.randint(0, 1), rng.randint(0, 5) / 5) for i in range(50)]
    got = metrics.bootstrap_auc(scored(spark, rows), rounds=40).first()
    ids, areas = sorted({g for g, _, _ in rows}), []
    for b in range(40):
        drawn = [ids[int(hashlib.md5(f"42|{b}|{j}".encode()).hexdigest()[:8], 16) % len(ids)] for j in range(len(ids))]
        some = [(y, p) for g in drawn for k, y, p in rows if k == g]
        if len({y for y, _ in some}) == 2:
            areas.append(pair_auc(some))
    import numpy as np

    assert got.rounds == len(areas)
    assert (got.ci_low, got.ci_high) == pytest.approx(tuple(np.percentile(areas, [2.5, 97.5])), abs=1e-8)


def test_prefixes_in_two_levels(spark):
    rng = random.Random(12)
    rows = [(0, rng.randint(0, 1), rng.choice([0.5, rng.random()])) for _ in range(300)]
    got = {r.id: (r.n, r.tp, r.fp) for r in metrics.cumulative(scored(spark, rows), parts=7).collect()}
    tp = fp = 0
    for n, (i, (_, y, _)) in enumerate(sorted(enumerate(rows), key=lambda r: (-r[1][2], r[0])), 1):
        tp, fp = tp + y, fp + 1 - y
        assert got[i] == (n, tp, fp)
