"""Exact ranking metrics, intervals and their per-group forms, as window and aggregate queries.

Input `scored`: (model, id, instance_id, label 0/1, score).  Ties: ranking
metrics average tied ranks; prefix metrics order by score descending, then id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054
#: Resamples of a bootstrap.
ROUNDS = 500


def _auc(scored: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Tie-averaged Mann-Whitney statistic of each group; null without both classes.

    Scores are first counted by value, so a rank needs no row order among ties.
    weight: a column saying how often each row counts.
    """
    once = F.col(weight) if weight else F.lit(1)
    by = scored.groupBy(*keys, "score").agg(F.sum(once).alias("n"), F.sum(F.col("label") * once).alias("p"))
    order = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    out = by.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2.0)).alias("ranks"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    return out.select(*keys, "pos", "neg", F.expr("case when pos > 0 and neg > 0 then round((ranks - pos * (pos + 1) / 2.0D) / (pos * neg), 9) end").alias("auc"))


def roc_auc(scored: DataFrame) -> DataFrame:
    return _auc(scored, ["model"]).select("model", "auc")


def pr_auc(scored: DataFrame) -> DataFrame:
    """Average precision over distinct thresholds."""
    by = scored.groupBy("model", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    run = Window.partitionBy("model").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.select("model", "p", F.sum("p").over(run).alias("tp"), F.sum("n").over(run).alias("all"))
    return by.groupBy("model").agg(F.expr("round(sum(p * double(tp) / all) / nullif(sum(p), 0), 9)").alias("ap"))


def cumulative(scored: DataFrame, parts: int = 64) -> DataFrame:
    """(model, id, n, tp, fp) after each row by descending score.

    Prefix sums in two levels: rows fall into score ranges of about equal size,
    each range is summed up on its own, and the totals of the ranges before it
    (a few rows a model) are added; no task sorts a whole model.
    """
    bounds = scored.groupBy("model").agg(F.array_distinct(F.percentile_approx("score", [k / parts for k in range(1, parts)], 10_000)).alias("_bounds"))
    rows = scored.join(F.broadcast(bounds), "model").withColumn("_part", F.expr("size(filter(_bounds, b -> b > score))")).drop("_bounds")
    sums = [F.count(F.lit(1)).alias("n0"), F.sum("label").cast("long").alias("tp0"), F.sum(1 - F.col("label")).cast("long").alias("fp0")]
    ahead = Window.partitionBy("model").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("model", "_part").agg(*sums).select("model", "_part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("n0", "tp0", "fp0")])
    run = Window.partitionBy("model", "_part").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("model", "_part", "id", F.count(F.lit(1)).over(run).alias("n"), F.sum("label").over(run).cast("long").alias("tp"), F.sum(1 - F.col("label")).over(run).cast("long").alias("fp"))
    return rows.join(F.broadcast(before), ["model", "_part"]).select("model", "id", *[(F.col(c) + F.col(f"{c}0")).alias(c) for c in ("n", "tp", "fp")])


def _totals(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))


def precision_at_fpr(scored: DataFrame, most: float = 0.05) -> DataFrame:
    """Precision of the last prefix whose false-positive rate is at most `most`; 0 without one or without both classes."""
    rows = cumulative(scored).join(_totals(scored), "model")
    return rows.groupBy("model").agg(F.expr(f"round(coalesce(max_by(case when pos > 0 and neg > 0 then tp / double(n) else 0D end, case when fp <= {most}D * neg then n end), 0D), 9)").alias("precision"))


def fp_per_100_at_recall(scored: DataFrame, least: float = 0.8) -> DataFrame:
    """False positives per 100 rows at the first prefix with recall of at least `least`; all negatives if none; 0 without both classes."""
    rows = cumulative(scored).join(_totals(scored), "model")
    return rows.groupBy("model").agg(F.expr(f"round(case when max(pos) = 0 or max(neg) = 0 then 0D else 100D * coalesce(min_by(fp, case when tp >= {least}D * pos then n end), max(neg)) / (max(pos) + max(neg)) end, 9)").alias("fp_per_100"))


def within_auc(scored: DataFrame) -> DataFrame:
    """Mean of instances' own areas over instances with both labels, and their number."""
    per = _auc(scored, ["model", "instance_id"]).filter("auc is not null")
    return scored.select("model").distinct().join(per.groupBy("model").agg(F.avg("auc").alias("mean"), F.count(F.lit(1)).alias("k")), "model", "left").select("model", F.round(F.coalesce("mean", F.lit(0.0)), 9).alias("within_auc"), F.coalesce("k", F.lit(0)).cast("long").alias("n_instances"))


def draws(groups: DataFrame, rounds: int, seed: str) -> DataFrame:
    """(b, instance_id, weight): `rounds` resamples with replacement of the groups, by md5-keyed draws.

    groups: (instance_id).  Draw j of round b takes the group whose position is
    md5(seed|b|j) modulo their number.
    """
    n = groups.count()
    order = Window.orderBy("instance_id")  # a list of groups, not of rows
    placed = groups.select("instance_id", (F.row_number().over(order) - 1).alias("at"))
    grid = groups.sparkSession.range(rounds * max(n, 1)).select((F.col("id") / max(n, 1)).cast("long").alias("b"), (F.col("id") % max(n, 1)).alias("j"))
    key = F.expr(f"conv(substring(md5(concat('{seed}|', b, '|', j)), 1, 8), 16, 10)").cast("long") % max(n, 1)
    weight = grid.select("b", key.alias("at")).groupBy("b", "at").agg(F.count(F.lit(1)).alias("weight"))
    return weight.join(placed, "at").select("b", "instance_id", "weight")


def bootstrap_within(scored: DataFrame, rounds: int = ROUNDS, seed: str = "42") -> DataFrame:
    """2.5 and 97.5 percent points of the mean within-instance area over resampled instances."""
    per = _auc(scored, ["model", "instance_id"]).filter("auc is not null")
    chosen = draws(per.select("instance_id").distinct(), rounds, seed)
    means = per.join(chosen, "instance_id").groupBy("model", "b").agg((F.sum(F.col("auc") * F.col("weight")) / F.sum("weight")).alias("m"))
    return means.groupBy("model").agg(F.round(F.percentile("m", F.lit(0.025)), 9).alias("ci_low"), F.round(F.percentile("m", F.lit(0.975)), 9).alias("ci_high"), F.count(F.lit(1)).alias("rounds"))


def bootstrap_auc(scored: DataFrame, rounds: int = ROUNDS, seed: str = "42") -> DataFrame:
    """2.5 and 97.5 percent points of the area over the rows of resampled instances; draws of one class don't count."""
    chosen = draws(scored.select("instance_id").distinct(), rounds, seed)
    drawn = _auc(scored.join(chosen, "instance_id"), ["model", "b"], "weight").filter("auc is not null")
    return drawn.groupBy("model").agg(F.round(F.percentile("auc", F.lit(0.025)), 9).alias("ci_low"), F.round(F.percentile("auc", F.lit(0.975)), 9).alias("ci_high"), F.count(F.lit(1)).alias("rounds"))


def wilson(rows: DataFrame, k: str = "k", n: str = "n") -> DataFrame:
    """rows with Wilson's 95 % bounds of k out of n; (0, 0) for n <= 0."""
    p, z2 = f"({k} / double({n}))", Z * Z
    mid, den = f"({p} + {z2}D / (2 * {n}))", f"(1 + {z2}D / {n})"
    half = f"({Z}D * sqrt(({p} * (1 - {p}) + {z2}D / (4 * {n})) / {n}))"
    return rows.select("*", F.expr(f"case when {n} <= 0 then 0D else round(greatest(0D, ({mid} - {half}) / {den}), 9) end").alias("ci_low"), F.expr(f"case when {n} <= 0 then 0D else round(least(1D, ({mid} + {half}) / {den}), 9) end").alias("ci_high"))


def classification(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 at a threshold, rounded to four places, 0 where undefined."""
    hit = F.when(F.col("score") >= threshold, 1).otherwise(0)
    rows = scored.select("model", "label", hit.alias("hit")).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("hit * label")).alias("tp"), F.sum("hit").alias("called"), F.sum("label").alias("pos"), F.sum(F.expr("case when hit = label then 1 else 0 end")).alias("right"))
    ratio = lambda a, b: F.expr(f"round(coalesce({a} / nullif(double({b}), 0), 0D), 4)")
    return rows.select("model", ratio("right", "n").alias("accuracy"), ratio("tp", "called").alias("precision"), ratio("tp", "pos").alias("recall"), ratio("(2D * tp)", "(called + pos)").alias("f1"))


def tied_pairs(scored: DataFrame, atol: float = 1e-6, rtol: float = 1e-5) -> DataFrame:
    """Pairs of a positive and a negative of one instance, and those of (nearly) equal score.

    The join is within instances, whose size is the number of submissions.
    """
    a = scored.filter("label = 1").select("model", "instance_id", F.col("score").alias("a"))
    b = scored.filter("label = 0").select("model", "instance_id", F.col("score").alias("b"))
    pairs = a.join(b, ["model", "instance_id"])
    tied = F.when(F.abs(F.col("a") - F.col("b")) <= atol + rtol * F.abs("b"), 1).otherwise(0)
    return pairs.groupBy("model").agg(F.count(F.lit(1)).alias("pairs"), F.sum(tied).cast("long").alias("tied"))


def success_bar(within: DataFrame, interval: DataFrame, control: DataFrame, least: float = 0.7, low: float = 0.5) -> DataFrame:
    """Whether a model passes: area of at least `least`, a lower bound above `low`, and so the mean area over held-out groups.

    control: (model, control) with that mean.
    """
    rows = within.join(interval, "model").join(control, "model", "left").withColumn("control", F.coalesce("control", F.lit(0.0)))
    return rows.select("model", "within_auc", "ci_low", "control", F.expr(f"within_auc >= {least}D and ci_low > {low}D and control > {low}D").alias("passed"))


def within_by_group(scored: DataFrame, group: str) -> DataFrame:
    """(model, control): mean over groups of the within-instance area of each group's rows, groups without one left out."""
    per = _auc(scored, ["model", group, "instance_id"]).filter("auc is not null").groupBy("model", group).agg(F.avg("auc").alias("m"))
    return per.groupBy("model").agg(F.round(F.avg("m"), 9).alias("control"))
