"""De-duplicated findings, verdicts and audit records, one per patch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The verdicts' wording.
MANUAL = "Do not merge without manual review."
INJECTED = "Human should review: possible prompt-injection content in the issue or patch text."
RISKY = "Review recommended: risky behavior flagged."
NOTES = "Low-severity notes only; listed below."
CLEAN = "No risky patterns flagged."
FOOTER = "Flags are prompts for a human reviewer, not proof of intent; no flag is no guarantee."



def all_findings(security: DataFrame, injection: DataFrame) -> DataFrame:
    """Security findings, then injection findings, in one schema; ord keeps each layer's order."""
    cols = ["patch_id", "rule_id", "severity", "file", "line", "evidence"]
    a = security.select(*cols, F.struct(F.lit(0).alias("layer"), F.col("ord").alias("at")).alias("ord"))
    b = injection.select(*cols, F.struct(F.lit(1).alias("layer"), F.col("ord").alias("at")).alias("ord"))
    return a.unionByName(b)


def issue_layer(found: DataFrame, patches: DataFrame) -> DataFrame:
    """Findings of issue texts (text_id is the instance) as findings of each of their patches, before those of its comments."""
    rows = found.join(patches.select("patch_id", F.col("instance_id").alias("text_id")), "text_id")
    return rows.select("patch_id", "rule_id", "severity", F.lit(None).cast("string").alias("file"), "line", "evidence", (F.col("ord") - F.lit(1 << 40)).alias("ord"))


def _numbered(findings: DataFrame) -> DataFrame:
    """findings with _n, 1 for the first of each (rule_id, file, line, evidence) of a patch; nulls equal nulls."""
    first = Window.partitionBy("patch_id", "rule_id", "file", "line", "evidence").orderBy("ord", "severity")
    return findings.withColumn("_n", F.row_number().over(first))


def deduplicate(findings: DataFrame) -> DataFrame:
    """The first finding of each (rule_id, file, line, evidence) of a patch; nulls equal nulls."""
    return _numbered(findings).filter("_n = 1").drop("_n")


def duplicates(findings: DataFrame) -> DataFrame:
    """(patch_id, collapsed): findings less distinct findings."""
    key = F.struct("rule_id", "file", "line", "evidence")
    return findings.groupBy("patch_id").agg((F.count(F.lit(1)) - F.count_distinct(key)).alias("collapsed"))


def _flags() -> list:
    """Aggregates over a patch's findings by which its verdict is chosen."""
    flag = lambda cond: F.max(F.when(F.expr(cond), 1).otherwise(0))
    injected = "upper(rule_id) like 'INJ%'"
    return [flag(injected).alias("inj"), flag(f"not {injected} and upper(severity) in ('HIGH', 'CRITICAL')").alias("high"), flag(f"not {injected} and upper(severity) = 'MEDIUM'").alias("med"), flag(f"not {injected} and upper(severity) in ('LOW', 'REVIEW')").alias("low")]


def _named(rows: DataFrame, *more: str) -> DataFrame:
    """(patch_id, verdict, exit_code, more) from the flags, null for a patch without a finding."""
    text = f"case when high = 1 and inj = 1 then '{MANUAL} {INJECTED}' when high = 1 then '{MANUAL}' when inj = 1 and med = 1 then '{RISKY} {INJECTED}' when inj = 1 then '{INJECTED}' when med = 1 then '{RISKY}' when low = 1 then '{NOTES}' else '{CLEAN}' end"
    code = "case when high = 1 then 2 when inj = 1 or med = 1 then 1 else 0 end"
    return rows.select("patch_id", F.expr(text).alias("verdict"), F.expr(code).alias("exit_code"), *more)


def verdicts(findings: DataFrame, patches: DataFrame) -> DataFrame:
    """(patch_id, verdict, exit_code) of every patch, also of those without a finding."""
    return _named(patches.select("patch_id").join(findings.groupBy("patch_id").agg(*_flags()), "patch_id", "left"))


def audit_json(findings: DataFrame, patches: DataFrame) -> DataFrame:
    """(patch_id, payload): one JSON record per patch with verdict, layers, findings and footer."""
    # The findings are made once: one exchange on the patch serves the window and all the aggregates.
    kept = F.collect_list(F.when(F.col("_n") == 1, F.struct("ord", "rule_id", "severity", "file", "line", "evidence"))).alias("kept")
    folded = _numbered(findings.repartition("patch_id")).groupBy("patch_id").agg(*_flags(), kept, F.count(F.lit(1)).alias("every"))
    rows = patches.select("patch_id").join(folded, "patch_id", "left")
    rows = rows.withColumn("findings", F.expr("transform(array_sort(kept), f -> struct(f.rule_id, f.severity, f.file, f.line, f.evidence))")).withColumn("n", F.expr("case when kept is not null then size(kept) end"))
    rows = _named(rows, "findings", "n", (F.col("every") - F.col("n")).alias("collapsed"))
    empty = "cast(array() as array<struct<rule_id:string,severity:string,file:string,line:int,evidence:string>>)"
    body = F.struct("verdict", "exit_code", F.lit("ok").alias("security"), F.lit("ok").alias("injection"), F.expr(f"coalesce(findings, {empty})").alias("findings"), F.coalesce("collapsed", F.lit(0)).alias("duplicates_collapsed"), F.lit("NOT RUN (no model installed)").alias("experimental"), F.lit(FOOTER).alias("footer"))
    return rows.select("patch_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_findings"), F.to_json(body).alias("payload"))
