"""Auditing a stream of patches: the per-patch operators run unchanged on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from diffloom.operators import diff, injection, security, verdict


def audit(patches: DataFrame) -> DataFrame:
    """(patch_id, verdict, exit_code) of (patch_id, patch[, problem_statement]); the issue's text is audited where the column is there."""
    lines = diff.diff_lines(patches.select("patch_id", "patch"))
    injected = injection.scan_comments(diff.comment_segments(lines)).drop("source")
    if "problem_statement" in patches.columns:
        found = injection.scan_texts(patches.select(F.col("patch_id").alias("text_id"), F.col("problem_statement").alias("text")))
        injected = injected.unionByName(verdict.issue_layer(found, patches.select("patch_id", F.col("patch_id").alias("instance_id"))))
    return verdict.verdicts(verdict.all_findings(security.scan_patches(lines), injected), patches)


def audit_stream(patches: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the verdicts of a streaming (patch_id, patch[, problem_statement]) to Parquet under `out`.

    Each batch writes its own folder, named by its number and overwritten when
    the batch is run again, so a restart never doubles rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        audit(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    return patches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
