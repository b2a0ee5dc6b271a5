"""Audit one issue text and one diff: exit code 0, 1 or 2 by verdict, 3 on unusable input."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from diffloom.operators import diff, injection, security, verdict
from diffloom.sources import files


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        print(f"usage error: {message}", file=sys.stderr)
        raise SystemExit(3)


def _one(rows, what: str) -> str:
    got = rows.limit(2).collect()
    if len(got) != 1:
        raise files.InputError(f"{what}: one file expected")
    if got[0]["error"]:
        raise files.InputError(f"{what}: {got[0]['error']}")
    return got[0]["text"]


def run_audit(spark: SparkSession, issue_path: str, diff_path: str) -> dict:
    """The audit record of one pair."""
    issue = _one(files.text_files(spark, issue_path), "issue")
    patch = _one(files.diff_files(spark, diff_path), "diff")
    patches = spark.createDataFrame([(0, patch)], "patch_id long, patch string")
    lines = diff.diff_lines(patches)
    texts = spark.createDataFrame([(0, issue)], "text_id long, text string")
    on_issue = verdict.issue_layer(injection.scan_texts(texts), spark.createDataFrame([(0, 0)], "patch_id long, instance_id long"))
    on_patch = injection.scan_comments(diff.comment_segments(lines)).drop("source")
    findings = verdict.all_findings(security.scan_patches(lines), on_issue.unionByName(on_patch))
    return json.loads(verdict.audit_json(findings, patches).first()["payload"])


def report(record: dict, experimental: bool = False) -> str:
    """The record as text: state of each layer, findings, the model's signal where asked for, verdict and footer."""
    out = ["AUDIT REPORT (flags risky patterns; not a correctness check)", "", "Scanner layers"]
    out += [f"  {layer}: {record[layer]}" for layer in ("security", "injection", "experimental")]
    out += ["", f"{record['duplicates_collapsed']} duplicate findings collapsed", ""]
    if record["findings"]:
        rows = [("Rule ID", "Severity", "Location", "Evidence")]
        rows += [(f["rule_id"], f["severity"].upper(), f"{f.get('file') or 'issue'}:{f['line']}", f["evidence"][:120]) for f in record["findings"]]
        wide = [max(len(r[k]) for r in rows) for k in range(3)]
        out += ["Flagged patterns", *["  " + "  ".join([*(v.ljust(w) for v, w in zip(r, wide)), r[3]]) for r in rows], ""]
    if experimental:
        out += ["Experimental signal (not part of the verdict)", f"  Status: {record['experimental']}", ""]
    return "\n".join([*out, f"VERDICT: {record['verdict']}", "", record["footer"]])


def main(argv: list[str] | None = None) -> int:
    parser = Parser(description=__doc__)
    parser.add_argument("--diff", required=True)
    parser.add_argument("--issue", required=True)
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--codebert", action="store_true", help="report the experimental model's signal, which never changes the verdict")
    parser.add_argument("--model-path", default=None, help="accepted for compatibility; no model layer is installed")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        record = run_audit(spark, args.issue, args.diff)
    except Exception as error:  # any failing layer fails the audit
        print(f"error: {str(error).splitlines()[0] if str(error) else type(error).__name__}", file=sys.stderr)
        return 3
    if args.json:
        print(json.dumps(record, indent=2))
    else:
        print(report(record, args.codebert))
    return record["exit_code"]


if __name__ == "__main__":
    sys.exit(main())
