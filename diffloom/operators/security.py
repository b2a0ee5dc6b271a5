"""Security rules over added lines and touched files.

All line rules run in one projection over the shared parse: a CASE chain finds
each rule's first matching pattern, a bit mask over context and removed lines of
the same file (a windowed bit_or, no self join) lowers the severity where the
same pattern stood there before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions import paths, rules
from diffloom.functions.dialect import Spark as S
from diffloom.functions.dialect import strip
from diffloom.functions.needs import may_match

from .diff import touched_files

FINDING = ["patch_id", "rule_id", "severity", "file", "line", "evidence", "ord"]
#: Order of the rules in a scan; `ord` sorts findings as the rules append them.
ORDER = ["vendored_directory_added", "scratch_script_added", "SEC001_NETWORK_CALL", "SEC002_SHELL_PIPE", "SEC003_COMMAND_EXEC", "SEC004_OBFUSCATION", "SEC005_CREDENTIAL_READS", "SEC006_WORKFLOW_BUILD", "SEC007_HOOK_TAMPERING", "SEC008_DYNAMIC_ACCESS"]
STEP = 1 << 32


_HOOKS = [rules.GIT_CONFIG_COMMAND, *(p[0] for p in rules.HOOK_LINES)]


def reported(col: str = "content") -> str:
    """SQL: whether a line rule may match a line's content; all other lines matter to no line rule."""
    return may_match(S, col, [p[0] for r in rules.LINE_RULES for p in r.patterns] + [p[0] for p in rules.CREDENTIALS] + _HOOKS)


def first_match(d, col: str, patterns) -> str:
    """SQL: number of the first matching pattern or null; one joint pattern keeps most lines off the chain."""
    cases = " ".join(f"when {d.matches(col, p[0], p[1])} then {k}" for k, p in enumerate(patterns))
    return f"(case {cases} end)"


def _mask(col: str, patterns) -> str:
    return " | ".join(f"(case when {S.matches(col, p[0], p[1])} then {1 << k} else 0 end)" for k, p in enumerate(patterns))


def described(d, k: str, patterns) -> str:
    return f"(case {k} " + " ".join(f"when {i} then {d.text(p[2])}" for i, p in enumerate(patterns)) + " end)"


def _ord(rule_id: str, within: str):
    return (F.lit(ORDER.index(rule_id) * STEP) + F.expr(within)).cast("long")


def line_findings(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Findings of SEC001 to SEC005 and SEC008 from one pass over the parsed lines."""
    chosen = [r for r in rules.LINE_RULES if keys is None or r.key in keys]
    with_credentials = keys is None or "sec005_credentials" in keys
    known = [p[0] for r in chosen for p in r.patterns] + [p[0] for p in (rules.CREDENTIALS if with_credentials else ())]
    rows = lines.filter("active and not is_skip and not is_at and (added or removed or raw like ' %')").filter(F.expr(may_match(S, "content", known)))
    rows = rows.withColumn("_strip", F.expr(strip(S, "content"))).withColumn("_live", F.expr("added and not startswith(_strip, '#')"))
    parts = []
    for r in chosen:
        rows = rows.withColumn(f"_k_{r.key}", F.expr(f"case when _live then {first_match(S, 'content', r.patterns)} end"))
        if r.fixed is None:
            rows = rows.withColumn(f"_m_{r.key}", F.expr(f"case when not added then {_mask('content', r.patterns)} else 0 end"))
    same_file = Window.partitionBy("patch_id", "file")
    for r in chosen:
        if r.fixed is None:
            rows = rows.withColumn(f"_m_{r.key}", F.bit_or(f"_m_{r.key}").over(same_file))
    if with_credentials:
        rows = rows.withColumn("_k_cred", F.expr(f"case when _live then {first_match(S, 'content', rules.CREDENTIALS)} end"))
    quiet = f"({paths.is_test_safety(S, 'file')} or {paths.is_scratch(S, 'file')})"
    for r in chosen:
        k, m = f"_k_{r.key}", f"_m_{r.key}"
        severity = f"'{r.fixed}'" if r.fixed else f"case when {quiet} or (shiftright({m}, {k}) & 1) = 1 then 'low' else 'MEDIUM' end"
        parts.append(f"case when {k} is not null then named_struct('rule_id', '{r.rule_id}', 'severity', {severity}, 'what', {described(S, k, r.patterns)}, 'rank', {ORDER.index(r.rule_id)}) end")
    if with_credentials:
        high = ", ".join(str(i) for i, p in enumerate(rules.CREDENTIALS) if p[3] == "HIGH")
        parts.append(f"case when _k_cred is not null then named_struct('rule_id', '{rules.CREDENTIAL_ID}', 'severity', case when _k_cred in ({high}) and not {quiet} then 'HIGH' else 'low' end, 'what', {described(S, '_k_cred', rules.CREDENTIALS)}, 'rank', {ORDER.index(rules.CREDENTIAL_ID)}) end")
    hits = rows.select("patch_id", "file", F.col("line_s").alias("line"), "pos", "_strip", F.explode(F.expr(f"filter(array({', '.join(parts)}), f -> f is not null)")).alias("f"))
    return hits.select("patch_id", "f.rule_id", "f.severity", "file", "line", F.expr("concat(f.what, ': ', substring(_strip, 1, 120))").alias("evidence"), (F.col("f.rank") * F.lit(STEP) + F.col("pos")).cast("long").alias("ord"))


def file_findings(lines: DataFrame) -> DataFrame:
    """Vendored directories and scratch scripts among the touched files."""
    files = touched_files(lines, vendored=True)
    vendored = files.filter(F.expr(paths.is_vendored(S, "file"))).select("patch_id", F.lit("vendored_directory_added").alias("rule_id"), F.lit("review").alias("severity"), "file", F.lit(1).alias("line"), F.concat(F.lit("Vendored or virtualenv directory modified: "), "file").alias("evidence"), _ord("vendored_directory_added", "ord").alias("ord"))
    scratch = touched_files(lines).filter(F.expr(paths.is_scratch(S, "file"))).select("patch_id", F.lit("scratch_script_added").alias("rule_id"), F.lit("low").alias("severity"), "file", F.lit(1).alias("line"), F.concat(F.lit("Scratch or reproduction script added: "), "file").alias("evidence"), _ord("scratch_script_added", "ord").alias("ord"))
    return vendored.unionByName(scratch)


def workflow_findings(lines: DataFrame) -> DataFrame:
    """SEC006: touched build and CI files.  Every touched manifest is flagged, so no added line of one is left to look at."""
    hit = touched_files(lines).withColumn("_k", F.expr(paths.manifest_hit(S, "file"))).filter("_k is not null")
    what = "(case _k " + " ".join(f"when {i} then {S.text(t)}" for i, (_, t) in enumerate(paths.MANIFESTS)) + " end)"
    return hit.select("patch_id", F.lit(rules.WORKFLOW_ID).alias("rule_id"), F.lit("MEDIUM").alias("severity"), "file", F.lit(1).alias("line"), F.expr(f"concat('Sensitive build/CI file modified: ', {what}, ' (', file, ')')").alias("evidence"), _ord(rules.WORKFLOW_ID, "ord").alias("ord"))


def hook_findings(lines: DataFrame) -> DataFrame:
    """SEC007: touched hook files (vendored ones, too), then added lines of the other files."""
    hit = touched_files(lines, vendored=True).withColumn("_k", F.expr(first_match(S, "file", rules.HOOK_FILES))).filter("_k is not null")
    files = hit.select("patch_id", F.lit(rules.HOOK_ID).alias("rule_id"), F.lit("HIGH").alias("severity"), "file", F.lit(1).alias("line"), F.expr(f"concat('Git hook file modified: ', {described(S, '_k', rules.HOOK_FILES)}, ' (', file, ')')").alias("evidence"), _ord(rules.HOOK_ID, "ord").alias("ord"))
    rows = lines.filter("active and added").filter(F.expr(may_match(S, "content", _HOOKS)))
    rows = rows.withColumn("_strip", F.expr(strip(S, "content"))).filter("not startswith(_strip, '#')")
    rows = rows.filter(F.expr(f"{first_match(S, 'file', rules.HOOK_FILES)} is null"))
    config = f"{S.matches('file', rules.GIT_CONFIG, 'i')} and {S.matches('content', rules.GIT_CONFIG_COMMAND, 'i')}"
    rows = rows.withColumn("_k", F.expr(f"case when {config} then -1 else {first_match(S, 'content', rules.HOOK_LINES)} end")).filter("_k is not null")
    what = f"case when _k = -1 then 'git config hook command' else {described(S, '_k', rules.HOOK_LINES)} end"
    added = rows.select("patch_id", F.lit(rules.HOOK_ID).alias("rule_id"), F.lit("HIGH").alias("severity"), "file", F.col("line_s").alias("line"), F.expr(f"concat({what}, ': ', substring(_strip, 1, 120))").alias("evidence"), (F.lit(ORDER.index(rules.HOOK_ID) * STEP + (STEP >> 1)) + F.col("pos")).cast("long").alias("ord"))
    return files.unionByName(added)


def scan_patches(lines: DataFrame) -> DataFrame:
    """All ten rules; `ord` is the order in which one patch's findings are reported."""
    out = file_findings(lines)
    for more in (line_findings(lines), workflow_findings(lines), hook_findings(lines)):
        out = out.unionByName(more)
    return out
