"""Corpus-level queries: joins, reports, windows, sampling, splits, metrics and models."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from diffloom.functions import rules
from diffloom.functions.dialect import Duck as D
from diffloom.operators import diff, heuristics, injection, learn, metrics, pairs, security

from . import cases
from .oracle import prioritized_sql, split_sql
from .queries import _FILES_LIKE, _HUNKS_LIKE, _added, _count, _removed, define, query

ORDER_SQL = "(values " + ", ".join(f"('{r}')" for r in security.ORDER) + ") r(rule_id)"
RANK = "case upper(severity) when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end"


def _all_rules(x):
    return x.spark.createDataFrame([(r,) for r in security.ORDER], "rule_id string")


# ---- Loading and label repair ----------------------------------------------------
define("src_hub_dataset", lambda x: x.issues.join(x.patches, "instance_id").select("patch_id", "instance_id", F.trim("problem_statement").alias("problem_statement"), F.trim("patch").alias("patch")).filter("problem_statement <> '' and patch <> ''"), "select patch_id, p.instance_id, trim(problem_statement, ' ') as problem_statement, trim(patch, ' ') as patch from patches p join issues i on i.instance_id = p.instance_id where trim(problem_statement) <> '' and trim(patch) <> ''")
define("fix_labels", lambda x: x.patches.select("patch_id", F.expr("case when resolved = 1 then 1 else patch_id % 2 end").cast("int").alias("well_formed"), F.expr("case when resolved = 1 then 1 when patch_id % 3 = 0 then null else 0 end").cast("int").alias("applied")), "select patch_id, (case when resolved = 1 then 1 else patch_id % 2 end)::integer as well_formed, (case when resolved = 1 then 1 when patch_id % 3 = 0 then null else 0 end)::integer as applied from patches")
define("cache_scores", lambda x: x.segments.select("content").distinct().select(F.sha2("content", 256).alias("key"), F.length("content").cast("long").alias("chars")).join(x.table("documents").filter("doc_id % 2 = 0").select(F.sha2("text", 256).alias("key"), F.lit(1.0).alias("cached")).distinct(), "key", "left").select("key", "chars", F.coalesce("cached", F.lit(0.0)).alias("score")), "select key, chars, coalesce(cached, 0.0::double) as score from (select distinct sha256(content) as key, length(content) as chars from segments) s left join (select distinct sha256(text) as key, 1.0::double as cached from documents where doc_id % 2 = 0) c using (key)")

# ---- Joins -----------------------------------------------------------------------
_issue_left = "select p.patch_id, length(coalesce(i.problem_statement, '')) as chars from patches p left join issues i on i.instance_id = p.instance_id"
define("join_issue_text", lambda x: x.patches.join(x.issues, "instance_id", "left").select("patch_id", F.length(F.coalesce("problem_statement", F.lit(""))).cast("long").alias("chars")), _issue_left)
define("join_split", lambda x: x.patches.select("patch_id", "instance_id").join(x.issues.filter("instance_id % 3 < 2").select("instance_id", F.expr("case when instance_id % 3 = 0 then 'train' else 'test' end").alias("part")), "instance_id", "left").select("patch_id", F.coalesce("part", F.lit("unknown")).alias("part")), "select patch_id, coalesce(part, 'unknown') as part from patches p left join (select instance_id, case when instance_id % 3 = 0 then 'train' else 'test' end as part from issues where instance_id % 3 < 2) i on i.instance_id = p.instance_id")
define("join_labels", lambda x: x.table("documents").select("doc_id").join(x.table("labels").filter("quality = 1").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left").select("doc_id", F.col("hit").isNotNull().cast("int").alias("resolved")), "select doc_id, (doc_id in (select doc_id from labels where quality = 1))::integer as resolved from documents")
define("join_semi_split", lambda x: x.patches.join(x.issues.filter("instance_id % 3 = 0"), "instance_id", "left_semi").select("patch_id", "submission"), "select patch_id, submission from patches where instance_id in (select instance_id from issues where instance_id % 3 = 0)")
define("join_anti_instances", lambda x: x.patches.join(x.patches.filter("submission = 'src1'").select("instance_id").distinct(), "instance_id", "left_anti").filter("submission <> 'src1'").select("patch_id", "instance_id"), "select patch_id, instance_id from patches where submission <> 'src1' and instance_id not in (select instance_id from patches where submission = 'src1')")
define("join_anti_findings", lambda x: injection.ml_comments(x.segments, 0.3).join(x.injection.select(*[F.col(c).alias(f"r_{c}") for c in ("patch_id", "file", "line")]), F.expr("patch_id <=> r_patch_id and file <=> r_file and line <=> r_line"), "left_anti").select("patch_id", "file", "line", "evidence"), "select patch_id, file, line_no as line, substr(content, 1, 200) as evidence from segments s where ('0x' || substr(md5(content), 1, 8))::bigint / 4294967295.0::double >= 0.3 and not exists (select 1 from injection i where i.patch_id = s.patch_id and i.file = s.file and i.line = s.line_no)")
define("join_theta_rules", lambda x: security.line_findings(x.lines, ["sec001_network", "sec003_command_exec"]).groupBy("rule_id", "evidence").agg(F.count(F.lit(1)).alias("n")), "select rule_id, evidence, count(*) as n from (select * from sec001_network union all select * from sec003_command_exec) group by 1, 2")
define("join_exists_context", lambda x: security.line_findings(x.lines, ["sec003_command_exec"]).groupBy("file", "severity").agg(F.count(F.lit(1)).alias("n")), "select file, severity, count(*) as n from sec003_command_exec group by 1, 2")
define("join_theta_paths", lambda x: heuristics.file_overlap(x.lines, x.patches, x.issues).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fraction_touched_named"), 9).alias("mean")), "select severity, count(*) as n, round(avg(fraction_touched_named), 9) as mean from file_overlap group by 1")
define("join_pairs", lambda x: metrics.tied_pairs(x.scored), "select a.model, count(*) as pairs, sum(case when abs(a.score - b.score) <= 1e-6 + 1e-5 * abs(b.score) then 1 else 0 end)::bigint as tied from scored a join scored b on a.model = b.model and a.instance_id = b.instance_id and a.label = 1 and b.label = 0 group by 1")
define("join_index_align", lambda x: diff.size_features(x.patches).join(heuristics.fire(x.lines, x.patches, x.issues), "patch_id").select("patch_id", "lines_added", "hunks", "rule_1", "rule_8"), "select p.patch_id, len(list_filter(string_split(patch, chr(10)), lambda l: l like '+%' and l not like '+++%')) as lines_added, len(list_filter(string_split(patch, chr(10)), lambda l: l like '@@%')) as hunks, rule_1, rule_8 from patches p join fire f on f.patch_id = p.patch_id")

# ---- Aggregations ----------------------------------------------------------------
_known = "select * from patches where resolved is not null"
define("agg_repo_prior", lambda x: learn.prior(x.patches.filter("split = 'train' and resolved is not null").withColumn("label", F.col("resolved")), x.patches.select("patch_id", "repo"), "repo").select("patch_id", F.round("score", 9).alias("score")), f"select patch_id, round(coalesce(m, (select avg(resolved) from ({_known}) where split = 'train')), 9) as score from patches p left join (select repo, avg(resolved) as m from ({_known}) where split = 'train' group by 1) s on s.repo = p.repo")
_rules = [f"rule_{k}" for k in range(1, 9)]
_stack = "stack(8, " + ", ".join(f"'{r}', {r}" for r in _rules) + ") as (rule, fired)"
_long = "select patch_id, rule, fired from fire unpivot (fired for rule in (" + ", ".join(_rules) + "))"
define("agg_fire_overall", lambda x: heuristics.fire(x.lines, x.patches, x.issues).select("patch_id", F.expr(_stack)).groupBy("rule").agg(F.sum("fired").cast("long").alias("n"), F.round(F.avg("fired") * 100, 6).alias("percent"), F.expr("avg(fired) < 0.01").alias("rare")), f"select rule, sum(fired)::bigint as n, round(avg(fired) * 100, 6) as percent, avg(fired) < 0.01 as rare from ({_long}) group by 1")
define("agg_fire_by_submission", lambda x: heuristics.fire(x.lines, x.patches, x.issues).join(x.patches.select("patch_id", "submission"), "patch_id").select("submission", F.expr(_stack)).groupBy("submission", "rule").agg(F.sum("fired").cast("long").alias("n"), F.round(F.avg("fired") * 100, 6).alias("percent")), f"select submission, rule, sum(fired)::bigint as n, round(avg(fired) * 100, 6) as percent from ({_long}) f join patches p on p.patch_id = f.patch_id group by 1, 2")
define("agg_rule_distinct", lambda x: _all_rules(x).join(x.security.join(x.patches.select("patch_id", "instance_id"), "patch_id").groupBy("rule_id").agg(F.count_distinct("patch_id").alias("np"), F.count_distinct("instance_id").alias("ni")), "rule_id", "left").select("rule_id", F.coalesce("np", F.lit(0)).cast("long").alias("patches"), F.coalesce("ni", F.lit(0)).cast("long").alias("instances")), f"select r.rule_id, count(distinct s.patch_id) as patches, count(distinct p.instance_id) as instances from {ORDER_SQL} left join security s on s.rule_id = r.rule_id left join patches p on p.patch_id = s.patch_id group by 1")
define("agg_severity_max", lambda x: x.security.groupBy("patch_id", "rule_id").agg(F.max_by("severity", F.expr(RANK)).alias("severity")).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n")), f"select rule_id, severity, count(*) as n from (select patch_id, rule_id, max_by(severity, {RANK}) as severity from security group by 1, 2) group by 1, 2")
define("agg_flagged_total", lambda x: x.security.agg(F.count_distinct("patch_id").alias("flagged"), F.count_distinct(F.when(F.upper("severity").isin("HIGH", "CRITICAL"), F.col("patch_id"))).alias("high")).crossJoin(x.patches.agg(F.count(F.lit(1)).alias("n"))).select("flagged", "high", "n", F.round(F.col("flagged") / F.col("n"), 9).alias("rate")), "select count(distinct patch_id) as flagged, count(distinct case when upper(severity) in ('HIGH', 'CRITICAL') then patch_id end) as high, (select count(*) from patches) as n, round(count(distinct patch_id) / (select count(*) from patches)::double, 9) as rate from security")
_pivot = ", ".join(f"count(distinct case when rule_id = '{r}' then s.patch_id end) as {r.lower()}" for r in security.ORDER)
define("agg_submission_matrix", lambda x: x.patches.select("patch_id", "submission").join(x.security.select("patch_id", "rule_id"), "patch_id", "left").groupBy("submission").pivot("rule_id", security.ORDER).agg(F.count_distinct("patch_id")).fillna(0).select("submission", *[F.col(r).cast("long").alias(r.lower()) for r in security.ORDER]), f"select p.submission, {_pivot} from patches p left join security s on s.patch_id = p.patch_id group by 1")

_code = cases.code_cases()
_values = lambda rows: ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else D.text(v) for v in r) + ")" for r in rows)
_case_patches = f"select id as patch_id, id as instance_id, '' as submission, '' as repo, '' as split, null::integer as resolved, 'diff --git a/src/a.py b/src/a.py' || chr(10) || '--- a/src/a.py' || chr(10) || '+++ b/src/a.py' || chr(10) || '@@ -0,0 +1,1 @@' || chr(10) || '+' || line || chr(10) as patch from (values {_values(_code)}) c(id, expected, line)"
_hits = f"select id, expected, max(case when starts_with(rule_id, expected) then 1 else 0 end) as hit, max(case when rule_id is not null then 1 else 0 end) as anything from (values {_values(_code)}) c(id, expected, line) left join security s on s.patch_id = c.id group by 1, 2"


@query("agg_coverage", f"select expected, count(*) as n, sum(hit)::bigint as by_rule, sum(anything)::bigint as by_any from ({_hits}) group by 1", {"patches": _case_patches})
def _coverage(x):
    """Synthetic code lines that their expected rule, or any rule, finds."""
    known = x.spark.createDataFrame(_code, "id long, expected string, snippet string")
    found = security.scan_patches(diff.diff_lines(diff.synth_patch(known.withColumn("path", F.lit("src/a.py"))).withColumnRenamed("id", "patch_id")))
    hit = known.join(found, known["id"] == found["patch_id"], "left").groupBy("id", "expected").agg(F.max(F.when(F.expr("startswith(rule_id, expected)"), 1).otherwise(0)).alias("hit"), F.max(F.when(F.col("rule_id").isNotNull(), 1).otherwise(0)).alias("any"))
    return hit.groupBy("expected").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").cast("long").alias("by_rule"), F.sum("any").cast("long").alias("by_any"))


_texts = cases.text_cases()
_text_hits = f"select id, expected, disguise, max(case when rule_id = expected then 1 else 0 end) as hit, max(case when rule_id is not null then 1 else 0 end) as anything from (values {_values(_texts)}) c(id, expected, disguise, body) left join text_injection s on s.text_id = c.id group by 1, 2, 3"


@query("agg_injection_coverage", f"select expected, disguise, count(*) as n, sum(hit)::bigint as by_rule, sum(anything)::bigint as by_any from ({_text_hits}) group by 1, 2", {"texts": f"select id as text_id, body as text from (values {_values(_texts)}) c(id, expected, disguise, body)"})
def _text_coverage(x):
    """Synthetic texts, by disguise, that their expected rule, or any rule, finds."""
    known = x.spark.createDataFrame(_texts, "id long, expected string, disguise string, text string")
    found = injection.scan_texts(known.select(F.col("id").alias("text_id"), "text"))
    hit = known.join(found, known["id"] == found["text_id"], "left").groupBy("id", "expected", "disguise").agg(F.max(F.when(F.col("rule_id") == F.col("expected"), 1).otherwise(0)).alias("hit"), F.max(F.when(F.col("rule_id").isNotNull(), 1).otherwise(0)).alias("any"))
    return hit.groupBy("expected", "disguise").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").cast("long").alias("by_rule"), F.sum("any").cast("long").alias("by_any"))


define("agg_case_eval", lambda x: x.patches.select("patch_id", "repo", F.expr("case when patch_id % 2 = 0 then 'SEC001' else 'SEC003' end").alias("expected")).join(x.security.select("patch_id", "rule_id", "severity"), "patch_id", "left").groupBy("patch_id", "repo", "expected").agg(F.max(F.expr("case when startswith(rule_id, expected) then 1 else 0 end")).alias("hit"), F.max(F.expr("case when rule_id is not null then 1 else 0 end")).alias("any")).groupBy("repo", "expected").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").cast("long").alias("hit_expected"), F.sum("any").cast("long").alias("hit_any")), "select repo, expected, count(*) as n, sum(hit)::bigint as hit_expected, sum(a)::bigint as hit_any from (select p.patch_id, repo, expected, max(case when starts_with(rule_id, expected) then 1 else 0 end) as hit, max(case when rule_id is not null then 1 else 0 end) as a from (select patch_id, repo, case when patch_id % 2 = 0 then 'SEC001' else 'SEC003' end as expected from patches) p left join security s on s.patch_id = p.patch_id group by 1, 2, 3) group by 1, 2")
define("agg_rule_counts", lambda x: x.injection.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patch_id").alias("patches")), "select rule_id, count(*) as n, count(distinct patch_id) as patches from injection group by 1")
define("agg_build_summary", lambda x: x.patches.groupBy("submission", "split").agg(F.count(F.lit(1)).alias("kept"), F.count("resolved").alias("known"), F.sum(F.coalesce("resolved", F.lit(0))).cast("long").alias("resolved")), "select submission, split, count(*) as kept, count(resolved) as known, sum(coalesce(resolved, 0))::bigint as resolved from patches group by 1, 2")
define("agg_repo_distinct_count", lambda x: x.patches.groupBy("repo").agg(F.count_distinct("instance_id").alias("instances")), "select repo, count(distinct instance_id) as instances from patches group by 1")
define("agg_feature_variance", lambda x: x.scored.groupBy("model", "instance_id").agg((F.count_distinct("score") > 1).cast("long").alias("v")).groupBy("model").agg(F.sum("v").alias("varying")), "select model, sum(v)::bigint as varying from (select model, instance_id, (count(distinct score) > 1)::bigint as v from scored group by 1, 2) group by 1")
define("agg_majority", lambda x: x.patches.groupBy("submission").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.max("n") / F.sum("n"), 9).alias("share")), "select round(max(n) / sum(n)::double, 9) as share from (select submission, count(*) as n from patches group by 1)")
define("agg_patch_max_score", lambda x: x.segments.withColumn("score", F.expr(injection.stub_score("content"))).groupBy("patch_id").agg(F.round(F.max("score"), 9).alias("score"), F.max(F.struct("score", -F.col("pos")))["col2"].alias("back")).select("patch_id", "score", (-F.col("back")).cast("long").alias("pos")), "select patch_id, round(score, 9) as score, pos from (select *, ('0x' || substr(md5(content), 1, 8))::bigint / 4294967295.0::double as score, row_number() over (partition by patch_id order by ('0x' || substr(md5(content), 1, 8))::bigint desc, pos) as n from segments) where n = 1")
GRID = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 0.999, 0.99999]


@query("agg_threshold_grid", "select t.t as threshold, count(case when s.score >= t.t and s.kind = 'segment' then 1 end) as segments, count(case when s.score >= t.t and s.kind = 'issue' then 1 end) as issues from (values " + ", ".join(f"({t}::double)" for t in GRID) + ") t(t) cross join (select 'segment' as kind, ('0x' || substr(md5(content), 1, 8))::bigint / 4294967295.0::double as score from segments union all select 'issue', ('0x' || substr(md5(problem_statement), 1, 8))::bigint / 4294967295.0::double from issues) s group by 1")
def _grid(x):
    """Flags of both corpora at nine thresholds: one pass, one column for each threshold."""
    scores = x.segments.select(F.lit("segment").alias("kind"), F.expr(injection.stub_score("content")).alias("score")).unionByName(x.issues.select(F.lit("issue").alias("kind"), F.expr(injection.stub_score("problem_statement")).alias("score")))
    counted = scores.agg(*[F.count(F.when((F.col("score") >= t) & (F.col("kind") == kind), 1)).alias(f"{kind}_{i}") for i, t in enumerate(GRID) for kind in ("segment", "issue")])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"segment_{i}").alias("segments"), F.col(f"issue_{i}").alias("issues")) for i, t in enumerate(GRID)])).alias("r")
    return counted.select(rows).select("r.*")


define("agg_split_counts", lambda x: x.patches.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("repo")), ",").alias("repos")), "select split, count(*) as n, string_agg(distinct repo, ',' order by repo) as repos from patches group by 1")

# ---- Windows, sampling, sets -------------------------------------------------------
_run = "over (partition by model order by score desc, id rows unbounded preceding)"
define("win_cumulative", lambda x: metrics.cumulative(x.scored), f"select model, id, count(*) {_run} as n, (sum(label) {_run})::bigint as tp, (sum(1 - label) {_run})::bigint as fp from scored")
define("win_drop_dup_instance", lambda x: x.patches.withColumn("_n", F.row_number().over(Window.partitionBy("instance_id").orderBy("patch_id"))).filter("_n = 1").select("instance_id", "patch_id", "submission"), "select instance_id, patch_id, submission from patches qualify row_number() over (partition by instance_id order by patch_id) = 1")
define("win_line_state", lambda x: x.lines.select("patch_id", "pos", "file", "line_s", "line_h", "line_c", "in_docstring"), "select patch_id, pos, file, line_s, line_h, line_c, in_docstring from lines")
define("win_lookahead", lambda x: heuristics._ahead(x.lines).select("patch_id", "pos", "next", "next_file"), "select patch_id, pos, next, next_file from ahead")


@query("topk_worst", "select model, id, label, round(abs(label - score), 9) as gap from scored s where exists (select 1 from scored t where t.model = s.model and t.instance_id = s.instance_id and t.label <> s.label) qualify row_number() over (partition by model order by abs(label - score) desc, id) <= 10")
def _worst(x):
    """The ten largest errors of each model among instances with both labels."""
    both = x.scored.groupBy("model", "instance_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("model", "instance_id")
    rows = x.scored.join(both, ["model", "instance_id"], "left_semi").withColumn("gap", F.abs(F.col("label") - F.col("score")))
    top = Window.partitionBy("model").orderBy(F.desc("gap"), "id")
    return rows.withColumn("_n", F.row_number().over(top)).filter("_n <= 10").select("model", "id", "label", F.round("gap", 9).alias("gap"))


define("topk_scores", lambda x: x.issues.select("instance_id", F.round(F.expr(injection.stub_score("problem_statement")), 9).alias("score")).orderBy(F.desc("score"), "instance_id").limit(5), "select instance_id, round(('0x' || substr(md5(problem_statement), 1, 8))::bigint / 4294967295.0::double, 9) as score from issues order by score desc, instance_id limit 5")
define("sort_by_length", lambda x: x.segments.select("patch_id", "pos", F.length("content").cast("long").alias("chars")).sortWithinPartitions("chars", "patch_id", "pos"), "select patch_id, pos, length(content) as chars from segments")
define("sample_per_rule", lambda x: x.security.select("rule_id", "patch_id").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.md5(F.concat(F.lit("42|"), F.col("patch_id").cast("string"))), "patch_id"))).filter("_n <= 5").select("rule_id", "patch_id"), "select rule_id, patch_id from (select distinct rule_id, patch_id from security) qualify row_number() over (partition by rule_id order by md5('42|' || patch_id), patch_id) <= 5")


@query("sample_spread", "select submission from (select submission, row_number() over (order by submission) - 1 as spot, count(*) over () as n from (select distinct submission from patches)) where spot in (select round_even(i * (n - 1) / 4.0, 0)::bigint from range(5) r(i))")
def _spread(x):
    """Five evenly spaced submissions of the sorted list (names, not rows)."""
    names = x.patches.select("submission").distinct()
    placed = names.select("submission", (F.row_number().over(Window.orderBy("submission")) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    return placed.filter("array_contains(transform(sequence(0, 4), i -> cast(bround(i * (n - 1) / 4.0, 0) as bigint)), cast(at as bigint))").select("submission")


define("shuffle_rows", lambda x: x.patches.select("patch_id", F.md5(F.concat(F.lit("42|"), F.col("patch_id").cast("string"))).alias("key")).orderBy("key"), "select patch_id, md5('42|' || patch_id) as key from patches")
define("sample_n", lambda x: x.patches.select("patch_id", F.md5(F.concat(F.lit("42|"), F.col("patch_id").cast("string"))).alias("key")).orderBy("key").limit(50), "select patch_id, md5('42|' || patch_id) as key from patches order by key limit 50")
define("split_random_80_20", lambda x: x.patches.select("patch_id", F.expr("case when conv(substring(md5(concat('42|', patch_id)), 1, 8), 16, 10) % 100 < 80 then 'train' else 'val' end").alias("part")), "select patch_id, case when ('0x' || substr(md5('42|' || patch_id), 1, 8))::bigint % 100 < 80 then 'train' else 'val' end as part from patches")
define("split_by_repo", lambda x: x.patches.groupBy("split", "repo").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("instance_id").alias("instances")), "select split, repo, count(*) as n, count(distinct instance_id) as instances from patches group by 1, 2")
define("fold_by_submission", lambda x: learn.folds(x.patches, "submission", 3, "42").select("submission", F.col("fold").cast("long").alias("fold")), "select submission, ntile(3) over (order by md5('42|' || submission)) as fold from (select distinct submission from patches)")
define("set_union", lambda x: x.security.select("patch_id", "rule_id").unionByName(x.injection.select("patch_id", "rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")), "select rule_id, count(*) as n from (select patch_id, rule_id from security union all select patch_id, rule_id from injection) group by 1")
define("set_except", lambda x: x.patches.select("patch_id").exceptAll(x.security.select("patch_id").distinct()), "select patch_id from patches except all select distinct patch_id from security")
define("set_distinct", lambda x: x.segments.select("content").distinct(), "select distinct content from segments")
define("set_intersect", lambda x: x.security.select("patch_id").intersect(x.injection.select("patch_id")), "select patch_id from security intersect select patch_id from injection")

# ---- Metrics ------------------------------------------------------------------------
_average = "rank() over (partition by {k} order by score) + (count(*) over (partition by {k}, score) - 1) / 2.0::double"
_auc = lambda k: f"select {k}, sum(label) as pos, count(*) - sum(label) as neg, case when sum(label) > 0 and sum(label) < count(*) then (sum(case when label = 1 then r end) - sum(label) * (sum(label) + 1) / 2.0::double) / (sum(label) * (count(*) - sum(label))) end as auc from (select *, {_average.format(k=k)} as r from scored) group by {k}"
define("met_roc_auc", lambda x: metrics.roc_auc(x.scored), f"select model, round(auc, 9) as auc from ({_auc('model')})")
define("met_pr_auc", lambda x: metrics.pr_auc(x.scored), "select model, round(sum(p * tp / a::double) / sum(p), 9) as ap from (select model, p, sum(p) over (partition by model order by score desc) as tp, sum(n) over (partition by model order by score desc) as a from (select model, score, count(*) as n, sum(label) as p from scored group by 1, 2)) group by 1")
_prefix = f"select *, count(*) {_run} as n, sum(label) {_run} as tp, sum(1 - label) {_run} as fp, sum(label) over (partition by model) as pos, sum(1 - label) over (partition by model) as neg from scored"
define("met_prec_at_fpr", lambda x: metrics.precision_at_fpr(x.scored), f"select model, round(coalesce(max_by(tp / n::double, n) filter (where fp <= 0.05 * neg), 0.0::double), 9) as precision from ({_prefix}) group by 1")
define("met_fp100_at_recall", lambda x: metrics.fp_per_100_at_recall(x.scored), f"select model, round(100.0::double * coalesce(min_by(fp, n) filter (where tp >= 0.8 * pos), max(neg)) / (max(pos) + max(neg)), 9) as fp_per_100 from ({_prefix}) group by 1")
_within = _auc("model, instance_id")
define("met_within_auc", lambda x: metrics.within_auc(x.scored), f"select model, round(avg(auc), 9) as within_auc, count(*) as n_instances from ({_within}) where auc is not null group by 1")
_draws = f"""select w.model, w.b, sum(auc * weight) / sum(weight) as m from (select g.model, g.instance_id, g.auc, d.b, d.weight from ({_within}) g
    join (select instance_id, row_number() over (order by instance_id) - 1 as spot from (select distinct instance_id from ({_within}) where auc is not null)) q on q.instance_id = g.instance_id
    join (select b, spot, count(*) as weight from (select b.b, ('0x' || substr(md5('42|' || b.b || '|' || j.j), 1, 8))::bigint % k.k as spot from range({metrics.ROUNDS}) b(b), (select count(distinct instance_id) as k from ({_within}) where auc is not null) k, range(100000) j(j) where j.j < k.k) group by 1, 2) d on d.spot = q.spot where g.auc is not null) w group by 1, 2"""
define("met_within_ci", lambda x: metrics.bootstrap_within(x.scored), f"select model, round(quantile_cont(m, 0.025), 9) as ci_low, round(quantile_cont(m, 0.975), 9) as ci_high, count(*) as rounds from ({_draws}) group by 1")
_spots = "select instance_id, row_number() over (order by instance_id) - 1 as spot from (select distinct instance_id from scored)"
_weights = f"""select b, spot, count(*) as w from (select b.b, ('0x' || substr(md5('42|' || b.b || '|' || j.j), 1, 8))::bigint % k.k as spot from range({metrics.ROUNDS}) b(b), (select count(distinct instance_id) as k from scored) k, range(100000) j(j) where j.j < k.k) group by 1, 2"""
_by_score = f"select s.model, d.b, s.score, sum(w) as n, sum(w * label) as p from scored s join ({_spots}) q on q.instance_id = s.instance_id join ({_weights}) d on d.spot = q.spot group by 1, 2, 3"
_drawn = f"select model, b, sum(p) as pos, sum(n) - sum(p) as neg, sum(p * (coalesce(before, 0) + (n + 1) / 2.0::double)) as ranks from (select *, sum(n) over (partition by model, b order by score rows between unbounded preceding and 1 preceding) as before from ({_by_score})) group by 1, 2"
_areas = f"select model, (ranks - pos * (pos + 1) / 2.0::double) / (pos * neg) as auc from ({_drawn}) where pos > 0 and neg > 0"
define("met_bootstrap_ci", lambda x: metrics.bootstrap_auc(x.scored), f"select model, round(quantile_cont(auc, 0.025), 9) as ci_low, round(quantile_cont(auc, 0.975), 9) as ci_high, count(*) as rounds from ({_areas}) group by 1")
_z = metrics.Z
define("met_wilson", lambda x: metrics.wilson(x.patches.groupBy("submission").agg(F.sum(F.coalesce("resolved", F.lit(0))).cast("long").alias("k"), F.count("resolved").alias("n"))), f"select submission, k, n, case when n <= 0 then 0.0::double else round(greatest(0, (p + {_z * _z} / (2 * n) - {_z} * sqrt((p * (1 - p) + {_z * _z} / (4 * n)) / n)) / (1 + {_z * _z} / n)), 9) end as ci_low, case when n <= 0 then 0.0::double else round(least(1, (p + {_z * _z} / (2 * n) + {_z} * sqrt((p * (1 - p) + {_z * _z} / (4 * n)) / n)) / (1 + {_z * _z} / n)), 9) end as ci_high from (select submission, sum(coalesce(resolved, 0))::bigint as k, count(resolved) as n, sum(coalesce(resolved, 0)) / nullif(count(resolved), 0)::double as p from patches group by 1)")
_hit = "(case when score >= 0.5 then 1 else 0 end)"
_table = f"select model, count(*) as n, sum({_hit} * label) as tp, sum({_hit}) as called, sum(label) as pos, sum(case when {_hit} = label then 1 else 0 end) as good from scored group by 1"
define("met_classification", lambda x: metrics.classification(x.scored), f"select model, round(good / n::double, 4) as accuracy, round(coalesce(tp / nullif(called, 0)::double, 0), 4) as precision, round(coalesce(tp / nullif(pos, 0)::double, 0), 4) as recall, round(coalesce(2 * tp / nullif(called + pos, 0)::double, 0), 4) as f1 from ({_table})")
define("met_accuracy", lambda x: x.scored.groupBy("model").agg(F.round(F.avg(F.expr("case when (score >= 0.5) = (label = 1) then 1D else 0D end")), 9).alias("accuracy")), "select model, round(avg(case when (score >= 0.5) = (label = 1) then 1.0::double else 0.0::double end), 9) as accuracy from scored group by 1")
define("met_eval_split", lambda x: metrics.roc_auc(x.scored).join(metrics.pr_auc(x.scored), "model").join(metrics.precision_at_fpr(x.scored), "model").join(metrics.fp_per_100_at_recall(x.scored), "model").join(metrics.within_auc(x.scored), "model"), f"select a.model, auc, ap, precision, fp_per_100, within_auc, n_instances from (select model, round(auc, 9) as auc from ({_auc('model')})) a join (select model, round(sum(p * tp / a::double) / sum(p), 9) as ap from (select model, p, sum(p) over (partition by model order by score desc) as tp, sum(n) over (partition by model order by score desc) as a from (select model, score, count(*) as n, sum(label) as p from scored group by 1, 2)) group by 1) b using (model) join (select model, round(coalesce(max_by(tp / n::double, n) filter (where fp <= 0.05 * neg), 0.0::double), 9) as precision, round(100.0::double * coalesce(min_by(fp, n) filter (where tp >= 0.8 * pos), max(neg)) / (max(pos) + max(neg)), 9) as fp_per_100 from ({_prefix}) group by 1) c using (model) join (select model, round(avg(auc), 9) as within_auc, count(*) as n_instances from ({_within}) where auc is not null group by 1) d using (model)")
_control = f"select model, round(avg(m), 9) as control from (select model, submission, avg(auc) as m from ({_auc('model, submission, instance_id')}) where auc is not null group by 1, 2) group by 1"
define("met_success_bar", lambda x: metrics.success_bar(metrics.within_auc(x.scored), metrics.bootstrap_within(x.scored), metrics.within_by_group(x.scored, "submission")), f"select model, within_auc, ci_low, coalesce(control, 0) as control, within_auc >= 0.7 and ci_low > 0.5 and coalesce(control, 0) > 0.5 as passed from (select model, round(avg(auc), 9) as within_auc from ({_within}) where auc is not null group by 1) w join (select model, round(quantile_cont(m, 0.025), 9) as ci_low from ({_draws}) group by 1) c using (model) left join ({_control}) g using (model)")
define("met_tie_pairs", lambda x: metrics.tied_pairs(x.scored).select("model", "pairs", "tied", F.round(F.col("tied") / F.col("pairs"), 9).alias("share")), "select a.model, count(*) as pairs, sum(case when abs(a.score - b.score) <= 1e-6 + 1e-5 * abs(b.score) then 1 else 0 end)::bigint as tied, round(sum(case when abs(a.score - b.score) <= 1e-6 + 1e-5 * abs(b.score) then 1 else 0 end) / count(*)::double, 9) as share from scored a join scored b on a.model = b.model and a.instance_id = b.instance_id and a.label = 1 and b.label = 0 group by 1")

# ---- Models -----------------------------------------------------------------------
SIZES = ["lines_added", "lines_removed", "lines_changed", "files_touched", "hunks"]


def _labelled(x):
    return x.patches.filter("resolved is not null").withColumn("label", F.col("resolved").cast("double"))


def _nonzero(df, column: str):
    """What a text model saw: number of terms and the vector's length, one row for each text."""
    from pyspark.ml.functions import vector_to_array

    return df.withColumn("_v", vector_to_array(column)).select("patch_id", F.expr("cast(size(filter(_v, v -> v <> 0)) as bigint)").alias("terms"), F.expr("round(sqrt(aggregate(_v, 0D, (s, v) -> s + v * v)), 6)").alias("length"))


def _text_model(x, texts, column: str, token: str):
    rows = _labelled(x).select("patch_id", "split", "label").join(texts, "patch_id")
    return learn.tfidf(rows.filter("split = 'train'"), rows, column, token, "features", train_if="split = 'train'")


def _with_issue(x):
    return _labelled(x).join(x.issues, "instance_id", "left").select("patch_id", F.coalesce("problem_statement", F.lit("")).alias("problem_statement"))


define("ml_tfidf_patch", lambda x: _nonzero(_text_model(x, x.patches.select("patch_id", "patch"), "patch", learn.PATCH_TOKEN), "features"))
define("ml_tfidf_issue", lambda x: _nonzero(_text_model(x, _with_issue(x), "problem_statement", learn.ISSUE_TOKEN), "features"))
define("ml_tfidf_body", lambda x: _nonzero(_text_model(x, diff.body_text(x.patches), "body", learn.PATCH_TOKEN), "features"))
define("ml_tfidf_paths", lambda x: _nonzero(_text_model(x, diff.paths_text(x.lines, x.patches), "paths", learn.ISSUE_TOKEN), "features"))


def _sized(x):
    rows = _labelled(x).select("patch_id", "instance_id", "submission", "repo", "split", "label").join(diff.size_features(x.patches), "patch_id").withColumns({c: F.col(c).cast("double") for c in SIZES})
    rows = learn.few(rows)  # the fits read them again and again
    return learn.scaled(rows.filter("split = 'train'"), rows, SIZES)


_size_sql = "select patch_id, split, " + ", ".join(f"len(list_filter(string_split(patch, chr(10)), lambda l: {c})) as {n}" for n, c in (("lines_added", "l like '+%' and l not like '+++%'"), ("hunks", "l like '@@%'"))) + " from patches where resolved is not null"
define("ml_scaler", lambda x: _sized(x).select("patch_id", F.round("lines_added", 6).alias("lines_added"), F.round("hunks", 6).alias("hunks")), f"select patch_id, round((lines_added - (select avg(lines_added) from ({_size_sql}) where split = 'train')) / (select coalesce(nullif(stddev_pop(lines_added), 0), 1) from ({_size_sql}) where split = 'train'), 6) as lines_added, round((hunks - (select avg(hunks) from ({_size_sql}) where split = 'train')) / (select coalesce(nullif(stddev_pop(hunks), 0), 1) from ({_size_sql}) where split = 'train'), 6) as hunks from ({_size_sql})")


def _fitted(rows, features: str = "features"):
    """Probability of every labelled patch from a model of the train split."""
    return learn.logistic(rows.filter("split = 'train'"), rows, features).select("patch_id", "split", "score")


def _combined(x):
    """Patch terms, issue terms and scaled sizes in one vector."""
    patch = _text_model(x, x.patches.select("patch_id", "patch"), "patch", learn.PATCH_TOKEN).select("patch_id", "split", "label", F.col("features").alias("f_patch"))
    issue = _text_model(x, _with_issue(x), "problem_statement", learn.ISSUE_TOKEN).select("patch_id", F.col("features").alias("f_issue"))
    rows = patch.join(issue, "patch_id").join(_sized(x).select("patch_id", *SIZES), "patch_id")
    return learn.stack(rows, ["f_patch", "f_issue", *SIZES], "wide").select("patch_id", "split", "label", "wide").persist(StorageLevel.MEMORY_AND_DISK)


def _ruled(x, sizes: bool = False):
    """The fifteen rule features (and the sizes), scaled on train."""
    rows = _labelled(x).select("patch_id", "instance_id", "submission", "repo", "split", "label").join(heuristics.features(x.lines, x.patches, x.issues), "patch_id")
    columns = [*rules.FEATURES, *(SIZES if sizes else [])]
    if sizes:
        rows = rows.join(diff.size_features(x.patches), "patch_id").withColumns({c: F.col(c).cast("double") for c in SIZES})
    rows = learn.few(rows)  # the fits read them again and again
    rows = learn.few(rows)
    return learn.scaled(rows.filter("split = 'train'"), rows, columns)


define("ml_logreg", lambda x: _fitted(learn.stack(_sized(x), SIZES)))
define("ml_model_a", lambda x: _fitted(_text_model(x, x.patches.select("patch_id", "patch"), "patch", learn.PATCH_TOKEN)))
define("ml_model_b", lambda x: _fitted(_text_model(x, _with_issue(x), "problem_statement", learn.ISSUE_TOKEN)))
define("ml_model_e", lambda x: _fitted(_combined(x), "wide"))
define("ml_model_a2", lambda x: _fitted(_text_model(x, diff.body_text(x.patches), "body", learn.PATCH_TOKEN)))
define("ml_model_a3", lambda x: _fitted(_text_model(x, diff.paths_text(x.lines, x.patches), "paths", learn.ISSUE_TOKEN)))
define("ml_model_h2", lambda x: _fitted(learn.stack(_ruled(x), rules.FEATURES)))
define("ml_model_h3", lambda x: _fitted(learn.stack(_ruled(x, True), [*rules.FEATURES, *SIZES])))


@query("ml_model_h1")
def _single(x):
    """Each rule feature alone, its direction fitted on train: one model for each of the fifteen."""
    rows = _ruled(x)
    out = None
    for name in rules.FEATURES:
        one = _fitted(learn.stack(rows.select("patch_id", "split", "label", name), [name])).withColumn("feature", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


define("ml_repo_prior", lambda x: learn.prior(_labelled(x).filter("split = 'train'"), _labelled(x).select("patch_id", "repo"), "repo").select("patch_id", F.round("score", 9).alias("score")), f"select patch_id, round(coalesce(m, (select avg(resolved) from ({_known}) where split = 'train')), 9) as score from ({_known}) p left join (select repo, avg(resolved) as m from ({_known}) where split = 'train' group by 1) s on s.repo = p.repo")
define("ml_hstack", lambda x: _nonzero(_combined(x), "wide"))


@query("ml_loro")
def _loro(x):
    """Patch terms, fitted anew without each repository in turn."""
    rows = _labelled(x).select("patch_id", "repo", "label", "patch")
    rows, prepare = learn.tfidf_folds(rows, "repo", "patch", learn.PATCH_TOKEN, "features")
    return learn.leave_one_out(rows, "repo", prepare=prepare)


define("ml_loso", lambda x: learn.leave_one_out(learn.stack(_sized(x), SIZES), "submission", also="instance_id"))


@query("ml_group_cv")
def _group_cv(x):
    rows = learn.stack(_sized(x), SIZES)
    rows = rows.join(F.broadcast(learn.folds(rows, "submission", 3, "42")), "submission").withColumnRenamed("fold", "part")
    return learn.leave_one_out(rows, "part")




@query("ml_sign_check")
def _sign(x):
    """Two features alone: the weight fitted on train and the within-instance area it reaches on val and test."""
    rows = _labelled(x).select("patch_id", "instance_id", "split", "label").join(heuristics.features(x.lines, x.patches, x.issues).select("patch_id", "scope_creep_count", "fraction_touched_named"), "patch_id").persist()
    out = None
    for name in ("scope_creep_count", "fraction_touched_named"):
        one = learn.stack(rows, [name])
        weight = learn.coefficients(one.filter("split = 'train'"))[0]
        scored = learn.logistic(one.filter("split = 'train'"), one).filter("split <> 'train'").select(F.col("split").alias("model"), "instance_id", "label", "score")
        areas = metrics.within_auc(scored).select(F.lit(name).alias("feature"), F.lit(round(weight, 6)).alias("train_coef"), F.col("model").alias("split"), "within_auc", "n_instances")
        out = areas if out is None else out.unionByName(areas)
    return out


@query("ml_origin_probe")
def _origin(x):
    """How well rule features of the test split tell the submission, beside chance and the most frequent one's share."""
    rows = learn.stack(_ruled(x), rules.FEATURES)
    names = sorted(r[0] for r in rows.select("submission").distinct().limit(learn.MOST_GROUPS + 1).collect() if r[0] is not None)
    if len(names) > learn.MOST_GROUPS:
        raise ValueError("too many submissions to tell apart")
    rows = rows.withColumn("origin", F.expr("double(array_position(array(" + ", ".join(f"'{n}'" for n in names) + "), submission) - 1)")).filter("origin is not null")
    test = learn.multinomial(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "origin")
    most = test.groupBy("origin").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k").alias("most"))
    return test.agg(F.count(F.lit(1)).alias("n"), F.avg(F.expr("case when predicted = origin then 1D else 0D end")).alias("a")).crossJoin(F.broadcast(most)).select("n", F.round("a", 6).alias("accuracy"), F.lit(round(1 / max(len(names), 1), 6)).alias("chance"), F.round(F.col("most") / F.col("n"), 6).alias("majority"))


_unsafe = r">=\s*0|==\s*None|is\s*None|!=\s*None|>\s*0"


_pick = "('0x' || substr(md5('42|' || patch_id), {k}, 8))::bigint"
_swap = D.text("^(.*?)(?:" + _unsafe + ")")
_safe = "trim(m[i + 1]) <> '' and ltrim(m[i + 1]) not like '#%' and m[i + 1] not like '---%' and m[i + 1] not like '+++%' and m[i + 1] not like '@@%'"
_corrupt_sql = f"""select patch_id, array_to_string(list_transform(m, lambda s, i: case when i = spot + 1 then (case when s like '+%' or s like '-%' then substr(s, 1, 1) || '# ' || substr(s, 2) else '# ' || s end) else s end), chr(10)) as patch from
    (select *, case when (m = l or pick % 2 = 0) and len(ok) > 0 then ok[pick % len(ok) + 1] end as spot from (select *, list_filter(range(len(m)), lambda i: {_safe}) as ok from
    (select *, case when magic then list_transform(l, lambda s: case when ltrim(s) like '#%' then s else regexp_replace(s, {_swap}, '\\1== -1') end) else l end as m from
    (select patch_id, {split_sql('patch')} as l, {_pick.format(k=1)} % 2 = 0 as magic, {_pick.format(k=9)} as pick from patches))))"""


@query("ml_corrupt_patch", _corrupt_sql)
def _corrupt(x):
    """Patches with one kind of damage: a safe comparison replaced, or a changed line commented out, by md5 draws."""
    draw = "conv(substring(md5(concat('42|', patch_id)), {k}, 8), 16, 10)"
    rows = x.patches.select("patch_id", F.expr(diff.split_lines("patch")).alias("l"), F.expr(f"{draw.format(k=1)} % 2 = 0").alias("magic"), F.expr(f"cast({draw.format(k=9)} as bigint)").alias("pick"))
    rows = rows.withColumn("m", F.expr(f"case when magic then transform(l, s -> case when startswith(ltrim(s), '#') then s else regexp_replace(s, '^(.*?)(?:{_unsafe.replace(chr(92), chr(92) * 2)})', '$1== -1') end) else l end"))
    rows = rows.withColumn("ok", F.expr("filter(sequence(0, size(m) - 1), i -> trim(m[i]) <> '' and not startswith(ltrim(m[i]), '#') and m[i] not like '---%' and m[i] not like '+++%' and m[i] not like '@@%')"))
    rows = rows.withColumn("at", F.expr("case when (m = l or pick % 2 = 0) and size(ok) > 0 then ok[cast(pick % size(ok) as int)] end"))
    damaged = "transform(m, (s, i) -> case when i = at then case when s like '+%' or s like '-%' then concat(substring(s, 1, 1), '# ', substring(s, 2)) else concat('# ', s) end else s end)"
    return rows.select("patch_id", F.expr(f"array_join({damaged}, '\\n')").alias("patch"))


_gold = "select p.patch_id, p.repo, {v} from patches p join issues i on i.instance_id = p.instance_id"


@query("ml_build_training", _gold.format(v="0 as label, 'gold' as source, problem_statement, patch") + f" union all select g.patch_id, repo, 1, 'synthetic', problem_statement, c.patch from ({_gold.format(v='problem_statement')}) g join ({_corrupt_sql}) c on c.patch_id = g.patch_id")
def _training(x):
    """Gold rows (label 0) and their damaged copies (label 1)."""
    gold = x.patches.join(x.issues, "instance_id").select("patch_id", "instance_id", "repo", "problem_statement", "patch", F.lit(0).alias("label"), F.lit("gold").alias("source"))
    bad = gold.drop("patch", "label", "source").join(_corrupt(x), "patch_id").select("patch_id", "instance_id", "repo", "problem_statement", "patch", F.lit(1).alias("label"), F.lit("synthetic").alias("source"))
    return gold.unionByName(bad).select("patch_id", "repo", "label", "source", "problem_statement", "patch")


_tok = lambda c: f"regexp_extract_all({c}, '[^\\s]+')"
_budget = pairs.MAX_LENGTH - pairs.MARKS
_pair_steps = f"""select *, case when over and size > room then (case when p = '' then p else array_to_string({split_sql('p')}, chr(10)) end) else p end as p1 from
    (select *, len(ti) + size > {_budget} as over, {_budget} - least(len(ti), greatest({pairs.LEAST_ISSUE}, least({pairs.MOST_ISSUE}, {_budget} // 4))) as room from
    (select patch_id, problem_statement as i, patch as p, {_tok('problem_statement')} as ti, len({_tok('patch')}) as size from patches q join issues s on s.instance_id = q.instance_id))"""
_pair_sql = f"""select patch_id, case when over and len(ti) > room2 then array_to_string(ti[1:room2], ' ') else i end as problem_statement, p3 as patch from
    (select *, greatest(0, {_budget} - least(len(t2), case when size > room then room else len(t2) end)) as room2, case when over and size > room and len(t2) > room then array_to_string(t2[1:room], ' ') else p2 end as p3 from
    (select *, {_tok('p2')} as t2 from (select *, case when over and size > room and len({_tok('p1')}) > room then {prioritized_sql('p1', f'(room * {pairs.TOKEN_CHARS})')} else p1 end as p2 from ({_pair_steps}))))"""


def _pairs(x):
    return x.patches.join(x.issues, "instance_id").select("patch_id", "problem_statement", "patch")


define("ml_truncate_pair", lambda x: pairs.truncate(_pairs(x)), _pair_sql)
define("ml_preprocess", lambda x: pairs.tokens(_pairs(x)).select("patch_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("long").alias("n_tokens")), f"select patch_id, array_to_string(t, ' ') as tokens, len(t) as n_tokens from (select patch_id, list_concat({_tok('problem_statement')}, {_tok('patch')})[1:{_budget}] as t from ({_pair_sql}))")
define("ml_transformer", lambda x: x.patches.select("patch_id", F.lit("NOT RUN (no model installed)").alias("status")), "select patch_id, 'NOT RUN (no model installed)' as status from patches")
