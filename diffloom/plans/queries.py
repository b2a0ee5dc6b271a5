"""The registry: every operator as a query over the input tables, with its SQL for the checking engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom import corpus
from diffloom.functions import paths, rules
from diffloom.functions.dialect import Duck as D
from diffloom.functions.dialect import Spark as S
from diffloom.functions.dialect import strip
from diffloom.operators import diff, heuristics, injection, learn, metrics, security, verdict

from .oracle import compose, prioritized_sql, wellformed_sql

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Inputs:
    """The relations one query starts from, each built once for it."""

    spark: SparkSession
    sf_dir: str
    made: dict = field(default_factory=dict)

    def _once(self, name: str, make):
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def patches(self) -> DataFrame:
        return self._once("patches", lambda: corpus.patches(self.spark, self.sf_dir))

    @property
    def issues(self) -> DataFrame:
        return self._once("issues", lambda: corpus.issues(self.spark, self.sf_dir))

    @property
    def lines(self) -> DataFrame:
        """The shared parse, kept (memory, then disk) because a scan reads it in several branches."""
        return self._once("lines", lambda: diff.diff_lines(self.patches).persist(StorageLevel.MEMORY_AND_DISK))

    @property
    def flagged(self) -> DataFrame:
        """The few lines that the scans of a patch look at, kept in place of all lines."""
        return self._once("flagged", lambda: diff.flagged(diff.diff_lines(self.patches), security.reported()).persist(StorageLevel.MEMORY_AND_DISK))

    @property
    def security(self) -> DataFrame:
        return self._once("security", lambda: security.scan_patches(self.flagged))

    @property
    def segments(self) -> DataFrame:
        return self._once("segments", lambda: diff.comment_segments(self.flagged))

    @property
    def injection(self) -> DataFrame:
        return self._once("injection", lambda: injection.scan_comments(self.segments))

    @property
    def findings(self) -> DataFrame:
        """All three layers: security, injection in the patch's issue, injection in its comments."""
        return self._once("findings", lambda: verdict.all_findings(self.security, verdict.issue_layer(injection.scan_texts(self.issue_texts), self.patches).unionByName(self.injection.drop("source"))))

    @property
    def issue_texts(self) -> DataFrame:
        return self.issues.select(F.col("instance_id").alias("text_id"), F.col("problem_statement").alias("text"))

    @property
    def texts(self) -> DataFrame:
        """Every document, for the queries that read texts alone."""
        return self._once("texts", lambda: corpus.texts(self.spark, self.sf_dir))

    @property
    def scored(self) -> DataFrame:
        """(model, id, instance_id, submission, label, score): labelled documents with two stand-in scores."""
        docs = self.table("documents").select("doc_id", "source", "n_chars").join(self.table("labels").select("doc_id", "quality"), "doc_id")
        kinds = F.explode(F.expr("array(struct('length' as model, double(floor(least(n_chars, 20000) / 200)) / 100 as score), struct('mixed' as model, double((doc_id * 7919) % 101) / 101 as score))")).alias("m")
        return docs.select(kinds, F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 10).alias("instance_id"), F.col("source").alias("submission"), F.col("quality").cast("int").alias("label")).select("m.model", "id", "instance_id", "submission", "label", "m.score")


REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, instead: dict[str, str] | None = None):
    """Register a function of Inputs under a name, with the checking engine's SQL where it can say the same."""

    def wrap(make):
        REGISTRY[name] = lambda spark, sf_dir: make(Inputs(spark, sf_dir))
        REGISTRY[name].__doc__ = make.__doc__
        if sql is not None:
            ORACLES[name] = compose(sql, instead)
        return make

    return wrap


def define(name: str, make, sql: str | None = None) -> None:
    query(name, sql)(make)


SIX = "patch_id, rule_id, severity, file, line, evidence"
six = lambda df: df.select(*[c.strip() for c in SIX.split(",")])
big = lambda c: F.col(c).cast("long").alias(c)

# ---- Parsing -----------------------------------------------------------------
define("diff_lines_heur", lambda x: diff.lines_heur(x.lines), "select patch_id, pos, file, line_no, kind, content from heur_lines")
define("diff_added_lines", lambda x: diff.added_lines(x.lines), "select patch_id, pos, file, line_no, content from added_lines")
define("diff_context_lines", lambda x: diff.context_lines(x.lines), "select patch_id, pos, file, content from context_lines")
define("diff_files_heur", lambda x: diff.touched_files(x.lines), "select patch_id, file, ord from touched")
define("diff_files_touched", lambda x: diff.touched_files(x.lines, vendored=True), "select patch_id, file, ord from touched_any")
define("diff_comment_segments", lambda x: x.segments, "select patch_id, pos, file, line_no, content from segments")
define("diff_body_text", lambda x: diff.body_text(x.patches), "select p.patch_id, coalesce(string_agg(l.content, ' ' order by l.pos), '') as body from patches p left join (select * from lines where added or removed) l on l.patch_id = p.patch_id group by 1")
define("diff_paths_text", lambda x: diff.paths_text(x.lines, x.patches), "select p.patch_id, coalesce(string_agg(t.file, ' ' order by t.ord), '') as paths from patches p left join touched t on t.patch_id = p.patch_id group by 1")
_GLUED = D.replace("patch", rules.GLUED, "{1}\n{2}")
_count = lambda cond: f"len(list_filter(string_split({_GLUED}, chr(10)), lambda l: {cond}))"
_added, _removed = "l like '+%' and l not like '+++%'", "l like '-%' and l not like '---%'"
_FILES_LIKE, _HUNKS_LIKE = "l like '--- %' or l like 'diff --git%'", "l like '@@%'"
define("diff_size_features", lambda x: diff.size_features(x.patches), f"select patch_id, {_count(_added)} as lines_added, {_count(_removed)} as lines_removed, {_count(_added)} + {_count(_removed)} as lines_changed, {_count(_FILES_LIKE)} as files_touched, {_count(_HUNKS_LIKE)} as hunks from patches")
define("diff_wellformed", lambda x: diff.wellformed(x.patches), f"select patch_id, reason = 'ok' as well_formed, reason from ({wellformed_sql()})")


@query("diff_wellformed_report", f"select reason = 'ok' as well_formed, reason, count(*) as n, count(resolved) as known, round(avg(resolved), 9) as resolved_rate from ({wellformed_sql()}) group by 1, 2")
def _wellformed_report(x):
    """Patches and resolved share by well-formedness and reason."""
    rows = diff.wellformed(x.patches).join(x.patches.select("patch_id", "resolved"), "patch_id")
    return rows.groupBy("well_formed", "reason").agg(F.count(F.lit(1)).alias("n"), F.count("resolved").alias("known"), F.round(F.avg("resolved"), 9).alias("resolved_rate"))


@query("diff_synth_patch", "select doc_id as id, 'diff --git a/x.py b/x.py' || chr(10) || '--- a/x.py' || chr(10) || '+++ b/x.py' || chr(10) || '@@ -0,0 +1,' || len(string_split(coalesce(text, ''), chr(10))) || ' @@' || chr(10) || '+' || replace(coalesce(text, ''), chr(10), chr(10) || '+') || chr(10) as patch from documents")
def _synth(x):
    docs = x.table("documents").select(F.col("doc_id").alias("id"), F.lit("x.py").alias("path"), F.coalesce("text", F.lit("")).alias("snippet"))
    return diff.synth_patch(docs)


define("diff_prioritize", lambda x: diff.prioritize(x.patches, 400), f"select patch_id, {prioritized_sql('patch', '400')} as text from patches")

# ---- Path predicates ----------------------------------------------------------
_FILES = "select distinct file from touched_any"
for _name, _rule in paths.PREDICATES.items():
    if _name == "repo_of":
        define(_name, lambda x: x.table("documents").select("doc_id", F.expr(paths.repo_of(S, "concat(source, '__', lang, '-', doc_id)")).alias("value")), f"select doc_id, {paths.repo_of(D, chr(40) + 'source || ' + chr(39) + '__' + chr(39) + ' || lang || ' + chr(39) + '-' + chr(39) + ' || doc_id)')} as value from documents")
    else:
        define(_name, lambda x, r=_rule: diff.touched_files(x.lines, True).select("file").distinct().select("file", F.expr(r(S, "file")).alias("value")), f"select file, {_rule(D, 'file')} as value from ({_FILES})")

# ---- Security -----------------------------------------------------------------
define("sec_vendored", lambda x: six(security.file_findings(x.lines).filter("rule_id = 'vendored_directory_added'")), f"select {SIX} from sec_vendored")
define("sec_scratch", lambda x: six(security.file_findings(x.lines).filter("rule_id = 'scratch_script_added'")), f"select {SIX} from sec_scratch")
for _rule in rules.LINE_RULES:
    define(_rule.key, lambda x, k=_rule.key: six(security.line_findings(x.lines, [k])), f"select {SIX} from {_rule.key}")
define("sec005_credentials", lambda x: six(security.line_findings(x.lines, ["sec005_credentials"])), f"select {SIX} from sec005_credentials")
define("sec006_workflow_build", lambda x: six(security.workflow_findings(x.lines)), f"select {SIX} from sec006_workflow_build")
define("sec007_hooks", lambda x: six(security.hook_findings(x.lines)), f"select {SIX} from sec007_hooks")
define("sec_scan_patch", lambda x: x.security.select(*security.FINDING), f"select {SIX}, ord from security")

# ---- Injection ----------------------------------------------------------------
define("txt_normalize", lambda x: x.texts.select("text_id", injection.normalize_text("text").alias("norm"), injection.normalize_text("text", True).alias("leet")))
define("txt_base64", lambda x: x.texts.select("text_id", F.array_join(injection.base64_payloads("text"), "\n").alias("payloads")))
_whole, _body = injection.embedded_comments(D, "html")


@query("txt_comments", f"select page_id, array_to_string(list_transform(list_filter(list_transform({_whole}, lambda m: {_body}), lambda c: c <> ''), lambda c: {strip(D, 'c')}), chr(10)) as comments from pages")
def _comments(x):
    """Bodies of hidden comments in pages, in their order."""
    whole, body = injection.embedded_comments(S, "html")
    return x.table("pages").select("page_id", F.expr(f"array_join(transform(filter(transform({whole}, m -> {body}), c -> c <> ''), c -> {strip(S, 'c')}), '\n')").alias("comments"))


define("txt_variants", lambda x: injection.text_variants(x.texts))
define("inj_scan_text", lambda x: injection.scan_texts(x.texts).drop("ord"), "select * from text_injection")
_found = "select patch_id, rule_id, severity, source, file, line, evidence from injection"
_seven = ["patch_id", "rule_id", "severity", "source", "file", "line", "evidence"]
define("inj_scan_patch", lambda x: x.injection.select(*_seven), _found)
for _key, _id in rules.INJECTION_KEYS.items():
    define(_key, lambda x, i=_id: injection.scan_texts(x.texts).filter(F.col("rule_id") == i).drop("ord"), f"select * from text_injection where rule_id = '{_id}'")
_k = "(case " + " ".join(f"when {D.matches('text', p, 'i')} then {i}" for i, (p, _) in enumerate(rules.LEGACY)) + " end)"
_span = "(case k " + " ".join(f"when {i} then {D.extract('text', p, 0, 'i')}" for i, (p, _) in enumerate(rules.LEGACY)) + " end)"
_why = "(case k " + " ".join(f"when {i} then {D.text(w)}" for i, (_, w) in enumerate(rules.LEGACY)) + " end)"
define("inj_legacy_regex", lambda x: injection.legacy_regex(x.texts), f"select text_id, 'CRITICAL' as status, 1.0::double as confidence, 'Fast-layer regex detected a ' || {_why} || '. Matched text: ''' || substr(trim({_span}), 1, 80) || '''' as reason, 'regex' as layer from (select *, {_k} as k from texts) where k is not null")


def _stub_labels(texts: DataFrame) -> DataFrame:
    """Stand-in scores of a classifier, from the text's md5, for the decision rules."""
    share = lambda k: F.expr(f"round(cast(conv(substring(md5(text), {1 + 4 * k}, 4), 16, 10) as double) / 65535, 6)")
    rows = texts.select("text_id", F.explode(F.array(*[F.struct(F.lit(label).alias("label"), share(k).alias("score")) for k, label in enumerate(rules.LEGACY_LABELS)])).alias("s"))
    return rows.select("text_id", "s.label", "s.score")


_p = lambda k: f"round(('0x' || substr(md5(text), {1 + 4 * k}, 4))::bigint / 65535.0::double, 6)"
_legacy_sql = f"""select text_id, case when layer = 'validation' then 'WARNING' when layer = 'regex' then 'CRITICAL' when bug > 0.8 then 'SAFE' when bad > 0.5 then 'FLAGGED' else 'WARNING' end as status,
    case when layer = 'validation' then 0.0::double when layer = 'regex' then 1.0::double else round(case when bug > 0.8 then bug when bad > 0.5 then bad else top end, 4) end as confidence, layer
    from (select text_id, {_p(0)} as bug, greatest({_p(2)}, {_p(3)}) as bad, greatest({_p(0)}, {_p(1)}, {_p(2)}, {_p(3)}) as top,
    case when trim(text) = '' then 'validation' when {' or '.join(D.matches('text', p, 'i') for p, _ in rules.LEGACY)} then 'regex' else 'ai' end as layer from texts)"""
define("inj_legacy_scan", lambda x: injection.legacy_scan(x.texts, _stub_labels(x.texts)), _legacy_sql)
define("inj_legacy_batch", lambda x: injection.legacy_scan(x.texts, _stub_labels(x.texts.join(injection.legacy_regex(x.texts), "text_id", "left_anti"))), _legacy_sql)
define("inj_ml_chunks", lambda x: injection.chunk_lines(x.texts))
define("inj_ml_score", lambda x: injection.chunk_lines(x.texts).groupBy("text_id").agg(F.round(F.max(F.expr(injection.stub_score("text"))), 9).alias("score"), F.bool_or("partial").alias("partial")))
define("inj_ml_text", lambda x: injection.ml_texts(x.texts, 0.9))
_hash = "(('0x' || substr(md5(content), 1, 8))::bigint / 4294967296.0::double)"
define("inj_ml_patch", lambda x: injection.ml_comments(x.segments, 0.5).drop("status"), f"select patch_id, 'INJ_ML' as rule_id, 'MEDIUM' as severity, 'comment' as source, file, line_no as line, substr(content, 1, 200) as evidence, round({_hash.replace('4294967296', '4294967295')}, 6) as score from segments where {_hash.replace('4294967296', '4294967295')} >= 0.5")
define("inj_ml_loader", lambda x: injection.not_run(x.texts, "no model installed"), "select text_id, 'INJ_ML' as rule_id, 'REVIEW' as severity, 'model' as source, 0 as line, '' as evidence, cast(null as double) as score, 'NOT RUN (no model installed)' as status from texts")


@query("inj_all_text")
def _all_text(x):
    """Pattern findings of texts and those model findings that stand on other lines."""
    found = injection.scan_texts(x.texts).drop("ord")
    model = injection.ml_texts(x.texts, 0.9).unionByName(injection.not_run(x.texts, "disabled"))
    return injection.combine(found, model, ["text_id", "line"])


_h = _hash.replace("4294967296", "4294967295")


@query("inj_all_patch", f"select patch_id, rule_id, severity, source, file, line, evidence, cast(null as double) as score from injection union all select s.patch_id, 'INJ_ML', 'MEDIUM', 'comment', s.file, s.line_no, substr(content, 1, 200), round({_h}, 6) from segments s where {_h} >= 0.3 and not exists (select 1 from injection i where i.patch_id = s.patch_id and i.file = s.file and i.line = s.line_no)")
def _all_patch(x):
    return injection.combine(x.injection.drop("ord"), injection.ml_comments(x.segments, 0.3), ["patch_id", "file", "line"]).drop("status")


# ---- Issue versus patch ---------------------------------------------------------
_joined = lambda df, c: df.select("instance_id", F.array_join(c, "|").alias(c))
define("heur_named_items", lambda x: _joined(heuristics.named_items(x.issues), "named"), "select instance_id, array_to_string(named, '|') as named from named")
define("heur_issue_idents", lambda x: _joined(heuristics.issue_identifiers(x.issues), "idents"), "select instance_id, array_to_string(idents, '|') as idents from idents")
define("heur_issue_literals", lambda x: heuristics.issue_literals(x.issues).select("instance_id", F.array_join("strings", "|").alias("strings"), F.array_join("numbers", "|").alias("numbers")), "select instance_id, array_to_string(strings, '|') as strings, array_to_string(numbers, '|') as numbers from literals")
_r9 = lambda df, *cs: df.withColumns({c: F.round(c, 9) for c in cs})
_place = "rule_id, severity, file, line, evidence"
define("heur1_file_overlap", lambda x: _r9(heuristics.file_overlap(x.lines, x.patches, x.issues), "fraction_touched_named"), f"select patch_id, round(fraction_touched_named, 9) as fraction_touched_named, any_named_untouched, {_place} from file_overlap")
define("heur2_ident_overlap", lambda x: _r9(heuristics.identifier_overlap(x.lines, x.patches, x.issues), "issue_identifier_overlap_frac"), f"select patch_id, round(issue_identifier_overlap_frac, 9) as issue_identifier_overlap_frac, {_place} from identifier_overlap")
define("heur3_literal_hardcoding", lambda x: six(heuristics.line_findings(x.lines, heuristics.issue_facts(x.patches, x.issues), ["literal_hardcoding"])), f"select {SIX} from literal_hardcoding")
for _name, _key in (("heur4_special_casing", "special_casing"), ("heur5_swallowed_exc", "swallowed_exception"), ("heur6_test_tampering", "test_tampering"), ("heur7_suppression", "suppression_marker")):
    define(_name, lambda x, k=_key: six(heuristics.line_findings(x.lines, keys=[k])), f"select {SIX} from {_key}")
define("heur8_scope_creep", lambda x: _r9(heuristics.scope_creep(x.lines, x.patches, x.issues), "scope_creep_fraction"), "select patch_id, scope_creep_count, round(scope_creep_fraction, 9) as scope_creep_fraction from scope_creep")
define("heur8_scope_findings", lambda x: six(heuristics.scope_findings(heuristics.file_rules(x.lines, x.patches, heuristics.issue_facts(x.patches, x.issues)))), f"select {SIX} from scope_findings")
_rules_sql = [f"select {SIX} from {k}" for k in ("literal_hardcoding", "special_casing", "swallowed_exception", "test_tampering", "suppression_marker", "scope_findings")] + [f"select {SIX} from {k} where rule_id is not null" for k in ("file_overlap", "identifier_overlap")]
define("heur_findings", lambda x: heuristics.findings(x.lines, x.patches, x.issues), " union all ".join(_rules_sql))
_feature_sql = "select patch_id, " + ", ".join(f"round({c}, 9) as {c}" for c in rules.FEATURES) + " from features"
define("heur_all", lambda x: _r9(heuristics.features(x.lines, x.patches, x.issues), *rules.FEATURES), _feature_sql)
define("heur_dataset", lambda x: _r9(heuristics.features(x.lines, x.patches, x.issues), *rules.FEATURES).join(x.patches.select("patch_id", "instance_id", "submission", "split", "resolved"), "patch_id"), _feature_sql.replace("select patch_id", "select f.patch_id, instance_id, submission, split, resolved").replace("from features", "from features f join patches p on p.patch_id = f.patch_id"))
define("heur_fire", lambda x: heuristics.fire(x.lines, x.patches, x.issues), "select patch_id, rule_1, rule_2, rule_3, rule_4, rule_5, rule_6, rule_7, rule_8 from fire")

# ---- Verdicts -------------------------------------------------------------------
define("win_dedup_first", lambda x: six(verdict.deduplicate(x.findings)), f"select {SIX} from (select *, row_number() over (partition by patch_id, rule_id, file, line, evidence order by layer, ord, severity) as n from findings) where n = 1")
define("agg_dedup_count", lambda x: verdict.duplicates(x.findings), "select patch_id, count(*) - count(distinct (rule_id, file, line, evidence)) as collapsed from findings group by 1")
V = verdict
_verdicts = f"""select p.patch_id, case when high and inj then '{V.MANUAL} {V.INJECTED}' when high then '{V.MANUAL}' when inj and med then '{V.RISKY} {V.INJECTED}' when inj then '{V.INJECTED}' when med then '{V.RISKY}' when low then '{V.NOTES}' else '{V.CLEAN}' end as verdict,
    case when high then 2 when inj or med then 1 else 0 end as exit_code from patches p left join (select patch_id, bool_or(rule_id like 'INJ%') as inj, bool_or(rule_id not like 'INJ%' and upper(severity) in ('HIGH', 'CRITICAL')) as high,
    bool_or(rule_id not like 'INJ%' and upper(severity) = 'MEDIUM') as med, bool_or(rule_id not like 'INJ%' and upper(severity) in ('LOW', 'REVIEW')) as low from findings group by 1) f on f.patch_id = p.patch_id"""
define("agg_verdict", lambda x: verdict.verdicts(x.findings, x.patches), _verdicts)
_kept = "(select * from findings qualify row_number() over (partition by patch_id, rule_id, file, line, evidence order by layer, ord, severity) = 1)"
_entry = "'{\"rule_id\":' || to_json(rule_id) || ',\"severity\":' || to_json(severity) || case when file is null then '' else ',\"file\":' || to_json(file) end || ',\"line\":' || line || ',\"evidence\":' || to_json(evidence) || '}'"
_listed = f"select patch_id, count(*) as n, string_agg({_entry}, ',' order by layer, ord, rule_id, severity) as entries from {_kept} group by 1"
_collapsed = "select patch_id, count(*) - count(distinct (rule_id, file, line, evidence)) as k from findings group by 1"
_payload = f"""'{{"verdict":' || to_json(verdict) || ',"exit_code":' || exit_code || ',"security":"ok","injection":"ok","findings":[' || coalesce(entries, '') || '],"duplicates_collapsed":' || coalesce(k, 0) || ',"experimental":"NOT RUN (no model installed)","footer":' || to_json('{V.FOOTER}') || '}}'"""
define("sink_audit_json", lambda x: verdict.audit_json(x.findings, x.patches), f"select v.patch_id, coalesce(n, 0) as n_findings, {_payload} as payload from ({_verdicts}) v left join ({_listed}) l on l.patch_id = v.patch_id left join ({_collapsed}) c on c.patch_id = v.patch_id")
define("sink_audit_text", lambda x: six(verdict.deduplicate(x.findings)).withColumn("evidence", F.substring("evidence", 1, 120)), f"select patch_id, rule_id, severity, file, line, substr(evidence, 1, 120) as evidence from (select *, row_number() over (partition by patch_id, rule_id, file, line, evidence order by layer, ord, severity) as n from findings) where n = 1")
