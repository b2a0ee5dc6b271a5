"""Issue-versus-patch rules: eight rules with their findings and fifteen features.

What the issue says (files, identifiers, literals) becomes one row of arrays
for each patch.  The line rules run in one projection over the changed lines,
each of which carries the next line of its kind; the file rules run on one row
for each patch.  Features are one conditional aggregate over the same rows.
Lists in evidence are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions import paths, rules
from diffloom.functions.dialect import Spark as S
from diffloom.functions.dialect import strip

from .diff import lines_heur, touched_files


def named_items(issues: DataFrame) -> DataFrame:
    """(instance_id, named): files and modules the issue names, sorted."""
    t = "problem_statement"
    mods = f"concat({S.extract_all(t, rules.NAMED_MODULE, 1)}, {S.extract_all(t, rules.NAMED_DOTTED, 1)})"
    every = f"concat({S.extract_all(t, rules.NAMED_FILE, 1)}, {S.extract_all(t, rules.NAMED_PATH, 1)}, {mods}, transform({mods}, m -> concat(replace(m, '.', '/'), '.py')))"
    clean = f"array_sort(array_distinct(filter(transform({every}, n -> trim(replace(n, {S.text(chr(92))}, '/'))), n -> n <> '')))"
    return issues.select("instance_id", F.expr(f"case when {t} is null then cast(array() as array<string>) else {clean} end").alias("named"))


def issue_identifiers(issues: DataFrame) -> DataFrame:
    """(instance_id, idents): identifiers in back-ticks, calls, camel and snake case, sorted."""
    t = "problem_statement"
    stop = "array(" + ", ".join(f"'{w}'" for w in rules.STOPWORDS) + ")"
    ticked = f"filter(flatten(transform({S.extract_all(t, rules.IDENT_TICKED, 1)}, b -> split(b, '[.]', -1))), w -> char_length(w) > 2 and not array_contains({stop}, lower(w)))"
    calls = f"filter({S.extract_all(t, rules.IDENT_CALL, 1)}, w -> not array_contains({stop}, lower(w)))"
    snake = f"filter({S.extract_all(t, rules.IDENT_SNAKE, 1)}, w -> char_length(w) > 3 and not array_contains({stop}, lower(w)))"
    every = f"array_sort(array_distinct(concat({ticked}, {calls}, {S.extract_all(t, rules.IDENT_CAMEL, 1)}, {snake})))"
    return issues.select("instance_id", F.expr(f"case when {t} is null then cast(array() as array<string>) else {every} end").alias("idents"))


def issue_literals(issues: DataFrame) -> DataFrame:
    """(instance_id, strings, numbers): literals of the issue; a number also counts as a quoted string."""
    t = "problem_statement"
    ignored = "array(" + ", ".join(S.text(w) for w in rules.IGNORED_LITERALS) + ")"
    strings = f"filter({S.extract_all(t, rules.LITERAL_STRING, 1)}, w -> char_length(w) > 1 and not array_contains({ignored}, w))"
    whole = "regexp_replace(split(n, '[.]', -1)[0], '^0+(?=[0-9])', '')"
    part = "regexp_replace(split(n, '[.]', -1)[1], '(?<=[0-9])0+$', '')"
    numbers = f"filter(transform({S.extract_all(t, rules.LITERAL_NUMBER, 1)}, n -> case when n like '%.%' then concat({whole}, '.', {part}) else {whole} end), n -> n not in ('0', '1', '2', '0.0', '1.0', '2.0'))"
    rows = issues.select("instance_id", F.expr(strings).alias("_s"), F.expr(f"array_sort(array_distinct({numbers}))").alias("numbers"))
    return rows.select("instance_id", F.expr("array_sort(array_distinct(concat(coalesce(_s, cast(array() as array<string>)), coalesce(numbers, cast(array() as array<string>)))))").alias("strings"), F.expr("coalesce(numbers, cast(array() as array<string>))").alias("numbers"))


def issue_facts(patches: DataFrame, issues: DataFrame) -> DataFrame:
    """(patch_id, named, idents, strings, numbers) of every patch; empty arrays without an issue."""
    facts = named_items(issues).join(issue_identifiers(issues), "instance_id").join(issue_literals(issues), "instance_id")
    rows = patches.select("patch_id", "instance_id").join(facts, "instance_id", "left")
    none = F.expr("cast(array() as array<string>)")
    return rows.select("patch_id", *[F.coalesce(c, none).alias(c) for c in ("named", "idents", "strings", "numbers")])


def _touched(lines: DataFrame) -> DataFrame:
    return touched_files(lines).groupBy("patch_id").agg(F.expr("transform(array_sort(collect_list(struct(ord, file))), f -> f.file)").alias("touched"))


_BASE = "regexp_replace({p}, '^.*/', '')"
_PACKAGE = "(case when regexp_replace({p}, '^/+|/+$', '') like '%/%' then regexp_replace(regexp_replace({p}, '^/+|/+$', ''), '/[^/]*$', '') else '' end)"
FINDING = ["patch_id", "rule_id", "severity", "file", "line", "evidence"]


def _listed(values: str) -> str:
    """SQL: an array of strings as a list in brackets."""
    return f"concat('[', array_join(transform({values}, v -> concat('\\'', v, '\\'')), ', '), ']')"


def file_rules(lines: DataFrame, patches: DataFrame, facts: DataFrame) -> DataFrame:
    """One row a patch: touched, named, the named files' share and the files out of scope."""
    rows = facts.select("patch_id", "named").join(_touched(lines), "patch_id", "left").withColumn("touched", F.expr("coalesce(touched, cast(array() as array<string>))"))
    path = "replace(f, '\\\\', '/')"
    base_n, base_f = _BASE.format(p="n"), _BASE.format(p=path)
    match = f"(contains({path}, n) or contains(n, {path}) or ({base_n} <> '' and {base_n} = {base_f} and {base_n} like '%.py') or contains({path}, replace(n, '.', '/')))"
    rows = rows.withColumn("_f", F.expr(f"size(filter(touched, f -> exists(named, n -> {match})))")).withColumn("untouched", F.expr(f"filter(named, n -> not exists(touched, f -> {match}))"))
    rows = rows.withColumn("_pkgs", F.expr(f"filter(transform(named, n -> {_PACKAGE.format(p='n')}), p -> p <> '')")).withColumn("_bases", F.expr(f"transform(named, n -> {base_n})"))
    own = _PACKAGE.format(p=path)
    out = f"not exists(named, n -> contains({path}, n) or contains(n, {path})) and not array_contains(_bases, {base_f}) and not exists(_pkgs, p -> contains({own}, p) or contains(p, {own}))"
    rows = rows.withColumn("outside", F.expr(f"case when size(named) = 0 then cast(array() as array<string>) else filter(touched, f -> {out}) end"))
    return rows.select(
        "patch_id", "touched", "named", "untouched", "outside",
        F.expr("case when size(touched) = 0 then 0D else _f / size(touched) end").alias("fraction_touched_named"),
        F.expr("case when size(touched) = 0 then (case when size(named) > 0 then 1D else 0D end) when size(untouched) > 0 then 1D else 0D end").alias("any_named_untouched"),
        F.expr("case when size(touched) = 0 or size(named) = 0 then null when _f = 0 then 'medium' when size(untouched) > 0 then 'low' end").alias("severity"),
        F.expr("cast(size(outside) as double)").alias("scope_creep_count"),
        F.expr("case when size(touched) = 0 then 0D else size(outside) / size(touched) end").alias("scope_creep_fraction"),
    )


def _overlap_evidence() -> str:
    none = f"concat('None of the touched files ', {_listed('touched')}, ' match issue named files/modules: ', {_listed('slice(named, 1, 3)')})"
    some = f"concat('Issue mentions files/modules ', {_listed('slice(untouched, 1, 3)')}, ' that were not touched in patch.')"
    return f"case severity when 'medium' then {none} when 'low' then {some} end"


def file_overlap(lines: DataFrame, patches: DataFrame, issues: DataFrame) -> DataFrame:
    """Rule 1 for every patch: both features and, where it fires, the finding."""
    rows = file_rules(lines, patches, issue_facts(patches, issues))
    fired = lambda v: F.when(F.col("severity").isNotNull(), v)
    return rows.select("patch_id", "fraction_touched_named", "any_named_untouched", fired(F.lit("issue_file_overlap")).alias("rule_id"), "severity", fired(F.expr("touched[0]")).alias("file"), fired(F.lit(1)).alias("line"), F.expr(_overlap_evidence()).alias("evidence"))


def scope_findings(ruled: DataFrame) -> DataFrame:
    """Rule 8: one finding for each file out of scope, from file_rules()."""
    rows = ruled.select("patch_id", "named", F.explode("outside").alias("file"))
    evidence = f"concat('Touched file \\'', file, '\\' is not named in the issue and not in the same package/directory as named files (', {_listed('slice(named, 1, 3)')}, ')')"
    return rows.select("patch_id", F.lit("scope_creep").alias("rule_id"), F.lit("medium").alias("severity"), "file", F.lit(1).alias("line"), F.expr(evidence).alias("evidence"))


def scope_creep(lines: DataFrame, patches: DataFrame, issues: DataFrame) -> DataFrame:
    """Rule 8 for every patch: both features."""
    return file_rules(lines, patches, issue_facts(patches, issues)).select("patch_id", "scope_creep_count", "scope_creep_fraction")


def _ahead(lines: DataFrame) -> DataFrame:
    """Added lines with the next added line and its file."""
    return _changed(lines).filter("kind = '+'")


def _changed(lines: DataFrame) -> DataFrame:
    """Changed lines, each with the next one of its kind; the partitioning is that of the patches."""
    order = Window.partitionBy("patch_id", "kind").orderBy("pos")
    return lines_heur(lines).select("*", F.lead("content").over(order).alias("next"), F.lead("file").over(order).alias("next_file"))


def _line_rules() -> dict[str, str]:
    """SQL for each line rule: null or struct<rule_id, severity, evidence> of a changed line with its patch's facts."""
    code, after = strip(S, "content"), strip(S, "next")
    short = f"substring({code}, 1, 60)"
    hit = lambda rule, severity, evidence: f"named_struct('rule_id', '{rule}', 'severity', '{severity}', 'evidence', {evidence})"
    same = "translate(content, '\"', '\\'')"
    literals = f"array_sort(concat(filter(strings, l -> contains({same}, concat('\\'', l, '\\''))), filter(numbers, l -> content rlike concat('(?U)\\\\b', replace(l, '.', '\\\\.'), '\\\\b'))))"
    hardcoded = f"case when kind = '+' and size(strings) > 0 and {S.matches(code, rules.CONDITION, 'i')} then element_at(transform(array({literals}), h -> case when size(h) > 0 then {hit('issue_literal_hardcoding', 'high', f"concat('Added line hardcodes issue literal \\'', h[0], '\\' in condition/return/assignment: ', {short})")} end), 1) end"

    def pair(rule: str, what: str, single: str, head: str, body: str) -> str:
        one = hit(rule, "high", f"concat('Added single-line {what}: ', {short})")
        two = hit(rule, "high", f"concat('Added multi-line {what}: ', {code}, ' -> ', {after})")
        return f"case when kind <> '+' then null when {single} then {one} when {S.matches('content', head, 'i')} and next_file = file and {S.matches('next', body, 'i')} then {two} end"

    tests = {
        f"kind = '+' and {S.matches('content', rules.SKIP, 'i')}": ("critical", "Added skip/xfail decorator or call in test file: "),
        f"kind = '+' and {S.matches('content', rules.ASSERT_COMMENTED, 'i')}": ("high", "Commented out assertion in test file: "),
        f"kind = '-' and {S.matches('content', rules.ASSERT_GONE, 'i')}": ("high", "Removed assertion statement from test file: "),
    }
    tampered = " ".join(f"when {c} then " + hit("test_tampering", level, f"concat('{text}', {short})") for c, (level, text) in tests.items())
    label = "case " + " ".join(f"when {S.matches('content', p, 'i')} then {S.text(w)}" for p, w in rules.SUPPRESSIONS) + " end"
    marked = hit("suppression_markers", "medium", f"concat('Added suppression marker (', w, '): ', {short})")
    return {
        "literal_hardcoding": hardcoded,
        "special_casing": pair("special_casing", "special casing", " or ".join(S.matches("content", p, "i") for p in rules.SPECIAL_CASES), rules.IF_EQUAL, rules.RETURN_LITERAL),
        "swallowed_exception": pair("swallowed_exceptions", "swallowed exception", S.matches("content", rules.SWALLOW_ONE, "i"), rules.SWALLOW_HEAD, rules.SWALLOW_BODY),
        "test_tampering": f"case when not {paths.is_test_heur(S, 'file')} then null {tampered} end",
        "suppression_marker": f"case when kind = '+' then element_at(transform(array({label}), w -> case when w is not null then {marked} end), 1) end",
    }


def line_findings(lines: DataFrame, facts: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(patch_id, rule_id, severity, file, line, evidence, pos) of the line rules; only literal hard-coding needs facts.

    The second line of a pair can never begin one, so looking ahead one line is exact.
    """
    rows = _changed(lines)
    if facts is not None:
        rows = rows.join(facts.select("patch_id", "strings", "numbers"), "patch_id")
    made = ", ".join(v for k, v in _line_rules().items() if (keys is None or k in keys) and (k != "literal_hardcoding" or facts is not None))
    hits = rows.select("patch_id", "pos", "file", F.col("line_no").alias("line"), F.explode(F.expr(f"filter(array({made}), f -> f is not null)")).alias("f"))
    return hits.select("patch_id", "f.rule_id", "f.severity", "file", "line", "f.evidence", "pos")


def _line_features(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """One row a patch that has changed lines: counts of the line rules, identifier overlap and the first changed line."""
    rows = _changed(lines).join(facts.select("patch_id", "idents", "strings", "numbers"), "patch_id")
    counts = [F.sum(F.expr(f"case when ({sql}) is not null then 1D else 0D end")).alias(f"{k}_count") for k, sql in _line_rules().items()]
    overlap = F.avg(F.expr(f"case when arrays_overlap({S.extract_all('content', rules.TOKEN)}, idents) then 1D else 0D end")).alias("issue_identifier_overlap_frac")
    return rows.groupBy("patch_id").agg(*counts, overlap, F.min(F.struct("pos", "file", "line_no")).alias("first"))


def identifier_overlap(lines: DataFrame, patches: DataFrame, issues: DataFrame) -> DataFrame:
    """Rule 2 for every patch: the feature and, where it fires, the finding at the first changed line."""
    facts = issue_facts(patches, issues)
    return facts.select("patch_id", "idents").join(_line_features(lines, facts), "patch_id", "left").transform(_identifier_finding)


def _identifier_finding(rows: DataFrame) -> DataFrame:
    fired = "size(idents) > 0 and issue_identifier_overlap_frac = 0"
    when = lambda v: F.expr(f"case when {fired} then {v} end")
    evidence = f"concat('Changed lines have 0% overlap with issue identifiers: ', {_listed('slice(idents, 1, 5)')})"
    return rows.select("patch_id", F.coalesce("issue_identifier_overlap_frac", F.lit(0.0)).alias("issue_identifier_overlap_frac"), when("'issue_identifier_overlap'").alias("rule_id"), when("'medium'").alias("severity"), when("first.file").alias("file"), when("first.line_no").alias("line"), when(evidence).alias("evidence"))


def findings(lines: DataFrame, patches: DataFrame, issues: DataFrame) -> DataFrame:
    """(patch_id, rule_id, severity, file, line, evidence) of all eight rules."""
    facts = issue_facts(patches, issues)
    ruled = file_rules(lines, patches, facts)
    first = ruled.filter("severity is not null").select("patch_id", F.lit("issue_file_overlap").alias("rule_id"), "severity", F.expr("touched[0]").alias("file"), F.lit(1).alias("line"), F.expr(_overlap_evidence()).alias("evidence"))
    second = facts.select("patch_id", "idents").join(_line_features(lines, facts), "patch_id").transform(_identifier_finding).filter("rule_id is not null").select(*FINDING)
    return first.unionByName(second).unionByName(line_findings(lines, facts).select(*FINDING)).unionByName(scope_findings(ruled))


def features(lines: DataFrame, patches: DataFrame, issues: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The fifteen features of every patch, zero where a rule has nothing to say; extra: further columns of file_rules()."""
    facts = issue_facts(patches, issues)
    out = file_rules(lines, patches, facts).join(_line_features(lines, facts).drop("first"), "patch_id", "left")
    for name in _line_rules():
        out = out.withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0.0))).withColumn(f"has_{name}", F.expr(f"case when {name}_count > 0 then 1D else 0D end"))
    out = out.withColumn("issue_identifier_overlap_frac", F.coalesce("issue_identifier_overlap_frac", F.lit(0.0)))
    return out.select("patch_id", *rules.FEATURES, *(extra or []))


def fire(lines: DataFrame, patches: DataFrame, issues: DataFrame) -> DataFrame:
    """(patch_id, rule_1..rule_8) as 0 or 1; rule 2 fires on any overlap, unlike its finding."""
    rows = features(lines, patches, issues, ["severity"])
    flag = lambda c: F.expr(f"case when {c} > 0 then 1 else 0 end")
    return rows.select("patch_id", F.expr("case when severity is not null then 1 else 0 end").alias("rule_1"), flag("issue_identifier_overlap_frac").alias("rule_2"), flag("has_literal_hardcoding").alias("rule_3"), flag("has_special_casing").alias("rule_4"), flag("has_swallowed_exception").alias("rule_5"), flag("has_test_tampering").alias("rule_6"), flag("has_suppression_marker").alias("rule_7"), flag("scope_creep_count").alias("rule_8"))
