"""SQL of the checking engine: named relations and the composition of a query from those it needs."""

from __future__ import annotations

import re
from functools import cache

from diffloom import corpus
from diffloom.functions import paths, rules
from diffloom.functions.dialect import Duck as D
from diffloom.functions.dialect import strip
from diffloom.operators.diff import BREAK
from diffloom.operators.security import ORDER, STEP


def _first(col: str, patterns) -> str:
    return "(case " + " ".join(f"when {D.matches(col, p[0], p[1])} then {k}" for k, p in enumerate(patterns)) + " end)"


def _mask(col: str, patterns) -> str:
    return " + ".join(f"(case when {D.matches(col, p[0], p[1])} then {1 << k} else 0 end)" for k, p in enumerate(patterns))


def _what(k: str, patterns) -> str:
    return f"(case {k} " + " ".join(f"when {i} then {D.text(p[2])}" for i, p in enumerate(patterns)) + " end)"


def _base(p: str) -> str:
    return f"regexp_replace({p}, '^.*/', '')"


def _package(p: str) -> str:
    clean = f"regexp_replace({p}, '^/+|/+$', '', 'g')"
    return f"(case when {clean} like '%/%' then regexp_replace({clean}, '/[^/]*$', '') else '' end)"


@cache
def relations() -> dict[str, str]:
    out = dict(corpus.oracle_ctes())
    run = "over (partition by patch_id order by pos rows between unbounded preceding and current row)"
    parts = f"string_split_regex(patch, {D.text(BREAK)})"
    out["raw_lines"] = f"""select patch_id, unnest(l) as raw, unnest(range(len(l))) as pos from
        (select patch_id, case when {parts}[-1] = '' then {parts}[1:len({parts}) - 1] else {parts} end as l from patches where patch <> '')"""
    hunk = f"try_cast({D.extract('raw', rules.HUNK, 1)} as integer)"
    loose = f"try_cast({D.extract('raw', rules.HUNK_LOOSE, 1)} as integer)"
    out["flags"] = f"""select *, raw like '+++ b/%' as is_header, (raw like '--- %' or raw like 'diff --git%') as is_skip, raw like '@@%' as is_at,
        (raw like '+%' and raw not like '+++%') as added, (raw like '-%' and raw not like '---%') as removed, substr(raw, 2) as content,
        case when raw like '+++ b/%' then {strip(D, 'substr(raw, 7)')} end as header,
        case when raw like '+++ b/%' then 0 when raw like '@@%' then {hunk} end as reset, case when raw like '@@%' then {loose} end as reset_c,
        case when raw like '+%' and raw not like '+++%' then len(regexp_extract_all(raw, '\"\"\"|''''''')) else 0 end as quotes from raw_lines"""
    out["steps"] = """select *, case when reset is not null or is_header or is_skip then 0 when added then 1 when raw like '-%' or raw like '\\%' then 0 else 1 end as inc_s,
        case when reset is not null or is_header or is_skip then 0 when added then 1 when removed or raw like '\\%' then 0 else 1 end as inc_h,
        case when is_header or is_at then 0 when added then 1 when raw like '-%' then 0 else 1 end as inc_c from flags"""
    out["counts"] = f"""select *, coalesce(last_value(header ignore nulls) {run}, '') as file, sum(inc_s) {run} as cum_s, sum(inc_h) {run} as cum_h, sum(inc_c) {run} as cum_c,
        (sum(quotes % 2) {run}) % 2 = 1 as in_docstring from steps"""
    lines = ", ".join(f"cast(coalesce(last_value({r} - cum_{k} ignore nulls) {run}, 0) + cum_{k} - inc_{k} as integer) as line_{k}" for k, r in (("s", "reset"), ("h", "reset"), ("c", "reset_c")))
    out["lines"] = f"select *, file <> '' and not {paths.is_vendored(D, 'file')} as active, {strip(D, 'content')} as stripped from (select *, {lines} from counts)"
    out["added_lines"] = "select patch_id, pos, file, line_s as line_no, content, stripped from lines where active and added"
    out["heur_lines"] = "select patch_id, pos, file, line_h as line_no, substr(raw, 1, 1) as kind, content, stripped from lines where active and (added or removed) and not is_header"
    out["context_lines"] = "select patch_id, pos, file, content from lines where active and not is_skip and not is_at and (raw like ' %' or removed)"
    comment = f"({D.matches('stripped', rules.COMMENT_LINE)} or in_docstring or quotes > 0 or contains(stripped, '/*') or starts_with(stripped, '\"') or starts_with(stripped, ''''))"
    out["segments"] = f"select patch_id, pos, file, line_c as line_no, content from lines where added and {comment}"
    out["named_paths"] = f"""select patch_id, pos, is_header, case when is_header then header else {strip(D, "string_split(raw, ' b/')[2]")} end as file from lines
        where is_header or (raw like 'diff --git a/%' and len(string_split(raw, ' b/')) = 2)"""
    out["touched_any"] = "select patch_id, file, min(pos) as ord from named_paths where file <> '' and not (is_header and file = '/dev/null') group by all"
    out["touched"] = f"select * from touched_any where not {paths.is_vendored(D, 'file')}"
    # Security.
    quiet = f"({paths.is_test_safety(D, 'file')} or {paths.is_scratch(D, 'file')})"
    for r in rules.LINE_RULES:
        rank = ORDER.index(r.rule_id) * STEP
        if r.fixed:
            severity, source = f"'{r.fixed}'", f"select *, {_first('content', r.patterns)} as k from added_lines where not starts_with(stripped, '#')"
        else:
            severity = f"case when {quiet} or exists (select 1 from context_lines c where c.patch_id = f.patch_id and c.file = f.file and ({' or '.join(f'(f.k = {i} and ' + D.matches('c.content', p[0], p[1]) + ')' for i, p in enumerate(r.patterns))})) then 'low' else 'MEDIUM' end"
            source = f"select *, {_first('content', r.patterns)} as k from added_lines where not starts_with(stripped, '#')"
        out[r.key] = f"select f.patch_id, '{r.rule_id}' as rule_id, {severity} as severity, f.file, f.line_no as line, {_what('f.k', r.patterns)} || ': ' || substr(stripped, 1, 120) as evidence, cast({rank} + pos as bigint) as ord from ({source}) f where f.k is not null"
    high = ", ".join(str(i) for i, p in enumerate(rules.CREDENTIALS) if p[3] == "HIGH")
    out["sec005_credentials"] = f"""select patch_id, '{rules.CREDENTIAL_ID}' as rule_id, case when k in ({high}) and not {quiet} then 'HIGH' else 'low' end as severity, file, line_no as line,
        {_what('k', rules.CREDENTIALS)} || ': ' || substr(stripped, 1, 120) as evidence, cast({ORDER.index(rules.CREDENTIAL_ID) * STEP} + pos as bigint) as ord
        from (select *, {_first('content', rules.CREDENTIALS)} as k from added_lines where not starts_with(stripped, '#')) where k is not null"""
    out["sec_vendored"] = f"select patch_id, 'vendored_directory_added' as rule_id, 'review' as severity, file, 1 as line, 'Vendored or virtualenv directory modified: ' || file as evidence, cast(ord as bigint) as ord from touched_any where {paths.is_vendored(D, 'file')}"
    out["sec_scratch"] = f"select patch_id, 'scratch_script_added' as rule_id, 'low' as severity, file, 1 as line, 'Scratch or reproduction script added: ' || file as evidence, cast({STEP} + ord as bigint) as ord from touched where {paths.is_scratch(D, 'file')}"
    manifests = "(case k " + " ".join(f"when {i} then {D.text(t)}" for i, (_, t) in enumerate(paths.MANIFESTS)) + " end)"
    out["sec006_workflow_build"] = f"select patch_id, '{rules.WORKFLOW_ID}' as rule_id, 'MEDIUM' as severity, file, 1 as line, 'Sensitive build/CI file modified: ' || {manifests} || ' (' || file || ')' as evidence, cast({ORDER.index(rules.WORKFLOW_ID) * STEP} + ord as bigint) as ord from (select *, {paths.manifest_hit(D, 'file')} as k from touched) where k is not null"
    config = f"{D.matches('file', rules.GIT_CONFIG, 'i')} and {D.matches('content', rules.GIT_CONFIG_COMMAND, 'i')}"
    rank = ORDER.index(rules.HOOK_ID) * STEP
    out["sec007_hooks"] = f"""select patch_id, '{rules.HOOK_ID}' as rule_id, 'HIGH' as severity, file, 1 as line, 'Git hook file modified: ' || {_what('k', rules.HOOK_FILES)} || ' (' || file || ')' as evidence, cast({rank} + ord as bigint) as ord
        from (select *, {_first('file', rules.HOOK_FILES)} as k from touched_any) where k is not null
        union all select patch_id, '{rules.HOOK_ID}', 'HIGH', file, line_no, case when k = -1 then 'git config hook command' else {_what('k', rules.HOOK_LINES)} end || ': ' || substr(stripped, 1, 120), cast({rank + (STEP >> 1)} + pos as bigint)
        from (select *, case when {config} then -1 else {_first('content', rules.HOOK_LINES)} end as k from added_lines where not starts_with(stripped, '#') and {_first('file', rules.HOOK_FILES)} is null) where k is not null"""
    keys = ["sec_vendored", "sec_scratch", "sec001_network", "sec002_shell_pipe", "sec003_command_exec", "sec004_obfuscation", "sec005_credentials", "sec006_workflow_build", "sec007_hooks", "sec008_dynamic"]
    out["security"] = " union all ".join(f"select * from {k}" for k in keys)
    # Injection on texts as they are after lowering and single white space (the corpus' own ASCII phrases need no more).
    norm = "trim(regexp_replace(lower({t}), '\\s+', ' ', 'g'))"
    out["injection_raw"] = " union all ".join(
        f"select patch_id, '{r}' as rule_id, {k} as pattern, pos, file, line_no as line, 'Prompt injection ({w}): ' || substr({D.extract('norm', p, 0, 'i')}, 1, 120) as evidence from (select *, {norm.format(t='content')} as norm from segments) where {D.matches('norm', p, 'i')}" for k, (r, p, w) in enumerate(rules.INJECTIONS)
    )
    out["injection"] = "select patch_id, rule_id, 'HIGH' as severity, 'comment' as source, file, line, evidence, cast(pos * 100000 + pattern as bigint) as ord from (select *, row_number() over (partition by patch_id, pos, rule_id order by pattern) as n from injection_raw) where n = 1"
    out["findings"] = "select patch_id, rule_id, severity, file, line, evidence, 0 as layer, ord from security union all select patch_id, t.rule_id, 'HIGH', null, cast(coalesce(l.line, 1) as integer), evidence, 1, vord * 100 + pattern from patches p join text_first t on t.text_id = 10 * p.instance_id left join text_places l on l.text_id = t.text_id and l.rule_id = t.rule_id union all select patch_id, rule_id, severity, file, line, evidence, 2, ord from injection"
    # Texts: the plain and leet forms, and payloads in base64; enough for texts without entities, accents or look-alikes.
    leet = f"translate({{t}}, {D.text(''.join(rules.LEET))}, '{''.join(rules.LEET.values())}')"
    packed = f"regexp_replace(unnest(regexp_extract_all(text, {D.text(rules.BASE64)})), '\\s+', '', 'g')"
    out["payloads"] = f"select text_id, text, try(decode(from_base64(p))) as payload from (select text_id, text, {packed} as p from texts) where length(p) >= 16"
    plain, folded = norm.format(t="{t}"), leet.format(t=norm.format(t="{t}"))
    out["text_forms"] = " union all ".join(
        f"select text_id, text, {v} as vord, {form.format(t=col)} as n, {'true' if v % 2 else 'false'} as leet from {src}" for v, (form, col, src) in enumerate(((plain, "text", "texts"), (folded, "text", "texts"), (plain, "payload", "payloads where length(payload) >= 8"), (folded, "payload", "payloads where length(payload) >= 8")))
    )
    out["text_hits"] = " union all ".join(f"select text_id, text, vord, leet, '{r}' as rule_id, {k} as pattern, 'Prompt injection ({w}): ' || substr({D.extract('n', p, 0, 'i')}, 1, 120) as evidence from text_forms where {D.matches('n', p, 'i')}" for k, (r, p, w) in enumerate(rules.INJECTIONS))
    out["text_first"] = "select * from text_hits qualify row_number() over (partition by text_id, rule_id order by vord, pattern) = 1"
    out["text_lines"] = f"select text_id, rule_id, pattern, leet, unnest(string_split_regex(text, {D.text(BREAK)})) as l, unnest(range(1, len(string_split_regex(text, {D.text(BREAK)})) + 1)) as spot from text_first"
    form = f"(case when leet then {folded.format(t='l')} else {plain.format(t='l')} end)"
    on_line = " or ".join(f"(pattern = {k} and {D.matches(form, p, 'i')})" for k, (_, p, _) in enumerate(rules.INJECTIONS))
    out["text_places"] = f"select text_id, rule_id, min(spot) as line from text_lines where {on_line} group by 1, 2"
    out["text_injection"] = "select f.text_id, f.rule_id, 'HIGH' as severity, 'issue' as source, cast(coalesce(p.line, 1) as integer) as line, evidence from text_first f left join text_places p on p.text_id = f.text_id and p.rule_id = f.rule_id"
    # Issue-versus-patch rules.
    t = "problem_statement"
    stop = "[" + ", ".join(f"'{w}'" for w in rules.STOPWORDS) + "]"
    ea = lambda p: D.extract_all(t, p, 1)
    mods = f"list_concat({ea(rules.NAMED_MODULE)}, {ea(rules.NAMED_DOTTED)})"
    every = f"list_concat(list_concat({ea(rules.NAMED_FILE)}, {ea(rules.NAMED_PATH)}), list_concat({mods}, list_transform({mods}, lambda m: replace(m, '.', '/') || '.py')))"
    out["named"] = f"select instance_id, list_sort(list_distinct(list_filter(list_transform({every}, lambda n: trim(replace(n, '\\', '/'))), lambda n: n <> ''))) as named from issues"
    ticked = f"list_filter(flatten(list_transform({ea(rules.IDENT_TICKED)}, lambda b: string_split(b, '.'))), lambda w: length(w) > 2 and not list_contains({stop}, lower(w)))"
    calls = f"list_filter({ea(rules.IDENT_CALL)}, lambda w: not list_contains({stop}, lower(w)))"
    snake = f"list_filter({ea(rules.IDENT_SNAKE)}, lambda w: length(w) > 3 and not list_contains({stop}, lower(w)))"
    out["idents"] = f"select instance_id, list_sort(list_distinct(list_concat(list_concat({ticked}, {calls}), list_concat({ea(rules.IDENT_CAMEL)}, {snake})))) as idents from issues"
    ignored = "[" + ", ".join(D.text(w) for w in rules.IGNORED_LITERALS) + "]"
    whole, part = "regexp_replace(string_split(n, '.')[1], '^0+([0-9])', '\\1')", "regexp_replace(string_split(n, '.')[2], '([0-9])0+$', '\\1')"
    numbers = f"list_sort(list_distinct(list_filter(list_transform({ea(rules.LITERAL_NUMBER)}, lambda n: case when contains(n, '.') then {whole} || '.' || {part} else {whole} end), lambda n: n not in ('0', '1', '2', '0.0', '1.0', '2.0'))))"
    out["literals"] = f"select instance_id, list_sort(list_distinct(list_concat(list_filter({ea(rules.LITERAL_STRING)}, lambda w: length(w) > 1 and not list_contains({ignored}, w)), {numbers}))) as strings, {numbers} as numbers from issues"
    out["touched_list"] = "select patch_id, list(file order by ord) as touched from touched group by patch_id"
    match = f"(contains(f, n) or contains(n, f) or ({_base('n')} <> '' and {_base('n')} = {_base('f')} and {_base('n')} like '%.py') or contains(f, replace(n, '.', '/')))"
    out["pair_lists"] = "select p.patch_id, coalesce(touched, []) as touched, coalesce(named, []) as named from patches p left join touched_list using (patch_id) left join named using (instance_id)"
    # Pairs one by one, then counted: no nested lambdas here.
    out["path_pairs"] = f"select patch_id, f, n, {match} as hit from (select patch_id, f, unnest(named) as n from (select patch_id, named, unnest(touched) as f from pair_lists))"
    listed = lambda v: f"'[' || coalesce(array_to_string(list_transform({v}, lambda v: '''' || v || ''''), ', '), '') || ']'"
    out["overlap_counts"] = "select patch_id, count(distinct case when hit then f end) as fs, count(distinct case when hit then n end) as ns, list_sort(list(distinct n) filter (where hit)) as met from path_pairs group by 1"
    out["overlap_rows"] = """select l.patch_id, touched, named, list_filter(named, lambda n: not coalesce(list_contains(met, n), false)) as untouched, case when len(touched) = 0 then 0.0::double else coalesce(fs, 0) / len(touched)::double end as fraction_touched_named,
        case when len(touched) = 0 then (case when len(named) > 0 then 1.0::double else 0.0::double end) when coalesce(ns, 0) < len(named) then 1.0::double else 0.0::double end as any_named_untouched,
        case when len(touched) = 0 or len(named) = 0 then null when coalesce(fs, 0) = 0 then 'medium' when coalesce(ns, 0) < len(named) then 'low' end as severity
        from pair_lists l left join overlap_counts h using (patch_id)"""
    out["file_overlap"] = f"""select patch_id, fraction_touched_named, any_named_untouched, severity, case when severity is not null then 'issue_file_overlap' end as rule_id, case when severity is not null then touched[1] end as file, case when severity is not null then 1 end as line,
        case severity when 'medium' then 'None of the touched files ' || {listed('touched')} || ' match issue named files/modules: ' || {listed('named[1:3]')} when 'low' then 'Issue mentions files/modules ' || {listed('untouched[1:3]')} || ' that were not touched in patch.' end as evidence from overlap_rows"""
    out["identifier_rows"] = f"""select h.patch_id, avg(case when list_has_any({D.extract_all('content', rules.TOKEN)}, idents) then 1.0::double else 0.0::double end) as frac, any_value(idents) as idents, arg_min(file, pos) as file, arg_min(line_no, pos) as line
        from heur_lines h join patches q on q.patch_id = h.patch_id join idents i on i.instance_id = q.instance_id group by 1"""
    out["identifier_overlap"] = f"""select p.patch_id, coalesce(frac, 0) as issue_identifier_overlap_frac, case when fired then 'issue_identifier_overlap' end as rule_id, case when fired then 'medium' end as severity, case when fired then file end as file, case when fired then line end as line,
        case when fired then 'Changed lines have 0% overlap with issue identifiers: ' || {listed('idents[1:5]')} end as evidence from patches p left join (select *, len(idents) > 0 and frac = 0 as fired from identifier_rows) r on r.patch_id = p.patch_id"""
    same = "translate(content, '\"', '''')"
    out["literal_hits"] = f"""select h.patch_id, file, line_no as line, pos, content, unnest(strings) as l, false as num from heur_lines h join patches q on q.patch_id = h.patch_id join literals t on t.instance_id = q.instance_id where kind = '+' and {D.matches('stripped', rules.CONDITION, 'i')}
        union all select h.patch_id, file, line_no, pos, content, unnest(numbers), true from heur_lines h join patches q on q.patch_id = h.patch_id join literals t on t.instance_id = q.instance_id where kind = '+' and {D.matches('stripped', rules.CONDITION, 'i')}"""
    code, after = strip(D, "content"), strip(D, "next")
    short = f"substr({code}, 1, 60)"
    out["literal_hardcoding"] = f"""select patch_id, 'issue_literal_hardcoding' as rule_id, 'high' as severity, file, line, 'Added line hardcodes issue literal ''' || min(l) || ''' in condition/return/assignment: ' || any_value({short}) as evidence
        from literal_hits where case when num then regexp_matches(content, '\\b' || replace(l, '.', '\\.') || '\\b') else contains({same}, '''' || l || '''') end group by patch_id, file, line, pos"""
    out["ahead"] = "select *, lead(content) over (partition by patch_id order by pos) as next, lead(file) over (partition by patch_id order by pos) as next_file from heur_lines where kind = '+'"
    for key, rule, what, one, head, body in (
        ("special_casing", "special_casing", "special casing", " or ".join(D.matches("content", p, "i") for p in rules.SPECIAL_CASES), rules.IF_EQUAL, rules.RETURN_LITERAL),
        ("swallowed_exception", "swallowed_exceptions", "swallowed exception", D.matches("content", rules.SWALLOW_ONE, "i"), rules.SWALLOW_HEAD, rules.SWALLOW_BODY),
    ):
        out[key] = f"""select patch_id, '{rule}' as rule_id, 'high' as severity, file, line_no as line, case when {one} then 'Added single-line {what}: ' || {short} else 'Added multi-line {what}: ' || {code} || ' -> ' || {after} end as evidence
            from ahead where {one} or ({D.matches('content', head, 'i')} and next_file = file and {D.matches('next', body, 'i')})"""
    form = f"case when kind = '+' and {D.matches('content', rules.SKIP, 'i')} then 'Added skip/xfail decorator or call in' when kind = '+' and {D.matches('content', rules.ASSERT_COMMENTED, 'i')} then 'Commented out assertion in' when kind = '-' and {D.matches('content', rules.ASSERT_GONE, 'i')} then 'Removed assertion statement from' end"
    out["test_tampering"] = f"select patch_id, 'test_tampering' as rule_id, case when form like 'Added%' then 'critical' else 'high' end as severity, file, line, form || ' test file: ' || code as evidence from (select patch_id, file, line_no as line, {form} as form, {short} as code from heur_lines where {paths.is_test_heur(D, 'file')}) where form is not null"
    label = "case " + " ".join(f"when {D.matches('content', p, 'i')} then {D.text(w)}" for p, w in rules.SUPPRESSIONS) + " end"
    out["suppression_marker"] = f"select patch_id, 'suppression_markers' as rule_id, 'medium' as severity, file, line, 'Added suppression marker (' || marker || '): ' || code as evidence from (select patch_id, file, line_no as line, {label} as marker, {short} as code from heur_lines where kind = '+') where marker is not null"
    own = _package("f")
    out["scope_pairs"] = f"select patch_id, f, bool_or(contains(f, n) or contains(n, f)) as by_name, bool_or({_base('n')} = {_base('f')}) as by_base, bool_or({_package('n')} <> '' and (contains({own}, {_package('n')}) or contains({_package('n')}, {own}))) as by_package from path_pairs group by 1, 2"
    out["scope_creep"] = """select l.patch_id, coalesce(files, 0)::double as scope_creep_count, case when len(touched) = 0 then 0.0::double else coalesce(files, 0) / len(touched)::double end as scope_creep_fraction
        from pair_lists l left join (select patch_id, count(*) as files from scope_pairs where not by_name and not by_base and not by_package group by 1) using (patch_id)"""
    counted = ["literal_hardcoding", "special_casing", "swallowed_exception", "test_tampering", "suppression_marker"]
    out["scope_findings"] = f"""select s.patch_id, 'scope_creep' as rule_id, 'medium' as severity, f as file, 1 as line, 'Touched file ''' || f || ''' is not named in the issue and not in the same package/directory as named files (' || {listed('named[1:3]')} || ')' as evidence
        from scope_pairs s join pair_lists l on l.patch_id = s.patch_id where not by_name and not by_base and not by_package"""
    out["features"] = (
        "select f.patch_id, fraction_touched_named, any_named_untouched, issue_identifier_overlap_frac, "
        + ", ".join(f"coalesce(c_{c}.n, 0)::double as {c}_count, case when c_{c}.n > 0 then 1.0::double else 0.0::double end as has_{c}" for c in counted)
        + ", scope_creep_count, scope_creep_fraction from file_overlap f join (select patch_id, issue_identifier_overlap_frac from identifier_overlap) using (patch_id) join scope_creep using (patch_id) "
        + " ".join(f"left join (select patch_id, count(*) as n from {c} group by 1) c_{c} on c_{c}.patch_id = f.patch_id" for c in counted)
    )
    out["fire"] = """select f.patch_id, case when severity is not null then 1 else 0 end as rule_1, case when issue_identifier_overlap_frac > 0 then 1 else 0 end as rule_2, has_literal_hardcoding::integer as rule_3, has_special_casing::integer as rule_4,
        has_swallowed_exception::integer as rule_5, has_test_tampering::integer as rule_6, has_suppression_marker::integer as rule_7, case when scope_creep_count > 0 then 1 else 0 end as rule_8 from features f join (select patch_id, severity from file_overlap) o using (patch_id)"""
    # Scored rows for metrics: labelled documents with two stand-in scores.
    out["scored"] = """select m.model, d.doc_id as id, d.doc_id // 10 as instance_id, d.source as submission, l.quality as label,
        case m.model when 'length' then least(n_chars, 20000) // 200 / 100.0::double else ((d.doc_id * 7919) % 101) / 101.0::double end as score
        from documents d join labels l on l.doc_id = d.doc_id cross join (values ('length'), ('mixed')) m(model)"""
    return out


def split_sql(col: str) -> str:
    """Lines as Python's splitlines() gives them."""
    parts = f"string_split_regex({col}, {D.text(BREAK)})"
    return f"case when {col} = '' then []::varchar[] when {parts}[-1] = '' then {parts}[1:len({parts}) - 1] else {parts} end"


def prioritized_sql(col: str, most: str) -> str:
    must = "(l like '@@%' or l like '---%' or l like '+++%')"
    kept = f"list_filter({split_sql(col)}, lambda l: {must} or l like 'diff %' or l like 'index %' or l like '+%' or l like '-%')"
    fold = f"array_to_string(list_reduce({kept}, lambda s, l: case when {must} or s.n + length(l) + 1 <= {most} then {{'n': s.n + length(l) + 1, 'out': list_append(s.out, l)}} else s end, {{'n': 0::bigint, 'out': []::varchar[]}}).out, chr(10))"
    return f"case when {col} = '' then {col} when length(array_to_string({kept}, chr(10))) <= {most} then array_to_string({kept}, chr(10)) else {fold} end"


def wellformed_sql() -> str:
    """The same fold over a patch's lines, with one struct as its state."""
    fixed = D.replace("patch", rules.GLUED, "{1}\n{2}")
    parts = f"string_split({fixed}, chr(10))"
    num = lambda k: f"coalesce(try_cast(nullif({D.extract('l', rules.HUNK_COUNTS, k)}, '') as bigint), 1)"
    state = lambda o, n, h, e: f"{{'o': {o}, 'n': {n}, 'h': {h}, 'e': {e}}}"
    step = f"""case when s.e <> '' then s when s.o > 0 or s.n > 0 then (case when l like '\\%' then s when l like '+%' then {state('s.o', 's.n - 1', 's.h', 's.e')} when l like '-%' then {state('s.o - 1', 's.n', 's.h', 's.e')}
        when l like ' %' or l = '' then {state('s.o - 1', 's.n - 1', 's.h', 's.e')} else {state('s.o', 's.n', 's.h', "'bad_line_in_hunk'")} end)
        when s.o <> 0 or s.n <> 0 then {state('0', '0', 's.h', "'truncated_or_miscounted_hunk'")} when {D.matches('l', rules.HUNK_COUNTS)} then {state(num(2), num(4), 's.h + 1', 's.e')} else s end"""
    fold = f"list_reduce(ls, lambda s, l: {step}, {{'o': 0::bigint, 'n': 0::bigint, 'h': 0::bigint, 'e': ''}})"
    return f"""select patch_id, resolved, case when blank then 'empty' when not headed then 'missing_file_headers' when f.e <> '' then f.e when f.o <> 0 or f.n <> 0 then 'truncated_or_miscounted_hunk' when f.h = 0 then 'no_hunks' else 'ok' end as reason
        from (select patch_id, resolved, blank, len(list_filter(ls, lambda l: l like '--- %')) > 0 and len(list_filter(ls, lambda l: l like '+++ %')) > 0 as headed, {fold} as f
        from (select patch_id, resolved, {strip(D, 'patch')} = '' as blank, case when {parts}[-1] = '' then {parts}[1:len({parts}) - 1] else {parts} end as ls from patches))"""


def compose(body: str, instead: dict[str, str] | None = None) -> str:
    """A query with every relation it needs, in order of need; `instead` stands in for named ones."""
    known, order = relations() | (instead or {}), []

    def need(text: str) -> None:
        for name in re.findall(r"\b[a-z][a-z0-9_]*\b", text):
            if name in known and name not in order and re.search(rf"(?:from|join)\s+{name}\b", text):
                need(known[name])
                if name not in order:
                    order.append(name)

    need(body)
    return ("with " + ",\n".join(f"{n} as ({known[n]})" for n in order) + "\n" if order else "") + body
