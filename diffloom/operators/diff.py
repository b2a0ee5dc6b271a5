"""Unified diffs as line tables.

One parse serves every rule: the patch is split once, its lines exploded behind
one exchange on the patch id, and running windows over (patch, position) carry
the file name and the three line counters, which differ on purpose:

* `line_s` (added lines): removed lines of any form and `\\` lines do not count;
* `line_h` (issue-versus-patch rules): `---x` without a blank counts;
* `line_c` (comments): a file header does not restart it and header lines count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions import paths, rules
from diffloom.functions.dialect import Spark as S
from diffloom.functions.dialect import strip

_QUOTED = r"^\s*[\"']"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def split_lines(col: str) -> str:
    """SQL: Python's splitlines(); no empty last element."""
    parts = f"element_at(transform(array(split({col}, {S.text(BREAK)}, -1)), p -> case when element_at(p, -1) = '' then slice(p, 1, size(p) - 1) else p end), 1)"  # split once
    return f"case when {col} is null or {col} = '' then cast(array() as array<string>) else {parts} end"


def diff_lines(patches: DataFrame, id_col: str = "patch_id", text_col: str = "patch") -> DataFrame:
    """Every line of every patch with file, counters and flags.

    Null and empty patches have no lines.  Patch ids must be unique.
    """
    rows = patches.select(F.col(id_col).alias("patch_id"), F.col(text_col).alias("_patch")).repartition("patch_id")
    # An outer explode: an inner one would split every patch twice, for a filter on the number of lines.
    rows = rows.select("patch_id", F.posexplode_outer(F.expr(split_lines("_patch"))).alias("pos", "raw")).filter("pos is not null")
    rows = rows.select(
        "*",
        F.expr("raw like '+++ b/%'").alias("is_header"),
        F.expr("raw like '--- %' or raw like 'diff --git%'").alias("is_skip"),
        F.expr("raw like '@@%'").alias("is_at"),
        F.expr("raw like '+%' and raw not like '+++%'").alias("added"),
        F.expr("raw like '-%' and raw not like '---%'").alias("removed"),
    )
    hunk = f"case when is_at then {S.integer(S.extract('raw', rules.HUNK, 1))} end"
    loose = f"case when is_at then {S.integer(S.extract('raw', rules.HUNK_LOOSE, 1))} end"
    content = strip(S, "substring(raw, 2)")
    quotes = "(char_length(raw) - char_length(replace(replace(raw, '\"\"\"', ''), \"'''\", ''))) div 3"
    rows = rows.select(
        "*",
        F.expr(f"case when is_header then {strip(S, 'substring(raw, 7)')} end").alias("header"),
        F.expr(f"case when is_header then 0 when not is_skip then {hunk} end").alias("reset"),
        F.expr(f"case when not is_header then {loose} end").alias("reset_c"),
        F.expr(f"case when added then {quotes} else 0 end").alias("quotes"),
        F.expr("case when is_header or is_skip then 0 when raw like '+%' and raw not like '+++%' then 1 when raw like '-%' or raw like '\\\\\\\\%' then 0 else 1 end").alias("inc_s"),
        F.expr("case when is_header or is_skip then 0 when raw like '+%' and raw not like '+++%' then 1 when (raw like '-%' and raw not like '---%') or raw like '\\\\\\\\%' then 0 else 1 end").alias("inc_h"),
        F.expr("case when is_header or is_at then 0 when raw like '+%' and raw not like '+++%' then 1 when raw like '-%' then 0 else 1 end").alias("inc_c"),
    )
    rows = rows.withColumn("inc_s", F.expr("case when reset is null then inc_s else 0 end")).withColumn("inc_h", F.expr("case when reset is null then inc_h else 0 end"))
    run = Window.partitionBy("patch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "*",
        F.last("header", ignorenulls=True).over(run).alias("file"),
        *[F.sum(f"inc_{k}").over(run).alias(f"cum_{k}") for k in "shc"],
        (F.sum(F.col("quotes") % 2).over(run) % 2 == 1).alias("in_docstring"),
    )
    marks = {"s": "reset", "h": "reset", "c": "reset_c"}
    for k, reset in marks.items():
        base = F.last(F.when(F.col(reset).isNotNull(), F.col(reset) - F.col(f"cum_{k}")), ignorenulls=True).over(run)
        rows = rows.withColumn(f"line_{k}", (F.coalesce(base, F.lit(0)) + F.col(f"cum_{k}") - F.col(f"inc_{k}")).cast("int"))
    rows = rows.withColumn("file", F.coalesce("file", F.lit("")))
    rows = rows.withColumn("vendored", F.expr(paths.is_vendored(S, "file")))
    return rows.withColumn("active", F.expr("file <> '' and not vendored")).withColumn("content", F.expr("substring(raw, 2)"))


def lines_heur(lines: DataFrame) -> DataFrame:
    return lines.filter("active and (added or removed) and not is_header").select("patch_id", "pos", F.col("file"), F.col("line_h").alias("line_no"), F.expr("substring(raw, 1, 1)").alias("kind"), "content")


def added_lines(lines: DataFrame) -> DataFrame:
    return lines.filter("active and added").select("patch_id", "pos", "file", F.col("line_s").alias("line_no"), "content")


def context_lines(lines: DataFrame) -> DataFrame:
    return lines.filter("active and not is_skip and not is_at and (raw like ' %' or removed)").select("patch_id", "pos", "file", "content")


def is_comment() -> str:
    """SQL: whether an added line is a comment, in a docstring or a string."""
    return f"(in_docstring or quotes > 0 or contains(content, '/*') or {S.matches('content', rules.COMMENT_LINE)} or {S.matches('content', _QUOTED)})"


def flagged(lines: DataFrame, reported: str) -> DataFrame:
    """The lines that name files, are comments or meet `reported`, of all lines: what the scans of a patch look at."""
    return lines.filter(F.expr(f"is_header or raw like 'diff --git a/%' or (added and {is_comment()}) or {reported}"))


def comment_segments(lines: DataFrame) -> DataFrame:
    """Added comment, docstring and string lines; vendored files included."""
    return lines.filter("added").filter(F.expr(is_comment())).select("patch_id", "pos", "file", F.col("line_c").alias("line_no"), "content")


def touched_files(lines: DataFrame, vendored: bool = False) -> DataFrame:
    """(patch_id, file, ord): distinct touched paths in order of appearance."""
    git = "raw like 'diff --git a/%' and size(split(raw, ' b/', -1)) = 2"
    name = f"case when is_header then header when {git} then {strip(S, 'element_at(split(raw, \" b/\", -1), 2)')} end"
    named = lines.filter(F.expr(f"is_header or ({git})")).select("patch_id", "pos", F.expr(name).alias("file"), "is_header")
    named = named.filter("file <> '' and not (is_header and file = '/dev/null')")
    if not vendored:
        named = named.filter(F.expr(f"not {paths.is_vendored(S, 'file')}"))
    return named.groupBy("patch_id", "file").agg(F.min("pos").alias("ord"))


def _kept(col: str) -> str:
    return f"filter({split_lines(col)}, l -> (l like '+%' and l not like '+++%') or (l like '-%' and l not like '---%'))"


def body_text(patches: DataFrame) -> DataFrame:
    """Contents of changed lines joined by spaces; no explode needed."""
    return patches.select("patch_id", F.expr(f"array_join(transform({_kept('patch')}, l -> substring(l, 2)), ' ')").alias("body"))


def paths_text(lines: DataFrame, patches: DataFrame) -> DataFrame:
    joined = touched_files(lines).groupBy("patch_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(ord, file))), f -> f.file), ' ')").alias("paths"))
    return patches.select("patch_id").join(joined, "patch_id", "left").select("patch_id", F.coalesce("paths", F.lit("")).alias("paths"))


def size_features(patches: DataFrame) -> DataFrame:
    """Five counts per patch, without an explode."""
    rows = patches.select("*", F.expr(f"case when patch is null or patch = '' then cast(array() as array<string>) else split({S.replace('patch', rules.GLUED, '{1}' + chr(10) + '{2}')}, '\\n', -1) end").alias("_l"))
    count = lambda cond: F.expr(f"cast(size(filter(_l, l -> {cond})) as bigint)")
    rows = rows.select("patch_id", count("l like '+%' and l not like '+++%'").alias("lines_added"), count("l like '-%' and l not like '---%'").alias("lines_removed"), count("l like '--- %' or l like 'diff --git%'").alias("files_touched"), count("l like '@@%'").alias("hunks"))
    return rows.withColumn("lines_changed", F.col("lines_added") + F.col("lines_removed"))


def wellformed(patches: DataFrame) -> DataFrame:
    """(patch_id, well_formed, reason): one fold over the lines checks hunk counts; the first failure stands."""
    fixed = S.replace("patch", rules.GLUED, "{1}\n{2}")
    parts = f"split({fixed}, '\\n', -1)"
    rows = patches.select("*", F.expr(f"case when element_at({parts}, -1) = '' then slice({parts}, 1, size({parts}) - 1) else {parts} end").alias("_l"))
    num = lambda k: f"coalesce({S.integer(S.extract('l', rules.HUNK_COUNTS, k))}, 1)"
    opens = f"named_struct('o', {num(2)}, 'n', {num(4)}, 'hunks', s.hunks + 1, 'err', s.err)"
    inside = (
        "case when l like '\\\\\\\\%' then s "
        "when l like '+%' then named_struct('o', s.o, 'n', s.n - 1, 'hunks', s.hunks, 'err', s.err) "
        "when l like '-%' then named_struct('o', s.o - 1, 'n', s.n, 'hunks', s.hunks, 'err', s.err) "
        "when l like ' %' or l = '' then named_struct('o', s.o - 1, 'n', s.n - 1, 'hunks', s.hunks, 'err', s.err) "
        "else named_struct('o', s.o, 'n', s.n, 'hunks', s.hunks, 'err', 'bad_line_in_hunk') end"
    )
    step = f"case when s.err <> '' then s when s.o > 0 or s.n > 0 then {inside} when s.o <> 0 or s.n <> 0 then named_struct('o', 0, 'n', 0, 'hunks', s.hunks, 'err', 'truncated_or_miscounted_hunk') when {S.matches('l', rules.HUNK_COUNTS)} then {opens} else s end"
    fold = f"aggregate(_l, named_struct('o', 0, 'n', 0, 'hunks', 0, 'err', ''), (s, l) -> {step}, s -> case when s.err <> '' then s.err when s.o <> 0 or s.n <> 0 then 'truncated_or_miscounted_hunk' when s.hunks = 0 then 'no_hunks' else 'ok' end)"
    reason = f"case when patch is null or {strip(S, 'patch')} = '' then 'empty' when not exists(_l, l -> l like '--- %') or not exists(_l, l -> l like '+++ %') then 'missing_file_headers' else {fold} end"
    rows = rows.withColumn("reason", F.expr(reason))
    return rows.select("patch_id", (F.col("reason") == "ok").alias("well_formed"), "reason")


def synth_patch(snippets: DataFrame, new_file: bool = False) -> DataFrame:
    """(id, patch) from (id, path, snippet): the smallest valid diff that adds the snippet."""
    old = F.lit("/dev/null") if new_file else F.concat(F.lit("a/"), "path")
    count = F.expr("size(split(snippet, '\\n', -1))").cast("string")
    return snippets.select("id", F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- "), old, F.lit("\n+++ b/"), "path", F.lit("\n@@ -0,0 +1,"), count, F.lit(" @@\n+"), F.expr("replace(snippet, '\\n', '\\n+')"), F.lit("\n")).alias("patch"))


def prioritized(col: str, max_chars: str) -> str:
    """SQL: the lines of a patch that fit a budget of characters: context lines go first, then any changed line that no longer fits."""
    must = "(l like '@@%' or l like '---%' or l like '+++%')"
    kept = f"filter({split_lines(col)}, l -> {must} or l like 'diff %' or l like 'index %' or l like '+%' or l like '-%')"
    fold = f"aggregate({kept}, named_struct('n', 0, 'out', cast(array() as array<string>)), (s, l) -> case when {must} or s.n + char_length(l) + 1 <= {max_chars} then named_struct('n', s.n + char_length(l) + 1, 'out', concat(s.out, array(l))) else s end, s -> array_join(s.out, '\\n'))"
    return f"case when {col} = '' then {col} when char_length(array_join({kept}, '\\n')) <= {max_chars} then array_join({kept}, '\\n') else {fold} end"


def prioritize(patches: DataFrame, max_chars: int | None) -> DataFrame:
    """(patch_id, text): headers and changed lines first, within a budget of characters; without one all lines stay."""
    if max_chars is None:
        return patches.select("patch_id", F.expr(f"array_join({split_lines('patch')}, '\\n')").alias("text"))
    return patches.select("patch_id", F.expr(prioritized("patch", str(max_chars))).alias("text"))
