"""Readers and writers as queries: files are written from the tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffloom.sources import files

from .queries import define, query

_names = "n_name as name, n_comment as text"


def _nations(x):
    return x.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))


def _one_file_a_row(x, rows, name: str) -> str:
    """rows (name, value) as one text file each, in a folder of that name."""
    path = files.scratch(x.spark, name)
    rows.write.partitionBy("name").text(path)
    return path


def _named(df, *columns: str):
    """The folder's name beside the columns."""
    return df.select(F.regexp_extract(F.url_decode("path"), "name=([^/]*)", 1).alias("name"), *columns)


@query("src_text_file", "select n_name as name, 'about ' || n_name || chr(10) as text, null::varchar as error from nation")
def _text_file(x):
    """One text file a nation."""
    path = _one_file_a_row(x, _nations(x).select("name", F.concat(F.lit("about "), "name").alias("value")), "texts")
    return _named(files.text_files(x.spark, f"{path}/*"), "text", "error")


@query("src_diff_file", "select n_name as name, case when n_nationkey % 4 > 0 then '+' || n_name || chr(10) end as text, case n_nationkey % 4 when 0 then 'blank' end as error from nation")
def _diff_file(x):
    """One diff file a nation, every fourth blank."""
    path = _one_file_a_row(x, _nations(x).select("name", F.expr("case when id % 4 = 0 then ' ' else concat('+', name) end").alias("value")), "diffs")
    return _named(files.diff_files(x.spark, f"{path}/*"), "text", "error")


_kept = "patch_id, instance_id, repo, patch"


@query("sink_csv", f"select {_kept} from patches")
def _sink_csv(x):
    path = files.scratch(x.spark, "csv")
    files.write_csv(x.patches.select(*[c.strip() for c in _kept.split(",")]), path)
    return x.spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema="patch_id long, instance_id long, repo string, patch string")


@query("sink_json", "select patch_id, instance_id, patch from patches")
def _sink_json(x):
    path = files.scratch(x.spark, "json")
    files.write_json(x.patches.select("patch_id", "instance_id", "patch"), path)
    return x.spark.read.schema("patch_id long, instance_id long, patch string").json(path)


@query("src_csv_corpus", "select submission, instance_id::varchar as instance_id, repo, split, patch, resolved::integer as resolved, case when resolved = 1 then 1 end::integer as well_formed, case when resolved = 1 then 1 end::integer as applied from patches")
def _corpus(x):
    path = files.scratch(x.spark, "corpus")
    files.write_csv(x.patches.select("submission", F.col("instance_id").cast("string").alias("instance_id"), "repo", "split", "patch", "resolved"), path)
    return files.corpus_csv(x.spark, path).select("submission", "instance_id", "repo", "split", "patch", "resolved", "well_formed", "applied")


@query("src_csv_training", "select problem_statement, patch, (patch_id % 2)::integer as label from patches p join issues i on i.instance_id = p.instance_id where patch_id % 5 <> 0")
def _training(x):
    """Pairs whose label is missing go."""
    path = files.scratch(x.spark, "training")
    pairs = x.patches.join(x.issues, "instance_id").select("problem_statement", "patch", F.expr("case when patch_id % 5 <> 0 then patch_id % 2 end").alias("label"))
    files.write_csv(pairs, path)
    return files.training_csv(x.spark, path)


@query("src_predictions", "select instance_id::varchar as instance_id, arg_max(patch, patch_id) as patch from patches group by 1")
def _predictions(x):
    """Lines of predictions, an instance's in one file; the last counts."""
    path = files.scratch(x.spark, "predictions")
    rows = x.patches.repartition("instance_id").sortWithinPartitions("instance_id", "patch_id")
    rows.select(F.to_json(F.struct(F.col("instance_id").cast("string").alias("instance_id"), F.col("patch").alias("model_patch"))).alias("value")).write.text(path)
    return files.predictions(x.spark, path).select("instance_id", "patch")


_by_region = "r.r_name as name, n_name as instance_id"


@query("src_results_json", f"select {_by_region}, (n_nationkey % 2 = 0)::integer as resolved, case when n_regionkey > 0 then 1 end::integer as applied from nation n join region r on r_regionkey = n_regionkey where n_regionkey > 0 or n_nationkey % 2 = 0")
def _results(x):
    """One results file a region: even nations are resolved; the first region's file lists no applied ones."""
    rows = x.table("nation").join(x.table("region"), F.expr("r_regionkey = n_regionkey")).groupBy(F.col("r_name").alias("name"), "r_regionkey")
    rows = rows.agg(F.sort_array(F.collect_list(F.expr("case when n_nationkey % 2 = 0 then n_name end"))).alias("resolved"), F.sort_array(F.collect_list("n_name")).alias("applied"))  # five nations a region
    rows = rows.select("name", F.to_json(F.struct("resolved", F.when(F.col("r_regionkey") > 0, F.col("applied")).alias("applied"))).alias("value"))
    path = _one_file_a_row(x, rows, "results")
    return _named(files.results_json(x.spark, f"{path}/*"), "instance_id", "resolved", "applied")


@query("src_split_manifest", "select n_name as instance_id, 'val' as split from nation")
def _manifest(x):
    path = files.scratch(x.spark, "manifest")
    _nations(x).agg(F.to_json(F.struct(F.sort_array(F.collect_list("name")).alias("instance_ids"))).alias("value")).coalesce(1).write.text(path)
    return files.split_manifest(x.spark, path, "val")


@query("src_list_dirs", "select 'name=' || n_name as name from nation where n_name not like '% %'")
def _dirs(x):
    path = _one_file_a_row(x, _nations(x).filter("name not like '% %'").select("name", F.col("name").alias("value")), "dirs")
    return files.list_dirs(x.spark, path)


_table = "'| region | nations |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_regionkey || ' | ' || k || ' |', chr(10) order by n_regionkey)"
_counts = "(select n_regionkey, count(*) as k from nation group by 1)"


def _report(x):
    return _nations(x).groupBy("region").agg(F.count(F.lit(1)).alias("nations")).orderBy("region")


def _whole(x, path: str):
    return x.spark.read.text(path, wholetext=True).select(F.rtrim(F.translate("value", "\n", "~")).alias("text"))


_flat = "replace({0}, chr(10), '~')"


@query("sink_markdown", f"select {_flat.format(chr(39) + '# Nations' + chr(39) + ' || chr(10) || chr(10) || ' + _table)} || '~~' as text from {_counts}")
def _markdown(x):
    """One report, written twice: one copy stays."""
    path = files.scratch(x.spark, "report")
    for _ in range(2):
        files.write_markdown(_report(x), path, "Nations")
    return _whole(x, path)


_section = "'## {0}' || chr(10) || chr(10) || " + _table


@query("sink_append_md", f"select {_flat.format(_section.format('First') + ' || chr(10) || chr(10) || ' + _section.format('Second'))} || '~' as text from {_counts}")
def _append(x):
    """Two sections, the first written anew: it keeps its place."""
    path = files.scratch(x.spark, "sections")
    for title in ("First", "Second", "First"):
        files.append_markdown(_report(x), path, title)
    return _whole(x, path)
