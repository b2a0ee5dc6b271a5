"""Readers and writers of the engine's file formats; every path goes through Spark's readers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = {"submission": "string", "instance_id": "string", "repo": "string", "split": "string", "patch": "string", "resolved": "int", "source": "string", "applied": "int", "well_formed": "int", "malformed_reason": "string"}
TRAINING = ["problem_statement", "patch", "label"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that all executors see: below spark.checkpoint.dir, or a temporary one for a local master."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise InputError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="diffloom-")
    return f"{top}/{name}-{uuid.uuid4().hex}"


class InputError(ValueError):
    """An input that is missing, blank or not text."""


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of whole text files; blank ones carry an error."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("error", F.when(F.trim("text") == "", F.lit("blank")))


def diff_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of diff files: NUL bytes mean binary, then UTF-8 must be valid, then blank is an error."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = rows.withColumn("text", F.expr("try_validate_utf8(cast(content as string))"))
    error = "case when position(x'00' in content) > 0 then 'binary' when text is null then 'not utf-8' when regexp_replace(text, '\\\\s', '') = '' then 'blank' end"
    return rows.select("path", F.expr(f"case when {error} is null then text end").alias("text"), F.expr(error).alias("error"))


def corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled patches: header, quoted multi-line fields, explicit schema; resolved patches are well formed and applied."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    for name in CORPUS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    rows = rows.select(*[F.expr(f"try_cast({name} as {kind})").alias(name) for name, kind in CORPUS.items()])
    return rows.withColumns({c: F.when(F.col("resolved") == 1, 1).otherwise(F.col(c)) for c in ("well_formed", "applied")})


def training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Training pairs; the three columns must exist, rows with a null in them go, labels are whole numbers."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    missing = [c for c in TRAINING if c not in rows.columns]
    if missing:
        raise InputError(f"missing columns: {', '.join(missing)}")
    return rows.withColumn("label", F.expr("try_cast(label as int)")).dropna(subset=TRAINING)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(path, instance_id, patch) from a JSON object, a JSON list or JSON lines; the last entry of an id counts.

    A record's patch is model_patch, else patch, else the empty string; in an
    object the key is the id where the record has none.  Bad lines are skipped.
    """
    record = "instance_id string, model_patch string, patch string"
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.trim("value").alias("value"))
    kind = F.expr("case when startswith(value, '[') then 'list' when startswith(value, '{') and try_parse_json(value) is not null and size(map_keys(from_json(value, 'map<string,string>'))) > 0 and from_json(value, 'instance_id string').instance_id is null then 'dict' else 'lines' end")
    whole = whole.withColumn("kind", kind)
    lists = whole.filter("kind = 'list'").select("path", F.posexplode(F.from_json("value", f"array<struct<{record.replace(' string', ':string')}>>")).alias("at", "r"), F.lit(None).cast("string").alias("key"))
    dicts = whole.filter("kind = 'dict'").select("path", F.posexplode(F.from_json("value", "map<string,string>")).alias("at", "key", "body")).select("path", "at", F.from_json("body", record).alias("r"), "key")
    lines = whole.filter("kind = 'lines'").select("path", F.posexplode(F.split("value", "\n")).alias("at", "line")).filter("try_parse_json(line) is not null").select("path", "at", F.from_json("line", record).alias("r"), F.lit(None).cast("string").alias("key"))
    rows = lists.select("path", "at", "r", "key").unionByName(dicts).unionByName(lines)
    rows = rows.select("path", "at", F.coalesce("r.instance_id", "key").alias("instance_id"), F.coalesce("r.model_patch", "r.patch", F.lit("")).alias("patch")).filter("instance_id is not null")
    return rows.groupBy("path", "instance_id").agg(F.max_by("patch", "at").alias("patch"))


def results_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, instance_id, resolved, applied): ids of the two lists of a results file; applied is null where the file has none."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "resolved array<string>, applied array<string>").alias("r")).filter("r.resolved is not null")
    ids = rows.select("path", "r", F.explode(F.array_union("r.resolved", F.coalesce("r.applied", F.array().cast("array<string>")))).alias("instance_id"))
    return ids.select("path", "instance_id", F.array_contains("r.resolved", F.col("instance_id")).cast("int").alias("resolved"), F.when(F.col("r.applied").isNotNull(), F.array_contains("r.applied", F.col("instance_id")).cast("int")).alias("applied"))


def split_manifest(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(instance_id, split) from a manifest: a list of ids under one of three names, an object's keys, or a list of records."""
    rows = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    named = F.from_json("v", "instance_ids array<string>, ids array<string>, instances array<string>")
    ids = F.expr("case when startswith(v, '[') then coalesce(filter(transform(from_json(v, 'array<struct<instance_id:string>>'), r -> r.instance_id), i -> i is not null), array()) when coalesce(n.instance_ids, n.ids, n.instances) is not null then coalesce(n.instance_ids, n.ids, n.instances) else map_keys(from_json(v, 'map<string,string>')) end")
    return rows.withColumn("n", named).select(F.explode(ids).alias("instance_id"), F.lit(split).alias("split"))


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted where needed, white space at the ends of fields kept."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small report table as Markdown; reports have few rows, `limit` bounds what reaches the driver."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    body = ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in df.limit(limit).collect()]
    return "\n".join([head, *body]) + "\n"


def write_markdown(df: DataFrame, path: str, title: str) -> None:
    """One overwritten Markdown file; writing again leaves one copy of the section."""
    text = f"# {title}\n\n{markdown_table(df)}"
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_markdown(df: DataFrame, path: str, title: str) -> None:
    """Add a section to a Markdown report, or put it in the place of the section of that title; the rest stays."""
    spark = df.sparkSession
    section = f"## {title}\n\n{markdown_table(df)}"
    try:
        before = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()).rstrip("\n")  # a report, a few pages
    except AnalysisException:  # no report yet
        before = ""
    found = re.compile(rf"(?ms)^## {re.escape(title)}\n.*?(?=^## |\Z)")
    text = found.sub(lambda _: section + "\n", before, count=1).rstrip("\n") if found.search(before) else f"{before}\n\n{section}".strip("\n")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def list_dirs(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the folders right below path, hidden ones left out; works on any store."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)
    names = sorted(s.getPath().getName() for s in found if s.isDirectory() and not s.getPath().getName().startswith((".", "_")))
    return spark.createDataFrame([(n,) for n in names], "name string")
