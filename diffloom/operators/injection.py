"""Prompt-injection rules over issue texts and patch comments, and the older text scanner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffloom.functions import normalize, rules
from diffloom.functions.dialect import Spark as S

LEET = ("".join(rules.LEET), "".join(rules.LEET.values()))
#: Text that needs no Python: plain ASCII without entities.
PLAIN = r"^[\x00-\x25\x27-\x7f]*$"


def normalize_text(col: str, leet: bool = False):
    """Normalised text; Python sees only the rows that are not plain ASCII."""
    plain = F.expr(f"{col} rlike {S.text('(?s)' + PLAIN)}")
    kept = f"lower(regexp_replace({col}, {S.text(r'[\x00-\x08\x0B\x0C\x0E-\x1F]')}, ''))"
    native = F.expr(f"trim(regexp_replace({kept}, {S.text(r'\s+')}, ' '))")
    if leet:
        native = F.translate(native, *LEET)
    udf = normalize.normalize_leet_udf if leet else normalize.normalize_udf
    return F.when(plain, native).otherwise(udf(F.when(~plain, F.col(col))))


def base64_payloads(col: str):
    return normalize.base64_udf(F.col(col))


def embedded_comments(d, col: str) -> tuple[str, str]:
    """SQL of either dialect: whole comments in order, and the body of one comment m (empty ones don't count)."""
    pattern = "(?s)" + rules.COMMENT
    first, second = d.extract("m", pattern, 1), d.extract("m", pattern, 2)
    return d.extract_all(col, pattern, 0), f"case when {first} <> '' then {first} else {second} end"


def text_variants(texts: DataFrame) -> DataFrame:
    """(text_id, ord, kind, norm) from (text_id, text): the forms in the order they are scanned."""
    return texts.select("text_id", F.posexplode(normalize.variants_udf("text")).alias("ord", "v")).select("text_id", "ord", "v.kind", "v.norm")


def scan_texts(texts: DataFrame, source: str = "issue", keep: list[str] | None = None) -> DataFrame:
    """Findings of (text_id, text): at most one for each rule of a text; keep: further columns."""
    keep = keep or []
    rows = texts.select("text_id", *keep, F.col("text").cast("string").alias("text"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"])
    for name, kind in (("vord", "integer"), ("pattern", "integer"), ("line", "integer"), ("norm", "string")):
        schema = schema.add(name, kind)
    # Python hands on the few variants that hold what a pattern needs; whether it matches is decided here.
    forms = rows.mapInArrow(normalize.suspect_rows, schema)
    case = lambda value: "case pattern " + " ".join(f"when {k} then {value(r, p, w)}" for k, (r, p, w) in enumerate(rules.INJECTIONS)) + " end"
    # An outer explode of one value: the span is extracted once, as no filter on it moves below.
    span = F.expr(case(lambda r, p, w: S.extract("norm", p, 0, "i")))
    hits = forms.select("text_id", *keep, "vord", "pattern", "line", F.explode_outer(F.array(span)).alias("span")).filter("span <> ''").select(
        "text_id", *keep, "vord", "pattern", "line", F.expr(case(lambda r, p, w: f"'{r}'")).alias("rule_id"),
        F.expr(f"concat('Prompt injection (', {case(lambda r, p, w: S.text(w))}, '): ', substring(span, 1, 120))").alias("evidence"),
    )
    first = Window.partitionBy("text_id", *keep, "rule_id").orderBy("vord", "pattern")
    hits = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return hits.select("text_id", *keep, "rule_id", F.lit("HIGH").alias("severity"), F.lit(source).alias("source"), "line", "evidence", (F.col("vord") * 100 + F.col("pattern")).cast("long").alias("ord"))


def scan_comments(segments: DataFrame) -> DataFrame:
    """The same on comment segments (patch_id, pos, file, line_no, content); file and line are the segment's."""
    found = scan_texts(segments.select(F.col("patch_id").alias("text_id"), "pos", "file", "line_no", F.col("content").alias("text")), "comment", ["pos", "file", "line_no"])
    return found.select(F.col("text_id").alias("patch_id"), "rule_id", "severity", "source", "file", F.col("line_no").alias("line"), "evidence", (F.col("pos") * 100000 + F.col("ord")).cast("long").alias("ord"))


def legacy_regex(texts: DataFrame) -> DataFrame:
    """(text_id, status, confidence, reason, layer) of the texts that match an old pattern; the first counts."""
    k = "(case " + " ".join(f"when {S.matches('text', p, 'i')} then {i}" for i, (p, _) in enumerate(rules.LEGACY)) + " end)"
    span = "(case _k " + " ".join(f"when {i} then {S.extract('text', p, 0, 'i')}" for i, (p, _) in enumerate(rules.LEGACY)) + " end)"
    what = "(case _k " + " ".join(f"when {i} then {S.text(w)}" for i, (_, w) in enumerate(rules.LEGACY)) + " end)"
    rows = texts.withColumn("_k", F.expr(k)).filter("_k is not null")
    return rows.select("text_id", F.lit("CRITICAL").alias("status"), F.lit(1.0).alias("confidence"), F.expr(f"concat('Fast-layer regex detected a ', {what}, '. Matched text: ''', substring(trim({span}), 1, 80), '''')".replace("''''", "'\\''").replace("Matched text: '''", "Matched text: \\''")).alias("reason"), F.lit("regex").alias("layer"))


def legacy_scan(texts: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(text_id, status, confidence, layer) of every text; scores: (text_id, label, score) of a classifier.

    Blank text: WARNING of layer `validation`.  A pattern: CRITICAL.  Then the
    classifier: the bug label above 0.80 SAFE, another label above 0.50 FLAGGED,
    else WARNING with the top label.  Only texts without a pattern need scores.
    """
    hit = "(" + " or ".join(S.matches("text", p, "i") for p, _ in rules.LEGACY) + ")"
    rows = texts.select("text_id", F.expr(f"case when text is null or trim(text) = '' then 'validation' when {hit} then 'regex' else 'ai' end").alias("layer"))
    if scores is None:
        return rows.select("text_id", F.expr("case layer when 'validation' then 'WARNING' when 'regex' then 'CRITICAL' else 'NOT RUN' end").alias("status"), F.expr("case layer when 'regex' then 1.0D else 0.0D end").alias("confidence"), "layer")
    bug = F.max(F.when(F.col("label") == rules.LEGACY_LABELS[0], F.col("score")))
    bad = F.max(F.when(F.col("label").isin(*rules.LEGACY_NEGATIVE), F.col("score")))
    best = scores.groupBy("text_id").agg(bug.alias("bug"), bad.alias("bad"), F.max("score").alias("top"))
    rows = rows.join(best, "text_id", "left")
    status = "case layer when 'validation' then 'WARNING' when 'regex' then 'CRITICAL' else case when bug > 0.8 then 'SAFE' when bad > 0.5 then 'FLAGGED' when top is null then 'NOT RUN' else 'WARNING' end end"
    value = "case layer when 'validation' then 0.0D when 'regex' then 1.0D else coalesce(round(case when bug > 0.8 then bug when bad > 0.5 then bad else top end, 4), 0.0D) end"
    return rows.select("text_id", F.expr(status).alias("status"), F.expr(value).alias("confidence"), "layer")


def combine(regex: DataFrame, model: DataFrame, on: list[str]) -> DataFrame:
    """Regex findings and those model findings that no regex finding has at the same place; status rows stay."""
    # One window over the findings of both: neither layer is made twice.
    none = lambda kind: F.lit(None).cast(kind)
    both = regex.withColumns({"score": none("double"), "status": none("string"), "_regex": F.lit(1)}).unionByName(model.filter("status is null").withColumn("_regex", F.lit(0)))
    kept = both.withColumn("_taken", F.max("_regex").over(Window.partitionBy(*on))).filter("_regex = 1 or _taken = 0").drop("_regex", "_taken")
    return kept.unionByName(model.filter("status is not null"))


def chunk_lines(texts: DataFrame, max_tokens: int = 400, overlap: int = 1, max_chunks: int = 50) -> DataFrame:
    """(text_id, chunk, start, n_lines, text, partial): windows of whole lines under max_tokens; overlap is 0 or 1.

    A line costs its words and one.  A fold keeps the greedy boundaries; each
    window but the first starts `overlap` lines before its predecessor's end.
    """
    from .diff import split_lines

    rows = texts.select("text_id", F.expr(split_lines("text")).alias("_l"))
    # An outer explode of one value: no filter on the number of lines moves below and splits every text again.
    rows = rows.select("text_id", F.explode_outer(F.array("_l")).alias("_l")).filter("size(_l) > 0")
    costs = f"transform(_l, l -> size(regexp_extract_all(l, {S.text(r'[^\s]+')}, 0)) + 1)"
    rows = rows.withColumn("_c", F.expr(costs))
    # State: start of the open window, its cost, and the closed windows.
    back = lambda i: f"greatest(s.lo + 1, {i} - {overlap})"
    cost = lambda lo, n: f"aggregate(slice(_c, {lo} + 1, {n}), 0, (a, x) -> a + x)"
    again = cost(back("i"), f"i - {back('i')} + 1")
    # Where the overlap and the new line together do not fit, the overlap closes as a window of its own.
    step = (
        f"case when s.lo = i or s.cost + _c[i] <= {max_tokens} then named_struct('lo', s.lo, 'cost', s.cost + _c[i], 'out', s.out) "
        f"when {again} <= {max_tokens} or {back('i')} = i then named_struct('lo', {back('i')}, 'cost', {again}, 'out', concat(s.out, array(named_struct('lo', s.lo, 'hi', i)))) "
        f"else named_struct('lo', i, 'cost', _c[i], 'out', concat(s.out, array(named_struct('lo', s.lo, 'hi', i), named_struct('lo', {back('i')}, 'hi', i)))) end"
    )
    empty = "cast(array() as array<struct<lo:int,hi:int>>)"
    fold = f"aggregate(sequence(0, size(_c) - 1), named_struct('lo', 0, 'cost', 0, 'out', {empty}), (s, i) -> {step}, s -> concat(s.out, array(named_struct('lo', s.lo, 'hi', size(_c)))))"
    rows = rows.withColumn("_w", F.expr(fold))
    # The windows go on from the overlap until no line is left.
    first = f"(element_at(_w, -1).lo + greatest(1, element_at(_w, -1).hi - element_at(_w, -1).lo - {overlap}))"
    rows = rows.withColumn("_w", F.expr(f"case when {first} < size(_c) then concat(_w, transform(sequence({first}, size(_c) - 1), i -> named_struct('lo', i, 'hi', size(_c)))) else _w end"))
    rows = rows.withColumn("partial", F.expr(f"size(_w) > {max_chunks}"))
    rows = rows.select("text_id", "_l", "partial", F.posexplode(F.expr(f"slice(_w, 1, {max_chunks})")).alias("chunk", "w"))
    return rows.select("text_id", "chunk", F.col("w.lo").alias("start"), F.expr("w.hi - w.lo").alias("n_lines"), F.expr("array_join(slice(_l, w.lo + 1, w.hi - w.lo), '\\n')").alias("text"), "partial")


def stub_score(col: str) -> str:
    """SQL stand-in for a model: a number in 0..1 from the text's md5, equal in every engine."""
    return f"(cast(conv(substring(md5({col}), 1, 8), 16, 10) as double) / 4294967295D)"


def ml_texts(texts: DataFrame, threshold: float, scorer=stub_score, source: str = "issue") -> DataFrame:
    """Model findings of (text_id, text): each window at or above the threshold points to its best line."""
    chunks = chunk_lines(texts).withColumn("score", F.expr(scorer("text"))).filter(F.col("score") >= threshold)
    lines = chunks.select("text_id", "chunk", "start", "score", F.posexplode(F.split("text", "\n")).alias("at", "line_text")).withColumn("line_score", F.expr(scorer("line_text")))
    best = lines.groupBy("text_id", "chunk", "start", "score").agg(F.max(F.struct("line_score", (-F.col("at")).alias("back"), "line_text")).alias("b"))
    return best.select("text_id", F.lit("INJ_ML").alias("rule_id"), F.lit("MEDIUM").alias("severity"), F.lit(source).alias("source"), (F.col("start") - F.col("b.back") + 1).cast("int").alias("line"), F.expr("substring(b.line_text, 1, 200)").alias("evidence"), F.round("score", 6).alias("score"), F.lit(None).cast("string").alias("status"))


def ml_comments(segments: DataFrame, threshold: float, scorer=stub_score) -> DataFrame:
    """Model findings of comment segments; equal texts are scored once."""
    scored = segments.select("content").distinct().withColumn("score", F.expr(scorer("content"))).filter(F.col("score") >= threshold)
    rows = segments.join(scored, "content")
    return rows.select("patch_id", F.lit("INJ_ML").alias("rule_id"), F.lit("MEDIUM").alias("severity"), F.lit("comment").alias("source"), "file", F.col("line_no").alias("line"), F.expr("substring(content, 1, 200)").alias("evidence"), F.round("score", 6).alias("score"), F.lit(None).cast("string").alias("status"))


def not_run(texts: DataFrame, why: str) -> DataFrame:
    """The status row of a layer that could not run, one for each text."""
    return texts.select("text_id", F.lit("INJ_ML").alias("rule_id"), F.lit("REVIEW").alias("severity"), F.lit("model").alias("source"), F.lit(0).alias("line"), F.lit("").alias("evidence"), F.lit(None).cast("double").alias("score"), F.lit(f"NOT RUN ({why})").alias("status"))
