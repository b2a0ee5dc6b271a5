"""Host-level quality rules, in DataFrame expressions only.

Each document is put to fixed rules over its whole text.  Failures are added up
by host (the `source` column), each host's failure rate is shrunk towards the
corpus by a beta prior fitted to all hosts by their moments, and the host's
verdict is joined back: a document is kept if it passes its own base rules and
its host's shrunken rate is below `host_limit`, or the host is bad and the
document passes every rule.

The base rules and counts follow fixed definitions: words are runs without
ASCII white space; n_dup_lines counts lines with a word that equal an earlier
line; n_repeat_words counts the words inside 3-word windows that occur twice or
more.

Null text has no words and fails.  A null host is a host of its own.  Repeated
rows each count and give a row; null ids stay; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join

HOST_LIMIT = 0.5
#: The prior's strength in documents is at most this.
MOST_STRENGTH = 1000
WHITE = " \t\n\x0b\x0c\r"
_WHITE_RE = "[\\\\x20\\\\x09-\\\\x0D]+"


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars) of each row."""
    rows = docs.select(docs[id_col].alias(id_col), docs[host_col].cast("string").alias("host"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_t"))
    rows = rows.withColumn("_w", F.expr(f"filter(split(_t, '{_WHITE_RE}', -1), w -> w != '')"))
    rows = rows.withColumn("_lines", F.expr("filter(split(_t, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    # Hashes tell which texts have no window twice; only the others compare windows themselves.
    rows = rows.withColumn("_h", F.expr("case when size(_w) < 4 then cast(array() as array<bigint>) else transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) end"))
    sorted_windows = "array_sort(transform(sequence(0, size(_w) - 3), i -> named_struct('a', _w[i], 'b', _w[i + 1], 'c', _w[i + 2], 'i', i)))"
    rows = rows.withColumn("_s", F.expr(f"case when size(array_distinct(_h)) < size(_h) then {sorted_windows} end"))
    same = "(x.a = y.a and x.b = y.b and x.c = y.c)"
    # Neighbours in sorted order: a window is repeated if it equals the one before or after it.
    pairs = f"filter(zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1), (x, y) -> case when {same} then array(x.i, y.i) end), p -> p is not null)"
    covered = f"size(array_distinct(flatten(transform(array_distinct(flatten({pairs})), i -> array(i, i + 1, i + 2)))))"
    return rows.select(
        id_col,
        "host",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.translate("_t", WHITE, "")).cast("long").alias("word_chars"),
        F.expr("char_length(_t) - char_length(translate(_t, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
        F.expr("size(_lines) - size(array_distinct(_lines))").cast("long").alias("n_dup_lines"),
        F.expr(f"case when _s is null then 0 else {covered} end").cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


#: The rules: name and failing condition.  The first two are the base rules, the others the method's.
RULES = {
    "few_words": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words and n_symbols >= 20",
    "dup_lines": "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 and (word_chars > 15 * n_words or word_chars < 2 * n_words)",
}


def host_verdicts(counts: DataFrame) -> DataFrame:
    """(host, host_docs, host_failed, host_rate): failure rates shrunk by a beta prior.

    The prior's mean is the corpus rate; its strength comes from the variance
    of host rates above what chance would give (moments, weighted by size) and
    lies between 1 and MOST_STRENGTH documents, so that a large host always
    outweighs it; hosts that differ no more than by chance get the latter.
    """
    failed = " or ".join(f"({r})" for r in RULES.values())
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.expr(f"case when {failed} then 1 else 0 end")).alias("host_failed"))
    total = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("x"), F.count(F.lit(1)).alias("k"), F.sum(F.expr("host_docs * double(host_docs)")).alias("n2"), F.sum(F.expr("double(host_failed) * host_failed / host_docs")).alias("r2"))
    # Weighted between-host variance: (sum n (r-m)^2 - (k-1) m(1-m)) / (N - sum n^2 / N).
    prior = total.select(
        F.expr("x / double(n)").alias("mean"),
        F.expr("(r2 - x * (x / double(n)) - (k - 1) * (x / double(n)) * (1 - x / double(n))) / nullif(n - n2 / n, 0)").alias("var"),
    )
    prior = prior.select("mean", F.expr(f"greatest(1D, least({MOST_STRENGTH}D, coalesce(mean * (1 - mean) / nullif(greatest(var, 0D), 0D) - 1, {MOST_STRENGTH}D)))").alias("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "host_docs", "host_failed", F.expr("round((host_failed + mean * strength) / (host_docs + strength), 9)").alias("host_rate"))


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """Counts, base_failed, the host's shrunken rate and kept for each row of docs."""
    counts = cut(document_counts(docs, id_col, text_col, host_col))  # a few numbers a row, used twice
    hosts = host_verdicts(counts).withColumn("host_key", F.coalesce("host", F.lit(""))).withColumn("host_null", F.col("host").isNull()).drop("host")
    rows = counts.withColumn("host_key", F.coalesce("host", F.lit(""))).withColumn("host_null", F.col("host").isNull())
    rows = salted_join(rows, hosts, ["host_key", "host_null"], F.xxhash64(F.col(id_col).cast("string"), "n_words", "word_chars", "n_symbols"), salts=32)
    any_rule = " or ".join(f"({r})" for r in RULES.values())
    base = f"({RULES['few_words']}) or ({RULES['repeated']})"
    return rows.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.expr(base).alias("base_failed"),
        F.expr(f"not ({base}) and (host_rate < {host_limit}D or not ({any_rule}))").alias("kept"),
        "host_rate",
    )
