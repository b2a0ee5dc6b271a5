"""Secret scanning with sliding-window entropy, in DataFrame expressions only.

Three fixed kinds (assignments, access keys, long hexadecimal runs) are found
by pattern.  Beside them, candidate strings (runs of 20 and more characters of
base64's and its URL form's alphabets, with a digit and a letter) are judged by
the largest Shannon entropy of any window of WINDOW characters.  The window's
character counts and the sum of c*log2(c) are kept up as characters enter and
leave; the threshold belongs to the candidate's character class (hexadecimal,
upper case and digits, mixed).  An allow list suppresses candidates of known
harmless forms; it never touches the three fixed kinds, and a candidate that
overlaps one of those adds nothing.

Null text counts as empty.  Repeated rows each give a row; null ids stay; other
columns are not read.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import apart, quoted, span_sql

#: The patterns of the three kinds and of candidates.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
WINDOW = 20
#: Bits a character by class.  A random window of 20 characters has about 3.5 (hexadecimal), 3.9 and 4.1.
THRESHOLDS = {"hex": 3.0, "upper": 3.5, "mixed": 3.75}
#: Harmless forms: UUIDs, digests with their name, placeholders, runs of the alphabet, rules of one character, words joined by - _ or /.
ALLOW = [
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)^(?:sha1|sha256|sha384|sha512|md5)[-=]",
    r"(?i)example|sample|dummy|placeholder|changeme|your[-_]?(?:key|token|secret)|xxxx|lorem",
    r"(?i)abcdefgh|0123456|1234567|qwerty",
    r"([A-Za-z0-9+/=_-])\1{5,}",
    r"^[A-Za-z]*[0-9]{0,4}(?:[-_/=+][A-Za-z]*[0-9]{0,4})*$",
]


def _entropy(value: str) -> str:
    """SQL for the largest entropy of a window of `value`, in bits a character."""
    grow = "(case when {c} <= 1 then 0D else {c} * log2({c}) end)"
    f = lambda c: grow.format(c=c)
    chars = f"regexp_extract_all({value}, '.', 0)"
    # Each step pairs the entering character with the leaving one, so the fold never indexes the text.
    steps = (
        f"zip_with({chars}, concat(array_repeat('', least({WINDOW}, char_length({value}))), slice({chars}, 1, greatest(char_length({value}) - {WINDOW}, 0))), "
        f"(a, b) -> named_struct('x', instr('{ALPHABET}', a), 'y', case when b = '' then 0 else instr('{ALPHABET}', b) end))"
    )
    cx, cy = "s.counts[p.x - 1]", "s.counts[p.y - 1]"
    change = f"(case when p.x = p.y then 0D else {f(f'({cx} + 1)')} - {f(cx)} + (case when p.y = 0 then 0D else {f(f'({cy} - 1)')} - {f(cy)} end) end)"
    return (
        f"aggregate({steps}, named_struct('n', 0, 'counts', array_repeat(0, {len(ALPHABET)}), 'sum', 0D, 'best', 0D), "
        f"(s, p) -> named_struct('n', s.n + 1, "
        f"'counts', case when p.x = p.y then s.counts else transform(s.counts, (c, k) -> c + (case when k = p.x - 1 then 1 else 0 end) - (case when k = p.y - 1 then 1 else 0 end)) end, "
        f"'sum', s.sum + {change}, "
        f"'best', case when s.n + 1 >= {WINDOW} then greatest(s.best, log2({WINDOW}) - (s.sum + {change}) / {WINDOW}) else s.best end), "
        "s -> s.best)"
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, assign, access, hex, entropy) of each row of docs: arrays of (start, end, value[, bits])."""
    rows = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    rows = rows.select(
        id_col,
        F.expr(f"filter({span_sql('_text', ASSIGN)}, m -> char_length(regexp_extract(m.value, {quoted(ASSIGN)}, 2)) >= 12)").alias("assign"),
        F.expr(f"filter({span_sql('_text', ACCESS, 'AKIA')}, m -> char_length(m.value) >= 18)").alias("access"),
        F.expr(span_sql("_text", HEX)).alias("hex"),
        F.expr(f"filter({span_sql('_text', CANDIDATE)}, m -> m.value rlike '[0-9]' and m.value rlike '[A-Za-z]')").alias("_cands"),
    )
    allowed = " or ".join(f"m.value rlike {quoted(p)}" for p in ALLOW)
    rows = rows.withColumn("_cands", F.expr(f"filter(_cands, m -> not ({allowed}))"))
    rows = rows.withColumn("_cands", F.expr(apart("_cands", ["assign", "access", "hex"])))
    limit = f"case when m.value rlike '^[0-9A-Fa-f]+$' then {THRESHOLDS['hex']}D when m.value rlike '^[A-Z0-9]+$' then {THRESHOLDS['upper']}D else {THRESHOLDS['mixed']}D end"
    judged = f"transform(_cands, m -> named_struct('start', m.start, 'end', m.end, 'value', m.value, 'bits', {_entropy('m.value')}))"
    # Rows without a candidate, nearly all, never enter the fold.
    rows = rows.withColumn("entropy", F.expr(f"case when size(_cands) > 0 then filter({judged}, m -> m.bits >= {limit}) else cast(array() as array<struct<start:int,end:int,value:string,bits:double>>) end"))
    return rows.drop("_cands")


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, hash of the fixed kinds' spans and the text of all spans, by start and then kind."""
    kinds = ["assign", "access", "hex", "entropy"]
    tagged = [f"transform({k}, m -> named_struct('start', m.start, 'rank', {i}, 'text', concat('{k}:', m.start, ':', m.end)))" for i, k in enumerate(kinds)]
    line = lambda parts: f"array_join(transform(array_sort(concat({', '.join(parts)})), m -> m.text), ',')"
    return found.select(
        id_col,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds[:3]],
        F.sha2(F.expr(line(tagged[:3])), 256).alias("base_sha256"),
        F.expr(line(tagged)).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
