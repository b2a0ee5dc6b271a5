"""Personal data by weak supervision, in DataFrame expressions only.

Candidates are the matches of four fixed kinds (email, ip, card, phone), which
always stay, and of broader patterns (obfuscated addresses, local phone
numbers, national ids, bank accounts, long addresses), which the method judges.
Five labelers vote on every candidate (1 for, -1 against, 0 abstains): strict
form, checksum or range, gazetteer, words before it, and its borders.
Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is (the chance of each vote given the truth) and how
likely each pattern is personal data.  These soft labels train the final span
classifier, a logistic regression over features of the span, itself fitted on
counts: patterns and features have few values, so what reaches the driver is
bounded by their product, not by the corpus.  The classifier then runs inside
the scan as an expression.

scan() reads the texts once: what it keeps of each row are its spans with the
words before them (back to the last match of the kind, BEFORE characters at
most), from which both the model and the answers are made.  The fixed kinds'
spans get the classifier's probability, too, but stay whatever it says.

Null text counts as empty.  Repeated rows each give a row; null ids stay; other
columns are not read.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .spans import AROUND, apart, quoted, running, span_sql

KINDS = ["email", "ip", "card", "phone"]
#: The four kinds.  Starting points are tied to the beginning of a run (or the last match's end), so no run is scanned twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Broader kinds judged by the method; one pattern finds them all.
EXTRA = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z]{2,}(?![A-Za-z0-9])",
    "local": r"(?<![0-9A-Za-z+.-])(?<![0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])(?![ .-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
}
ALL_KINDS = [*KINDS, *EXTRA]
#: What every text with a match of EXTRA holds: one of the strings, which are looked for quickly, and then the pattern.  The pattern of all kinds is slow and most texts have none.
GATES = [
    ([" at ", "(at", "[at"], r"(?: at |[\[(]at[\])] ?)[A-Za-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z]{2}"),
    (list("0123456789"), r"[0-9]{3}[ .-][0-9]{4}|[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    ([":"], r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
]

#: Gazetteers.
DOMAINS = "com|org|net|edu|gov|mil|int|info|io|de|fr|es|uk|it|nl|eu|us|ca|au|ch|at|be"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CALLING = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
IBAN_LANDS = "^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE)"
CUES = r"(?i)(?:e-?mail|mail|contact|write|reach|phone|tel|call|mobile|fax|card|visa|credit|payment|host|server|login|from ip|address|ssn|social security|iban|account|tarjeta|correo|tel[eé]fono|kontakt|telefon|courriel)[^\p{L}]{0,4}\p{L}{0,12}[^\p{L}]{0,4}$"
COUNTER = r"(?i)(?:version|v|isbn|issn|order|invoice|ref|section|chapter|fig|no)[.:# ]{0,3}$"


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes Luhn's check."""
    d = f"cast(substring({digits}, char_length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, char_length({digits}) - 1), 0, (s, i) -> s + case when i % 2 = 0 then {d} when {d} >= 5 then 2 * {d} - 9 else 2 * {d} end) % 10 = 0"


_DIGITS = "regexp_replace(m.value, '[^0-9]', '')"
_OCTETS = "forall(split(m.value, '[.]', -1), p -> char_length(ltrim('0', p)) <= 3 and cast(case when ltrim('0', p) = '' then '0' else substring(ltrim('0', p), 1, 4) end as int) <= 255)"
_OCTETS = _OCTETS.replace("ltrim('0', p)", "regexp_replace(p, '^0+', '')")


def _gate(text: str) -> str:
    """SQL: whether a text can hold a match of EXTRA."""
    held = lambda strings: " or ".join(f"contains({text}, {quoted(x)})" for x in strings)
    return "(" + " or ".join(f"(({held(strings)}) and {text} rlike {quoted(pattern)})" for strings, pattern in GATES) + ")"


def _base(kind: str, text: str) -> str:
    if kind == "email":
        return span_sql(text, EMAIL, "@", True)
    if kind == "ip":
        return f"filter({span_sql(text, IP, "[0-9][.][0-9]", True)}, m -> {_OCTETS})"
    if kind == "card":
        return f"filter({span_sql(text, CARD, "(?:[0-9][ -]?){15}[0-9]", True)}, m -> {_luhn(_DIGITS)})"
    return f"filter({span_sql(text, PHONE, "[+][0-9]", True)}, m -> char_length({_DIGITS}) between 8 and 15)"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(_id, _keep0.., _text, _email, _ip, _card, _phone, _extra): arrays of spans with their surroundings; _extra has kind, too."""
    rows = docs.select(docs[id_col].alias("_id"), *[docs[c].alias(f"_keep{i}") for i, c in enumerate(keep)], F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    rows = rows.select("*", *[F.expr(_base(k, "_text")).alias(f"_{k}") for k in KINDS])
    every = span_sql("_text", "|".join(f"(?:{p})" for p in EXTRA.values()), None, True)
    rows = rows.withColumn("_more", F.expr(f"case when {_gate('_text')} then {every} else cast(array() as array<{AROUND}>) end"))
    kind = "case " + " ".join(f"when m.value rlike {quoted('^(?:' + p + ')$')} then '{k}'" for k, p in EXTRA.items()) + " else 'local' end"
    rows = rows.withColumn("_extra", F.expr(apart("_more", [f"_{k}" for k in KINDS], AROUND))).drop("_more")
    return rows.withColumn("_extra", F.expr(f"transform(_extra, m -> named_struct('start', m.start, 'end', m.end, 'value', m.value, 'before', m.before, 'after', m.after, 'kind', {kind}))"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """candidates() without the texts, written to the shared folder: few rows have spans."""
    return cut(candidates(docs, id_col, text_col).drop("_text"))


def _described(spans: str) -> str:
    """SQL: spans with five votes and the classifier's features."""
    kind = "m.kind"
    before, after = "m.before", "m.after"
    prior = "case when m.before = '' then ' ' else right(m.before, 1) end"
    strict = (
        f"case {kind} when 'email' then case when m.value rlike '^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9][A-Za-z0-9-]*[.])+[A-Za-z]{{2,}}$' then 1 else -1 end "
        "when 'mail' then case when m.value rlike '(?i)[\\\\[(]at[\\\\])]' then 1 else -1 end "
        "when 'phone' then case when m.value rlike '^[+][0-9]{1,3}[ .-]?[(]?[0-9]{1,4}[)]?(?:[ .-]?[0-9]{2,4}){2,4}$' then 1 else -1 end "
        "when 'card' then case when m.value rlike '^[0-9]{16,19}$|^[0-9]{4}([ -])[0-9]{4}\\\\1[0-9]{4}\\\\1[0-9]{4}$' then 1 else -1 end "
        "when 'local' then case when m.value rlike '^[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}$|^[0-9]{3}([ .-])[0-9]{3}\\\\1[0-9]{4}$' then 1 else -1 end "
        "else 1 end"
    )
    range_ = (
        f"case {kind} when 'card' then case when {_luhn(_DIGITS)} then 1 else -1 end "
        f"when 'phone' then case when char_length({_DIGITS}) between 10 and 13 then 1 else 0 end "
        f"when 'ip' then case when m.value rlike '(?:^|[.])0[0-9]' then -1 else 1 end "
        f"when 'local' then case when substring({_DIGITS}, 1, 1) >= '2' then 1 else -1 end "
        f"when 'ssn' then case when m.value rlike '^(?:000|666|9)|-00-|-0000$' then -1 else 1 end "
        "else 0 end"
    )
    gazetteer = (
        f"case {kind} when 'email' then case when m.value rlike '(?i)[.](?:{DOMAINS})$' then 1 else 0 end "
        f"when 'mail' then case when m.value rlike '(?i)(?:[.]|dot[\\\\])]? ?)(?:{DOMAINS})$' then 1 else -1 end "
        f"when 'card' then case when {_DIGITS} rlike '{ISSUERS}' then 1 else 0 end "
        f"when 'phone' then case when m.value rlike {quoted(CALLING)} then 1 else -1 end "
        "when 'ip' then case when m.value rlike '^(?:0|127|255)[.]' then -1 else 1 end "
        f"when 'iban' then case when m.value rlike '{IBAN_LANDS}' then 1 else -1 end "
        "else 0 end"
    )
    context = f"case when {before} rlike {quoted(CUES)} then 1 when {before} rlike {quoted(COUNTER)} then -1 else 0 end"
    border = f"case when {prior} rlike '[\\\\p{{L}}\\\\p{{N}}_/=#]' or {after} rlike '[\\\\p{{L}}\\\\p{{N}}_/=]' then -1 else 1 end"
    features = (
        f"'kind', {kind}, 'size', least(int(m.end - m.start) div 4, 8), 'digits', least(char_length({_DIGITS}) div 3, 6), "
        f"'cue', {context}, 'border', {border}, 'form', {strict}, 'marks', case when m.value rlike '[()\\\\[\\\\]+]' then 1 else 0 end"
    )
    return f"transform({spans}, m -> named_struct('start', m.start, 'end', m.end, 'votes', array({strict}, {range_}, {gazetteer}, {context}, {border}), 'f', named_struct({features})))"


FEATURES = ["kind", "size", "digits", "cue", "border", "form", "marks"]


@dataclass
class Model:
    """Labelers' reliabilities (chance of each vote, given the truth) and the span classifier's weights."""

    share: float = 0.5
    reliability: list[dict[int, tuple[float, float]]] = field(default_factory=list)
    weights: dict[tuple[str, str], float] = field(default_factory=dict)
    bias: float = 0.0

    def sql(self, f: str) -> str:
        """SQL for the probability of a feature struct."""
        parts = [f"{self.bias!r}D"]
        for name in FEATURES:
            cases = [f"when '{v}' then {w!r}D" for (n, v), w in sorted(self.weights.items()) if n == name]
            if cases:
                parts.append(f"(case cast({f}.{name} as string) {' '.join(cases)} else 0D end)")
        return f"(1D / (1D + exp(-({' + '.join(parts)}))))"


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over counted vote patterns: share, reliabilities, posterior of each pattern."""
    if not patterns:
        return 0.5, [], {}
    width = len(next(iter(patterns)))
    post = {v: min(0.95, max(0.05, 0.5 + 0.45 * sum(v) / width)) for v in patterns}
    share, rel = 0.5, []
    for _ in range(rounds):
        yes = sum(n * post[v] for v, n in patterns.items())
        no = sum(n * (1 - post[v]) for v, n in patterns.items())
        share = (yes + 1) / (yes + no + 2)
        rel = []
        for k in range(width):
            table = {}
            for vote in (-1, 0, 1):
                a = sum(n * post[v] for v, n in patterns.items() if v[k] == vote)
                b = sum(n * (1 - post[v]) for v, n in patterns.items() if v[k] == vote)
                # The faint prior holds each labeler to be somewhat better than chance, which fixes the classes' names.
                table[vote] = ((a + (2, 1, 1)[1 - vote]) / (yes + 4), (b + (1, 1, 2)[1 - vote]) / (no + 4))
            rel.append(table)
        for v in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(rel[k][x][0] / rel[k][x][1]) for k, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return share, rel, post


def fit_classifier(rows: list[tuple[tuple[str, ...], float, float]], rounds: int = 300, strength: float = 1e-3) -> tuple[dict[tuple[str, str], float], float]:
    """Logistic regression on (feature values, weight, soft label) groups, one weight for each value."""
    total = sum(w for _, w, _ in rows) or 1.0
    weights: dict[tuple[str, str], float] = {}
    bias, rate = 0.0, 1.0
    for _ in range(rounds):
        grad: dict[tuple[str, str], float] = {}
        slope = 0.0
        for values, w, y in rows:
            z = bias + sum(weights.get((n, v), 0.0) for n, v in zip(FEATURES, values))
            gap = (y - 1 / (1 + math.exp(-max(-30, min(30, z))))) * w / total
            slope += gap
            for key in zip(FEATURES, values):
                grad[key] = grad.get(key, 0.0) + gap
        bias += rate * slope
        for key, g in grad.items():
            weights[key] = weights.get(key, 0.0) + rate * (g - strength * weights.get(key, 0.0))
    return {k: round(v, 6) for k, v in weights.items()}, round(bias, 6)


def _tagged(k: str) -> str:
    """SQL for one kind's spans with their kind."""
    return "_extra" if k == "extra" else f"transform(_{k}, m -> named_struct('start', m.start, 'end', m.end, 'value', m.value, 'before', m.before, 'after', m.after, 'kind', '{k}'))"


def train(scanned: DataFrame) -> Model:
    """Fit on every candidate of every row of scan() or candidates()."""
    # Outer, as an inner explode adds a filter on the array, for which Spark would scan every text twice.
    spans = scanned.select(F.expr(f"concat({', '.join(map(_tagged, [*KINDS, 'extra']))})").alias("_all")).select(F.explode_outer(F.expr(_described("_all"))).alias("s")).filter("s is not null")
    groups = spans.groupBy(F.col("s.votes").alias("votes"), *[F.col(f"s.f.{n}").cast("string").alias(n) for n in FEATURES]).agg(F.count(F.lit(1)).alias("n")).collect()
    groups = sorted(groups, key=lambda r: (list(r["votes"]), [r[n] for n in FEATURES]))
    patterns: dict[tuple[int, ...], int] = {}
    for r in groups:
        patterns[tuple(r["votes"])] = patterns.get(tuple(r["votes"]), 0) + r["n"]
    share, rel, post = estimate(patterns)
    weights, bias = fit_classifier([(tuple(r[n] for n in FEATURES), float(r["n"]), post[tuple(r["votes"])]) for r in groups]) if groups else ({}, 0.0)
    return Model(share, rel, weights, bias)


def _judged(scanned: DataFrame, model: Model, least: float) -> DataFrame:
    """scan() with arrays of (start, end, value, kind, p); of the extra spans only those that the model accepts."""
    for k in [*KINDS, "extra"]:
        spans, name = _tagged(k), f"_{k}"
        judged = f"zip_with({spans}, {_described(spans)}, (m, d) -> named_struct('start', m.start, 'end', m.end, 'value', m.value, 'kind', m.kind, 'p', {model.sql('d.f')}))"
        if k == "extra":
            judged = f"filter({judged}, m -> m.p >= {least}D)"
        none = "cast(array() as array<struct<start:int,end:int,value:string,kind:string,p:double>>)"
        scanned = scanned.withColumn(name, F.expr(f"case when size({name}) > 0 then {judged} else {none} end"))
    return scanned


def find_pii(scanned: DataFrame, model: Model, id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """(id, pii_email, pii_ip, pii_card, pii_phone, pii_extra) of each row of scan(); pii_extra holds the accepted broader spans."""
    found = _judged(scanned, model, least)
    return found.select(F.col("_id").alias(id_col), *[F.col(f"_{k}").alias(f"pii_{k}") for k in [*KINDS, "extra"]])


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, hash of the fixed kinds' spans and the text of all spans, by kind and then start.

    span_scores: the classifier's probability of each span in that order;
    n_doubtful: spans of the fixed kinds it would not have accepted.
    """
    base = [f"transform(pii_{k}, m -> concat('{k}:', m.start, ':', m.end))" for k in KINDS]
    extra = [f"transform(filter(pii_extra, m -> m.kind = '{k}'), m -> concat('{k}:', m.start, ':', m.end))" for k in EXTRA]
    scored = [f"pii_{k}" for k in KINDS] + [f"filter(pii_extra, m -> m.kind = '{k}')" for k in EXTRA]
    return found.select(
        id_col,
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(f"array_join(concat({', '.join(base)}), ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join(concat({', '.join(base + extra)}), ',')").alias("spans"),
        F.size("pii_extra").cast("long").alias("n_extra"),
        F.expr(f"array_join(transform(concat({', '.join(scored)}), m -> cast(round(m.p, 4) as string)), ',')").alias("span_scores"),
        F.expr(" + ".join(f"size(filter(pii_{k}, m -> m.p < 0.5D))" for k in KINDS)).cast("long").alias("n_doubtful"),
    )


def redact_pii(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs, with a null text empty, with every span of text replaced by its kind in brackets; spans that overlap become one.

    Without a model one is fitted to docs, which scans the texts once more:
    keeping them beside their spans would write the whole input again.
    """
    keep = tuple(c for c in docs.columns if c not in (id_col, text_col))
    found = _judged(candidates(docs, id_col, text_col, keep), model or train(candidates(docs, id_col, text_col)), least)
    spans = f"array_sort(transform(concat({', '.join(f'_{k}' for k in [*KINDS, 'extra'])}), m -> named_struct('start', m.start, 'end', m.end, 'kind', m.kind)))"
    found = found.withColumn("_spans", F.expr(spans))
    found = found.withColumn("_over", F.expr(running("_spans", "struct<start:int,end:int,kind:string>", "named_struct('start', x.start, 'end', greatest(x.end, y.end), 'kind', x.kind)")))
    part = "case when m.start >= coalesce(r.end, 0) then concat(substring(_text, coalesce(r.end, 0) + 1, m.start - coalesce(r.end, 0)), '[', upper(m.kind), ']') else '' end"
    parts = f"zip_with(_spans, concat(array(cast(null as struct<start:int,end:int,kind:string>)), slice(_over, 1, size(_over) - 1)), (m, r) -> {part})"
    clean = f"concat(array_join({parts}, ''), substring(_text, element_at(_over, -1).end + 1))"
    names = {id_col: F.col("_id"), text_col: F.expr(f"case when size(_spans) > 0 then {clean} else _text end")} | {c: F.col(f"_keep{i}") for i, c in enumerate(keep)}
    return found.select(*[names[c].alias(c) for c in docs.columns])
