"""Secrets, personal data, host rules and decontamination against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffloom.llm import decontam, hostrules, pii, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def noise(seed, pieces, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(n)]


SECRET_PIECES = [" ", "é", "😀", "token = ", 'Secret:"', "api_key='", "abc", "0123456789abcdef", "deadbeef", "AKIA", "ABCDEFGH12345678", "==", ".", "x9Yz", "\n", "password"]


def secret_spans(t):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_base(docs_of):
    texts = noise(1, SECRET_PIECES, 200)
    rows = secrets.secret_digest(secrets.find_secrets(docs_of(texts))).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        spans = secret_spans(t)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[2] == k for x in spans) for k in ("assign", "access", "hex")]
        assert {f"{k}:{s}:{e}" for s, _, k, e in spans} <= set(r.spans.split(","))


def test_window_entropy_equals_a_recount(spark):
    rng = random.Random(2)
    values = ["".join(rng.choice(secrets.ALPHABET) for _ in range(rng.randint(20, 90))) for _ in range(30)] + ["a" * 30, "ab" * 20]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i long, v string").orderBy("i").select(F.expr(secrets._entropy("v"))).collect()]
    for v, bits in zip(values, got):
        w = secrets.WINDOW
        best = max(-sum(c / w * math.log2(c / w) for c in Counter(v[i : i + w]).values()) for i in range(len(v) - w + 1))
        assert bits == pytest.approx(best, abs=1e-9)


def test_entropy_spans_and_allow_list(docs_of):
    key = "kD8s0qPz7LmX2vB9nT4yRw1Hc6Jf3Gu5"
    texts = [f"use {key} now", "550e8400-e29b-41d4-a716-446655440000", f"sha256-{key}", "some_long_function_name_with_words_only2", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", f"token={key}", f"EXAMPLE{key}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    rows = secrets.secret_digest(secrets.find_secrets(docs_of(texts))).orderBy("doc_id").collect()
    assert [r.n_entropy for r in rows] == [1, 0, 0, 0, 0, 0, 0, 0]
    assert rows[0].spans == f"entropy:4:{4 + len(key)}" and rows[5].n_assign == 1


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def pii_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


PII_PIECES = [" ", "é", "a@b.c", "_d@e.f-g.h", "..", ".", "x", "1.2.3.4", "0256.1.1.1", "300.1.1.1", "4111 1111-1111 1111", "4242424242424242", "-", "+1 (212) 555-0100", "+", "9", "12", "(", "mail me at ", "@", "😀"]
MODEL = pii.Model()


def test_pii_base(docs_of):
    texts = noise(3, PII_PIECES, 300)
    rows = pii.pii_digest(pii.find_pii(pii.candidates(docs_of(texts)), MODEL)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        spans = pii_spans(t)
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert set(spans) <= set(r.spans.split(","))


def test_pii_gates_hold_back_no_match_and_most_texts(docs_of):
    mails = [f"{a}ann{at}host{dot}com" for a in ("", "x ") for at in (" at ", "(at)", " [at] ", "[at)", " (at)", "(at] ") for dot in (".", " dot ", "(dot)", " [dot] ", "[dot)")]
    others = ["GB29 NWBK ABCD EFGH", "DE12ABCDEFGHIJKL", "(415) 555-0134", "415.555.0134", "415 555-0134", "123-45-6789", "ab:cd:ef:ab:cd:ef:ab:cd", "1:22:333:4444:a:b:c:D"]
    plain = ["we met at noon. 12 of 300 came at 10:30:05, as planned", "AB12 is 5-1234", "(at) the door", ""]
    rows = pii.scan(docs_of([*mails, *others, *plain])).orderBy("_id").collect()
    assert [[m.value for m in r._extra] for r in rows] == [[x.removeprefix("x ")] for x in mails] + [[x] for x in others] + [[]] * len(plain)
    assert [r.g for r in docs_of(plain).orderBy("doc_id").selectExpr(f"{pii._gate('text')} as g").collect()] == [False] * len(plain)


def test_pii_learns_from_votes(docs_of):
    rng = random.Random(5)
    number = lambda n: "".join(rng.choice("23456789") for _ in range(n))
    texts = [f"call me: phone ({number(3)}) {number(3)}-{number(4)} please" for _ in range(40)] + [f"write to name{i}@mail.example.com or jo{i} [at] mail [dot] com" for i in range(40)] + [f"version 1{number(2)}-{number(3)}-{number(4)}x and id 9{number(2)}-00-0000z" for i in range(40)]
    docs = pii.scan(docs_of(texts))
    model = pii.train(docs)
    assert model.weights and all(abs(sum(v[k] for v in t.values()) - 1) < 1e-9 for t in model.reliability for k in (0, 1))
    rows = pii.pii_digest(pii.find_pii(docs, model)).orderBy("doc_id").collect()
    assert sum(r.n_extra for r in rows[:40]) >= 36 and sum(r.n_extra for r in rows[40:80]) >= 36 and sum(r.n_extra for r in rows[80:]) == 0


def plain_model(spans):
    """Expectation-maximisation and the logistic fit over the spans one by one, in numpy."""
    votes = np.array([s.votes for s in spans])
    post = np.clip(0.5 + 0.45 * votes.sum(1) / votes.shape[1], 0.05, 0.95)
    for _ in range(50):
        share = (post.sum() + 1) / (len(post) + 2)
        odds = np.full(len(post), math.log(share / (1 - share)))
        for k in range(votes.shape[1]):
            for vote, up, down in ((1, 2, 1), (0, 1, 1), (-1, 1, 2)):
                at = votes[:, k] == vote
                odds[at] += math.log((post[at].sum() + up) / (post.sum() + 4)) - math.log(((1 - post)[at].sum() + down) / ((1 - post).sum() + 4))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    names = sorted({(n, str(s.f[n])) for s in spans for n in pii.FEATURES})
    x = np.array([[(n, v) in {(f, str(s.f[f])) for f in pii.FEATURES} for n, v in names] for s in spans], float)
    w, b = np.zeros(len(names)), 0.0
    for _ in range(300):
        gap = (post - 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))) / len(post)
        w, b = w + x.T @ gap - 1e-3 * w, b + gap.sum()
    return 1 / (1 + np.exp(-(x @ w + b)))


def test_model_equals_plain_estimation(docs_of):
    rng = random.Random(13)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kinds = [lambda: f"call phone {number(3)}-{number(3)}-{number(4)}", lambda: f"id {number(3)}-{number(2)}-{number(4)}", lambda: f"jo{number(1)} [at] mail [dot] {rng.choice(['com', 'zz'])}", lambda: f"v {number(3)}.{number(3)}.{number(4)}x", lambda: f"a{number(2)}@b.c{rng.choice(['om', ''])}", lambda: f"+{number(2)} {number(3)} {number(5)}", lambda: f"{number(1)}.{number(2)}.1.0"]
    scanned = pii.scan(docs_of([" ".join(rng.choice(kinds)() for _ in range(rng.randint(0, 9))) for _ in range(80)]))
    spans = [s for r in scanned.select("_id", F.expr(pii._described(f"concat({', '.join(map(pii._tagged, [*pii.KINDS, 'extra']))})")).alias("d")).orderBy("_id").collect() for s in r.d]
    want = plain_model(spans)
    got = [m.p for r in pii.find_pii(scanned, pii.train(scanned), least=0.0).orderBy("doc_id").collect() for k in [*pii.KINDS, "extra"] for m in r[f"pii_{k}"]]
    assert len(got) == len(want) > 200 and np.abs(np.array(got) - want).max() < 1e-3 and min(want) < 0.5 < max(want)
    digest = pii.pii_digest(pii.find_pii(scanned, pii.train(scanned))).collect()
    assert sum(r.n_doubtful for r in digest) == sum(p < 0.5 for p, k in zip(want, [k for r in pii.find_pii(scanned, MODEL, least=0.0).orderBy("doc_id").collect() for k in [*pii.KINDS, "extra"] for _ in r[f"pii_{k}"]]) if k in pii.KINDS)
    assert all(len([x for x in r.span_scores.split(",") if x]) == len([x for x in r.spans.split(",") if x]) for r in digest)


def test_very_many_matches(docs_of):
    n = 20_000
    texts = [" ".join(f"{i:016x}" for i in range(n)), " ".join(f"u{i}@h.org" for i in range(n)), " ".join(f"{i:016x} kD8s0qPz7LmX2vB9nT4y{i}" for i in range(n // 4))]
    found = {r.doc_id: r for r in secrets.secret_digest(secrets.find_secrets(docs_of(texts))).collect()}
    assert found[0].n_hex == n and found[0].base_sha256 == hashlib.sha256(",".join(f"hex:{17 * i}:{17 * i + 16}" for i in range(n)).encode()).hexdigest()
    assert found[2].n_hex == n // 4 and found[2].n_entropy == n // 4
    rows = pii.redact_pii(docs_of(texts[1:2])).collect()
    assert rows[0].text == " ".join(["[EMAIL]"] * n)


def test_apart(spark):
    from diffloom.llm import spans as sp

    rng = random.Random(14)
    make = lambda n: sorted((a := rng.randrange(60), a + rng.randint(1, 6), "v") for _ in range(n))
    rows = [(i, make(rng.randint(0, 8)), make(rng.randint(0, 5)), make(rng.randint(0, 5))) for i in range(200)]
    df = spark.createDataFrame(rows, f"i int, a array<{sp.FIELDS}>, b array<{sp.FIELDS}>, c array<{sp.FIELDS}>")
    for i, got in df.select("i", F.expr(sp.apart("a", ["b", "c"]))).collect():
        want = [x for x in rows[i][1] if not any(o[0] < x[1] and x[0] < o[1] for o in rows[i][2] + rows[i][3])]
        assert [tuple(x) for x in got] == want


def test_estimation_recovers_reliabilities():
    rng = random.Random(6)
    good = [0.9, 0.8, 0.7]
    patterns = Counter()
    for _ in range(6000):
        y = rng.random() < 0.4
        patterns[tuple((1 if (rng.random() < g) == y else -1) for g in good)] += 1
    share, rel, post = pii.estimate(dict(patterns))
    assert abs(share - 0.4) < 0.05
    for g, table in zip(good, rel):
        assert abs(table[1][0] - g) < 0.05 and abs(table[-1][1] - g) < 0.05
    assert post[(1, 1, 1)] > 0.9 > 0.1 > post[(-1, -1, -1)]


def test_redaction(docs_of):
    docs = docs_of(["é mail a@b.co, ip 1.2.3.4 end", "nothing", None, ""])
    out = pii.redact_pii(docs, MODEL).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["é mail [EMAIL], ip [IP] end", "nothing", "", ""]
    assert out[0].asDict().keys() == docs.first().asDict().keys()


def host_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_host_counts(docs_of):
    texts = noise(7, ["a ", "b ", "c ", "\n", "a b c ", "#", "é ", "\t", "same line\n", "\x0b", "\x1f", "a b c\na b c\n"], 200) + [None, "", "a a a a"]
    rows = hostrules.host_quality(docs_of(texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == host_counts(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_bad_hosts_lose_their_doubtful_documents(docs_of):
    rng = random.Random(8)
    prose = lambda n=80: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(i, prose(), "en", "good") for i in range(40)] + [(100 + i, "short", "en", "bad") for i in range(36)]
    rows += [(200, prose() + " ##### $$$$$ %%%%% &&&&& |||||", "en", "bad"), (201, prose(), "en", "bad"), (202, prose() + " ##### $$$$$ %%%%% &&&&& |||||", "en", "good"), (203, prose(), "en", None)]
    kept = {r.doc_id: r.kept for r in hostrules.host_quality(docs_of(rows)).collect()}
    assert (kept[200], kept[201], kept[202], kept[203], kept[100], kept[0]) == (False, True, True, True, False, True)
    hosts = {r.host: r for r in hostrules.host_verdicts(hostrules.document_counts(docs_of(rows))).collect()}
    assert 0 < hosts["good"].host_rate < hosts["bad"].host_rate < 1 and hosts["bad"].host_failed == 37


def items(seed=9, n=30):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
    return [(i, " ".join(word() for _ in range(rng.randint(14, 60))) + ".") for i in range(n)], word, rng


def test_decontamination(spark, docs_of):
    bench, word, rng = items()
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, want, near = [], set(), set()
    for i, text in bench:
        rows.append((i, f"{prose(rng.randint(0, 50))} {text} {prose(rng.randint(0, 50))}"))
        want.add((i, i))
        rows.append((100 + i, f"{prose(20)}\n{text.upper().replace(' ', ', ')} {prose(20)}"))  # case and marks do not matter
        want.add((100 + i, i))
        words = text.split()
        if len(words) > 50:  # one word is five of at least 46 shingles: 41 of 51 shared
            words[len(words) // 2] = word()
            rows.append((200 + i, f"{prose(30)} {' '.join(words)} {prose(30)}"))
            near.add((200 + i, i))
        rows.append((300 + i, f"{prose(30)} {' '.join(text.split()[: len(text.split()) // 3])} {prose(30)}"))
        rows.append((400 + i, prose(120)))
    got = decontam.contaminated(docs_of(rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert want <= pairs and near <= pairs and pairs <= want | near
    assert all(r.similarity == 1.0 and r.hamming == 0 for r in got if (r.doc_id, r.item_id) in want)
    small = decontam.contaminated(docs_of(rows), spark.createDataFrame(bench, "item_id long, text string"), seed_block=100).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, got))
    clean = decontam.drop_contaminated(docs_of(rows), spark.createDataFrame(bench, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in pairs}


def test_decontamination_beyond_the_radius(spark, docs_of):
    """One word of 40 replaced: 32 of 40 shingles shared, similarity exactly 0.8, at any distance of the fingerprints."""
    rng = random.Random(12)
    prose = lambda n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(n)]
    bench = [prose(40) for _ in range(300)]
    docs = [" ".join([*prose(10), *words[:3], *prose(1), *words[4:], *prose(10)]) for words in bench]
    got = decontam.contaminated(docs_of(docs), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bench)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.similarity) for r in got) == [(i, i, 10, 0.8) for i in range(300)]
    assert max(r.hamming for r in got) > decontam.RADIUS


def brute_windows(docs, bench, percent=80):
    """The best similarity of any window of the item's size, for each document and item that reaches the percent."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    grams = lambda ws: [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)] if len(ws) >= 5 else [tuple(ws)] if ws else []
    items = {i: grams(cut(t)) for i, t in bench}
    df = Counter(g for gs in items.values() for g in set(gs))
    weight = lambda g: 1 + math.floor(math.log2(len(items) / df[g])) if g in df else 1 + len(items).bit_length() - 1
    out = {}
    for d, t in docs:
        gs = grams(cut(t))
        for i, want in items.items():
            b = Counter(want)
            for s in range(max(1, len(gs) - len(want) + 1)):
                a = Counter(gs[s : s + len(want)])
                shared = sum(min(a[g], b[g]) * weight(g) for g in a)
                every = sum(k * weight(g) for g, k in (a | b).items())
                if 100 * shared >= percent * every > 0 and shared / every > out.get((d, i), (0, 0))[0] + 1e-12:
                    out[d, i] = (shared / every, s)
    return out


def test_decontamination_equals_all_windows(spark, docs_of):
    """Parts in any order, replaced, inserted and dropped words, shared boilerplate, repeated shingles."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
    prose = lambda n: [word() for _ in range(n)]
    boiler = prose(12)
    bench = [prose(30) + prose(30) + prose(30) for _ in range(6)] + [boiler + prose(rng.randint(20, 40)) for _ in range(8)] + [prose(8) * 4, prose(3), prose(7)]
    docs = []
    for words in bench:
        a, b, c = words[: len(words) // 3], words[len(words) // 3 : 2 * len(words) // 3], words[2 * len(words) // 3 :]
        for parts in ([a, b, c], [b, c, a], [c, b, a], [a, prose(1), b, c], [a[:-2], b, c[1:]], [a, b, prose(2), c[2:]]):
            copy = [w if rng.random() > 0.003 else word() for p in parts for w in p]
            docs.append(" ".join(prose(rng.randint(0, 20)) + copy + prose(rng.randint(0, 20))))
    docs += [" ".join(boiler + prose(30)) for _ in range(5)] + [" ".join(bench[0] + bench[7]), " ".join(bench[-2])]
    bench, docs = [(i, " ".join(w)) for i, w in enumerate(bench)], list(enumerate(docs))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontam.contaminated(docs_of(docs), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = brute_windows(docs, bench)
    assert got.keys() == want.keys() and len(want) > 40
    assert all(got[k] == (pytest.approx(want[k][0], abs=1e-8), want[k][1]) for k in want)
    turned = [k for k in want if k[0] < 36 and k[0] % 6 == 1]
    assert len(turned) >= 3  # parts B C A of items A B C


def test_several_texts_of_one_id(spark, docs_of):
    bench, word, rng = items(16, 4)
    rows = [(1, bench[0][1]), (1, bench[1][1]), (1, bench[1][1]), (2, "other words")]
    items_ = [(0, bench[0][1]), (1, bench[1][1]), (1, bench[2][1])]
    got = decontam.contaminated(docs_of(rows), spark.createDataFrame(items_, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.similarity) for r in got} == {(1, 0, 1.0), (1, 1, 1.0)}


def test_multi_index_keeps_every_pair_within_the_radius():
    masks = set(decontam._variants(16, decontam.RADIUS // decontam.BLOCKS))
    rng = random.Random(10)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), decontam.RADIUS):
            y ^= 1 << b
        assert any(((x >> 16 * k) ^ (y >> 16 * k)) & 0xFFFF in masks for k in range(4))


def test_odd_rows(spark, odd_rows, no_rows):
    bench = spark.createDataFrame([(0, None), (None, "text"), (1, ""), (2, "plain words for a text of eight tokens"), (2, "plain words for a text of eight tokens"), (3, "two words")], "item_id long, text string")
    got = decontam.contaminated(odd_rows, bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(6, 2)]
    assert decontam.contaminated(no_rows, bench).count() == 0
    assert decontam.contaminated(odd_rows, bench.limit(0)).count() == 0
    for made in (secrets.secret_digest(secrets.find_secrets(odd_rows)), hostrules.host_quality(odd_rows), pii.pii_digest(pii.find_pii(pii.scan(odd_rows), pii.train(pii.scan(odd_rows))))):
        assert len(made.collect()) == 10
    assert pii.redact_pii(odd_rows, MODEL).columns == odd_rows.columns
    assert hostrules.host_quality(no_rows).count() == 0 and pii.find_pii(pii.scan(no_rows), pii.train(pii.scan(no_rows))).count() == 0 and secrets.find_secrets(no_rows).count() == 0
