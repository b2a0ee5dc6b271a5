"""Language model, language identification, quality, and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from diffloom.llm import langid, lm, quality

PIECES = P.path("piece_bpe_32k.model")
LOWER = {c: c + 32 for c in range(65, 91)}


def all_segmentations(word, table):
    """Sum of products over every way to cut the bytes into pieces."""
    if not word:
        return 1.0
    return sum(p * all_segmentations(word[n:], table) for n in range(1, len(word) + 1) if (p := table.get(word[:n])))


def test_forward_recursion_adds_up_all_segmentations():
    pieces, start = lm.vocabulary(PIECES)
    lattice, table = lm.Lattice(pieces, start), {p: math.exp(s) for p, s in zip(pieces, start)}
    words = ["a", "the", "hello", "über", "日本", "zzqx", "1,5"]
    got = lattice.score(pa.array([w.encode() for w in words]))
    for w, s in zip(words, got):
        assert s == pytest.approx(math.log(all_segmentations(b" " + w.encode(), table)), abs=1e-9)


def uncut(word, pieces, start):
    """The forward recursion in plain Python, scaled at each place."""
    table, longest = {p: math.exp(s) for p, s in zip(pieces, start)}, max(map(len, pieces))
    reached, shift = [1.0], 0.0
    for j in range(1, len(word) + 1):
        here = sum(reached[-n] * table.get(word[j - n : j], 0.0) for n in range(1, min(longest, j) + 1))
        shift += math.log(here)
        reached = [r / here for r in reached[-longest:]] + [1.0]
    return shift


def test_long_words_are_scored_whole():
    pieces, start = lm.vocabulary(PIECES)
    lattice, rng = lm.Lattice(pieces, start), random.Random(9)
    words = [b"th" * 1500, "日本語".encode() * 700, bytes(rng.choice(b"etaoin") for _ in range(200_000)), b"x" * 2047, b"x" * 2048]
    got = lattice.score(pa.array(words))
    for w, s in zip(words, got):
        assert s == pytest.approx(uncut(b" " + w, pieces, start), rel=1e-9)
    (uses,), total = lattice.expected(pa.array(words[:2]), np.array([2.0, 3.0]))
    assert sum(u * len(p) for u, p in zip(uses, pieces)) == pytest.approx(2 * 3001 + 3 * 6301)
    assert total == pytest.approx(got[:2])
    block = np.frombuffer(b" " + words[0], np.uint8)[None]
    assert lattice.forward(lattice.edges(block), 3001)[0] == pytest.approx(lattice.sweep(block[0]))


def test_expected_uses_cover_every_byte():
    pieces, start = lm.vocabulary(PIECES)
    (uses,), _ = lm.Lattice(pieces, start).expected(pa.array([b"hello", b"the"]), np.array([2.0, 3.0]))
    assert sum(u * len(p) for u, p in zip(uses, pieces)) == pytest.approx(2 * 6 + 3 * 4)


def test_scores(docs_of):
    rng = random.Random(1)
    words = ["the", "cat", "Sat", "on", "mat", "über", "x1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "the qzxv", "THE cat"]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    counts = Counter(w for i in train for w in [*tokens(texts[i]), None])
    n, v = sum(counts.values()), len(counts)
    for head in (lm.HEAD, 3, 0):
        rows = {r.doc_id: r for r in lm.score_documents(docs_of(texts), PIECES, head=head).collect()}
        for i, t in enumerate(texts):
            r, ws = rows[i], [*tokens(t), None]
            assert r.held_out == (i not in train) and r.train_tokens == n
            assert (r.n_tokens, r.n_known) == (len(ws), sum(counts[w] > 0 for w in ws))
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), abs=1e-6)
            assert r.score < 0
        assert rows[62].score < rows[63].score  # an unseen word costs more than a known one
    again = {r.doc_id: r.score for r in lm.score_documents(docs_of(texts), PIECES).collect()}
    assert all(again[i] == pytest.approx(rows[i].score, abs=1e-6) for i in again)


def test_odd_rows(odd_rows, no_rows):
    rows = lm.score_documents(odd_rows, PIECES).collect()
    assert len(rows) == 10 and next(r for r in rows if r.doc_id == 1).n_tokens == 1
    assert lm.score_documents(no_rows, PIECES).count() == 0
    found = langid.identify_languages(odd_rows).collect()
    assert len(found) == 10 and {r.lang_pred for r in found if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.identify_languages(no_rows).count() == 0
    labels = odd_rows.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "cast(null as int) as toxic")
    assert quality.score_quality(odd_rows, quality.train(odd_rows, labels)).count() == 10
    assert quality.score_quality(no_rows, quality.train(no_rows, labels.limit(0))).count() == 0


WORDS = {
    "en": "the of and to in that with this from have house water night light through would people".split(),
    "de": "der die und nicht mit ein werden schon über wasser nacht licht durch würde leute haus straße".split(),
    "fr": "le la et les des dans pour avec être maison eau nuit lumière travers serait gens cette".split(),
    "es": "el la los que para con una está casa agua noche luz través sería gente esta niño".split(),
}


def test_languages_held_out(docs_of):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(8, 40))), lang if i % 11 else None))
    truth = {i: next(k for k, ws in WORDS.items() if set(t.split()) <= set(ws)) for i, t, _ in rows}
    got = {r.doc_id: r for r in langid.identify_languages(docs_of(rows)).collect()}
    held = [r for r in got.values() if r.held_out]
    assert len(held) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.accept_languages(docs_of(rows + [(900, "1234 5678"), (901, None)]), langid.train(docs_of(rows)))
    assert {r.doc_id for r in kept.collect()} >= {r.doc_id for r in held if r.score >= 0.5} and not {900, 901} & {r.doc_id for r in kept.collect()}


def plain_prediction(model, x):
    """Family by the largest share, language by votes of the pairs, in plain Python."""
    prob = lambda k, m: 1 / (1 + math.exp(-max(-40, min(40, model.platt[k][0] * m + model.platt[k][1]))))
    out = []
    for row in x:
        margins = [float(row @ model.weights[:, k] + model.bias[k]) for k in range(model.weights.shape[1])]
        nf = len(model.families)
        p = [prob(k, m) for k, m in enumerate(margins)]
        f = max(range(nf), key=lambda k: p[k])
        score, langs = p[f] / sum(p[:nf]), model.members[model.families[f]]
        votes = {g: [0, 0.0, 1.0] for g in langs}
        for k, (owner, a, b) in enumerate(model.pairs, nf):
            if owner == model.families[f]:
                for g, q in ((a, p[k]), (b, 1 - p[k])):
                    votes[g] = [votes[g][0] + (p[k] >= 0.5 if g == a else p[k] < 0.5), votes[g][1] + q, min(votes[g][2], q)]
        best = max(langs, key=lambda g: votes[g][0] + 0.01 * votes[g][1])
        out.append((best, score * votes[best][2]))
    return out


def test_prediction_equals_plain_votes():
    rng = random.Random(6)
    words = WORDS | {"nl": "de het een en van niet met voor zijn water nacht licht huis mensen straat".split(), "it": "il la che per con una essere casa acqua notte luce gente questa bambino".split()}
    texts = [(" ".join(rng.choice(words[g]) for _ in range(rng.randint(2, 25))), g) for g in words for _ in range(40)]
    column = pa.array([t for t, _ in texts])
    x = langid.histogram(column, langid.ORDERS, langid.SIZE)
    model = langid.fit(x, [g for _, g in texts])
    assert len(model.pairs) == 6 and len(model.families) == 2
    lang, score = model.predict(column)
    for got, s, (want, p) in zip(lang, score, plain_prediction(model, x.astype(float))):
        assert got == want and s == pytest.approx(p, abs=1e-3)


def test_every_language_is_learned(docs_of):
    rng = random.Random(8)
    rows = []
    for k in range(510):
        letters = [chr(0x4E00 + 3 * k + j) for j in range(3)]
        rows += [(3 * k + j, "".join(rng.choice(letters) for _ in range(6)), f"lang{k}") for j in range(3)]
    model = langid.train(docs_of(rows), most_rows=1000)
    learned = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert {g for ms in model.members.values() for g in ms} == learned and len(learned) > 480


def test_quality_views_agree_on_held_out(spark, docs_of):
    rng = random.Random(3)
    rows, label = [], {}
    for i in range(700):
        good = rng.random() < 0.6
        text = " ".join(rng.choice(WORDS["en"]) for _ in range(60)) if good else " ".join(rng.choice(WORDS["en"]) + rng.choice(["###", "$$$", "!!"]) for _ in range(60))
        rows.append((i, text, "en", rng.choice(["s1", "s2"]) if good else rng.choice(["s2", "s3"])))
        label[i] = int(good)
    labels = spark.createDataFrame([(i, label[i], 0) for i in range(0, 700, 3)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    model = quality.train(docs, labels)
    assert model.exchanged and model.exchanged[0] > 0 and len(model.views) == 2
    got = quality.score_quality(docs, model).collect()
    unseen = [r for r in got if r.doc_id % 3]
    assert sum(r.good == bool(label[r.doc_id]) for r in unseen) / len(unseen) > 0.95
    assert all(0 <= x <= 1 for r in got for x in (r.content_score, r.meta_score, r.score))


def test_co_training_equals_a_plain_version(spark, docs_of):
    """The rounds over all rows at once, in numpy."""
    rng = random.Random(17)
    rows, label = [], {}
    for i in range(500):
        good = rng.random() < 0.5
        text = " ".join(rng.choice(WORDS["en"]) + rng.choice(["", "" if good else "##"]) for _ in range(rng.randint(5, 50)))
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["s1", "s2"]) if good else rng.choice(["s2", "s3"])))
        label[i] = int(good)
    rows += [(600 + i, *rows[3][1:]) for i in range(40)]  # copies are passed on once
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, label[i], 0) for i in range(0, 500, 4)], "doc_id long, quality int, toxic int")
    got_model = quality.train(docs, labels, exchange=15, sure=0.7)
    got = {r.doc_id: r for r in quality.score_quality(docs, got_model).collect()}

    keys = [r[0] for r in docs.selectExpr("concat_ws(' ', cast(doc_id as string), cast(xxhash64(text, source, lang) as string))").collect()]
    held = np.array([r[0] for r in docs.selectExpr("pmod(xxhash64('held', cast(doc_id as string)), 4) = 0").collect()])
    ids = np.array([r[0] for r in rows])
    x = [quality.content_features(pa.array([r[1] for r in rows])), quality.meta_features(quality.meta_slots([r[3] for r in rows], [r[2] for r in rows], [len(r[1]) for r in rows]))]
    lab = np.flatnonzero((ids < 500) & (ids % 4 == 0))
    lab = lab[np.argsort([keys[i] for i in lab])]
    y, free, given, exchanged = np.array([label[i] for i in ids[lab]], float), np.array(sorted(set(range(len(ids))) - set(lab.tolist()))), [{}, {}], []
    fit = lambda: quality.fit_views([v[lab] for v in x], y, held[lab], [(v[list(g)], np.array(list(g.values()))) for v, g in zip(x, given)])
    for _ in range(quality.ROUNDS):
        views, passed = fit(), 0
        for k, (w, b, _, _) in enumerate(views):
            margin = np.round(x[k][free] @ w + b, 6)
            for want, sign in ((1.0, 1), (0.0, -1)):
                best = {}
                for r, m in zip(free.tolist(), margin.tolist()):
                    if sign * m >= math.log(0.7 / 0.3) and (m not in best or keys[r] < keys[best[m]]):
                        best[m] = r
                new = [r for _, r in sorted(best.items(), reverse=sign > 0) if r not in given[1 - k]][:15]
                passed += len(new)
                given[1 - k].update(dict.fromkeys(new, want))
        exchanged.append(passed)
    model = quality.CoTrained(float(y.mean()), fit(), exchanged)
    score, (content, meta) = model.combine(tuple(v @ w + b for v, (w, b, _, _) in zip(x, model.views)))
    assert got_model.exchanged[0] == exchanged[0] > 20 and len(got_model.exchanged) == len(exchanged)
    assert np.abs(np.array([got[i].score for i in ids.tolist()]) - score).mean() < 0.02
    assert np.mean([(got[i].score >= 0.5) == (s >= 0.5) for i, s in zip(ids.tolist(), score)]) > 0.98


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    prose = lambda lang, n=70: " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(50)) * (rng.random() < 0.3) for _ in range(n))
    item = " ".join(f"item{rng.randrange(10**6)}" for _ in range(30))
    rows = [(i, prose(lang := rng.choice(list(WORDS))), lang, "s", 1) for i in range(120)]
    copy = rows[7][1]
    rows += [(500, copy, "en", "s", 1), (501, f"{prose('en')} {item} {prose('en')}", "en", "s", 1), (502, f"{prose('en')} write to a.b@c.example.com soon", "en", "s", 1), (503, "123 456", None, "s", 1), (504, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert seen["language"] == {i for i, *_ in rows} - {503, 504}
    assert seen["near_dedup"] == seen["language"] - {500} and seen["decontaminate"] == seen["near_dedup"] - {501}
    assert seen["pii"] == seen["tokens"] == seen["decontaminate"]
    assert "[EMAIL] soon" in spark.read.parquet(str(tmp_path / "pii")).filter("doc_id = 502").first().text
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in docs.collect()} and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_with_odd_and_empty_tables(spark, docs_of, odd_rows, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "some words of a benchmark item that stand in no text"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    prose = [(100 + i, " ".join(WORDS["en"][(i * k) % 17] for k in range(30)), "en", "s") for i in range(12)]
    more = docs_of(prose + prose[:3])
    for name in set(odd_rows.columns) - set(more.columns):
        more = more.withColumn(name, F.lit(None).cast(odd_rows.schema[name].dataType))
    for k, docs in enumerate((odd_rows.unionByName(more), odd_rows.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, str(tmp_path))
            if name != "tokens":
                assert made.columns == docs.columns
            made.write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        rows = docs.collect()
        assert all(r.round_trip for r in rows)
        if k:
            assert not rows
        else:  # repeated rows of an id leave one, rows without text or letters go, null ids stay
            ids = [r.doc_id for r in rows]
            assert len(ids) == len(set(ids)) and not {1, 2, 3} & set(ids) and {4, 100} <= set(ids)


def test_words_are_gathered_before_they_are_scored():
    """Batches of few rows are put together, with the same rows in the same order, up to a bound."""
    words = [f"w{i}".encode() for i in range(1000)]
    small = [pa.RecordBatch.from_arrays([pa.array(words[i : i + 10]), pa.array(range(i, i + 10))], ["word", "c"]) for i in range(0, 1000, 10)]
    out = list(lm.gathered(iter(small), rows=400))
    assert [b.num_rows for b in out] == [400, 400, 200]
    assert [w for b in out for w in b.column(0).to_pylist()] == words and [c for b in out for c in b.column(1).to_pylist()] == list(range(1000))
    assert len(list(lm.gathered(iter(small), size=1))) == 100 and not list(lm.gathered(iter([])))
