"""Pair truncation and issue-versus-patch findings against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from diffloom.operators import diff, heuristics, pairs

MARKS = ("---", "+++", "@@")


def prune(patch, most=None):
    lines = patch.splitlines()
    if most is None:
        return "\n".join(lines) if lines else patch
    kept = [x for x in lines if x.startswith((*MARKS, "diff ", "index ", "+", "-"))]
    if len("\n".join(kept)) <= most:
        return "\n".join(kept)
    out, used = [], 0
    for x in kept:
        if x.startswith(MARKS) or used + len(x) + 1 <= most:
            out.append(x)
            used += len(x) + 1
    return "\n".join(out)


def truncated(issue, patch, most):
    budget = most - 3
    a, b = issue.split(), patch.split()
    if len(a) + len(b) <= budget:
        return issue, patch
    room = budget - min(len(a), max(16, min(48, budget // 4)))
    if len(b) > room:
        patch = prune(patch)
        if len(patch.split()) > room:
            patch = prune(patch, 4 * room)
        if len(patch.split()) > room:
            patch = " ".join(patch.split()[:room])
    left = max(0, budget - len(patch.split()))
    return (" ".join(a[:left]) if len(a) > left else issue), patch


@pytest.mark.parametrize("most", [40, 100, 256])
def test_truncation(spark, most):
    rng = random.Random(most)
    line = lambda: rng.choice("+- @") * rng.choice([1, 1, 2, 3]) + " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 14)))
    rows = [(i, " ".join("i" * rng.randint(1, 8) for _ in range(rng.choice([0, 5, 40, 300]))), "\n".join(["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1 +1 @@", *[line() for _ in range(rng.choice([0, 3, 20, 120]))]])) for i in range(60)]
    df = spark.createDataFrame([*rows, (60, None, None)], "patch_id long, problem_statement string, patch string")
    got = {r.patch_id: (r.problem_statement, r.patch) for r in pairs.truncate(df, most).collect()}
    assert got == {i: truncated(a, b, most) for i, a, b in rows} | {60: ("", "")}
    made = {r.patch_id: r.tokens for r in pairs.tokens(df, most).collect()}
    assert all(made[i] == [*got[i][0].split(), *got[i][1].split()][: most - 3] for i in got)


ISSUE = "`parse_args_list` breaks in SymbolTable, see `lib/util.py`; got 'magic-value'"
PATCH = """diff --git a/lib/util.py b/lib/util.py
--- a/lib/util.py
+++ b/lib/util.py
@@ -1,2 +10,9 @@
+x = 'magic-value'
+if x == 'a':
+    return 'b'
+if y is None: return 0
+try:
+    go()
+except Exception:
+    pass
+z = 1  # noqa
diff --git a/tests/test_z.py b/tests/test_z.py
--- a/tests/test_z.py
+++ b/tests/test_z.py
@@ -5,2 +5,2 @@
+@pytest.mark.skip
-    assert old
+    # assert new
"""


def found(spark, issue, patch):
    patches = spark.createDataFrame([(1, 1, patch)], "patch_id long, instance_id long, patch string")
    issues = spark.createDataFrame([(1, issue)], "instance_id long, problem_statement string")
    return sorted(tuple(r)[1:] for r in heuristics.findings(diff.diff_lines(patches), patches, issues).collect())


def test_findings_of_all_rules(spark):
    assert found(spark, ISSUE, PATCH) == sorted([
        ("issue_literal_hardcoding", "high", "lib/util.py", 10, "Added line hardcodes issue literal 'magic-value' in condition/return/assignment: x = 'magic-value'"),
        ("special_casing", "high", "lib/util.py", 11, "Added multi-line special casing: if x == 'a': -> return 'b'"),
        ("special_casing", "high", "lib/util.py", 13, "Added single-line special casing: if y is None: return 0"),
        ("swallowed_exceptions", "high", "lib/util.py", 16, "Added multi-line swallowed exception: except Exception: -> pass"),
        ("suppression_markers", "medium", "lib/util.py", 18, "Added suppression marker (# noqa): z = 1  # noqa"),
        ("test_tampering", "critical", "tests/test_z.py", 5, "Added skip/xfail decorator or call in test file: @pytest.mark.skip"),
        ("test_tampering", "high", "tests/test_z.py", 6, "Removed assertion statement from test file: assert old"),
        ("test_tampering", "high", "tests/test_z.py", 6, "Commented out assertion in test file: # assert new"),
        ("scope_creep", "medium", "tests/test_z.py", 1, "Touched file 'tests/test_z.py' is not named in the issue and not in the same package/directory as named files (['lib/util.py'])"),
        ("issue_identifier_overlap", "medium", "lib/util.py", 10, "Changed lines have 0% overlap with issue identifiers: ['SymbolTable', 'parse_args_list']"),
    ])


def test_file_findings(spark):
    patch = "--- a/other/z.py\n+++ b/other/z.py\n@@ -1 +1 @@\n+parse_args_list(SymbolTable)\n"
    rows = [r for r in found(spark, ISSUE, patch) if r[0] == "issue_file_overlap"]
    assert rows == [("issue_file_overlap", "medium", "other/z.py", 1, "None of the touched files ['other/z.py'] match issue named files/modules: ['lib/util.py']")]
    patch = "--- a/lib/util.py\n+++ b/lib/util.py\n@@ -1 +1 @@\n+parse_args_list(SymbolTable)\n"
    rows = found(spark, ISSUE + " and `core/app.py`", patch)
    assert rows == [("issue_file_overlap", "low", "lib/util.py", 1, "Issue mentions files/modules ['core/app.py'] that were not touched in patch.")]
    assert found(spark, None, "") == []


def test_damaged_lines_stay_apart(spark):
    import __spark_entry__

    df = __spark_entry__.queries()["ml_build_training"](spark, "/root/testdata/sf0.001")
    assert {(r.label, r.source) for r in df.select("label", "source").distinct().collect()} == {(0, "gold"), (1, "synthetic")}
    both = df.groupBy("patch_id").agg(F.count_distinct("patch").alias("k"))
    assert both.filter("k = 2").count() > 0.9 * both.count()
