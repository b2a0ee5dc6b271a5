"""Line tables against an independent line-by-line parser, on fixed odd cases and random diffs."""

import random
import re

import pytest

from diffloom.operators import diff

HEAD = "diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n"
ODD = [
    HEAD + "@@ -1,2 +5,3 @@ def f():\n ctx\n-old\n+new\n+more\n",
    HEAD + "@@ -1,2 +5,3 @@\n---x\n+++x\n+after\n\\ No newline at end of file\n+last",
    HEAD + "+no hunk header\n",
    HEAD + "@@ -1,2 +9,3\n+loose header\n",
    HEAD + "@@ -1,1 +3,2 @@\r\n+crlf\r\n+two\r\n",
    HEAD + "@@ -1,1 +3,2 @@\n+form\x0cfeed\n+end\x85next\n",
    "diff --git a/old.py b/old.py\n--- a/old.py\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-gone\n" + HEAD + "@@ -1 +1 @@\n+x\n",
    "diff --git a/venv/m.py b/venv/m.py\n--- a/venv/m.py\n+++ b/venv/m.py\n@@ -1 +1 @@\n+skip\n" + HEAD + "@@ -1 +1 @@\n+\"\"\"open\n+inside\n+close\"\"\"\n+out\n",
    HEAD + "@@ -1 +1 @@\n--- old header look\n+x\n\n-\n+\n",
    "diff --git a/x b/y.py b/x b/y.py\nrename from a\n",
    "",
    "plain prose\n",
]


def lines_of(text):
    return text.splitlines()


def expected(patch):
    """Independent walk over the lines with three counters side by side."""
    file, added, changed, segments = "", [], [], []
    s = h = c = 0
    doc = False
    for raw in lines_of(patch):
        plus = raw[:1] == "+" and raw[:3] != "+++"
        minus = raw[:1] == "-" and raw[:3] != "---"
        if raw.startswith("+++ b/"):
            file, s, h = raw[6:].strip(), 0, 0
            continue
        hunk = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", raw)
        loose = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)", raw)
        live = file and not re.search(r"(?i)(?:^|[/\\])(?:venv|\.venv|site-packages|node_modules)(?:[/\\]|$)", file)
        header = raw.startswith("--- ") or raw.startswith("diff --git")
        if hunk:
            s = h = int(hunk[1])
        elif live and not header:
            if plus:
                added.append((file, s, raw[1:]))
            if plus or minus:
                changed.append((file, h, raw[0], raw[1:]))
            s += plus or raw[:1] not in ("-", "\\")
            h += plus or not (minus or raw[:1] == "\\")
        if raw.startswith("@@"):
            if loose:
                c = int(loose[1])
        elif plus:
            body = raw[1:].strip()
            n = body.count('"""') + body.count("'''")
            doc ^= bool(n % 2)
            if re.match(r"(?:#|//|/\*|\*)", body) or doc or n or "/*" in body or body[:1] in ("'", '"'):
                segments.append((file, c, raw[1:]))
            c += 1
        elif raw[:1] != "-":
            c += 1
    return added, changed, segments


def random_patch(seed):
    rng = random.Random(seed)
    pieces = [" ctx", "-old", "+new", "+# note", '+"""', "---x", "+++x", "\\ No newline at end of file", "", "@@ -1,2 +7,3 @@", "@@ -1 +4", "+++ b/lib/b.py", "+++ b/node_modules/z.js", "--- a/q", "diff --git a/k.py b/k.py", "+ 'quoted'", "+/* c */", "prose", "-- sql", "+++ /dev/null"]
    return HEAD + "@@ -1,3 +2,4 @@\n" + "\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) + rng.choice(["", "\n", "\r\n"])


def test_parsers_match_a_plain_loop(spark):
    cases = ODD + [random_patch(i) for i in range(150)]
    patches = spark.createDataFrame(list(enumerate(cases)), "patch_id long, patch string")
    lines = diff.diff_lines(patches).cache()
    added, changed, segments = ({i: [] for i in range(len(cases))} for _ in range(3))
    for r in diff.added_lines(lines).orderBy("patch_id", "pos").collect():
        added[r.patch_id].append((r.file, r.line_no, r.content))
    for r in diff.lines_heur(lines).orderBy("patch_id", "pos").collect():
        changed[r.patch_id].append((r.file, r.line_no, r.kind, r.content))
    for r in diff.comment_segments(lines).orderBy("patch_id", "pos").collect():
        segments[r.patch_id].append((r.file, r.line_no, r.content))
    for i, patch in enumerate(cases):
        assert (added[i], changed[i], segments[i]) == expected(patch), patch
    lines.unpersist()


def test_touched_files(spark):
    text = "diff --git a/a.py b/a.py\n+++ b/a.py\n+++ b/venv/x.py\n+++ b//dev/null\ndiff --git a/x b/y.py b/z.py\n+++ b/ c.py \n"
    lines = diff.diff_lines(spark.createDataFrame([(1, text)], "patch_id long, patch string"))
    assert [r.file for r in diff.touched_files(lines).orderBy("ord").collect()] == ["a.py", "c.py"]
    assert "venv/x.py" in [r.file for r in diff.touched_files(lines, True).collect()]


@pytest.mark.parametrize(
    ("patch", "reason"),
    [
        (HEAD + "@@ -1,2 +1,2 @@\n a\n-b\n+c\n", "ok"),
        ("", "empty"),
        (" \n", "empty"),
        ("prose only\n", "missing_file_headers"),
        (HEAD, "no_hunks"),
        (HEAD + "@@ -1,2 +1,2 @@\n a\n", "truncated_or_miscounted_hunk"),
        (HEAD + "@@ -1 +1 @@\n-a\n+b\n\\ No newline at end of file\n", "ok"),
        (HEAD + "@@ -1,2 +1,2 @@\n a\nprose\n", "bad_line_in_hunk"),
        (HEAD + "@@ -1,1 +1,2 @@\n a\x0cb\n+c\n", "ok"),
        (HEAD + "@@ -1,2 +1,1 @@\n+a\n+b\n-c\n", "truncated_or_miscounted_hunk"),
        ("diff --git a/x b/x--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n", "ok"),
    ],
)
def test_wellformed(spark, patch, reason):
    row = diff.wellformed(spark.createDataFrame([(1, patch)], "patch_id long, patch string")).first()
    assert (row.reason, row.well_formed) == (reason, reason == "ok")


def test_sizes_and_texts(spark):
    patches = spark.createDataFrame([(1, HEAD + "@@ -1,2 +1,3 @@\n a\n-b\n+c\n+d\n"), (2, None), (3, "")], "patch_id long, patch string")
    rows = {r.patch_id: r for r in diff.size_features(patches).collect()}
    assert (rows[1].lines_added, rows[1].lines_removed, rows[1].lines_changed, rows[1].files_touched, rows[1].hunks) == (2, 1, 3, 2, 1)
    assert (rows[2].lines_added, rows[3].files_touched) == (0, 0)
    assert [r.body for r in diff.body_text(patches).orderBy("patch_id").collect()] == ["b c d", "", ""]
    lines = diff.diff_lines(patches)
    assert [r.paths for r in diff.paths_text(lines, patches).orderBy("patch_id").collect()] == ["src/a.py", "", ""]


def test_prioritize_drops_context_first(spark):
    patch = HEAD + "@@ -1,9 +1,9 @@\n" + " context line\n" * 5 + "-old\n+new\n"
    patches = spark.createDataFrame([(1, patch)], "patch_id long, patch string")
    assert diff.prioritize(patches, None).first().text == patch.rstrip("\n")
    short = diff.prioritize(patches, 120).first().text
    assert "context" not in short and "+new" in short and "@@" in short
    tiny = diff.prioritize(patches, 10).first().text.split("\n")
    assert tiny == ["--- a/src/a.py", "+++ b/src/a.py", "@@ -1,9 +1,9 @@"]


def test_synthetic_patches_are_well_formed(spark):
    rows = spark.createDataFrame([(1, "a.py", "x = 1"), (2, "b.py", "x\ny")], "id long, path string, snippet string")
    for new in (False, True):
        made = diff.synth_patch(rows, new).withColumnRenamed("id", "patch_id")
        assert {r.reason for r in diff.wellformed(made).collect()} == {"ok"}
