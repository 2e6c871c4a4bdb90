import random

from pyspark.sql import functions as F

from lintlake.operators import changes as CH
from lintlake.operators import compliance as CO
from lintlake.operators import history as HI
from lintlake.operators import review as RV
from lintlake.operators import rules as RU
from lintlake.operators import scoring as SC
from lintlake.schemas import SNAPSHOTS
from lintlake.sources import diffs as DI
from lintlake.sources import state as ST

# --- diffs -------------------------------------------------------------------

TWO_HUNKS = """diff --git a/src/pay.rs b/src/pay.rs
index 111..222 100644
--- a/src/pay.rs
+++ b/src/pay.rs
@@ -10,0 +11,2 @@ fn pay() {
+    let a = 1;
+    balance -= amount;
@@ -20 +22 @@
-old
+new
"""


def lines_of(spark, text, chunk=4096):
    diffs = spark.createDataFrame([("p", "d", text)], "project STRING, diff_id STRING, diff STRING")
    rows = DI.added_lines(DI.diff_rows(diffs, chunk)).collect()
    return sorted((r.path, r.line_no, r.text) for r in rows)


def test_two_hunks(spark):
    assert [(p, n) for p, n, _ in lines_of(spark, TWO_HUNKS)] == [("src/pay.rs", 11), ("src/pay.rs", 12), ("src/pay.rs", 22)]


def test_deleted_file_and_two_files(spark):
    deleted = "--- a/x.rs\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n"
    assert lines_of(spark, deleted) == []
    two = "+++ b/a.rs\t2024\n@@ -0,0 +1 @@\n+x\n+++ b/b.rs\n@@ -0,0 +5 @@\n ctx\n+y\n"
    assert lines_of(spark, two) == [("a.rs", 1, "x"), ("b.rs", 6, "y")]


def test_read_diffs(spark, tmp_path):
    (tmp_path / "one.diff").write_text(TWO_HUNKS)
    rows = DI.read_diffs(spark, str(tmp_path), "p")
    got = DI.added_lines(rows).collect()
    assert {(r.project, r.diff_id) for r in got} == {("p", "one.diff")} and len(got) == 3


def test_a_diff_file_of_many_splits(spark, tmp_path):
    """Headers, hunks and rows that are parted by split borders, against numbering the file from its first line on."""
    rng = random.Random(9)
    out, want, path, line = [], [], None, 0
    for i in range(6000):
        kind = rng.choices(["add", "keep", "gone", "hunk", "file", "null"], [60, 20, 15, 2, 1, 0.2])[0]
        if kind == "file" or i == 0:
            path = f"d/{i}.py"
            out += [f"--- a/{path}", f"+++ b/{path}"]
        elif kind == "null":
            path = None
            out.append("+++ /dev/null")
        elif kind == "hunk":
            line = rng.randrange(1, 9000)
            out.append(f"@@ -1,2 +{line},9 @@")
        elif kind == "gone":
            out.append(f"-text {i}")
        else:
            out.append(("+" if kind == "add" else " ") + f"text é {i}" + rng.choice(["", "\r"]))
            if path is not None:
                if kind == "add":
                    want.append((path, line, f"text é {i}"))
                line += 1
    (tmp_path / "big.diff").write_bytes("\n".join(out).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = DI.read_diffs(spark, str(tmp_path), "p")
        assert rows.rdd.getNumPartitions() > 20 and rows.select("range").distinct().count() > 20
        got = sorted((r.path, r.line_no, r.text) for r in DI.added_lines(rows).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(want) and len(got) > 3000


def test_odd_diffs_in_every_chunk_size(spark):
    odd = ("+early\n@@ -1 +3 @@\n+no file yet\n+++ b/a.rs\n+carries on\n ctx\n@@ bad @@\n+still\n++ looks like a header\n"
           "+++ /dev/null\n+ghost\n ghost\n+++ c.rs\n+after\n@@ -1 +40,2 @@\n-gone\n\\ No newline\n+forty\n--- a/skipped\n+++ b/d.rs\n+next\n"
           + "".join(f"+row {i}\n ctx\n" for i in range(20)) + "@@ -9 +9 @@\n+nine\n")
    want = sorted(
        [("a.rs", 3, "carries on"), ("a.rs", 5, "still"), ("a.rs", 6, "+ looks like a header"), ("c.rs", 7, "after"),
         ("c.rs", 40, "forty"), ("d.rs", 41, "next"), ("d.rs", 9, "nine")]
        + [("d.rs", 42 + 2 * i, f"row {i}") for i in range(20)])
    for chunk in (1, 2, 3, 7, 4096):
        assert lines_of(spark, odd, chunk) == want


# --- review and gate -----------------------------------------------------------


def test_review_and_gate(spark, make_files):
    files = make_files(
        ("bad", "a.py", "import os\nos.system(x)\nos.system(y)\nstock = stock - 1\n"),
        ("warn", "b.py", "count += 1\n"),
        ("fine", "c.py", "x = 1\n"),
    )
    added = spark.createDataFrame(
        [("bad", "a.py", 3, "os.system(y)"), ("bad", "a.py", 4, "stock = stock - 1"), ("bad", "gone.py", 1, "total += 1"),
         ("warn", "b.py", 1, "count += 1")],
        "project STRING, path STRING, line_no INT, text STRING")
    found = RU.scan_findings(files)
    review = RV.review_findings(found, files, added)
    got = sorted((r.project, r.rule, r.line_no) for r in review.collect())
    assert got == [("bad", "dangerous-command", 3), ("bad", "race-condition", 4), ("warn", "race-condition", 1)]
    verdicts = {r.project: (r.findings, r.blocking, r.verdict) for r in RV.review_summary(files, review).collect()}
    assert verdicts == {"bad": (2, 1, "failed"), "warn": (1, 0, "passed with advisories"), "fine": (0, 0, "passed")}
    user = spark.createDataFrame([("fine", "r")], "project STRING, rule STRING")
    gates = {r.project: (r.scan_blocking, r.rule_findings, r.review_blocking, r.passed)
             for r in RV.gate(RU.scan_rows(files), user, added).collect()}
    assert gates == {"bad": (2, 0, 1, False), "warn": (0, 0, 0, True), "fine": (0, 1, 0, False)}
    assert {r.path for r in RV.touched_files(files, added).collect()} == {"a.py", "b.py"}


# --- framework ----------------------------------------------------------------


def status(spark, keys):
    k = spark.createDataFrame([("p", x) for x in [None, *keys]], "project STRING, key STRING")
    return {r.id[:3]: (r.status, r.reasons) for r in CO.category_status(k).collect()}


def test_category_status(spark):
    got = status(spark, ["KLR-SQLI", "dangerous-command", "todo-tracker"])
    assert got["A03"] == ("Warning", ["OS Command Injection (dangerous-command)", "SQL Injection (KLR-SQLI)"])
    assert got["A07"] == ("Passed", []) and got["A10"] == ("Not assessed", []) and len(got) == 10
    assert {s for s, _ in status(spark, []).values()} == {"Passed", "Not assessed"}
    got = status(spark, ["hardcoded-secret"])
    assert got["A07"][0] == "Warning" and got["A03"][0] == "Passed"


def test_extra_mapping(spark):
    extra = [("todo-tracker", "A09:2021", "CWE-546", "Suspicious Comment")]
    k = spark.createDataFrame([("p", "todo-tracker")], "project STRING, key STRING")
    rows = {r.id: r.status for r in CO.category_status(k, extra).collect()}
    assert rows["A09:2021"] == "Warning" and rows["A03:2021"] == "Not assessed"
    assert CO.weakness_counts(k, extra).first().cwe == "CWE-546"


def test_weakness_counts(spark):
    k = spark.createDataFrame([("p", "hardcoded-secret")] * 2 + [("p", "large-file")], "project STRING, key STRING")
    assert [(r.cwe, r.n) for r in CO.weakness_counts(k).collect()] == [("CWE-798", 2)]


# --- history ------------------------------------------------------------------


def snapshots(spark, *points):
    rows = [("p", f"{i:020d}", f"epoch-{i}", None, score, total, 0, 0, 0, total, 1, 1) for i, (score, total) in enumerate(points)]
    return spark.createDataFrame(rows, SNAPSHOTS)


def test_trend_and_index(spark):
    rows = snapshots(spark, (78, 30), (88, 12), (94, 7))
    t = HI.score_trend(rows).first()
    assert (t.score_change, t.findings_fixed, t.findings_added, t.snapshot_count) == (16, 23, 0, 3)
    assert t.first.security_score == 78 and t.latest.total_findings == 7
    i = HI.project_index(rows).first()
    assert (i.created, i.last_updated, i.latest_score, i.best_score, i.snapshot_count) == ("epoch-0", "epoch-2", 94, 94, 3)
    t = HI.score_trend(snapshots(spark, (90, 5), (70, 15))).first()
    assert (t.score_change, t.findings_fixed, t.findings_added) == (-20, 0, 10)
    assert HI.score_trend(snapshots(spark, (90, 5))).count() == 0


def test_glyphs_and_bands(spark):
    rows = HI.history_points(snapshots(spark, (0, 1), (14, 1), (15, 1), (50, 1), (79, 1), (80, 1), (100, 1))).orderBy("id").collect()
    assert "".join(r.glyph for r in rows) == "▁▁▂▄▆▆█"
    assert [r.band for r in rows] == ["poor"] * 3 + ["fair"] * 2 + ["good"] * 2


def test_json_sink(spark, tmp_path):
    rows = snapshots(spark, (78, 30), (88, 12))
    ST.write_json(HI.score_trend(rows), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back.score_change == 10 and back.latest.total_findings == 12


def test_rule_and_case_tables(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"name": "r", "contains": ["x"], "severity": "low"}\n')
    (tmp_path / "cases.json").write_text('{"case_id": "c", "send": {"a": "1"}, "checks": ["auth"]}\n')
    rule = ST.read_line_rules(spark, str(tmp_path / "rules.json")).first()
    case = ST.read_probe_cases(spark, str(tmp_path / "cases.json")).first()
    assert (rule.contains, rule.reaches) == (["x"], None) and (case.send, case.checks) == ({"a": "1"}, ["auth"])


def test_saved_state(spark, tmp_path, make_files):
    path = str(tmp_path / "history")
    files = make_files(("a.py", "eval(x)\n"))
    scores = SC.project_scores(RU.scan_rows(files))
    for nanos in (1_700_000_000_000_000_002, 1_700_000_000_000_000_001):
        ST.append_snapshots(HI.make_snapshots(scores, F.lit(nanos)), path)
    with open(tmp_path / "history" / "broken.json", "w") as f:
        f.write("{not json\n")
    rows = ST.load_history(spark, path).collect()
    assert [r.id[-1] for r in rows] == ["1", "2"] and rows[0].security_score == 90
    assert len(rows[0].id) == 20 and rows[0].timestamp == "epoch-1700000000"


# --- listings ------------------------------------------------------------------


def test_listing_changes(spark):
    def listing(**paths):
        return spark.createDataFrame([("p", k, v) for k, v in paths.items()], "project STRING, path STRING, mtime_ns BIGINT")

    changes = CH.listing_changes(listing(a=1, b=2, c=3), listing(a=1, b=9, d=4))
    assert sorted((r.path, r.status) for r in changes.collect()) == [("b", "modified"), ("c", "removed"), ("d", "added")]
    c = CH.change_counts(changes).first()
    assert (c.added, c.modified, c.removed, c.total) == (1, 1, 1, 3)
