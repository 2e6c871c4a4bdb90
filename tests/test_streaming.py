import random

from pyspark.sql import functions as F

from lintlake.operators import rules as RU
from lintlake.operators import scoring as SC
from lintlake.sources.corpus import read_corpus
from lintlake.streaming import sinks as SI
from lintlake.streaming import watch as WA


def found(df):
    return sorted((r.project, r.path, r.line_no, r.rule, r.message) for r in df.collect())


def write_tree(root, files):
    for path, text in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)


def test_stream_equals_batch(spark, tmp_path):
    """Whatever arrives in whatever batches, the table ends as one batch scan would."""
    rng = random.Random(5)
    parts = ["eval(x)\n", "# TODO: a\n", "token = 'abc1234'\n", "x = 1\n", "".join(f"value_{i} = {i}\n" for i in range(6)) * 2]
    root, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    for batch in range(3):
        write_tree(root, {f"p{rng.randrange(3)}/f{batch}_{i}.py": "".join(rng.choices(parts, k=4)) for i in range(4)})
        ticks = iter(range(1, 100))
        WA.scan_stream(
            WA.stream_corpus(spark, str(root)), out, ckpt, clock_ns=lambda: 10**18 + batch
        ).awaitTermination()
        assert next(ticks) == 1
    want = read_corpus(spark, str(root))
    assert found(WA.current_findings(spark, out)) == found(RU.scan_findings(want))
    scores = {r.project: r.security_score for r in SC.project_scores(RU.scan_rows(want)).collect()}
    snaps = spark.read.parquet(f"{out}/snapshots").where("id like '%2'").collect()
    assert {r.project: r.security_score for r in snaps} == scores
    assert spark.read.parquet(f"{out}/snapshots").select("batch_id").distinct().count() == 3


def test_rewritten_files_give_differences(spark, tmp_path):
    """A rewritten path takes back what is gone and adds what is new; the rest stays, and each batch reads its own files only."""
    root, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    batches = [
        {"p/a.py": "eval(x)\n# TODO: one\n", "p/b.py": "eval(y)\n", "q/c.py": "x = 1\n"},
        {"p/a.py": "eval(x)\nx = 1\n# TODO: one\n", "p/b.py": "y = 1\n"},
        {"p/a.py": "eval(x)\nx = 1\n# TODO: one\n", "q/d.py": "eval(z)\n"},
    ]
    signs, read = [], []
    for n, batch in enumerate(batches):
        write_tree(root, {f"drop{n}/{path}": text for path, text in batch.items()})
        dropped = WA.stream_corpus(spark, str(root))  # a file stream reads a path once, so each batch has a folder of its own
        files = dropped.withColumn("project", F.substring_index("path", "/", 1)).withColumn("path", F.substring_index("path", "/", -1))
        watch = WA.scan_stream(files, out, ckpt)
        read.append(sum(p["numInputRows"] for p in watch.queries[1].recentProgress))
        rows = spark.read.schema(f"{WA.CHANGES}, batch_id BIGINT").parquet(f"{out}/changes").where(F.col("batch_id") == n).collect()
        signs.append(sorted((r.path, r.rule or "file", r.line_no if r.rule else r.lines, r.sign) for r in rows))
    assert signs[0] == [("a.py", "dangerous-command", 1, 1), ("a.py", "file", 2, 1), ("a.py", "todo-tracker", 2, 1),
                        ("b.py", "dangerous-command", 1, 1), ("b.py", "file", 1, 1), ("c.py", "file", 1, 1)]
    assert signs[1] == [("a.py", "file", 2, -1), ("a.py", "file", 3, 1), ("a.py", "todo-tracker", 2, -1), ("a.py", "todo-tracker", 3, 1),
                        ("b.py", "dangerous-command", 1, -1)]
    assert signs[2] == [("d.py", "dangerous-command", 1, 1), ("d.py", "file", 1, 1)]
    assert read == [6, 4, 5]
    newest = tmp_path / "newest"
    for batch in batches:
        write_tree(newest, batch)
    want = read_corpus(spark, str(newest))
    assert found(WA.current_findings(spark, out)) == found(RU.scan_findings(want))
    assert sorted(map(tuple, WA.current_files(spark, out).collect())) == [("p", "a.py", 3), ("p", "b.py", 1), ("q", "c.py", 1), ("q", "d.py", 1)]


def test_a_scan_that_arrives_twice_changes_nothing(spark, tmp_path):
    """Scans that were written again, several scans of a path at once, and an old one that comes late."""
    scans = str(tmp_path / "scans")
    row = lambda rule, line, lines: ("p", rule, "t", "c", "HIGH" if rule else None, "a.py", line, "m", None, lines)
    deliveries = [[(0, [row("x", 1, None), row(None, None, 4)])], [(0, [row("x", 1, None), row(None, None, 4)])],
                  [(2, [row("x", 2, None), row("x", 2, None), row(None, None, 5)]), (1, [row("y", 9, None), row(None, None, 9)])],
                  [(1, [row("y", 9, None), row(None, None, 9)])]]
    signs = []
    for delivery in deliveries:
        for batch_id, rows in delivery:
            WA.packed(spark.createDataFrame(rows, WA.SCANNED)).coalesce(1).write.mode("append").parquet(f"{scans}/batch_id={batch_id}")
        SI.run_to_table(WA.scan_changes(spark, scans), str(tmp_path / "out"), str(tmp_path / "ckpt"), "update").awaitTermination()
        n = len(signs)
        seen = spark.read.schema(f"{WA.CHANGES}, batch_id BIGINT").parquet(str(tmp_path / "out")).where(F.col("batch_id") == n)
        signs.append(sorted((r.rule or "file", r.line_no or r.lines, r.sign) for r in seen.collect()))
    assert signs == [[("file", 4, 1), ("x", 1, 1)], [], [("file", 4, -1), ("file", 5, 1), ("x", 1, -1), ("x", 2, 1), ("x", 2, 1)], []]


def test_paths_share_state_by_bucket(spark, tmp_path):
    """Forty paths in three buckets: three states, and each path's differences are its own."""
    scans, out = str(tmp_path / "scans"), str(tmp_path / "out")
    row = lambda project, path, line, lines: (project, "x" if line else None, "t", "c", "HIGH" if line else None, path, line, "m", None, lines)
    both = [(project, f"f{i}.py") for project in "pq" for i in range(20)]
    first = [row(*of, 1, None) for of in both] + [row(*of, None, 4) for of in both]
    second = [row("p", "f3.py", 2, None), row("p", "f3.py", None, 4), row("q", "f3.py", None, 4)]
    signs = []
    for batch_id, rows in enumerate((first, second)):
        WA.packed(spark.createDataFrame(rows, WA.SCANNED)).coalesce(1).write.mode("append").parquet(f"{scans}/batch_id={batch_id}")
        query = SI.run_to_table(WA.scan_changes(spark, scans, buckets=3), out, str(tmp_path / "ckpt"), "update")
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
        seen = spark.read.schema(f"{WA.CHANGES}, batch_id BIGINT").parquet(out).where(F.col("batch_id") == batch_id)
        signs.append(sorted((r.project, r.path, r.line_no or 0, r.sign) for r in seen.collect()))
    assert signs[0] == sorted((*of, line, 1) for of in both for line in (0, 1))
    assert signs[1] == [("p", "f3.py", 1, -1), ("p", "f3.py", 2, 1), ("q", "f3.py", 1, -1)]


def test_config_is_loaded_per_batch(spark, tmp_path):
    root, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    configs = iter([RU.ScanConfig(), RU.ScanConfig(dangerous_commands=False)])
    for name in ("a", "b"):
        write_tree(root, {f"p/{name}.py": "eval(x)\n"})
        WA.scan_stream(WA.stream_corpus(spark, str(root)), out, ckpt, load_config=lambda: next(configs)).awaitTermination()
    assert [r.path for r in WA.current_findings(spark, out).collect()] == ["a.py"]


def test_live_scores(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    schema = "project STRING, severity STRING"
    weight = SC.severity_weight(F.col("severity"))
    for rows in ([("a", "HIGH"), ("b", None)], [("a", "CRITICAL"), ("a", "INFO")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        SI.run_to_table(WA.live_scores(stream, weight), out, str(tmp_path / "ckpt"), mode="update").awaitTermination()
    newest = SI.newest_rows(spark.read.parquet(out), ["project"])
    assert {r.project: (r.total_findings, r.security_score) for r in newest.collect()} == {"a": (3, 64), "b": (0, 100)}


def test_rate_limit_windows_drop_late_rows(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    schema = "who STRING, at TIMESTAMP, status INT"
    batches = [
        [("a", "2024-01-01 00:05:00", 200), ("a", "2024-01-01 00:06:00", 429), ("a", "2024-01-01 03:00:00", 200)],
        [("a", "2024-01-01 00:07:00", 429), ("a", "2024-01-01 03:10:00", 503)],  # the first is beyond the watermark
    ]
    for rows in batches:
        df = spark.createDataFrame(rows, "who STRING, at STRING, status INT").withColumn("at", F.to_timestamp("at"))
        df.coalesce(1).write.mode("append").parquet(str(src))
        stream = WA.rate_limit_windows(spark.readStream.schema(schema).parquet(str(src)), "who", "at", "status")
        SI.run_to_table(stream, out, str(tmp_path / "ckpt"), mode="update").awaitTermination()
    rows = SI.newest_rows(spark.read.parquet(out), ["who", "window_start"]).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.requests, r.blocked, r.limited) for r in rows] == [(0, 2, 1, True), (3, 2, 1, True)]
    assert rows[0].first_blocked_at.minute == 6


def test_watch_ticks(spark, tmp_path):
    root, state = tmp_path / "in", str(tmp_path / "state")
    write_tree(root, {"a.py": "1", "b.py": "2"})
    listing = lambda: WA.read_listing(spark, str(root), "p")
    first = WA.watch_tick(listing(), state, 0).collect()
    assert {r.status for r in first} == {"added"} and len(first) == 2
    (root / "a.py").unlink()
    write_tree(root, {"c.py": "3"})
    second = WA.watch_tick(listing(), state, 1).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.status) for r in second) == [("a.py", "removed"), ("c.py", "added")]
