"""Registered queries. Each takes (spark, sf_dir), reads whole tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import safe_value, score_band
from ..functions.text import escape_html, is_comment, slug
from ..functions.urls import absolute_url, url_parts
from ..operators import changes as CH
from ..operators import compliance as CO
from ..operators import dependencies as DE
from ..operators import duplicates as DU
from ..operators import graph as GR
from ..operators import history as HI
from ..operators import probes as PR
from ..operators import reports as RP
from ..operators import responses as RE
from ..operators import review as RV
from ..operators import rules as RU
from ..operators import scoring as SC
from ..operators import user_rules as UR
from ..session import fresh_dir
from ..sources import corpus as CP
from ..sources import diffs as DI
from ..sources import state as ST
from ..sources.manifests import declared_dependencies
from ..streaming import sinks as SI
from ..streaming import watch as WA
from . import derived as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Documents are far shorter than source files, so the file rule gets a lower limit.
SCAN = RU.ScanConfig(large_file_threshold=20)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- corpus --------------------------------------------------------------------


@query
def corpus_stats(spark, d):
    stats = CP.corpus_stats(D.code_corpus(spark, d))
    return stats.withColumn("languages", F.array_join("languages", ","))


@query
def files_of_a_tree(spark, d):
    """Every file below a root: read, or skipped by its path, its size or a NUL byte."""
    tree = D.document_tree(spark, d, "/corpus")
    skipped = CP.skipped_files(tree, "/corpus", max_file_bytes=D.TREE_LIMIT)
    files = CP.corpus_from_binary(tree, "/corpus", max_file_bytes=D.TREE_LIMIT)
    size = F.octet_length("content").cast("bigint")
    return files.select("project", "path", size.alias("bytes"), F.lit("read").alias("reason")).union(skipped)


@query
def language_mix(spark, d):
    return (
        D.code_corpus(spark, d)
        .groupBy("project", "language")
        .agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    )


@query
def comment_lines(spark, d):
    lines = CP.explode_lines(D.code_corpus(spark, d))
    comment = is_comment(F.col("text"), F.col("language"))
    return lines.groupBy("project", "language").agg(
        F.count("*").alias("lines"), F.count_if(comment).alias("comments")
    )


# --- scan rules ------------------------------------------------------------------


def _only(**on) -> RU.ScanConfig:
    off = dict.fromkeys(
        ["secret_detection", "dangerous_commands", "large_files", "todo_tracker", "duplicate_code"], False
    )
    return RU.ScanConfig(**{**off, "large_file_threshold": SCAN.large_file_threshold, **on})


def _findings(spark, d) -> DataFrame:
    return RU.scan_findings(D.code_corpus(spark, d), SCAN)


def _single_rule(spark, d, **on) -> DataFrame:
    found = RU.scan_findings(D.code_corpus(spark, d), _only(**on))
    return found.select("project", "path", "line_no", "severity", "title", "message")


@query
def secret_findings(spark, d):
    return _single_rule(spark, d, secret_detection=True)


@query
def dangerous_commands(spark, d):
    return _single_rule(spark, d, dangerous_commands=True)


@query
def todo_markers(spark, d):
    return _single_rule(spark, d, todo_tracker=True)


@query
def large_files(spark, d):
    return _single_rule(spark, d, large_files=True)


@query
def duplicate_code(spark, d):
    return _single_rule(spark, d, duplicate_code=True)


@query
def duplicate_pairs(spark, d):
    """Repeated blocks of two lines, the smallest block size."""
    return DU.duplicate_blocks(D.code_corpus(spark, d), 2).select(
        "project", "path", "line_no", "first_line"
    )


LONG_LINE = 400


@query
def registered_rule(spark, d):
    """A user rule from the registry, run over every file next to no built-in rule."""
    if "long-line" not in RU.rule_ids():
        RU.register_rule("long-line", RU.line_rule(
            "long-line", "Long line", "Quality", "INFO",
            lambda text, language: F.length(text) > LONG_LINE,
            lambda text: F.concat(F.length(text).cast("string"), F.lit(" characters")),
        ))
    found = RU.scan_findings(D.code_corpus(spark, d), _only(extra_rules=("long-line",)))
    return found.select("project", "path", "line_no", "message")


@query
def race_conditions(spark, d):
    """The shared-state heuristic over every line of the corpus."""
    lines = CP.explode_lines(D.code_corpus(spark, d))
    return RV.race_findings(lines).select("project", "path", "line_no", "message", "suggestion")


@query
def project_score(spark, d):
    """Flagship: full scan of every project, rolled up to counts, score and band."""
    scores = SC.project_scores(RU.scan_rows(D.code_corpus(spark, d), SCAN))
    return scores.withColumn("band", score_band(F.col("security_score")))


@query
def severity_pivot(spark, d):
    return SC.severity_counts(_findings(spark, d))


@query
def severity_bars(spark, d):
    return SC.severity_bars(_findings(spark, d))


@query
def category_counts(spark, d):
    return SC.category_counts(_findings(spark, d))


@query
def blocking_projects(spark, d):
    scores = SC.project_scores(RU.scan_rows(D.code_corpus(spark, d), SCAN))
    return scores.where("blocking").select("project", "critical", "high")


@query
def findings_report(spark, d):
    """Every finding in report order."""
    return SC.ordered_findings(_findings(spark, d)).select(
        "project", "severity", "path", "line_no", "rule"
    )


@query
def top_findings(spark, d):
    return SC.top_findings(_findings(spark, d), 5).select(
        "project", "position", "severity", "path", "line_no", "rule"
    )


# --- imports and dependencies -------------------------------------------------------


@query
def code_imports(spark, d):
    """Imports of the document corpus, all languages mixed into prose."""
    return DE.import_edges(D.code_corpus(spark, d))


@query
def import_edges(spark, d):
    return DE.import_edges(D.import_corpus(spark, d))


@query
def top_modules(spark, d):
    return GR.top_modules(DE.import_edges(D.import_corpus(spark, d)))


@query
def import_hotspots(spark, d):
    return GR.import_hotspots(D.import_corpus(spark, d))


@query
def module_count(spark, d):
    return GR.graph_summary(DE.import_edges(D.import_corpus(spark, d)))


@query
def declared_packages(spark, d):
    return declared_dependencies(D.manifest_corpus(spark, d))


@query
def dependency_inventory(spark, d):
    return DE.dependency_inventory(
        D.project_corpus(spark, d), declared=declared_dependencies(D.manifest_corpus(spark, d))
    )


@query
def dependency_totals(spark, d):
    return DE.dependency_totals(dependency_inventory(spark, d))


@query
def unused_dependencies(spark, d):
    return DE.unused_dependencies(dependency_inventory(spark, d)).select(
        "project", "path", "name", "version"
    )


@query
def version_conflicts(spark, d):
    return DE.version_conflicts(declared_dependencies(D.manifest_corpus(spark, d)))


@query
def ecosystem_counts(spark, d):
    return DE.ecosystem_counts(declared_dependencies(D.manifest_corpus(spark, d)))


@query
def dependency_nodes(spark, d):
    return GR.dependency_nodes(
        D.project_corpus(spark, d), declared=declared_dependencies(D.manifest_corpus(spark, d))
    )


@query
def node_totals(spark, d):
    return GR.node_totals(dependency_nodes(spark, d))


# --- framework ------------------------------------------------------------------------


def _plans(spark, d) -> DataFrame:
    return PR.request_plan(PR.expand_cases(D.probe_cases(spark, d)))


def _outcomes(spark, d) -> DataFrame:
    return RE.judge_cases(_plans(spark, d), D.recorded_responses(spark, d))


@query
def compliance_status(spark, d):
    rows = RU.scan_rows(D.code_corpus(spark, d), SCAN)
    status = CO.category_status(CO.finding_keys(rows, _outcomes(spark, d)))
    return status.withColumn("reasons", F.array_join("reasons", "; "))


@query
def weakness_counts(spark, d):
    outcomes = RE.judge_cases(_plans(spark, d).where(CO.has_mapped_issue()), D.recorded_responses(spark, d))
    return CO.weakness_counts(CO.finding_keys(_findings(spark, d), outcomes))


# --- history ----------------------------------------------------------------------------


@query
def score_history(spark, d):
    return HI.history_points(D.order_snapshots(spark, d))


@query
def score_trend(spark, d):
    trend = HI.score_trend(D.order_snapshots(spark, d))
    return trend.select(
        "project",
        F.col("first.id").alias("first_id"),
        F.col("latest.id").alias("latest_id"),
        F.col("first.security_score").alias("first_score"),
        F.col("latest.security_score").alias("latest_score"),
        "score_change",
        "findings_fixed",
        "findings_added",
        "snapshot_count",
    )


@query
def project_index(spark, d):
    return HI.project_index(D.order_snapshots(spark, d))


@query
def saved_history(spark, d):
    """Snapshots appended to a JSON store and read back, oldest first."""
    path = fresh_dir(spark, "history")
    ST.append_snapshots(D.order_snapshots(spark, d), path)
    return ST.load_history(spark, path).select(
        "project", "id", "timestamp", "security_score", "total_findings"
    )


@query
def latest_run(spark, d):
    """The newest of two saved test runs; the second repeats what wasn't secure in every other project."""
    path = fresh_dir(spark, "runs")
    first = "00000000000000000001"
    ST.save_run(_outcomes(spark, d), first, path)
    even = F.substr("project", F.lit(4)).cast("int") % 2 == 0
    ST.save_run(ST.saved_run(spark, first, path).where(even & (F.col("verdict") != "secure")), "00000000000000000002", path)
    return ST.latest_run(spark, path).select("project", "run_id", "case_id", "verdict", "issue_id")


# --- review -------------------------------------------------------------------------------


def _added(spark, d) -> DataFrame:
    return DI.added_lines(DI.diff_rows(D.doc_diffs(spark, d)))


@query
def diff_lines(spark, d):
    return _added(spark, d).select("project", "path", "line_no", "text")


@query
def patch_file_lines(spark, d):
    """What patch files with every line of the documents add; the files are read in splits."""
    path = fresh_dir(spark, "patches")
    D.write_doc_patches(spark, d, path)
    rows = DI.read_diffs(spark, path, F.col("project"))
    return DI.added_lines(rows).select("project", "path", "line_no", "text")


def _review(spark, d) -> DataFrame:
    files = D.code_corpus(spark, d)
    return RV.review_findings(RU.scan_findings(files, SCAN), files, _added(spark, d))


@query
def review_findings(spark, d):
    return _review(spark, d).select("project", "rule", "severity", "path", "line_no", "message")


@query
def review_summary(spark, d):
    return RV.review_summary(_added(spark, d), _review(spark, d))


@query
def gate(spark, d):
    rows = RU.scan_rows(D.code_corpus(spark, d), SCAN)
    return RV.gate(rows, user_rules(spark, d), _added(spark, d))


@query
def snapshot_changes(spark, d):
    return CH.listing_changes(*D.event_listings(spark, d))


@query
def watch_ticks(spark, d):
    """Three ticks of a watched tree: what each listing adds, changes and no longer has."""
    state = fresh_dir(spark, "ticks")
    ticks = [WA.watch_tick(D.event_listing(spark, d, *span), state, n) for n, span in enumerate(D.TICK_SPANS)]
    return reduce(DataFrame.union, [t.select(F.lit(n).alias("tick"), "project", "path", "status") for n, t in enumerate(ticks)])


@query
def change_counts(spark, d):
    return CH.change_counts(CH.listing_changes(*D.event_listings(spark, d)))


# --- user rules -----------------------------------------------------------------------------

# name, contains, reaches, without, severity, report
USER_RULES = [
    ("unsafe query", ["QUERY("], "select", ["sanitization"], "critical", "Query text reaches the database"),
    ("any execute", [], "execute(", [], "medium", None),
    ("token and quote", ["token", '"'], None, [], "low", "token near a literal"),
    ("unsanitised execute", ["execute("], None, ["sanitization"], "high", "no placeholder"),
    ("prose word", ["tion", "ment"], None, [], "info", None),
    ("no criteria", [], None, ["sanitization"], "critical", "never matches"),
]


@query
def user_rules(spark, d):
    from ..schemas import LINE_RULES

    rules = spark.createDataFrame(USER_RULES, LINE_RULES)
    return UR.user_rule_findings(CP.explode_lines(D.code_corpus(spark, d)), rules)


# --- probes ----------------------------------------------------------------------------------


@query
def mutation_expand(spark, d):
    expanded = PR.expand_cases(D.probe_cases(spark, d, mutated=True))
    return expanded.select(
        "case_id",
        "variant_id",
        "name",
        PR.json_body(F.col("send")).alias("body"),
        F.size("expectations").alias("n_expectations"),
    )


@query
def request_plans(spark, d):
    plans = PR.request_plan(PR.expand_cases(D.probe_cases(spark, d)))
    lines = F.transform("request_headers", lambda h: F.concat_ws(": ", h["name"], h["value"]))
    return plans.select(
        "case_id", "http_method", "url", F.array_join(lines, "; ").alias("headers"), "body", "request_cap", "issue_id"
    )


@query
def issue_classes(spark, d):
    plans = PR.request_plan(PR.expand_cases(D.probe_cases(spark, d, mutated=True)))
    return plans.groupBy("project", "issue_id").agg(F.count("*").alias("cases"))


@query
def response_verdicts(spark, d):
    return _outcomes(spark, d).select(
        "project", "case_id", "suite", "severity", "verdict", "error", "issue_id"
    )


@query
def response_checks(spark, d):
    return RE.check_rows(_outcomes(spark, d))


@query
def suite_summary(spark, d):
    return RP.suite_totals(_outcomes(spark, d))


@query
def run_totals(spark, d):
    totals = RP.run_totals(_outcomes(spark, d))
    return totals.withColumn("issue_ids", F.array_join("issue_ids", ","))


@query
def executive_summary(spark, d):
    scores = SC.project_scores(RU.scan_rows(D.code_corpus(spark, d), SCAN))
    summary = RP.executive_summary(_outcomes(spark, d), scores)
    return summary.withColumn("issue_ids", F.array_join("issue_ids", ",")).withColumn(
        "remediations", F.array_join("remediations", " | ")
    )


@query
def technical_evidence(spark, d):
    return RP.technical_evidence(_outcomes(spark, d))


@query
def response_outcomes(spark, d):
    rows = D.recorded_responses(spark, d).select(
        F.concat(F.lit("seq"), F.col("seq").cast("string")).alias("generator"), "status", "error"
    )
    return RE.input_outcome_counts(rows, ["generator"])


@query
def input_preview(spark, d):
    """Display form of every conversation text, as fuzz values are shown."""
    turns = D.table(spark, d, "conversations")
    return turns.select("conv_id", "turn", safe_value(F.col("text")).alias("shown"))


@query
def page_slugs(spark, d):
    """Id slug of every URL and a digest of its escaped HTML."""
    pages = D.table(spark, d, "pages")
    return pages.select(
        "page_id", slug(F.col("url")).alias("slug"), F.md5(escape_html(F.col("html"))).alias("escaped_md5")
    )


@query
def endpoint_rollup(spark, d):
    parts = url_parts(F.col("url"))
    return (
        D.table(spark, d, "pages")
        .select("page_id", parts.alias("u"))
        .groupBy(
            F.col("u.host").alias("host"), F.col("u.port").alias("port"), F.col("u.secure").alias("secure")
        )
        .agg(F.count("*").alias("pages"), F.min(absolute_url(F.col("u"))).alias("first_url"))
    )


# --- streaming --------------------------------------------------------------------------------


def _stream(spark, d, name) -> DataFrame:
    # A pattern, because a file stream takes a plain path for a folder and the table
    # may be a single file.
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


ARRIVALS = 3


def _watched(spark, d) -> str:
    """Scan documents that arrive in three batches, of which the later ones rewrite files of the earlier ones."""
    root, out, checkpoint = (fresh_dir(spark, f"watch-{n}") for n in ("in", "out", "checkpoint"))
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    for arrival in range(ARRIVALS):
        docs = D.arriving_documents(spark, d, arrival, ARRIVALS)
        docs.write.mode("append").parquet(root)
        stream = spark.readStream.schema(docs.schema).parquet(root)
        files = CP.corpus_from_table(stream, F.col("source"), path, F.col("text"))
        WA.scan_stream(files, out, checkpoint, load_config=lambda: SCAN)
    return out


@query
def stream_scan(spark, d):
    """The scan repeated per batch of arriving and rewritten files; same findings as one batch of the newest."""
    out = _watched(spark, d)
    return WA.current_findings(spark, out).select("project", "path", "line_no", "rule", "message")


@query
def stream_score(spark, d):
    """Scores that follow the differences of three batches."""
    changes = WA.read_changes(spark, _watched(spark, d))
    scores = WA.live_scores(changes, SC.severity_weight(F.col("severity")), F.col("sign"))
    out = fresh_dir(spark, "score")
    SI.run_to_table(scores, out, fresh_dir(spark, "score-checkpoint"), mode="update").awaitTermination()
    return SI.newest_rows(spark.read.parquet(out), ["project"])


@query
def stream_rate_limit(spark, d):
    """Event-time windows per user; the event type and value stand in for a status."""
    status = F.when(
        F.col("event_type") == "error", F.when(F.col("value") > 20, F.lit(429)).otherwise(F.lit(500))
    ).otherwise(F.lit(200))
    requests = _stream(spark, d, "events").select(
        "user_id", D.utc_instant(F.col("ts")).alias("ts"), status.alias("status")
    )
    windows = WA.rate_limit_windows(requests, "user_id", "ts", "status", window="1 day")
    out = fresh_dir(spark, "rate")
    SI.run_to_table(windows, out, fresh_dir(spark, "rate-checkpoint"), mode="update").awaitTermination()
    newest = SI.newest_rows(spark.read.parquet(out), ["user_id", "window_start"])
    return newest.withColumns(
        {c: D.utc_wall_time(F.col(c)) for c in ("window_start", "first_blocked_at")}
    )
