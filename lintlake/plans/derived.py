"""Inputs the shipped tables do not hold, derived from them row by row.

The tables hold prose, orders and events, not source code, manifests or request
logs. Each function here adds such a column to every row of a table, so the derived
input is as large as the table. ``sql_*`` gives the same derivation as SQL, from the
same templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import literal_array
from ..sources.corpus import corpus_from_table
from ..schemas import REQUEST_FIELDS
from .sizing import computed_once, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc_instant(ts: Column) -> Column:
    """The instant of a UTC wall-clock time, whatever the session time zone."""
    return F.convert_timezone(
        F.lit("UTC"), F.current_timezone(), ts.cast("timestamp_ntz")
    ).cast("timestamp")


def utc_wall_time(ts: Column) -> Column:
    """The UTC wall-clock time of an instant."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def _files(df: DataFrame, project: Column, path: Column, content: Column) -> DataFrame:
    made = computed_once(df, project=project, path=path, content=content)
    return corpus_from_table(made, F.col("project"), F.col("path"), F.col("content"))


def _pick(values: list[str], index: Column) -> Column:
    """values[index mod n]."""
    return F.element_at(literal_array(values), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_pick(values: list[str], index: str) -> str:
    items = ", ".join(sql_text(v) for v in values)
    return f"([{items}])[(({index}) % {len(values)}) + 1]"


# --- documents as source files ------------------------------------------------

EXTENSIONS = ["py", "rs", "js", "ts", "go", "rb", "java", "sh", "c", "txt", "cpp", "md"]

# Lines of code that are mixed into the prose; {id} is the document id.
CODE_LINES = [
    'os.system("run " + user_input)',
    "# TODO: tidy item {id}",
    "x = 1  // FIXME - broken path {id})",
    'api_key = "k{id}f00dbeef"',
    "const token = process.env.TOKEN;",
    'password = "changeme"',
    "id = AKIA{id}ABCDEFGHIJKLMNOPQRST",
    "    balance -= fee_{id};",
    "stock = stock - qty",
    'rows = db.query("SELECT * FROM t WHERE id = " + req.params.id)',
    'cursor.execute("SELECT 1 FROM t WHERE id = ?", [user_input])',
    "   * XXX starred note {id}",
    "eval(payload_{id})",
    "Command::new(user_input).spawn();",
    "serde_json::to_string(&item)?;",
    "use tokio::sync::mpsc;",
    "import os, sys",
    "from numpy.linalg import norm",
    'import React from "react";',
    "const merge = require('lodash/merge');",
    '\t"github.com/acme/lib/v2"',
    "import com.google.common.io.Files;",
    "require 'rails/engine'",
    "if a == \"x\" { secret: 'zz-{id}-99' }",
    "client_secret => `{{ vault }}`",
    "// ghp_0123456789abcdefghijABCDEFGHIJ_{id}",
    "lock.acquire(); counter += 1",
    "Self.Points *= 2 // HACK_{id} and TODO2",
    "let std::password = 'p{id}!'; b = 'x'",
    "pub use crate::inner::Thing;",
    "import static org.junit.Assert.assertTrue;",
    "import './local.css'; import \"@scope/pkg/sub\";",
]
LINES_PER_FILE = 4


def _code_line(doc_id: Column, k: int) -> Column:
    return F.replace(_pick(CODE_LINES, doc_id + 11 * k), F.lit("{id}"), doc_id.cast("string"))


def doc_path(doc_id: Column) -> Column:
    return F.concat(F.lit("src/d"), doc_id.cast("string"), F.lit("."), _pick(EXTENSIONS, doc_id))


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a source file: its text, then four code lines.

    The project is the document's source. Every third file has CRLF line ends.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    doc_id = F.col("doc_id")
    content = F.concat_ws("\n", "text", *[_code_line(doc_id, k) for k in range(LINES_PER_FILE)])
    content = F.when(doc_id % 3 == 0, F.replace(content, F.lit("\n"), F.lit("\r\n"))).otherwise(
        F.concat(content, F.lit("\n"))
    )
    return _files(docs, F.col("source"), doc_path(doc_id), content)


def arriving_documents(spark: SparkSession, sf_dir: str, arrival: int, arrivals: int) -> DataFrame:
    """Every document that arrives at a time: its share in its own text, and a draft of the next share.

    A draft holds two code lines more. The next arrival brings the same path again, without them.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    doc_id = F.col("doc_id")
    turn = F.pmod(doc_id, F.lit(arrivals))
    draft = docs.withColumn("text", F.concat_ws("\n", _code_line(doc_id, 0), "text", _code_line(doc_id, 1)))
    return docs.where(turn == arrival).unionByName(draft.where(turn == arrival + 1))


# Extension -> language, for the extensions used here.
SQL_LANGUAGE = (
    "CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'py' THEN 'Python' WHEN 'rs' THEN 'Rust' "
    "WHEN 'js' THEN 'JavaScript' WHEN 'ts' THEN 'TypeScript' WHEN 'go' THEN 'Go' "
    "WHEN 'rb' THEN 'Ruby' WHEN 'java' THEN 'Java' WHEN 'sh' THEN 'Shell' WHEN 'c' THEN 'C' "
    "WHEN 'cpp' THEN 'C++' ELSE 'Other' END"
)


def sql_code_corpus() -> str:
    """CTEs ``files(project, path, content, language)`` and ``lines``."""
    injected = " || chr(10) || ".join(
        f"replace({sql_pick(CODE_LINES, f'doc_id + {11 * k}')}, '{{id}}', doc_id::VARCHAR)"
        for k in range(LINES_PER_FILE)
    )
    return f"""
files AS (
  SELECT project, path, content, {SQL_LANGUAGE} AS language FROM (
    SELECT source AS project,
           'src/d' || doc_id || '.' || {sql_pick(EXTENSIONS, 'doc_id')} AS path,
           CASE WHEN doc_id % 3 = 0 THEN replace(body, chr(10), chr(13) || chr(10))
                ELSE body || chr(10) END AS content
    FROM (SELECT doc_id, source, text || chr(10) || {injected} AS body FROM documents))),
{SQL_LINES}"""


# Lines of ``files``, numbered from 1.
SQL_LINES = """line_lists AS (
  SELECT project, path, language,
         string_split(CASE WHEN ends_with(unix, chr(10)) THEN left(unix, length(unix) - 1)
                           ELSE unix END, chr(10)) AS parts
  FROM (SELECT *, replace(content, chr(13) || chr(10), chr(10)) AS unix FROM files)),
lines AS (
  SELECT project, path, language, i::INT AS line_no, parts[i] AS text
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM line_lists))"""


# --- orders and parts as imports and manifests ----------------------------------

PROJECTS = 20
IMPORT_EXTENSIONS = ["py", "rs", "js", "go", "java", "rb", "ts", "sh"]
# One import line per extension; {m} is a module name.
IMPORT_LINES = {
    "py": "from {m}.core import run",
    "rs": "use {m}::prelude::*;",
    "js": "const a = require('{m}/lib');",
    "go": '\t"example.org/{m}"',
    "java": "import org.{m}.util.Tool;",
    "rb": "require '{m}/engine'",
    "ts": 'import { a } from "@acme/{m}/x";',
    "sh": "source {m}.sh",
}
MODULES = 60


def _module(n: Column) -> Column:
    return F.concat(F.lit("mod_"), F.pmod(n, F.lit(MODULES)).cast("string"))


def import_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a source file with three imports and a path use.

    The project comes from the customer, the modules from the order's keys and price.
    """
    orders = spread(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey"
    )
    key, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    names = [_module(key), _module(key * 7 + 3), _module(price)]
    ext = _pick(IMPORT_EXTENSIONS, key)
    template = _pick([IMPORT_LINES[e] for e in IMPORT_EXTENSIONS], key)
    lines = [F.replace(template, F.lit("{m}"), m) for m in names]
    use = F.concat(F.lit("    "), _module(price + 1), F.lit("::call();"))
    content = F.concat_ws("\n", F.lit("// header"), *lines, use)
    project = F.concat(F.lit("p"), F.pmod("o_custkey", F.lit(PROJECTS)).cast("string"))
    path = F.concat(F.lit("src/o"), key.cast("string"), F.lit("."), ext)
    return _files(orders, project, path, content)


def _sql_module(n: str) -> str:
    return f"('mod_' || (({n}) % {MODULES}))"


def sql_import_corpus() -> str:
    """CTE ``imports_in(project, path, ext, modules, used)``: raw modules per order."""
    price = "floor(o_totalprice)::BIGINT"
    return f"""
imports_in AS (
  SELECT 'p' || (o_custkey % {PROJECTS}) AS project,
         'src/o' || o_orderkey || '.' || ext AS path, ext,
         [{_sql_module('o_orderkey')}, {_sql_module('o_orderkey * 7 + 3')}, {_sql_module(price)}] AS raw,
         {_sql_module(price + ' + 1')} AS used
  FROM (SELECT *, {sql_pick(IMPORT_EXTENSIONS, 'o_orderkey')} AS ext FROM orders)),
edges AS (
  SELECT DISTINCT project, path, ext,
         CASE ext WHEN 'go' THEN 'example.org/' || m WHEN 'java' THEN 'org.' || m
                  WHEN 'ts' THEN '@acme/' || m ELSE m END AS module
  FROM (SELECT project, path, ext, unnest(raw) AS m FROM imports_in WHERE ext <> 'sh'))"""


MANIFEST_NAMES = ["Cargo.toml", "package.json", "requirements.txt", "go.mod", "pom.xml", "app.csproj"]


def manifest_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a manifest that declares two packages, one format per key."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    first = F.translate(_module(key * 3), "_", "-")
    second = _module(key * 5 + 1)

    def fill(template: str) -> Column:
        out = F.lit(template)
        for mark, value in (("{a}", first), ("{b}", second), ("{v}", size)):
            out = F.replace(out, F.lit(mark), value)
        return out

    kind = F.pmod(key, F.lit(len(MANIFEST_NAMES)))
    content = F.when(F.lit(False), F.lit(""))
    for i, name in enumerate(MANIFEST_NAMES):
        content = content.when(kind == i, fill(MANIFEST_TEXT[name]))
    project = F.concat(F.lit("p"), F.pmod(key, F.lit(PROJECTS)).cast("string"))
    path = F.concat(F.lit("svc"), key.cast("string"), F.lit("/"), _pick(MANIFEST_NAMES, key))
    return _files(parts, project, path, content)


# {a} and {b} are package names, {v} a version; {a} is for production, {b} for
# development where the format can say so.
MANIFEST_TEXT = {
    "Cargo.toml": '[package]\nname = "svc"\n\n[dependencies]\n{a} = { version = "{v}.0", default-features = false }\n\n'
    '[dev-dependencies]\n{b} = "1.{v}"\n',
    "package.json": '{"name": "svc", "dependencies": {"{a}": "{v}.0", "file": 3}, "devDependencies": {"@acme/{b}": "1.{v}"}}',
    "requirements.txt": "# pinned\n-r base.txt\n{a}=={v}.0\n{b} [extra] >= 1.{v}\n",
    "go.mod": "module svc\n\nrequire example.org/{b} v1.{v}\nrequire (\n\texample.org/{a} v{v}.0 // indirect\n)\n",
    "pom.xml": "<project><dependencies><dependency><groupId>org</groupId><artifactId>{a}</artifactId>"
    "<version> {v}.0 </version></dependency>\n<dependency><artifactId>{b}</artifactId><version>1.{v}</version>"
    "<scope>test</scope></dependency></dependencies></project>",
    "app.csproj": '<Project><ItemGroup><PackageReference Include="{a}" Version="{v}.0" />\n'
    '<PackageReference Include="{b}"><Version>1.{v}</Version></PackageReference></ItemGroup></Project>',
}


def sql_manifest_corpus() -> str:
    """CTE ``declared`` with what the derived manifests declare."""
    a = f"replace({_sql_module('p_partkey * 3')}, '_', '-')"
    b = _sql_module("p_partkey * 5 + 1")
    return f"""
parts_in AS (
  SELECT 'p' || (p_partkey % {PROJECTS}) AS project, p_partkey % {len(MANIFEST_NAMES)} AS kind,
         'svc' || p_partkey || '/' || {sql_pick(MANIFEST_NAMES, 'p_partkey')} AS path,
         {sql_pick(MANIFEST_NAMES, 'p_partkey')} AS manifest,
         {a} AS a, {b} AS b, p_size::VARCHAR AS v FROM part),
declared AS (
  SELECT project, path, manifest, ecosystem, d.name AS name, d.version AS version, d.dev AS dev FROM (
    SELECT project, path, manifest,
      (['Rust (Cargo)', 'Node (npm)', 'Python (PyPI)', 'Go (modules)', 'Java (Maven)', 'C# (NuGet)'])[kind + 1] AS ecosystem,
      unnest(CASE kind
        WHEN 0 THEN [{{'name': a, 'version': v || '.0', 'dev': false}}, {{'name': b, 'version': '1.' || v, 'dev': true}}]
        WHEN 1 THEN [{{'name': a, 'version': v || '.0', 'dev': false}}, {{'name': 'file', 'version': NULL, 'dev': false}},
                     {{'name': '@acme/' || b, 'version': '1.' || v, 'dev': true}}]
        WHEN 2 THEN [{{'name': a, 'version': '==' || v || '.0', 'dev': false}}, {{'name': b, 'version': '>= 1.' || v, 'dev': false}}]
        WHEN 3 THEN [{{'name': 'example.org/' || a, 'version': 'v' || v || '.0', 'dev': false}},
                     {{'name': 'example.org/' || b, 'version': 'v1.' || v, 'dev': false}}]
        WHEN 4 THEN [{{'name': 'org:' || a, 'version': v || '.0', 'dev': false}}, {{'name': b, 'version': '1.' || v, 'dev': true}}]
        ELSE [{{'name': a, 'version': v || '.0', 'dev': false}}, {{'name': b, 'version': '1.' || v, 'dev': false}}] END) AS d
    FROM parts_in))"""


def project_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files and manifests of the same projects."""
    return import_corpus(spark, sf_dir).unionByName(manifest_corpus(spark, sf_dir))


# --- documents as diffs ----------------------------------------------------------


def doc_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One diff text per document: its code lines were added in two hunks.

    The text lines are the old file; the hunks hold a context line and a removed line.
    Every fifth diff also deletes a file.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    doc_id = F.col("doc_id")
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    old, path = n.cast("string"), doc_path(doc_id)
    added = [F.concat(F.lit("+"), _code_line(doc_id, k)) for k in range(LINES_PER_FILE)]
    gone = F.when(
        doc_id % 5 == 0,
        F.concat_ws("\n", F.lit("--- a/gone.py"), F.lit("+++ /dev/null"), F.lit("@@ -1,2 +0,0 @@"),
                    F.lit("-balance -= 1"), F.lit("+balance -= 2")),
    )
    diff = F.concat_ws(
        "\n",
        gone,
        F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path),
        F.concat(F.lit("--- a/"), path),
        F.concat(F.lit("+++ b/"), path, F.lit("\t2024-01-01")),
        F.concat(F.lit("@@ -"), old, F.lit(",1 +"), old, F.lit(",3 @@ last line")),
        F.lit(" context"),
        added[0],
        added[1],
        F.concat(F.lit("@@ -"), old, F.lit(",1 +"), (n + 3).cast("string"), F.lit(",2 @@")),
        F.lit("-removed"),
        added[2],
        added[3],
        F.lit("\\ No newline at end of file"),
    )
    return docs.select(
        F.col("source").alias("project"), F.concat(F.lit("r"), doc_id.cast("string")).alias("diff_id"),
        diff.alias("diff"),
    )


def write_doc_patches(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Every document's own lines as a section of a patch file, below a folder for each source.

    Of three lines two are added and one is context; every seventh comes with a removed line. A second hunk
    starts at the tenth line and goes on at line 101.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id").where("text IS NOT NULL")
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))

    def line(text: Column, i: Column) -> Column:
        marked = F.concat(F.when(i % 3 == 2, F.lit(" ")).otherwise(F.lit("+")), text)
        marked = F.when(i % 7 == 4, F.concat(F.lit("-gone\n"), marked)).otherwise(marked)
        return F.when(i == 9, F.concat(F.lit("@@ -10,9 +101,9 @@ next\n"), marked)).otherwise(marked)

    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    head = F.concat(F.lit("diff --git a/x b/x\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1 +1,9 @@\n"))
    sections = docs.select(F.col("source").alias("project"), F.concat(head, body).alias("value"))
    sections.write.partitionBy("project").text(path)


# Rows of ``patched``: what the patch files add.
SQL_PATCHED = """
SELECT source AS project, 'docs/' || doc_id || '.txt' AS path, (CASE WHEN i < 10 THEN i ELSE i + 91 END)::INT AS line_no,
       CASE WHEN ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END AS text
FROM (SELECT source, doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
WHERE i % 3 <> 0"""


# CTE ``added(project, path, line_no, text)``; needs ``lines``.
SQL_ADDED = f"""
added AS (
  SELECT project, path, line_no, text FROM (
    SELECT *, max(line_no) OVER (PARTITION BY project, path) AS last FROM lines)
  WHERE line_no > last - {LINES_PER_FILE})"""


# --- orders as score snapshots ---------------------------------------------------


def order_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a snapshot of its customer's project; scores come from the price."""
    from ..operators.history import snapshot_id

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    cents = F.floor("o_totalprice").cast("bigint")
    seconds = F.unix_seconds(utc_instant(F.col("o_orderdate"))) + F.col("o_orderkey") % 86400
    nanos = seconds * 1_000_000_000 + F.col("o_orderkey")
    count = F.pmod(F.floor(cents / 7).cast("bigint"), F.lit(40))
    zero = F.lit(0).cast("bigint")
    return orders.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("project"),
        snapshot_id(nanos).alias("id"),
        F.concat(F.lit("epoch-"), seconds.cast("string")).alias("timestamp"),
        F.lit(None).cast("string").alias("label"),
        F.pmod(cents, F.lit(101)).cast("int").alias("security_score"),
        count.alias("total_findings"),
        zero.alias("critical"),
        zero.alias("high"),
        zero.alias("warning"),
        count.alias("info"),
        F.lit(1).cast("bigint").alias("files"),
        cents.alias("lines_of_code"),
    )


SQL_SNAPSHOTS = """
snapshots AS (
  SELECT 'c' || o_custkey AS project,
         lpad((secs * 1000000000 + o_orderkey)::VARCHAR, 20, '0') AS id,
         'epoch-' || secs AS timestamp,
         (cents % 101)::INT AS security_score, (cents // 7) % 40 AS total_findings
  FROM (SELECT *, floor(o_totalprice)::BIGINT AS cents,
               epoch(o_orderdate)::BIGINT + o_orderkey % 86400 AS secs FROM orders))"""


# --- events as file listings -------------------------------------------------------

LISTING_OLD_UNTIL = "2024-01-16"
LISTING_NEW_FROM = "2024-01-08"


def event_listing(spark: SparkSession, sf_dir: str, since: str | None, until: str | None) -> DataFrame:
    """A listing of paths from the events of a span; the newest event of a path is its time."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    if since:
        events = events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        events = events.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 13).cast("string"))
    listed = events.select(F.col("event_type").alias("project"), path.alias("path"), "event_id")
    return listed.groupBy("project", "path").agg(F.max("event_id").alias("mtime_ns"))


def event_listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An old and a new listing of paths from overlapping spans that cover all events."""
    return (
        event_listing(spark, sf_dir, None, LISTING_OLD_UNTIL),
        event_listing(spark, sf_dir, LISTING_NEW_FROM, None),
    )


#: Spans of three listings that cover all events: some paths come, some change, some go.
TICK_SPANS = [(None, LISTING_OLD_UNTIL), (LISTING_NEW_FROM, "2024-01-24"), ("2024-01-12", None)]


def sql_ticks() -> str:
    """What changes from tick to tick, as SQL."""
    lists, parts = [], []
    for n, (since, until) in enumerate(TICK_SPANS):
        bounds = [f"ts >= TIMESTAMP '{since}'"] if since else []
        bounds += [f"ts < TIMESTAMP '{until}'"] if until else []
        lists.append(f"l{n} AS (SELECT project, path, max(event_id) AS ns FROM listed WHERE {' AND '.join(bounds)} GROUP BY 1, 2)")
        before = f"l{n - 1}" if n else "(SELECT * FROM l0 WHERE false)"
        parts.append(
            f"SELECT {n} AS tick, project, path, CASE WHEN o.ns IS NULL THEN 'added' WHEN w.ns IS NULL THEN 'removed' ELSE 'modified' END AS status "
            f"FROM {before} o FULL JOIN l{n} w USING (project, path) WHERE o.ns IS DISTINCT FROM w.ns"
        )
    listed = "listed AS (SELECT event_type AS project, 'u' || user_id || '/' || (event_id % 13) AS path, ts, event_id FROM events)"
    return f"WITH {listed}, {', '.join(lists)}\n" + "\nUNION ALL ".join(parts)


# --- documents as files of a tree --------------------------------------------------

TREE_DIRS = ["src", "node_modules", "src/.cache", "lib/vendor", "docs/target.d", "a/b", ".venv/x"]
TREE_LIMIT = 4000


def document_tree(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Every document as a file as Spark lists it (path, length, content), in folders of which some are skipped.

    Every eleventh file is binary, with a NUL byte behind its first line.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    doc_id = F.col("doc_id")
    path = F.concat(F.lit(f"{root}/"), "source", F.lit("/"), _pick(TREE_DIRS, doc_id), F.lit("/d"), doc_id.cast("string"), F.lit(".py"))
    text = F.when(doc_id % 11 == 0, F.concat(F.lit("x = 1\n\0"), "text")).otherwise(F.col("text"))
    return docs.select(path.alias("path"), F.octet_length(text).cast("bigint").alias("length"), text.cast("binary").alias("content"))


def sql_document_tree() -> str:
    return f"""
SELECT source AS project, dir || '/d' || doc_id || '.py' AS path, bytes,
       CASE WHEN dir IN ('node_modules', 'src/.cache', 'lib/vendor', '.venv/x') THEN 'path' WHEN bytes > {TREE_LIMIT} THEN 'size'
            WHEN doc_id % 11 = 0 THEN 'binary' ELSE 'read' END AS reason
FROM (SELECT *, {sql_pick(TREE_DIRS, "doc_id")} AS dir,
             octet_length(encode(text)) + CASE WHEN doc_id % 11 = 0 THEN 7 ELSE 0 END AS bytes FROM documents)"""


# --- events as probe cases and recorded responses ------------------------------------

SUITES = {"signup": "Authentication", "error": "API", "click": "Web", "purchase": "Session", "view": None}
STATUSES = [200, 200, 401, 429, 500, 403, 200, 302]
BODIES = [
    "ok", "welcome, token=abc", "You have an error in your SQL syntax near", "root:x:0:0:root:/root",
    "<html>fine</html>", "{}", "ORA-00933: bad", "nothing here",
]


def probe_cases(spark: SparkSession, sf_dir: str, mutated: bool = False) -> DataFrame:
    """Every event as a probe case whose shape follows the event type."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")
    kind, eid = F.col("event_type"), F.col("event_id")
    nothing = F.array().cast("array<string>")

    def by_kind(values: dict, otherwise: Column) -> Column:
        out = otherwise
        for k, v in values.items():
            out = F.when(kind == k, v).otherwise(out)
        return out

    def expectation(k, op=None, num=None, text=None, expected=None):
        return F.struct(
            F.lit(k).alias("kind"), F.lit(op).cast("string").alias("op"),
            F.lit(num).cast("bigint").alias("num"), F.lit(text).cast("string").alias("text"),
            F.lit(expected).cast("boolean").alias("expected"),
        )

    def field(name, value, bare=False):
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(bare).alias("bare"))

    none_map = F.create_map().cast("map<string,string>")
    mutation = "array<struct<field:string,generators:array<string>>>"

    def mutate(field, generators):
        return F.array(F.struct(F.lit(field).alias("field"), literal_array(generators).alias("generators")))

    mutations = by_kind(
        {
            "error": mutate("q", ["sql_injection", "Huge", "admin"]),
            "signup": F.concat(mutate("user", ["empty", "decimals"]), mutate("extra", ["zero"])),
        },
        F.array().cast(mutation),
    )
    return e.select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("project"),
        F.concat(F.lit("e"), eid.cast("string")).alias("case_id"),
        by_kind({k: F.lit(s) for k, s in SUITES.items() if s}, F.lit(None).cast("string")).alias("suite"),
        F.concat(kind, F.lit("_case")).alias("name"),
        F.when(eid % 4 == 0, F.lit("PUT")).alias("method"),
        F.when(eid % 31 != 0, F.concat(F.lit("/e/"), (F.col("user_id") % 7).cast("string"))).alias("target"),
        by_kind(
            {
                "signup": F.create_map(F.lit("user"), F.concat(F.lit("u"), F.col("user_id").cast("string"))),
                "error": F.create_map(
                    F.lit("q"),
                    F.when(eid % 2 == 0, F.lit("' OR 1=1")).otherwise(F.lit('say "hi"')),
                ),
            },
            none_map,
        ).alias("send"),
        by_kind(
            {
                "signup": F.array(
                    field("user", F.concat(F.lit("u"), F.col("user_id").cast("string"))),
                    field("age", (F.col("user_id") % 90).cast("string"), bare=True),
                    field("terms", (eid % 2 == 0).cast("string"), bare=True),
                )
            },
            F.lit(None).cast(REQUEST_FIELDS),
        ).alias("fields"),
        F.when(eid % 6 == 0, F.create_map(F.lit("X-Trace"), F.concat(F.lit("t"), eid.cast("string"))))
        .otherwise(none_map).alias("headers"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("login_user"),
        F.when(kind == "click", F.when(eid % 3 == 0, F.lit("plain")).otherwise(F.lit("../../etc/passwd"))).alias("payload"),
        F.when(eid % 97 == 0, F.lit(120)).otherwise((eid % 12 + 1).cast("int")).alias("repeat"),
        F.when(kind == "purchase", F.array(F.lit("login"))).otherwise(nothing).alias("actions"),
        by_kind(
            {
                "signup": F.array(F.lit("Rate_Limit")), "error": F.array(F.lit("injection")),
                "view": F.array(F.lit("authentication"), F.lit("Mystery")),
            },
            nothing,
        ).alias("checks"),
        (mutations if mutated else F.array().cast(mutation)).alias("mutations"),
        by_kind(
            {
                "signup": F.array(expectation("status", "!=", 500)),
                "error": F.array(expectation("not_contains", text="token")),
                "click": F.array(
                    expectation("named", text="file_not_exposed", expected=True),
                    expectation("status", "<", 400),
                ),
                "purchase": F.array(expectation("named", text="session_invalidated", expected=True)),
            },
            F.array(expectation("contains", text="fine")),
        ).alias("expectations"),
        by_kind({"signup": F.lit("critical"), "error": F.lit("high"), "click": F.lit("Medium")}, F.lit("unknown")).alias("severity"),
        F.when(eid % 5 == 0, F.lit("Possible SQL problem")).otherwise(F.concat(kind, F.lit(" failed"))).alias("message"),
    )


def recorded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The responses of every derived case: one per repeat, or login and reuse."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "event_id")
    eid, session = F.col("event_id"), F.col("event_type") == "purchase"
    repeat = F.when(session, F.lit(2)).when(eid % 97 == 0, F.lit(120)).otherwise((eid % 12 + 1).cast("int"))
    rows = e.withColumn("seq", F.explode(F.sequence(F.lit(1), repeat)))
    seq = F.col("seq")
    login = session & (seq == 1)
    cookie = F.create_map(
        F.lit("Set-Cookie"), F.concat(F.lit("sid=s"), F.col("user_id").cast("string"), F.lit("; Path=/"))
    )
    statuses = F.array(*[F.lit(s) for s in STATUSES])
    return rows.select(
        F.concat(F.lit("e"), eid.cast("string")).alias("case_id"),
        F.when(login, F.lit("login")).when(session, F.lit("reuse")).otherwise(F.lit("request")).alias("phase"),
        seq.alias("seq"),
        F.element_at(statuses, ((eid * 3 + seq * 5) % len(STATUSES) + 1).cast("int")).alias("status"),
        F.when(login & (eid % 2 == 0), cookie).otherwise(F.create_map().cast("map<string,string>")).alias("headers"),
        _pick(BODIES, eid + seq * 3).alias("body"),
        F.when((eid + seq) % 29 == 0, F.lit("connection refused")).alias("error"),
    )


SQL_RESPONSES = f"""
cases AS (
  SELECT event_id, 'src' || (user_id % 20) AS project, 'e' || event_id AS case_id, event_type AS kind, user_id,
         CASE event_type WHEN 'signup' THEN 'Authentication' WHEN 'error' THEN 'API'
              WHEN 'click' THEN 'Web' WHEN 'purchase' THEN 'Session' END AS suite,
         event_type = 'purchase' AS session,
         CASE WHEN event_id % 31 <> 0 THEN '/e/' || (user_id % 7) END AS target,
         CASE WHEN event_type = 'purchase' THEN 2 WHEN event_id % 97 = 0 THEN 120 ELSE event_id % 12 + 1 END AS n
  FROM events),
responses AS (
  SELECT *, (event_id + seq) % 29 = 0 AS failed,
         ([{", ".join(map(str, STATUSES))}])[(event_id * 3 + seq * 5) % {len(STATUSES)} + 1] AS status,
         {sql_pick(BODIES, "event_id + seq * 3")} AS body
  FROM (SELECT *, unnest(range(1, n + 1)) AS seq FROM cases))"""
