"""Table schemas as DDL strings."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = "project STRING, path STRING, content STRING, lines INT, language STRING"

FINDINGS = (
    "project STRING, rule STRING, title STRING, category STRING, severity STRING, "
    "path STRING, line_no INT, message STRING, suggestion STRING"
)
FINDING_COLUMNS = [part.split()[0] for part in FINDINGS.split(", ")]

SNAPSHOTS = (
    "project STRING, id STRING, timestamp STRING, label STRING, security_score INT, "
    "total_findings BIGINT, critical BIGINT, high BIGINT, warning BIGINT, info BIGINT, "
    "files BIGINT, lines_of_code BIGINT"
)

DECLARED = T.ArrayType(
    T.StructType().add("name", "string").add("version", "string").add("dev", "boolean")
)

LINE_RULES = (
    "name STRING, contains ARRAY<STRING>, reaches STRING, without ARRAY<STRING>, "
    "severity STRING, report STRING"
)

EXPECTATIONS = (
    "ARRAY<STRUCT<kind: STRING, op: STRING, num: BIGINT, text: STRING, expected: BOOLEAN>>"
)
MUTATIONS = "ARRAY<STRUCT<field: STRING, generators: ARRAY<STRING>>>"

# The ordered fields of a request; a bare value is a number or a boolean and goes without quotes.
REQUEST_FIELDS = "ARRAY<STRUCT<name: STRING, value: STRING, bare: BOOLEAN>>"

# Cases may also have ``fields`` (REQUEST_FIELDS), which then stand for ``send``, and ``login_user STRING``.
PROBE_CASES = (
    "project STRING, case_id STRING, suite STRING, name STRING, method STRING, target STRING, "
    "send MAP<STRING, STRING>, headers MAP<STRING, STRING>, payload STRING, repeat INT, "
    f"actions ARRAY<STRING>, checks ARRAY<STRING>, mutations {MUTATIONS}, "
    f"expectations {EXPECTATIONS}, severity STRING, message STRING"
)

# ``case_id`` is the id of an expanded case and is unique across projects.
RESPONSES = (
    "case_id STRING, phase STRING, seq INT, status INT, headers MAP<STRING, STRING>, "
    "body STRING, error STRING"
)

TEST_RUNS = (
    "project STRING, run_id STRING, case_id STRING, suite STRING, name STRING, "
    "severity STRING, target STRING, verdict STRING, message STRING, error STRING, issue_id STRING"
)
