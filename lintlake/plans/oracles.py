"""The registered queries as plain SQL, for comparison by another engine.

The SQL is written from the meaning of each rule: joins, list functions and regular
expressions without look-around. Only word lists and derived inputs are shared.
"""

from __future__ import annotations

import re

from ..functions import fixed_values as V
from . import derived as D
from .derived import sql_text
from .queries import LONG_LINE, SCAN, USER_RULES


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {sql_text(w)})" for w in words) + ")"


def _in(words) -> str:
    return "(" + ", ".join(sql_text(w) for w in words) + ")"


def _with(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


CODE = D.sql_code_corpus()
TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
COMMENT = (
    r"(CASE WHEN language IN ('Python', 'Ruby', 'Shell') THEN regexp_matches(text, '^\s*#') "
    r"ELSE regexp_matches(text, '^\s*(//|[*]|/[*])') END)"
)

# --- scan rules ----------------------------------------------------------------

_token = " ".join(
    f"WHEN regexp_matches(text, {sql_text(pattern)}) THEN {sql_text(label)}"
    for _, pattern, label in V.PROVIDER_TOKENS
)
_EQ = r"'^((?:.*?[^=!<>])?)=(?:[^=]|$)'"
_COLON = r"'^((?:.*?[^:])?(?:::)*):(?:[^:]|$)'"


def _literal(quote: str) -> str:
    q = quote.replace("'", "''")
    pattern = rf"""'^[^"''`]*{q}((?:[^{q}\\]|\\.)*){q}'"""
    return f"regexp_extract(rest, {pattern}, 1)"


SECRETS = rf"""
assigned AS (
  SELECT *, lower(left(text, pos::INT)) AS lhs, substr(text, pos::INT + 1) AS rest FROM (
    SELECT *, least(
      CASE WHEN regexp_matches(text, {_EQ}) THEN length(regexp_extract(text, {_EQ}, 1)) END,
      CASE WHEN regexp_matches(text, {_COLON}) THEN length(regexp_extract(text, {_COLON}, 1)) END) AS pos
    FROM lines WHERE {_any('lower(text)', V.SECRET_WORDS)} AND NOT {COMMENT})
  WHERE pos IS NOT NULL),
literals AS (
  SELECT project, path, line_no, {TRIM.format("v")} AS v FROM (
    SELECT project, path, line_no, {_literal('"')} || {_literal("'")} || {_literal("`")} AS v
    FROM assigned WHERE {_any('lhs', V.SECRET_WORDS)})),
generic AS (
  SELECT project, path, line_no FROM literals
  WHERE strlen(v) >= {V.MIN_SECRET_BYTES} AND lower(v) NOT IN {_in(V.PLACEHOLDERS)}
    AND NOT {_any('v', V.LOOKUP_FRAGMENTS)} AND NOT starts_with(v, '$')
    AND (strlen(v) >= {V.LONG_SECRET_BYTES} OR regexp_matches(v, '[0-9]|[^A-Za-z0-9\s]'))),
secrets AS (
  SELECT project, 'hardcoded-secret' AS rule, 'Security' AS category, 'CRITICAL' AS severity, path, line_no,
         {sql_text(V.RULES['hardcoded-secret'][0])} AS title, kind || {sql_text(V.SECRET_MESSAGE)} AS message
  FROM (SELECT l.project, l.path, l.line_no, coalesce(
          CASE {_token} WHEN contains(text, '-----BEGIN') AND contains(text, 'PRIVATE KEY-----')
               THEN 'Private key block' END,
          CASE WHEN g.path IS NOT NULL THEN 'Hardcoded credential' END) AS kind
        FROM lines l LEFT JOIN generic g USING (project, path, line_no))
  WHERE kind IS NOT NULL)"""

_sinks = " ".join(
    "WHEN contains(text, {0}){1} THEN {2}".format(
        sql_text(needle), f" AND language = {sql_text(lang)}" if lang else "", sql_text(label)
    )
    for needle, lang, label in V.SINKS
)
COMMANDS = f"""
commands AS (
  SELECT project, 'dangerous-command' AS rule, 'Security' AS category, 'HIGH' AS severity, path, line_no,
         {sql_text(V.RULES['dangerous-command'][0])} AS title, what || {sql_text(V.COMMAND_MESSAGE)} AS message
  FROM (SELECT *, CASE WHEN NOT {COMMENT} THEN CASE {_sinks} END END AS what FROM lines)
  WHERE what IS NOT NULL)"""

_marker = " ".join(
    f"WHEN regexp_matches(text, '(^|[^A-Za-z0-9]){m}([^A-Za-z0-9]|$)') THEN '{m}'" for m, _ in V.MARKERS
)
_note = " ".join(
    f"WHEN '{m}' THEN regexp_extract(text, '(?:^|[^A-Za-z0-9]){m}((?:[^A-Za-z0-9].*)?)$', 1)"
    for m, _ in V.MARKERS
)
_marker_severity = " ".join(f"WHEN '{m}' THEN '{s}'" for m, s in V.MARKERS)
MARKERS = rf"""
markers AS (
  SELECT project, 'todo-tracker' AS rule, 'Quality' AS category,
         CASE marker {_marker_severity} END AS severity, path, line_no, marker || ' comment' AS title,
         CASE WHEN note = '' THEN marker || ' marker' ELSE marker || ': ' || note END AS message
  FROM (SELECT *, {TRIM.format("regexp_replace(tail, '^[: )-]+', '')")} AS note
        FROM (SELECT *, CASE marker {_note} END AS tail
              FROM (SELECT *, CASE {_marker} END AS marker FROM lines) WHERE marker IS NOT NULL)))"""

LARGE = f"""
large AS (
  SELECT project, 'large-file' AS rule, 'Quality' AS category, 'WARNING' AS severity, path, 0 AS line_no,
         {sql_text(V.RULES['large-file'][0])} AS title,
         len(parts) || ' lines (threshold {SCAN.large_file_threshold}' || {sql_text(V.LARGE_FILE_MESSAGE)} AS message
  FROM line_lists WHERE len(parts) > {SCAN.large_file_threshold})"""


def _duplicates(size: int) -> str:
    sig = " || chr(10) || ".join(["t"] + [f"lead(t, {k}) OVER w" for k in range(1, size)])
    return rf"""
kept AS (
  SELECT *, count(*) OVER (PARTITION BY project, path) AS n FROM (
    SELECT project, path, line_no, {TRIM.format("text")} AS t FROM lines)
  WHERE strlen(t) >= {V.MIN_SIGNIFICANT_BYTES} AND regexp_matches(t, '[\p{{L}}\p{{N}}]')),
blocks AS (
  SELECT project, path, line_no, {sig} AS sig FROM kept WHERE n >= {2 * size}
  WINDOW w AS (PARTITION BY project, path ORDER BY line_no)),
repeats AS (
  SELECT project, path, line_no, first_line FROM (
    SELECT *, min(line_no) OVER (PARTITION BY project, path, sig) AS first_line
    FROM blocks WHERE sig IS NOT NULL)
  WHERE line_no > first_line),
dup_blocks AS (
  SELECT project, path, unnest(keep).line_no AS line_no, unnest(keep).first_line AS first_line FROM (
    SELECT project, path, list_reduce(
      list_transform(list({{'line_no': line_no, 'first_line': first_line}} ORDER BY line_no), lambda x: [x]),
      lambda acc, x: CASE WHEN x[1].line_no - acc[-1].line_no >= {size} THEN list_concat(acc, x) ELSE acc END) AS keep
    FROM repeats GROUP BY project, path)),
dups AS (
  SELECT project, 'duplicate-code' AS rule, 'Quality' AS category, 'INFO' AS severity, path, line_no,
         {sql_text(V.RULES['duplicate-code'][0])} AS title,
         '{size}-line block duplicates one starting at line ' || first_line || {sql_text(V.DUPLICATE_MESSAGE)} AS message
  FROM dup_blocks)"""


SCAN_CTES = (CODE, SECRETS, COMMANDS, MARKERS, LARGE, _duplicates(SCAN.block_size), """
findings AS (SELECT * FROM secrets UNION ALL SELECT * FROM commands UNION ALL SELECT * FROM markers
             UNION ALL SELECT * FROM large UNION ALL SELECT * FROM dups)""")

_rank = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END"
_rule_rank = "CASE rule " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(V.RULES)) + " ELSE 99 END"
_weight = "CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 10 WHEN 'WARNING' THEN 3 WHEN 'INFO' THEN 1 END"
_counts = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s, _, _ in V.SEVERITIES)

SCORES = f"""
scores AS (
  SELECT f.project, f.files, f.lines_of_code, coalesce(c.critical, 0) AS critical, coalesce(c.high, 0) AS high,
         coalesce(c.warning, 0) AS warning, coalesce(c.info, 0) AS info, coalesce(c.total, 0) AS total_findings,
         greatest(0, 100 - coalesce(c.lost, 0))::INT AS security_score,
         coalesce(c.critical, 0) + coalesce(c.high, 0) > 0 AS blocking
  FROM (SELECT project, count(*) AS files, sum(len(parts))::BIGINT AS lines_of_code FROM line_lists GROUP BY 1) f
  LEFT JOIN (SELECT project, {_counts}, count(*) AS total, sum({_weight}) AS lost FROM findings GROUP BY 1) c
  USING (project))"""


def _race() -> str:
    name = r"regexp_extract({0}, '([a-z0-9_]+)\s*$', 1)"
    tries = []
    for op in V.COMPOUND_OPS:
        n = name.format(f"left(low, strpos(low, '{op}') - 1)")
        tries.append(f"CASE WHEN contains(low, '{op}') AND {n} IN {_in(V.STATEFUL_NAMES)} THEN {n} END")
    plain = r"'^((?:.*?[^=!<>+*/-])?)=(?:[^=]|$)'"
    return rf"""
race AS (
  SELECT project, path, language, line_no, coalesce({", ".join(tries)},
    CASE WHEN has_plain AND plain_name IN {_in(V.STATEFUL_NAMES)} AND contains(rhs, plain_name)
              AND (contains(rhs, '-') OR contains(rhs, '+')) THEN plain_name END) AS name
  FROM (SELECT *, {name.format("lhs")} AS plain_name, substr(low, length(lhs) + 2) AS rhs
        FROM (SELECT *, regexp_matches(low, {plain}) AS has_plain, regexp_extract(low, {plain}, 1) AS lhs
              FROM (SELECT *, lower(text) AS low FROM lines WHERE contains(text, '=')))
        WHERE NOT {_any('low', V.SYNC_WORDS)})),
races AS (
  SELECT project, 'race-condition' AS rule, 'Security' AS category, 'WARNING' AS severity, path, line_no,
         '`' || name || '`' || {sql_text(V.RACE_MESSAGE)} AS message,
         CASE WHEN language = 'Rust' THEN {sql_text(V.RACE_FIX_RUST)} ELSE {sql_text(V.RACE_FIX_OTHER)} END AS suggestion
  FROM race WHERE name IS NOT NULL)"""


# --- imports of the document corpus ---------------------------------------------

_Q = r"""[^"'']*["'']([^"'']*)["'']"""
CODE_IMPORTS = rf"""
trimmed AS (SELECT project, path, language, {TRIM.format("text")} AS t FROM lines),
modules AS (
  SELECT project, path, CASE
    WHEN language = 'Rust' AND regexp_matches(t, '^(pub )?use ') THEN
      nullif(regexp_replace({TRIM.format("split_part(regexp_extract(t, '^(?:pub )?use (.*)$', 1), ':', 1)")}, ';+$', ''), '')
    WHEN language IN ('JavaScript', 'TypeScript') THEN CASE
      WHEN regexp_matches(t, '^.*?from {_Q}') THEN regexp_extract(t, '^.*?from {_Q}', 1)
      WHEN regexp_matches(t, '^.*?require[(]{_Q}') THEN regexp_extract(t, '^.*?require[(]{_Q}', 1)
      WHEN regexp_matches(t, '^import {_Q}') THEN regexp_extract(t, '^import {_Q}', 1) END
    WHEN language = 'Python' THEN regexp_extract(t, '^(?:from|import)\s+([^ ,.]+)', 1)
    WHEN language = 'Go' THEN regexp_extract(t, '^{_Q}', 1)
    WHEN language = 'Java' THEN regexp_extract(t, '^import (?:static )?([^.;]+(?:[.][^.;]+)?)', 1)
    WHEN language = 'Ruby' AND starts_with(t, 'require ') THEN regexp_extract(t, '^{_Q}', 1) END AS m
  FROM trimmed),
code_edges AS (
  SELECT DISTINCT m.project, m.path,
         CASE WHEN f.language IN ('JavaScript', 'TypeScript', 'Ruby')
              THEN CASE WHEN starts_with(m, '@') THEN regexp_extract(m, '^@[^/]*/[^/]*') ELSE split_part(m, '/', 1) END
              ELSE m END AS module
  FROM modules m JOIN files f USING (project, path)
  WHERE m <> '' AND NOT (f.language = 'Rust' AND m IN {_in(V.RUST_LOCAL_HEADS)})
    AND NOT (f.language IN ('JavaScript', 'TypeScript') AND (starts_with(m, '.') OR starts_with(m, '/')))
    AND NOT (f.language = 'Go' AND NOT contains(split_part(m, '/', 1), '.'))
    AND NOT (f.language = 'Java' AND (starts_with(m, 'java.') OR starts_with(m, 'javax.'))))"""

# --- dependencies -----------------------------------------------------------------

IMPORTS = D.sql_import_corpus()
DECLARED = D.sql_manifest_corpus()
INVENTORY = f"""
norm_imports AS (SELECT DISTINCT project, replace(lower(module), '_', '-') AS norm FROM edges),
path_uses AS (
  SELECT DISTINCT project, ident FROM (
    SELECT project, unnest(list_concat(raw, [used, 'prelude'])) AS ident FROM imports_in WHERE ext = 'rs')),
inventory AS (
  SELECT d.*, CASE WHEN ecosystem IN {_in(V.USAGE_ECOSYSTEMS)} THEN
      EXISTS (SELECT 1 FROM norm_imports i WHERE i.project = d.project AND i.norm = replace(lower(d.name), '_', '-'))
      OR (ecosystem = 'Rust (Cargo)' AND EXISTS (
            SELECT 1 FROM path_uses p WHERE p.project = d.project AND p.ident = replace(d.name, '-', '_')))
      END AS used
  FROM declared d)"""

NODES = f"""
nodes AS (
  SELECT n.project, n.name, n.manifest, n.dev, coalesce(i.files, 0) AS importing_files,
         i.files IS NOT NULL OR p.ident IS NOT NULL AS used
  FROM (SELECT DISTINCT ON (project, name, manifest) project, name, manifest, dev FROM declared
        WHERE ecosystem IN {_in(V.USAGE_ECOSYSTEMS)} ORDER BY project, name, manifest, path, dev) n
  LEFT JOIN (SELECT project, replace(lower(module), '_', '-') AS norm, count(*) AS files FROM edges GROUP BY 1, 2) i
    ON i.project = n.project AND i.norm = replace(lower(n.name), '_', '-')
  LEFT JOIN path_uses p ON p.project = n.project AND p.ident = replace(n.name, '-', '_'))"""

# --- probes -----------------------------------------------------------------------

_sql_error = _any("lower(body)", V.SQL_ERROR_WORDS)
_exposed = _any("lower(body)", [w.lower() for w in V.EXPOSED_FILE_WORDS])
_ISSUE = (
    "CASE WHEN kind = 'click' AND event_id % 3 <> 0 THEN 'KLR-PATH-TRAVERSAL' "
    "WHEN kind = 'signup' THEN 'KLR-RATE-LIMIT' WHEN kind = 'purchase' THEN 'KLR-SESSION' "
    "WHEN (kind = 'error' AND event_id % 2 = 0) OR event_id % 5 = 0 THEN 'KLR-SQLI' ELSE 'KLR-GENERIC' END"
)


def _check(when: str, description: str, passed: str, evaluated: str, detail: str) -> str:
    return (
        f"SELECT project, case_id, {description} AS description, ({passed}) AS passed, "
        f"{evaluated} AS evaluated, {detail} AS detail FROM decided WHERE error IS NULL AND {when}"
    )


_tf = "CASE WHEN {0} THEN {1} ELSE {2} END"
_not_leaked = f"NOT {_sql_error}"
JUDGED = f"""
windows AS (
  SELECT *, min(seq) FILTER (failed) OVER (PARTITION BY case_id) AS failed_at FROM responses),
first_block AS (
  SELECT case_id, min(seq) AS blocked_at FROM windows
  WHERE NOT session AND status IN (403, 429, 503) AND (failed_at IS NULL OR seq < failed_at) GROUP BY 1),
last_seen AS (
  SELECT w.case_id, max(w.seq) AS last_seq, count(*) AS n_seen
  FROM windows w LEFT JOIN first_block b USING (case_id)
  WHERE (w.failed_at IS NULL OR w.seq < w.failed_at)
    AND (w.kind <> 'signup' OR b.blocked_at IS NULL OR w.seq <= b.blocked_at) GROUP BY 1),
login AS (
  SELECT case_id, bool_or(failed AND seq = 1) AS login_failed, bool_or(failed AND seq = 2) AS reuse_failed
  FROM responses WHERE session GROUP BY 1),
decided AS (
  SELECT c.*, b.blocked_at, s.n_seen, w.status, w.body,
         CASE WHEN c.target IS NULL AND NOT c.session THEN 'attack has no `target`/`endpoint` to request'
              WHEN l.login_failed THEN 'login request failed: connection refused'
              WHEN l.reuse_failed THEN 'reuse request failed: connection refused'
              WHEN w.case_id IS NULL THEN 'request failed: connection refused' END AS error,
         {_ISSUE.replace("kind", "c.kind").replace("event_id", "c.event_id")} AS issue_id
  FROM cases c LEFT JOIN first_block b USING (case_id) LEFT JOIN last_seen s USING (case_id)
  LEFT JOIN login l USING (case_id)
  LEFT JOIN windows w ON w.case_id = c.case_id AND w.seq = CASE WHEN c.session THEN 2 ELSE s.last_seq END),
checks AS (
  {_check("kind = 'signup'", "'status != 500'", "status <> 500", "true", "'observed status ' || status")}
  UNION ALL
  {_check("kind = 'signup'", "'blocked_after 50'", "blocked_at IS NOT NULL", "true",
          "CASE WHEN blocked_at IS NULL THEN 'no rate limiting after ' || n_seen || ' requests' "
          "ELSE 'blocked at request #' || blocked_at || ' (limit 50)' END")}
  UNION ALL
  {_check("kind = 'error'", "'response does_not_contain \"token\"'", "NOT contains(body, 'token')", "true",
          _tf.format("contains(body, 'token')", "'\"token\" leaked in response'", "'absent from response'"))}
  UNION ALL
  {_check("kind = 'error'", "'no SQL error leaked'", _not_leaked, "true",
          _tf.format(_sql_error, "'database error signature found in response'", "'no database error in response'"))}
  UNION ALL
  {_check(f"kind IN ('error', 'signup', 'click') AND {_sql_error}", "'no SQL error leaked in response'", "false", "true",
          "'response body contains a database error signature'")}
  UNION ALL
  {_check("kind = 'click'", "'file_not_exposed true'", f"NOT {_exposed}", "true",
          _tf.format(_exposed, "'sensitive file contents found in response'", "'no sensitive file contents in response'"))}
  UNION ALL
  {_check("kind = 'click'", "'status < 400'", "status < 400", "true", "'observed status ' || status")}
  UNION ALL
  {_check("kind = 'purchase'", "'captured session cookie'", "true", "true",
          "CASE WHEN event_id % 2 = 0 THEN 'stole cookie `sid=s' || user_id || '`' ELSE 'no Set-Cookie returned by login' END")}
  UNION ALL
  {_check("kind = 'purchase'", "'session_invalidated true'", "status IN (401, 403)", "true",
          "'reuse returned status ' || status")}
  UNION ALL
  {_check("kind = 'view'", "'response contains \"fine\"'", "contains(body, 'fine')", "true",
          _tf.format("contains(body, 'fine')", "'found in response'", "'not found in response'"))}
  UNION ALL
  {_check("kind = 'view'", "'requires authentication'", "status IN (401, 403, 302)", "true",
          "'unauthenticated request returned status ' || status")}
  UNION ALL
  {_check("kind = 'view'", "'mystery true'", "true", "false", "'not evaluated by this engine'")}),
outcomes AS (
  SELECT d.project, d.case_id, d.kind, d.suite,
         CASE d.kind WHEN 'signup' THEN 'CRITICAL' WHEN 'click' THEN 'WARNING' ELSE 'HIGH' END AS severity,
         CASE WHEN d.error IS NOT NULL THEN 'errored'
              WHEN EXISTS (SELECT 1 FROM checks k WHERE k.case_id = d.case_id AND k.evaluated AND NOT k.passed)
              THEN 'vulnerable' ELSE 'secure' END AS verdict,
         d.error, d.issue_id, d.event_id, d.session, d.target
  FROM decided d)"""
PROBES = (D.SQL_RESPONSES, JUDGED)
# Each step worked out once, for the query that joins two of them.
MATERIALIZED_PROBES = tuple(re.sub(r"(?m)^(\w+) AS \(", r"\1 AS MATERIALIZED (", part) for part in PROBES)
_verdicts = (
    "count(*) AS tested, count(*) FILTER (verdict = 'secure') AS passed, "
    "count(*) FILTER (verdict = 'vulnerable') AS vulnerable, count(*) FILTER (verdict = 'errored') AS errored"
)
_METHOD = (
    "CASE WHEN kind = 'purchase' THEN 'POST' WHEN event_id % 4 = 0 THEN 'PUT' "
    "WHEN kind IN ('signup', 'error', 'click') THEN 'POST' ELSE 'GET' END"
)
_URL = "'http://127.0.0.1:8080' || CASE WHEN session THEN coalesce(target, '/login') ELSE target END"
_FIXES = "CASE issue {} END".format(
    " ".join(f"WHEN {sql_text(e[0])} THEN {sql_text(e[4])}" for e in V.EXPLANATIONS)
)
_REFERENCES = "CASE issue {} END".format(
    " ".join(f"WHEN {sql_text(e[0])} THEN {sql_text(e[5][0])}" for e in V.EXPLANATIONS)
)
TOTALS = f"""
totals AS (
  SELECT project, {_verdicts},
         coalesce(list_sort(list(DISTINCT issue_id) FILTER (verdict = 'vulnerable')), []) AS ids
  FROM outcomes GROUP BY 1)"""


# --- framework ---------------------------------------------------------------------

_categories = ", ".join(f"({i}, {sql_text(c)}, {sql_text(t)})" for i, (c, t) in enumerate(V.FRAMEWORK_CATEGORIES))
_mappings = ", ".join(
    f"({i}, {', '.join(sql_text(x) for x in m)})" for i, m in enumerate(V.FRAMEWORK_MAPPINGS)
)
KEYS = f"""
categories(ord, id, title) AS (VALUES {_categories}),
mappings(ord, key, owasp, cwe, cwe_title) AS (VALUES {_mappings}),
keys AS (SELECT project, rule AS key FROM findings UNION ALL
         SELECT project, issue_id FROM outcomes WHERE verdict = 'vulnerable')"""

# --- review -------------------------------------------------------------------------

REVIEW = """
review AS (
  SELECT f.project, f.rule, f.severity, f.path, f.line_no, f.message
  FROM findings f JOIN added a USING (project, path, line_no)
  UNION ALL
  SELECT r.project, r.rule, r.severity, r.path, r.line_no, r.message
  FROM races r JOIN added a USING (project, path, line_no))"""


def _user_rules() -> str:
    comment = r"regexp_matches(text, '^\s*(#|//|[*]|/[*])')"
    reaches = _any("low", V.INPUT_WORDS + V.DYNAMIC_STRING_WORDS)
    clean = _any("low", V.SANITIZER_WORDS)
    words = {"critical": "CRITICAL", "high": "HIGH", "medium": "WARNING", "low": "INFO", "info": "INFO"}
    parts = []
    for name, needles, sink, without, severity, report in USER_RULES:
        if not needles and sink is None:
            continue
        cond = [f"contains(low, {sql_text(n.lower())})" for n in needles]
        if sink is not None:
            cond += [f"contains(low, {sql_text(sink.lower())})", reaches]
        if without:
            cond.append(f"NOT {clean}")
        parts.append(
            f"SELECT project, {sql_text(name)} AS rule, '{words[severity]}' AS severity, path, line_no, "
            f"{sql_text(report or name)} AS message FROM code WHERE {' AND '.join(cond)}"
        )
    return (
        f"code AS (SELECT *, lower(text) AS low FROM lines WHERE NOT {comment}),\nuser_hits AS ("
        + "\n UNION ALL ".join(parts)
        + ")"
    )


# --- listings -------------------------------------------------------------------------

CHANGES = f"""
listed AS (SELECT event_type AS project, 'u' || user_id || '/' || (event_id % 13) AS path, ts, event_id FROM events),
old_list AS (SELECT project, path, max(event_id) AS ns FROM listed WHERE ts < TIMESTAMP '{D.LISTING_OLD_UNTIL}' GROUP BY 1, 2),
new_list AS (SELECT project, path, max(event_id) AS ns FROM listed WHERE ts >= TIMESTAMP '{D.LISTING_NEW_FROM}' GROUP BY 1, 2),
changes AS (
  SELECT project, path, 'added' AS status FROM new_list ANTI JOIN old_list USING (project, path)
  UNION ALL SELECT project, path, 'removed' FROM old_list ANTI JOIN new_list USING (project, path)
  UNION ALL SELECT n.project, n.path, 'modified' FROM new_list n JOIN old_list o USING (project, path)
            WHERE n.ns <> o.ns)"""

_glyphs = ", ".join(sql_text(g) for g in V.SPARK_GLYPHS)
_band = "CASE WHEN security_score >= 80 THEN 'good' WHEN security_score >= 50 THEN 'fair' ELSE 'poor' END"
_single = "SELECT project, path, line_no, severity, title, message FROM "

# The plain documents, for the streaming queries.
PLAIN = (
    "files AS (SELECT source AS project, 'd' || doc_id || '.txt' AS path, text AS content, "
    "'Other' AS language FROM documents),\n" + D.SQL_LINES
)
PLAIN_SCAN = (PLAIN, *SCAN_CTES[1:])

_VALUES = {name: values for name, _, _, values in V.GENERATORS}


def _variants() -> str:
    """(kind, at, field, label, value) of each derived mutation."""
    rows = []
    spec = {
        "error": [("q", ["sql_injection", "Huge", "admin"])],
        "signup": [("user", ["empty", "decimals"]), ("extra", ["zero"])],
    }
    values = {**_VALUES, "Huge": _VALUES["huge_values"], "admin": ["admin"]}
    for kind, fields in spec.items():
        for fi, (field, generators) in enumerate(fields, 1):
            for gi, generator in enumerate(generators, 1):
                many = values[generator]
                for vi, value in enumerate(many, 1):
                    label = f"{generator}#{vi}" if len(many) > 1 else generator
                    rows.append(
                        "(" + ", ".join(map(sql_text, (kind, f"{fi}.{gi}.{vi}", field, label, value))) + ")"
                    )
    return f"variants(kind, pos, field, label, value) AS (VALUES {', '.join(rows)})"


_SEND = (
    "CASE kind WHEN 'signup' THEN '{\"user\":\"u' || user_id || '\"}' "
    "WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '{\"q\":\"'' OR 1=1\"}' ELSE '{\"q\":\"say \\\"hi\\\"\"}' END "
    "ELSE '{}' END"
)

ORACLES: dict[str, str] = {
    "corpus_stats": _with(CODE, body="""
SELECT project, count(*) AS files, sum(len(parts))::BIGINT AS lines_of_code,
       array_to_string(list_filter(['Rust','JavaScript','TypeScript','Python','Go','Ruby','Java','C','C++','Shell'],
         lambda x: list_contains(list(DISTINCT language), x)), ',') AS languages
FROM line_lists GROUP BY project"""),
    "language_mix": _with(CODE, body="""
SELECT project, language, count(*) AS files, sum(len(parts))::BIGINT AS lines FROM line_lists GROUP BY 1, 2"""),
    "comment_lines": _with(CODE, body=f"""
SELECT project, language, count(*) AS lines, count(*) FILTER ({COMMENT}) AS comments FROM lines GROUP BY 1, 2"""),
    "secret_findings": _with(CODE, SECRETS, body=_single + "secrets"),
    "dangerous_commands": _with(CODE, COMMANDS, body=_single + "commands"),
    "todo_markers": _with(CODE, MARKERS, body=_single + "markers"),
    "large_files": _with(CODE, LARGE, body=_single + "large"),
    "duplicate_code": _with(CODE, _duplicates(6), body=_single + "dups"),
    "duplicate_pairs": _with(CODE, _duplicates(2), body="SELECT project, path, line_no, first_line FROM dup_blocks"),
    "registered_rule": _with(CODE, body=f"""
SELECT project, path, line_no, length(text) || ' characters' AS message FROM lines WHERE length(text) > {LONG_LINE}"""),
    "race_conditions": _with(CODE, _race(), body="SELECT project, path, line_no, message, suggestion FROM races"),
    "project_score": _with(*SCAN_CTES, SCORES, body=f"SELECT *, {_band} AS band FROM scores"),
    "severity_pivot": _with(*SCAN_CTES, body=f"SELECT project, {_counts}, count(*) AS total_findings FROM findings GROUP BY 1"),
    "severity_bars": _with(*SCAN_CTES, body=f"""
SELECT project, s AS severity, n, CASE WHEN n = 0 THEN 0 ELSE greatest(n * {V.BAR_WIDTH} // greatest(max(n) OVER (PARTITION BY project), 1), 1) END::INT AS width
FROM (SELECT p.project, s.s, count(f.severity) AS n FROM (SELECT DISTINCT project FROM findings) p
      CROSS JOIN (VALUES ('CRITICAL'), ('HIGH'), ('WARNING'), ('INFO')) s(s)
      LEFT JOIN findings f ON f.project = p.project AND f.severity = s.s GROUP BY 1, 2)"""),
    "category_counts": _with(*SCAN_CTES, body="SELECT project, category, count(*) AS n FROM findings GROUP BY 1, 2"),
    "blocking_projects": _with(*SCAN_CTES, SCORES, body="SELECT project, critical, high FROM scores WHERE blocking"),
    "findings_report": _with(*SCAN_CTES, body=f"""
SELECT project, severity, path, line_no, rule FROM findings ORDER BY project, {_rank}, path, line_no, {_rule_rank}, rule"""),
    "top_findings": _with(*SCAN_CTES, body=f"""
SELECT project, position, severity, path, line_no, rule FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY {_rank}, path, line_no, {_rule_rank}, rule, message)::INT AS position FROM findings)
WHERE position <= 5"""),
    "code_imports": _with(CODE, CODE_IMPORTS, body="SELECT project, path, module FROM code_edges"),
    "import_edges": _with(IMPORTS, body="SELECT project, path, module FROM edges"),
    "top_modules": _with(IMPORTS, body="""
SELECT * FROM (SELECT project, module, files, row_number() OVER (PARTITION BY project ORDER BY files DESC, module)::INT AS position
  FROM (SELECT project, module, count(*) AS files FROM edges GROUP BY 1, 2)) WHERE position <= 10"""),
    "import_hotspots": _with(IMPORTS, body="""
SELECT * FROM (SELECT project, path, n_imports, row_number() OVER (PARTITION BY project ORDER BY n_imports DESC, path)::INT AS position
  FROM (SELECT project, path, count(*)::INT AS n_imports FROM edges GROUP BY 1, 2)) WHERE position <= 5"""),
    "module_count": _with(IMPORTS, body="""
SELECT project, count(*) AS edges, count(DISTINCT module) AS modules, count(DISTINCT path) AS importing_files
FROM edges GROUP BY 1"""),
    "declared_packages": _with(DECLARED, body="SELECT * FROM declared"),
    "dependency_inventory": _with(IMPORTS, DECLARED, INVENTORY, body="SELECT * FROM inventory"),
    "dependency_totals": _with(IMPORTS, DECLARED, INVENTORY, body="""
SELECT project, count(*) AS total, count(*) FILTER (NOT dev) AS production, count(*) FILTER (dev) AS development,
       count(*) FILTER (NOT used) AS unused, count(*) FILTER (used IS NULL) AS unknown FROM inventory GROUP BY 1"""),
    "unused_dependencies": _with(IMPORTS, DECLARED, INVENTORY, body="SELECT project, path, name, version FROM inventory WHERE NOT used"),
    "version_conflicts": _with(DECLARED, body="""
SELECT project, name, version, declarations, n_versions FROM (
  SELECT project, name, version, count(*) AS declarations, count(*) OVER (PARTITION BY project, name) AS n_versions
  FROM declared WHERE version IS NOT NULL GROUP BY 1, 2, 3) WHERE n_versions > 1"""),
    "ecosystem_counts": _with(DECLARED, body="SELECT project, ecosystem, count(*) AS packages FROM declared GROUP BY 1, 2"),
    "dependency_nodes": _with(IMPORTS, DECLARED, INVENTORY, NODES, body="SELECT * FROM nodes"),
    "node_totals": _with(IMPORTS, DECLARED, INVENTORY, NODES, body="""
SELECT project, count(*) AS declared, count(*) FILTER (used) AS used, count(*) FILTER (NOT used) AS unused
FROM nodes GROUP BY 1"""),
    "compliance_status": _with(*SCAN_CTES, *PROBES, KEYS, body="""
SELECT p.project, c.ord::INT AS ord, c.id, c.title,
       CASE WHEN count(k.key) > 0 THEN 'Warning' WHEN count(m.key) > 0 THEN 'Passed' ELSE 'Not assessed' END AS status,
       coalesce(string_agg(m.cwe_title || ' (' || m.key || ')', '; ' ORDER BY m.ord) FILTER (k.key IS NOT NULL), '') AS reasons
FROM (SELECT DISTINCT project FROM files) p CROSS JOIN categories c
LEFT JOIN mappings m ON m.owasp = c.id
LEFT JOIN (SELECT DISTINCT project, key FROM keys) k ON k.project = p.project AND k.key = m.key
GROUP BY ALL"""),
    "weakness_counts": _with(*SCAN_CTES, *PROBES, KEYS, body="""
SELECT project, cwe, cwe_title, count(*) AS n FROM keys JOIN mappings USING (key) GROUP BY 1, 2, 3"""),
    "score_history": _with(D.SQL_SNAPSHOTS, body=f"""
SELECT project, id, security_score, {_band} AS band, ([{_glyphs}])[least(security_score, 100) * 7 // 100 + 1] AS glyph FROM snapshots"""),
    "score_trend": _with(D.SQL_SNAPSHOTS, body="""
SELECT project, min(id) AS first_id, max(id) AS latest_id, arg_min(security_score, id) AS first_score,
       arg_max(security_score, id) AS latest_score,
       arg_max(security_score, id) - arg_min(security_score, id) AS score_change,
       greatest(arg_min(total_findings, id) - arg_max(total_findings, id), 0) AS findings_fixed,
       greatest(arg_max(total_findings, id) - arg_min(total_findings, id), 0) AS findings_added,
       count(*) AS snapshot_count
FROM snapshots GROUP BY project HAVING count(*) >= 2"""),
    "project_index": _with(D.SQL_SNAPSHOTS, body="""
SELECT project, arg_min(timestamp, id) AS created, arg_max(timestamp, id) AS last_updated,
       arg_max(security_score, id) AS latest_score, max(security_score) AS best_score, count(*) AS snapshot_count
FROM snapshots GROUP BY project"""),
    "saved_history": _with(D.SQL_SNAPSHOTS, body="SELECT * FROM snapshots"),
    "latest_run": _with(*PROBES, body="""
SELECT project, CASE WHEN again THEN '00000000000000000002' ELSE '00000000000000000001' END AS run_id, case_id, verdict, issue_id
FROM (SELECT *, substr(project, 4)::INT % 2 = 0 AND bool_or(verdict <> 'secure') OVER (PARTITION BY project) AS again FROM outcomes)
WHERE NOT again OR verdict <> 'secure'"""),
    "watch_ticks": D.sql_ticks(),
    "files_of_a_tree": D.sql_document_tree(),
    "diff_lines": _with(CODE, D.SQL_ADDED, body="SELECT project, path, line_no, text FROM added"),
    "patch_file_lines": D.SQL_PATCHED,
    "review_findings": _with(*SCAN_CTES, _race(), D.SQL_ADDED, REVIEW, body="SELECT * FROM review"),
    "review_summary": _with(*SCAN_CTES, _race(), D.SQL_ADDED, REVIEW, body="""
SELECT project, findings, blocking, CASE WHEN blocking > 0 THEN 'failed' WHEN findings = 0 THEN 'passed'
       ELSE 'passed with advisories' END AS verdict
FROM (SELECT p.project, count(r.rule) AS findings, count(*) FILTER (r.severity IN ('CRITICAL', 'HIGH')) AS blocking
      FROM (SELECT DISTINCT project FROM files) p LEFT JOIN review r USING (project) GROUP BY 1)"""),
    "gate": _with(*SCAN_CTES, _race(), D.SQL_ADDED, REVIEW, _user_rules(), body="""
SELECT *, scan_blocking = 0 AND rule_findings = 0 AND review_blocking = 0 AS passed FROM (
  SELECT p.project,
    (SELECT count(*) FROM findings f WHERE f.project = p.project AND severity IN ('CRITICAL', 'HIGH')) AS scan_blocking,
    (SELECT count(*) FROM user_hits u WHERE u.project = p.project) AS rule_findings,
    (SELECT count(*) FROM review r WHERE r.project = p.project AND severity IN ('CRITICAL', 'HIGH')) AS review_blocking
  FROM (SELECT DISTINCT project FROM files) p)"""),
    "snapshot_changes": _with(CHANGES, body="SELECT * FROM changes"),
    "change_counts": _with(CHANGES, body="""
SELECT project, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified,
       count(*) FILTER (status = 'removed') AS removed, count(*) AS total FROM changes GROUP BY 1"""),
    "user_rules": _with(CODE, _user_rules(), body="SELECT * FROM user_hits"),
    "mutation_expand": _with(D.SQL_RESPONSES, _variants(), body=f"""
SELECT c.case_id, c.case_id || coalesce('#' || v.pos, '') AS variant_id,
       c.kind || '_case' || coalesce(' [' || v.field || '=' || v.label || ']', '') AS name,
       CASE WHEN v.field IS NULL THEN {_SEND.replace("kind", "c.kind")}
            WHEN v.field = 'extra' THEN '{{"user":"u' || user_id || '","extra":"' || v.value || '"}}'
            ELSE '{{"' || v.field || '":"' || v.value || '"}}' END AS body,
       CASE c.kind WHEN 'signup' THEN 2 WHEN 'error' THEN 2 WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 ELSE 3 END AS n_expectations
FROM cases c LEFT JOIN variants v ON v.kind = c.kind"""),
    "request_plans": _with(D.SQL_RESPONSES, body=f"""
SELECT case_id, {_METHOD} AS http_method, {_URL} AS url,
       CASE WHEN kind = 'purchase' THEN '' ELSE concat_ws('; ', CASE WHEN kind = 'click' THEN 'Content-Type: text/plain' END,
         CASE WHEN event_id % 6 = 0 THEN 'X-Trace: t' || event_id END) END AS headers,
       CASE WHEN kind = 'signup' THEN '{{"user":"u' || user_id || '","age":' || (user_id % 90) || ',"terms":' || (event_id % 2 = 0) || '}}'
            WHEN kind = 'error' THEN {_SEND}
            WHEN kind = 'purchase' THEN CASE WHEN user_id % 3 <> 0 THEN '{{"username":"user' || user_id || '"}}' ELSE '{{}}' END
            WHEN kind = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'plain' ELSE '../../etc/passwd' END END AS body,
       CASE WHEN event_id % 97 = 0 THEN 120 ELSE (event_id % 12 + 1)::INT END AS request_cap, {_ISSUE} AS issue_id
FROM cases"""),
    "issue_classes": _with(D.SQL_RESPONSES, _variants(), body=f"""
SELECT project, issue_id, count(*) AS cases FROM (
  SELECT c.project, CASE WHEN v.field = 'q' AND (contains(v.value, '''') OR event_id % 5 = 0) THEN 'KLR-SQLI'
                         WHEN v.field = 'q' THEN 'KLR-GENERIC' ELSE {_ISSUE.replace("kind", "c.kind")} END AS issue_id
  FROM cases c LEFT JOIN variants v ON v.kind = c.kind) GROUP BY 1, 2"""),
    "response_verdicts": _with(*PROBES, body="SELECT project, case_id, suite, severity, verdict, error, issue_id FROM outcomes"),
    "response_checks": _with(*PROBES, body="SELECT * FROM checks"),
    "suite_summary": _with(*PROBES, body=f"SELECT project, coalesce(suite, 'Tests') AS suite, {_verdicts} FROM outcomes GROUP BY 1, 2"),
    "run_totals": _with(*PROBES, TOTALS, body="SELECT * EXCLUDE (ids), array_to_string(ids, ',') AS issue_ids FROM totals"),
    "executive_summary": _with(*SCAN_CTES, SCORES, *PROBES, TOTALS, body=f"""
SELECT project, security_score, CASE WHEN vulnerable > 0 OR security_score < 50 THEN 'HIGH'
         WHEN security_score < 80 OR errored > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
       tested, passed, vulnerable, errored, array_to_string(ids, ',') AS issue_ids,
       array_to_string(list_transform(ids, lambda issue: {_FIXES}), ' | ') AS remediations
FROM totals LEFT JOIN scores USING (project)"""),
    "technical_evidence": _with(*MATERIALIZED_PROBES, body=f"""
SELECT o.project, o.case_id, o.kind || '_case' AS name, o.severity,
       CASE WHEN session THEN 'session flow via ' ELSE {_METHOD} || ' ' END || {_URL} AS target,
       o.issue AS issue_id, k.description, k.detail, {_FIXES} AS remediation, {_REFERENCES} AS reference
FROM (SELECT *, issue_id AS issue FROM outcomes WHERE verdict = 'vulnerable') o
JOIN checks k ON k.case_id = o.case_id AND k.evaluated AND NOT k.passed"""),
    "response_outcomes": _with(D.SQL_RESPONSES, body="""
SELECT 'seq' || seq AS generator, count(*) AS total_inputs,
       count(*) FILTER (NOT failed AND status < 500) AS handled, count(*) FILTER (NOT failed AND status >= 500) AS fault,
       count(*) FILTER (failed) AS unreachable, count(*) FILTER (failed OR status >= 500) AS anomalies
FROM responses GROUP BY 1"""),
    "input_preview": r"""
SELECT conv_id, turn, CASE WHEN length(m) > 48 THEN left(m, 48) || '… (' || length(text) || ' chars)'
       WHEN m = '' THEN '(empty)' ELSE m END AS shown
FROM (SELECT *, regexp_replace(text, '\p{Cc}', '·', 'g') AS m FROM conversations)""",
    "page_slugs": """
SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]', '-', 'g') AS slug,
       md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_md5
FROM pages""",
    "endpoint_rollup": r"""
SELECT host, port, secure, count(*) AS pages, min(scheme || '://' || host || ':' || port || rest) AS first_url FROM (
  SELECT *, scheme = 'https' AS secure, split_part(auth, ':', 1) AS host,
         CASE WHEN contains(auth, ':') THEN split_part(auth, ':', 2)::INT WHEN scheme = 'https' THEN 443 ELSE 80 END AS port
  FROM (SELECT split_part(url, '://', 1) AS scheme, regexp_extract(url, '://([^/]*)', 1) AS auth,
               CASE WHEN regexp_matches(url, '://[^/]*/') THEN regexp_extract(url, '://[^/]*(/.*)$', 1) ELSE '/' END AS rest
        FROM pages))
GROUP BY 1, 2, 3""",
    "stream_scan": _with(*PLAIN_SCAN, body="SELECT project, path, line_no, rule, message FROM findings"),
    "stream_score": _with(*PLAIN_SCAN, body=f"""
SELECT p.project, count(f.rule) AS total_findings, coalesce(sum({_weight}), 0)::BIGINT AS deduction,
       greatest(0, 100 - coalesce(sum({_weight}), 0))::INT AS security_score
FROM (SELECT DISTINCT project FROM files) p
LEFT JOIN findings f USING (project) GROUP BY 1"""),
    "stream_rate_limit": """
SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS requests,
       count(*) FILTER (event_type = 'error' AND value > 20) AS blocked,
       min(ts) FILTER (event_type = 'error' AND value > 20) AS first_blocked_at,
       count(*) FILTER (event_type = 'error' AND value > 20) > 0 AS limited
FROM events GROUP BY 1, 2""",
}
