"""Probe cases: shorthand checks, input variants, request shape, issue class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.codelines import is_traversal
from ..functions.text import ascii_lower, let, literal_array, lower_contains_any
from ..functions.urls import absolute_url, resolve_target, url_parts
from ..schemas import EXPECTATIONS, MUTATIONS, PROBE_CASES, REQUEST_FIELDS


def seed_cases(spark: SparkSession, project: str) -> DataFrame:
    """The built-in suites as the ``probe_cases`` table of one project."""
    defaults = dict.fromkeys(
        ["suite", "method", "target", "payload", "repeat", "message"], None
    ) | {"send": {}, "headers": {}, "actions": [], "checks": [], "mutations": [], "expectations": []}
    order = [
        "project", "case_id", "suite", "name", "method", "target", "send", "headers", "payload", "repeat",
        "actions", "checks", "mutations", "expectations", "severity", "message",
    ]
    rows = []
    for case in V.SEED_CASES:
        row = {**defaults, **case, "project": project}
        row["case_id"] = f"{project}/{case['suite']}/{case['name']}"
        rows.append(tuple(row[c] for c in order))
    return spark.createDataFrame(rows, PROBE_CASES)


def all_cases(top_level: DataFrame, suites: DataFrame) -> DataFrame:
    """Cases outside any suite followed by suite cases, which carry their suite."""
    return top_level.withColumn("suite", F.lit(None).cast("string")).unionByName(
        suites, allowMissingColumns=True
    )


def block_repeat(repeat: Column, times: Column) -> Column:
    """Repeat count of a case inside a repeat block of ``times``."""
    times = F.greatest(times, F.lit(1))
    return F.greatest(F.coalesce(repeat, F.lit(1)) * times, times)


# --- generators ---------------------------------------------------------------


def _choose(c: Column, pairs, otherwise: Column) -> Column:
    """Value of the first pair whose key equals ``c``, evaluated once."""

    def chain(x: Column) -> Column:
        out = None
        for key, value in pairs:
            out = F.when(x == key, value) if out is None else out.when(x == key, value)
        return out.otherwise(otherwise)

    return let(c, chain)


def canonical_generator(name: Column) -> Column:
    return let(
        ascii_lower(name),
        lambda low: _choose(low, [(a, F.lit(t)) for a, t in V.GENERATOR_ALIASES.items()], low),
    )


def generator_category(name: Column) -> Column:
    pairs = [(generator, F.lit(category)) for generator, category, _, _ in V.GENERATORS]
    return _choose(canonical_generator(name), pairs, F.lit(V.CUSTOM_GENERATOR_CATEGORY))


def generator_values(name: Column) -> Column:
    """Values of a generator; an unknown name stands for its own lower-cased self."""
    pairs = [(generator, literal_array(values)) for generator, _, _, values in V.GENERATORS]
    return _choose(canonical_generator(name), pairs, F.array(ascii_lower(name)))


def generator_catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, n, c, d, v) for i, (n, c, d, v) in enumerate(V.GENERATORS)]
    return spark.createDataFrame(
        rows, "ord INT, name STRING, category STRING, description STRING, `values` ARRAY<STRING>"
    )


def default_mutations(fields: Column) -> Column:
    """``mutations`` that vary each field with the default generators."""
    return F.transform(
        fields,
        lambda f: F.struct(f.alias("field"), literal_array(V.DEFAULT_GENERATORS).alias("generators")),
    )


# --- expansion ----------------------------------------------------------------


def check_expectation(name: Column) -> Column:
    """Expectation a shorthand check stands for; unknown names stay named checks."""

    def expectation(kind, num, text):
        return F.struct(
            kind.alias("kind"),
            F.lit(None).cast("string").alias("op"),
            num.cast("bigint").alias("num"),
            text.cast("string").alias("text"),
            F.when(kind == "named", F.lit(True)).alias("expected"),
        )

    pairs = [
        (alias, expectation(F.lit(kind), F.lit(num), F.lit(text)))
        for alias, (kind, num, text) in V.CHECK_ALIASES.items()
    ]
    return let(
        ascii_lower(name),
        lambda low: _choose(low, pairs, expectation(F.lit("named"), F.lit(None), low)),
    )


def expand_cases(cases: DataFrame) -> DataFrame:
    """Cases with checks folded in and one row per input variant.

    ``variant_id`` is the case id for an unvaried case. The result always has ``fields``, the typed
    fields of the request in order: those of the case, or else its ``send``. Expansion happens inside
    the row; nothing is joined or shuffled.
    """
    none = F.array().cast(EXPECTATIONS)
    folded = cases.withColumn(
        "expectations",
        F.concat(
            F.coalesce("expectations", none),
            F.coalesce(F.transform("checks", check_expectation), none),
        ),
    ).drop("checks")
    def variants_of(m, mi, g, gi):
        return let(
            generator_values(g),
            lambda values: F.transform(
                values,
                lambda v, vi: F.struct(
                    m["field"].alias("field"),
                    v.alias("value"),
                    F.when(F.size(values) > 1, F.concat(g, F.lit("#"), (vi + 1).cast("string")))
                    .otherwise(g)
                    .alias("label"),
                    F.concat_ws(
                        ".", (mi + 1).cast("string"), (gi + 1).cast("string"), (vi + 1).cast("string")
                    ).alias("at"),
                ),
            ),
        )

    per_field = F.transform(
        F.coalesce("mutations", F.array().cast(MUTATIONS)),
        lambda m, mi: F.flatten(
            F.transform(m["generators"], lambda g, gi: variants_of(m, mi, g, gi))
        ),
    )
    untyped = typed_fields(F.col("send"))
    folded = folded.withColumn("fields", F.coalesce("fields", untyped) if "fields" in cases.columns else untyped)
    one = folded.withColumn("variant", F.explode_outer(F.flatten(per_field))).drop("mutations")
    v = F.col("variant")
    varied = v.isNotNull()
    # An existing field keeps its place; a new one goes last.
    send = F.coalesce("send", F.create_map().cast("map<string,string>"))
    replaced = F.when(
        F.map_contains_key(send, v["field"]),
        F.transform_values(send, lambda k, old: F.when(k == v["field"], v["value"]).otherwise(old)),
    ).otherwise(F.map_concat(send, F.create_map(F.coalesce(v["field"], F.lit("")), v["value"])))
    value = F.struct(v["field"].alias("name"), v["value"].alias("value"), F.lit(False).alias("bare"))
    retyped = F.when(
        F.exists("fields", lambda f: f["name"] == v["field"]),
        F.transform("fields", lambda f: F.when(f["name"] == v["field"], value).otherwise(f)),
    ).otherwise(F.concat("fields", F.array(value).cast(REQUEST_FIELDS)))
    return one.withColumns(
        {
            "variant_id": F.when(varied, F.concat("case_id", F.lit("#"), v["at"])).otherwise(F.col("case_id")),
            "name": F.when(
                varied,
                F.concat("name", F.lit(" ["), v["field"], F.lit("="), v["label"], F.lit("]")),
            ).otherwise(F.col("name")),
            "send": F.when(varied, replaced).otherwise(send),
            "fields": F.when(varied, retyped).otherwise(F.col("fields")),
        }
    ).drop("variant")


# --- request shape ------------------------------------------------------------


def _json_text(c: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def typed_fields(send: Column, bare_fields: Column | None = None) -> Column:
    """``send`` as typed fields, of which ``bare_fields`` are numbers or booleans; none for NULL."""

    def field(e):
        bare = F.lit(False) if bare_fields is None else F.array_contains(bare_fields, e["key"])
        return F.struct(e["key"].alias("name"), e["value"].alias("value"), bare.alias("bare"))

    return F.coalesce(F.transform(F.map_entries(send), field).cast(REQUEST_FIELDS), F.array().cast(REQUEST_FIELDS))


def fields_body(fields: Column) -> Column:
    """Compact JSON object of typed fields, in their order; a name that occurs twice is written twice."""

    def pair(f):
        quoted = F.concat(F.lit('"'), _json_text(f["value"]), F.lit('"'))
        return F.concat(F.lit('"'), _json_text(f["name"]), F.lit('":'), F.when(f["bare"], f["value"]).otherwise(quoted))

    return F.concat(F.lit("{"), F.array_join(F.transform(fields, pair), ","), F.lit("}"))


def json_body(send: Column, bare_fields: Column | None = None) -> Column:
    """Compact JSON object of the fields; ``bare_fields`` are numbers or booleans."""
    return fields_body(typed_fields(send, bare_fields))


def sends_body() -> Column:
    return (F.size("fields") > 0) | F.col("payload").isNotNull()


def request_headers(session: Column) -> Column:
    """Headers in sending order as (name, value): the one a text payload implies, then the case's own.

    A login sends none.
    """
    pairs = "ARRAY<STRUCT<name: STRING, value: STRING>>"
    none = F.array().cast(pairs)
    plain = F.struct(F.lit("Content-Type").alias("name"), F.lit("text/plain").alias("value"))
    implied = F.when((F.size("fields") == 0) & F.col("payload").isNotNull(), F.array(plain).cast(pairs)).otherwise(none)
    own = F.coalesce(F.map_entries("headers").cast(pairs), none)
    return F.when(session, none).otherwise(F.concat(implied, own))


def is_session_flow() -> Column:
    """A case that logs in, or that expects a session to be invalidated."""
    logs_in = F.coalesce(F.array_contains("actions", "login"), F.lit(False))
    expects = F.exists(
        "expectations", lambda e: (e["kind"] == "named") & (e["text"] == "session_invalidated")
    )
    return logs_in | F.coalesce(expects, F.lit(False))


def issue_class() -> Column:
    """Issue id of an expanded case, by the first class that fits."""
    limited = F.exists("expectations", lambda e: e["kind"] == "blocked_after")
    in_send = F.exists(
        "fields", lambda f: lower_contains_any(f["value"], V.SQLI_VALUE_WORDS)
    )
    in_message = F.coalesce(
        lower_contains_any(F.col("message"), V.SQLI_MESSAGE_WORDS), F.lit(False)
    )
    return (
        F.when(F.coalesce(is_traversal(F.col("payload")), F.lit(False)), F.lit(V.ISSUE_TRAVERSAL))
        .when(limited, F.lit(V.ISSUE_RATE_LIMIT))
        .when(is_session_flow(), F.lit(V.ISSUE_SESSION))
        .when(in_send | in_message, F.lit(V.ISSUE_SQLI))
        .otherwise(F.lit(V.ISSUE_GENERIC))
    )


def request_plan(
    expanded: DataFrame, base_url: str = V.DEFAULT_BASE_URL, max_requests: int | None = None
) -> DataFrame:
    """Expanded cases with method, URL, headers, body, request cap and issue class.

    A login sends its fields and then the user it logs in as, if ``login_user`` names one.

    A case asks for as many requests as it repeats, of which ``max_requests`` are kept if given.
    """
    wanted = F.greatest(F.coalesce("repeat", F.lit(1)), F.lit(1))
    implied = F.when(sends_body(), F.lit("POST")).otherwise(F.lit("GET"))
    session = is_session_flow()
    target = F.when(session, F.coalesce("target", F.lit(V.DEFAULT_LOGIN_TARGET))).otherwise(F.col("target"))
    url = absolute_url(url_parts(resolve_target(F.lit(base_url), target)))
    body = F.when(F.size("fields") > 0, fields_body(F.col("fields"))).otherwise(F.col("payload"))
    login = F.col("fields")
    if "login_user" in expanded.columns:
        user = F.struct(F.lit("username").alias("name"), F.col("login_user").alias("value"), F.lit(False).alias("bare"))
        acts = F.coalesce(F.array_contains("actions", "login"), F.lit(False)) & F.col("login_user").isNotNull()
        login = F.when(acts, F.concat(login, F.array(user).cast(REQUEST_FIELDS))).otherwise(login)
    return expanded.withColumns(
        {
            "session": session,
            "url": url,
            "http_method": F.when(session, F.lit("POST")).otherwise(F.coalesce("method", implied)),
            "request_headers": request_headers(session),
            "body": F.when(session, fields_body(login)).otherwise(body),
            "request_cap": wanted if max_requests is None else F.least(wanted, F.lit(max_requests)),
            "issue_id": issue_class(),
        }
    )
