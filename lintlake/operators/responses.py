"""Judge recorded responses against the expectations of their probe case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.codelines import exposes_file, leaks_sql_error
from .probes import sends_body
from .scoring import severity_of_word

CHECK = "STRUCT<description: STRING, passed: BOOLEAN, evaluated: BOOLEAN, detail: STRING>"


def compare(op: Column, left: Column, right: Column) -> Column:
    """Integer comparison by operator symbol."""
    return (
        F.when(op == "==", left == right)
        .when(op == "!=", left != right)
        .when(op == "<", left < right)
        .when(op == ">", left > right)
        .when(op == "<=", left <= right)
        .when(op == ">=", left >= right)
    )


def header(headers: Column, name: str) -> Column:
    """First header of that name, in any case."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(found, F.lit(0))["value"]


def cookie_of(headers: Column) -> Column:
    return F.substring_index(header(headers, "set-cookie"), ";", 1)


def _holds(e: Column, status: Column, body: Column) -> Column:
    """Whether one expectation holds on one response; NULL for unknown or limit checks."""
    name, expected = e["text"], e["expected"]
    return (
        F.when(e["kind"] == "status", compare(e["op"], status.cast("bigint"), e["num"]))
        .when(e["kind"] == "contains", F.contains(body, e["text"]))
        .when(e["kind"] == "not_contains", ~F.contains(body, e["text"]))
        .when(
            e["kind"] == "named",
            F.when(name == "file_not_exposed", ~exposes_file(body) == expected)
            .when(name == "session_invalidated", status.isin(V.INVALIDATED_STATUSES) == expected)
            .when(name == "requires_auth", status.isin(V.DENIED_STATUSES) == expected)
            .when(name == "no_sql_error", ~leaks_sql_error(body) == expected),
        )
    )


def _limit_kept(e: Column, blocked: Column, strict: bool) -> Column:
    return blocked.isNotNull() & (blocked <= e["num"]) if strict else blocked.isNotNull()


def _fails(e: Column, held: Column, blocked: Column, strict: bool) -> Column:
    """Whether a check that could be evaluated did not pass."""
    return F.when(e["kind"] == "blocked_after", ~_limit_kept(e, blocked, strict)).otherwise(F.coalesce(~held, F.lit(False)))


def _check(e: Column, held: Column, status: Column, blocked: Column, seen: Column, strict: bool) -> Column:
    """One check result from an expectation and whether it held."""
    text, num = e["text"], e["num"].cast("string")
    expected = F.when(e["expected"], F.lit("true")).otherwise(F.lit("false"))
    at = F.coalesce(status, F.lit(0)).cast("string")
    kind = e["kind"]
    # For the three boolean named checks, "the good state" is held == expected.
    good = held == e["expected"]
    limit_ok = _limit_kept(e, blocked, strict)
    description = (
        F.when(kind == "status", F.concat(F.lit("status "), e["op"], F.lit(" "), num))
        .when(kind == "contains", F.concat(F.lit('response contains "'), text, F.lit('"')))
        .when(kind == "not_contains", F.concat(F.lit('response does_not_contain "'), text, F.lit('"')))
        .when(kind == "blocked_after", F.concat(F.lit("blocked_after "), num))
        .when(text == "requires_auth", F.lit("requires authentication"))
        .when(text == "no_sql_error", F.lit("no SQL error leaked"))
        .otherwise(F.concat_ws(" ", text, expected))
    )
    detail = (
        F.when(kind == "status", F.concat(F.lit("observed status "), at))
        .when(kind == "contains", F.when(held, F.lit("found in response")).otherwise(F.lit("not found in response")))
        .when(
            kind == "not_contains",
            F.when(held, F.lit("absent from response")).otherwise(
                F.concat(F.lit('"'), text, F.lit('" leaked in response'))
            ),
        )
        .when(
            kind == "blocked_after",
            F.when(
                blocked.isNotNull(),
                F.concat(F.lit("blocked at request #"), blocked.cast("string"), F.lit(" (limit "), num, F.lit(")")),
            ).otherwise(F.concat(F.lit("no rate limiting after "), seen.cast("string"), F.lit(" requests"))),
        )
        .when(
            text == "file_not_exposed",
            F.when(good, F.lit("no sensitive file contents in response")).otherwise(
                F.lit("sensitive file contents found in response")
            ),
        )
        .when(text == "session_invalidated", F.concat(F.lit("reuse returned status "), at))
        .when(text == "requires_auth", F.concat(F.lit("unauthenticated request returned status "), at))
        .when(
            text == "no_sql_error",
            F.when(good, F.lit("no database error in response")).otherwise(
                F.lit("database error signature found in response")
            ),
        )
        .otherwise(F.lit("not evaluated by this engine"))
    )
    passed = F.when(kind == "blocked_after", limit_ok).otherwise(F.coalesce(held, F.lit(True)))
    evaluated = (kind == "blocked_after") | held.isNotNull()
    return F.struct(
        description.alias("description"),
        passed.alias("passed"),
        evaluated.alias("evaluated"),
        detail.alias("detail"),
    )


def judge_cases(
    plans: DataFrame, responses: DataFrame, strict_limit: bool = False
) -> DataFrame:
    """One outcome per planned case, with its check results.

    ``plans`` comes from ``request_plan``; ``responses`` holds (case_id = variant id,
    phase, seq, status, headers, body, error). Requests beyond a case's request cap do not count.
    ``strict_limit`` makes a rate limit fail when the block came later than promised.

    Two aggregates, so a case may have any number of responses. The first tells where a case stops; it needs no plan and
    is reduced before its shuffle. The second counts what was seen until then and keeps the response that
    decides. Expectations are tested on that one alone.
    """
    seq, status, session = F.col("seq"), F.col("status"), F.col("session")
    login, request = F.col("phase") == "login", F.col("phase") == "request"
    stops = responses.groupBy("case_id").agg(
        F.min(F.when(request & F.col("error").isNotNull(), seq)).alias("failed_at"),
        F.min(F.when(request & status.isin(V.BLOCKED_STATUSES), seq)).alias("blocked_at"),
        F.max(login & F.col("error").isNotNull()).alias("login_failed"),
    )
    within = lambda name: F.when(F.col(name) <= F.col("request_cap"), F.col(name)).alias(name)
    wanted = (
        plans.select(
            F.col("variant_id").alias("case_id"),
            "session",
            "request_cap",
            F.exists("expectations", lambda e: e["kind"] == "blocked_after").alias("stops"),
        )
        .join(stops, "case_id")
        .select("case_id", "session", "request_cap", "stops", "login_failed", within("failed_at"), within("blocked_at"))
        .withColumn(
            "blocked_at",
            F.when(~session & (F.col("failed_at").isNull() | (F.col("blocked_at") < F.col("failed_at"))), F.col("blocked_at")),
        )
    )
    counted = F.when(session, F.col("phase").isin("login", "reuse")).otherwise(request & (seq <= F.col("request_cap")))
    seen = (F.col("failed_at").isNull() | (seq < F.col("failed_at"))) & (
        ~F.col("stops") | F.col("blocked_at").isNull() | (seq <= F.col("blocked_at"))
    )
    # The deciding row: the last response seen, or else the failure that ended it; of a session, the login
    # that failed or the reuse.
    decides = F.when(
        session, F.when(F.when(F.col("login_failed"), login).otherwise(F.col("phase") == "reuse"), F.struct(F.lit(1), seq))
    ).otherwise(F.when(seen, F.struct(F.lit(1), seq)).when(seq == F.col("failed_at"), F.struct(F.lit(0), seq)))
    cookie = F.when(login, cookie_of(F.col("headers")))
    final = (
        responses.select("case_id", "phase", "seq", "status", "error", "body", cookie.alias("cookie"))
        .join(wanted, "case_id")
        .where(counted)
        .groupBy("case_id")
        .agg(
            F.count_if(seen).alias("n_seen"),
            F.max_by(F.struct("status", "error", "body", "blocked_at"), decides).alias("row"),
            F.max(F.when(login, F.col("error"))).alias("login_error"),
            F.max("cookie").alias("cookie"),
        )
        .where("row IS NOT NULL")
        .select(F.col("case_id").alias("variant_id"), F.struct("row.*", "n_seen", "login_error", "cookie").alias("last"))
    )
    last = F.col("last")
    ok = last.isNotNull() & last["error"].isNull()
    held = F.when(ok, F.transform("expectations", lambda e: _holds(e, last["status"], last["body"])))
    leak = F.when(ok & sends_body() & ~session, leaks_sql_error(last["body"]))
    joined = plans.join(final, "variant_id", "left").withColumns({"held": held, "leak": leak})
    return _outcomes(joined, strict_limit)


def _outcomes(joined: DataFrame, strict_limit: bool) -> DataFrame:
    last = F.col("last")
    session = F.col("session")
    error = (
        F.when(F.col("target").isNull() & ~session, F.lit("attack has no `target`/`endpoint` to request"))
        .when(F.col("url").isNull(), F.when(session, F.lit("invalid login target")).otherwise(F.lit("invalid target")))
        .when(last.isNull(), F.lit("no recorded response"))
        .when(session & last["login_error"].isNotNull(), F.concat(F.lit("login request failed: "), last["login_error"]))
        .when(session & last["error"].isNotNull(), F.concat(F.lit("reuse request failed: "), last["error"]))
        .when(last["error"].isNotNull(), F.concat(F.lit("request failed: "), last["error"]))
    )
    blocked = F.when(~session, last["blocked_at"])
    seen = F.when(session, F.lit(0)).otherwise(last["n_seen"])
    checks = F.zip_with(
        "expectations",
        "held",
        lambda e, held: _check(e, held, last["status"], blocked, seen, strict_limit),
    )
    captured = F.struct(
        F.lit("captured session cookie").alias("description"),
        F.lit(True).alias("passed"),
        F.lit(True).alias("evaluated"),
        F.coalesce(
            F.concat(F.lit("stole cookie `"), last["cookie"], F.lit("`")),
            F.lit("no Set-Cookie returned by login"),
        ).alias("detail"),
    )
    leaked = F.struct(
        F.lit("no SQL error leaked in response").alias("description"),
        F.lit(False).alias("passed"),
        F.lit(True).alias("evaluated"),
        F.lit("response body contains a database error signature").alias("detail"),
    )
    none = F.array().cast(f"ARRAY<{CHECK}>")
    checks = F.concat(
        F.when(session, F.array(captured)).otherwise(none),
        checks,
        F.when(F.col("leak"), F.array(leaked)).otherwise(none),
    )
    severity = F.coalesce(severity_of_word(F.col("severity")), F.lit("HIGH"))
    line = F.when(session, F.concat(F.lit("session flow via "), F.col("url"))).otherwise(
        F.concat_ws(" ", "http_method", "url")
    )
    judged = joined.withColumn("error", error).withColumn(
        "checks", F.when(F.col("error").isNull(), checks).otherwise(none)
    )
    # From the expectations themselves, so that a verdict alone needs no texts of checks.
    fails = F.zip_with("expectations", "held", lambda e, held: _fails(e, held, blocked, strict_limit))
    failed = F.coalesce(F.col("leak"), F.lit(False)) | F.exists(fails, lambda f: f)
    return judged.select(
        "project",
        F.col("variant_id").alias("case_id"),
        "suite",
        "name",
        severity.alias("severity"),
        F.when(F.col("error").isNull(), line).otherwise(F.coalesce("target", F.lit(""))).alias("target"),
        F.when(F.col("error").isNotNull(), F.lit("errored"))
        .when(failed, F.lit("vulnerable"))
        .otherwise(F.lit("secure"))
        .alias("verdict"),
        "message",
        "error",
        "issue_id",
        "checks",
    )


def check_rows(outcomes: DataFrame) -> DataFrame:
    """One row per check result."""
    return outcomes.select("project", "case_id", F.inline("checks"))


# --- input mutation outcomes --------------------------------------------------


def input_outcome(status: Column, error: Column) -> Column:
    """How a target took one input: handled, fault (5xx) or unreachable."""
    return (
        F.when(error.isNotNull(), F.lit("unreachable"))
        .when(status >= V.FAULT_STATUS, F.lit("fault"))
        .otherwise(F.lit("handled"))
    )


def input_outcome_counts(responses: DataFrame, by: list[str]) -> DataFrame:
    outcome = input_outcome(F.col("status"), F.col("error"))
    return (
        responses.select(*by, outcome.alias("outcome"))
        .groupBy(*by)
        .agg(
            F.count("*").alias("total_inputs"),
            *[F.count_if(F.col("outcome") == o).alias(o) for o in ("handled", "fault", "unreachable")],
            F.count_if(F.col("outcome") != "handled").alias("anomalies"),
        )
    )
