import random
import re

import pytest
from pyspark.sql import functions as F

from lintlake.functions import display as DS
from lintlake.functions import urls as U
from lintlake.operators import probes as PR
from lintlake.operators import reports as RP
from lintlake.operators import responses as RE
from lintlake.operators import user_rules as UR
from lintlake.schemas import LINE_RULES, PROBE_CASES, RESPONSES

DEFAULTS = dict(project="p", suite=None, method=None, target="/t", send={}, headers={}, payload=None, repeat=None,
                actions=[], checks=[], mutations=[], expectations=[], severity="high", message=None)
ORDER = ["project", "case_id", "suite", "name", "method", "target", "send", "headers", "payload", "repeat", "actions",
         "checks", "mutations", "expectations", "severity", "message"]


def cases(spark, **by_id):
    rows = [tuple({**DEFAULTS, "name": k, **v, "case_id": k}[c] for c in ORDER) for k, v in by_id.items()]
    return spark.createDataFrame(rows, PROBE_CASES)


def responses(spark, *rows):
    full = [(c, phase, seq, status, headers or {}, body, error) for c, phase, seq, status, headers, body, error in rows]
    return spark.createDataFrame(full, RESPONSES)


def request(case, seq, status, body="", error=None):
    return (case, "request", seq, status, None, body, error)


def judge(spark, case_table, *rows, max_requests=None, **kw):
    plans = PR.request_plan(PR.expand_cases(case_table), max_requests=max_requests)
    out = RE.judge_cases(plans, responses(spark, *rows), **kw)
    return {r.case_id: r for r in out.collect()}


def named(name, expected=True):
    return ("named", None, None, name, expected)


def test_expansion(spark):
    table = cases(
        spark,
        amount=dict(send={"amount": "1", "to": "x"}, mutations=[("amount", ["negative_numbers", "Huge", "decimals"])]),
        role=dict(send={"a": "1"}, mutations=[("role", ["Admin"]), ("a", [])]),
        none=dict(mutations=[("x", [])]),
    )
    rows = PR.expand_cases(table).collect()
    amount = [r for r in rows if r.case_id == "amount"]
    assert len(amount) == 6 and len({r.variant_id for r in amount}) == 6
    assert [r.name for r in amount][:3] == ["amount [amount=negative_numbers#1]", "amount [amount=negative_numbers#2]",
                                            "amount [amount=Huge#1]"]
    assert amount[0].send == {"amount": "-1", "to": "x"}
    role = [r for r in rows if r.case_id == "role"]
    assert [(r.name, r.send) for r in role] == [("role [role=Admin]", {"a": "1", "role": "admin"})]
    assert [(r.variant_id, r.name) for r in rows if r.case_id == "none"] == [("none", "none")]


def test_checks_become_expectations(spark):
    row = PR.expand_cases(cases(spark, c=dict(checks=["Auth", "ratelimit", "sqli", "Odd"], expectations=[named("x")]))).first()
    assert [(e.kind, e.num, e.text, e.expected) for e in row.expectations] == [
        ("named", None, "x", True), ("named", None, "requires_auth", True), ("blocked_after", 50, None, None),
        ("named", None, "no_sql_error", True), ("named", None, "odd", True)]


def test_generators(values, spark):
    names = ["negatives", "ZERO", "floats", "long", "anything", "Sqli"]
    assert values(PR.generator_category, names) == ["boundary", "boundary", "type-confusion", "resource", "custom", "injection"]
    assert [len(v) for v in values(PR.generator_values, names)] == [2, 1, 2, 1, 1, 1]
    assert values(PR.generator_values, ["AnyThing"]) == [["anything"]]
    assert sum(len(r["values"]) for r in PR.generator_catalog(spark).collect()) == 14


def test_default_mutations(spark):
    row = spark.range(1).select(PR.default_mutations(F.array(F.lit("q"), F.lit("r"))).alias("m")).first()
    assert [m.field for m in row.m] == ["q", "r"]
    assert row.m[0].generators == ["sql_injection", "xss", "huge_values", "negative_numbers", "empty"]


def test_seed_suites(spark):
    seeds = PR.seed_cases(spark, "p")
    expanded = PR.expand_cases(seeds)
    assert seeds.count() == 13 and seeds.select("suite").distinct().count() == 6
    # 4 generators with 6 values, 5 default generators with 7 values, one xss value, and ten plain cases
    assert expanded.count() == 6 + 7 + 1 + 10
    issues = {r.case_id.split("/", 1)[1]: r.issue_id for r in PR.request_plan(expanded).collect()}
    assert issues["Filesystem/traversal_windows"] == "KLR-PATH-TRAVERSAL"
    assert issues["Authentication/brute_force"] == "KLR-RATE-LIMIT"
    assert issues["Authentication/sql_login_bypass"] == "KLR-SQLI"
    assert issues["Crypto/no_secret_leak"] == "KLR-GENERIC"


def test_all_cases_and_block_repeat(spark):
    top, suites = cases(spark, a={}), cases(spark, b=dict(suite="S"))
    assert {r.case_id: r.suite for r in PR.all_cases(top, suites).collect()} == {"a": None, "b": "S"}
    got = spark.range(1).select(PR.block_repeat(F.lit(None).cast("int"), F.lit(5)), PR.block_repeat(F.lit(3), F.lit(4)),
                                PR.block_repeat(F.lit(2), F.lit(0))).first()
    assert tuple(got) == (5, 12, 2)


def test_json_body(spark):
    df = spark.createDataFrame([({"q": 'a"b\\\n\tc', "n": "5", "b": "true"},)], "send MAP<STRING, STRING>")
    got = df.select(PR.json_body(F.col("send"), F.array(F.lit("n"), F.lit("b")))).first()[0]
    assert sorted(got[1:-1].split(",")) == sorted(['"q":"a\\"b\\\\\\n\\tc"', '"n":5', '"b":true'])


def test_typed_fields_login_user_and_implied_headers(spark):
    from lintlake.schemas import REQUEST_FIELDS

    fields = [("n", "5", True), ("q", 'a"b', False), ("ok", "true", True), ("n", "6", True)]
    table = cases(
        spark, typed=dict(send={"n": "x"}), text=dict(payload="raw", headers={"A": "1"}), both=dict(payload="raw", send={"a": "b"}),
        login=dict(actions=["login"], payload="raw"), expects=dict(expectations=[("named", None, None, "session_invalidated", True)]),
        varied=dict(mutations=[("q", ["empty"]), ("new", ["empty"])]),
    )
    typed = F.when(F.col("case_id").isin("typed", "login", "varied"), F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"), F.lit(b).alias("bare")) for n, v, b in fields
    ])).cast(REQUEST_FIELDS)
    extra = table.withColumns({"fields": typed, "login_user": F.lit("test")})
    got = {r.variant_id: (r.body, [tuple(h) for h in r.request_headers]) for r in PR.request_plan(PR.expand_cases(extra)).collect()}
    body = '"n":5,"q":"a\\"b","ok":true,"n":6'
    assert got["typed"] == ("{" + body + "}", [])
    assert got["text"] == ("raw", [("Content-Type", "text/plain"), ("A", "1")])
    assert got["both"] == ('{"a":"b"}', [])
    assert got["login"] == ("{" + body + ',"username":"test"}', [])
    assert got["expects"] == ("{}", [])
    varied = sorted(v[0] for k, v in got.items() if k.startswith("varied"))
    assert varied == ["{" + body.replace('a\\"b', "") + "}", "{" + body + ',"new":""}']
    plain = PR.request_plan(PR.expand_cases(table)).where("variant_id = 'login'").first()
    assert plain.body == "{}"


def test_request_shape(spark):
    table = cases(spark, get={}, post=dict(send={"a": "b"}), raw=dict(payload="x", method="PUT", target="http://h:81/z"),
                  many=dict(repeat=500), zero=dict(repeat=0), login=dict(target=None, actions=["login"]), bad=dict(target="http://:80/x"))
    got = {r.variant_id: (r.http_method, r.url, r.body, r.request_cap) for r in PR.request_plan(PR.expand_cases(table)).collect()}
    base = "http://127.0.0.1:8080"
    assert got["get"] == ("GET", base + "/t", None, 1)
    assert got["post"] == ("POST", base + "/t", '{"a":"b"}', 1)
    assert got["raw"] == ("PUT", "http://h:81/z", "x", 1)
    assert got["many"][3] == 500 and got["zero"][3] == 1
    capped = PR.request_plan(PR.expand_cases(table), max_requests=100).where("variant_id = 'many'").first()
    assert capped.request_cap == 100
    assert got["login"] == ("POST", base + "/login", "{}", 1)
    assert got["bad"][1] is None


def test_urls(values):
    urls = ["http://a.b/c?d", "https://x", "https://h:8443/p/q", "ftp://x", "http:///p", "http://h:99999/", "http://h:x/", "http://h:/"]
    got = values(U.url_parts, urls)
    assert [tuple(g) if g else None for g in got] == [
        ("a.b", 80, "/c?d", False), ("x", 443, "/", True), ("h", 8443, "/p/q", True), None, None, None, None, None]
    join = values(lambda t: U.absolute_url(U.url_parts(U.resolve_target(F.lit("http://h:1/"), t))), ["a", "/a", "https://z/q"])
    assert join == ["http://h:1/a", "http://h:1/a", "https://z:443/q"]


# --- judging ---------------------------------------------------------------------

LOGIN = dict(send={"user": "' OR 1=1"}, expectations=[("status", "!=", 200, None, None), ("not_contains", None, None, "token", None)])


def test_login_bypass(spark):
    table = cases(spark, open=LOGIN, shut=LOGIN)
    got = judge(spark, table, request("open", 1, 200, "token=1"), request("shut", 1, 401, "no"))
    assert (got["open"].verdict, got["open"].issue_id) == ("vulnerable", "KLR-SQLI")
    assert got["shut"].verdict == "secure"
    assert [(c.description, c.passed) for c in got["open"].checks] == [
        ("status != 200", False), ('response does_not_contain "token"', False)]


def limit(n, repeat):
    return dict(repeat=repeat, expectations=[("blocked_after", None, n, None, None)])


def test_rate_limits(spark):
    table = cases(spark, limited=limit(10, 100), open=limit(5, 20), late=limit(1, 100), capped=limit(5, 500))
    rows = [request("limited", i, s) for i, s in ((1, 200), (2, 200), (3, 429), (4, 500))]
    rows += [request("open", i, 200) for i in range(1, 31)]
    rows += [request("late", i, 503 if i == 9 else 200) for i in range(1, 12)]
    rows += [request("capped", i, 429 if i > 100 else 200) for i in range(1, 151)]
    got = judge(spark, table, *rows)
    assert got["limited"].verdict == "secure" and got["limited"].issue_id == "KLR-RATE-LIMIT"
    assert got["limited"].checks[0].detail == "blocked at request #3 (limit 10)"
    assert got["open"].verdict == "vulnerable"
    assert got["open"].checks[0].detail == "no rate limiting after 20 requests"
    assert got["late"].verdict == "secure"
    assert got["capped"].checks[0].detail == "blocked at request #101 (limit 5)"
    capped = judge(spark, table, *rows, max_requests=100)["capped"]
    assert capped.checks[0].detail == "no rate limiting after 100 requests"
    assert judge(spark, table, *rows, strict_limit=True)["late"].verdict == "vulnerable"


def test_named_checks(spark):
    table = cases(
        spark,
        leak=dict(payload="../../etc/passwd", expectations=[named("file_not_exposed")]),
        auth=dict(checks=["authentication"]),
        served=dict(checks=["authentication"]),
        sql=dict(checks=["injection"], send={"q": "1"}),
        odd=dict(expectations=[named("mystery")]),
        expected_leak=dict(expectations=[named("file_not_exposed", False)]),
    )
    passwd = "root:x:0:0:root"
    got = judge(spark, table, request("leak", 1, 200, passwd), request("auth", 1, 302), request("served", 1, 200),
                request("sql", 1, 200, "You have an error in your SQL Syntax"), request("odd", 1, 200),
                request("expected_leak", 1, 200, passwd))
    assert {k: r.verdict for k, r in got.items()} == {"leak": "vulnerable", "auth": "secure", "served": "vulnerable",
                                                      "sql": "vulnerable", "odd": "secure", "expected_leak": "secure"}
    assert got["leak"].issue_id == "KLR-PATH-TRAVERSAL"
    assert len(got["sql"].checks) == 2 and not got["odd"].checks[0].evaluated
    assert got["expected_leak"].checks[0].detail == "sensitive file contents found in response"


def test_errors(spark):
    table = cases(spark, first=dict(repeat=3), later=dict(repeat=3, expectations=[("status", "==", 200, None, None)]),
                  silent={}, untargeted=dict(target=None))
    got = judge(spark, table, request("first", 1, None, None, "refused"), request("later", 1, 500), request("later", 2, 200),
                request("later", 3, None, None, "reset"), request("untargeted", 1, 200))
    assert got["first"].error == "request failed: refused" and got["first"].verdict == "errored"
    assert got["later"].verdict == "secure" and got["later"].checks[0].detail == "observed status 200"
    assert got["silent"].verdict == "errored" and got["untargeted"].verdict == "errored"


def test_session_flow(spark):
    flow = dict(target="/login", actions=["login", "steal"], expectations=[named("session_invalidated")])
    table = cases(spark, weak=flow, strong=flow, broken=flow)
    got = judge(
        spark, table,
        ("weak", "login", 1, 200, {"SET-Cookie": "sid=1; Path=/"}, "", None), ("weak", "reuse", 2, 200, None, "", None),
        ("strong", "login", 1, 200, None, "", None), ("strong", "reuse", 2, 401, None, "", None),
        ("broken", "login", 1, None, None, None, "refused"),
    )
    assert got["weak"].verdict == "vulnerable" and got["weak"].issue_id == "KLR-SESSION"
    assert got["weak"].checks[0].detail == "stole cookie `sid=1`"
    assert got["strong"].verdict == "secure"
    assert got["strong"].checks[0].detail == "no Set-Cookie returned by login"
    assert got["broken"].error == "login request failed: refused"


def test_reports(spark):
    table = cases(spark, open={**LOGIN, "suite": "Auth"}, shut=LOGIN, lost={})
    plans = PR.request_plan(PR.expand_cases(table))
    out = RE.judge_cases(plans, responses(spark, request("open", 1, 200, "token"), request("shut", 1, 401)))
    suites = {r.suite: (r.tested, r.passed, r.vulnerable, r.errored) for r in RP.suite_totals(out).collect()}
    assert suites == {"Auth": (1, 0, 1, 0), "Tests": (2, 1, 0, 1)}
    summary = RP.executive_summary(out).first()
    assert (summary.risk, summary.issue_ids) == ("HIGH", ["KLR-SQLI"]) and "parameterized" in summary.remediations[0]
    evidence = RP.technical_evidence(out).collect()
    assert len(evidence) == 2 and evidence[0].reference == "OWASP: SQL Injection"


def test_explain_ignores_case(spark):
    df = spark.createDataFrame([(" klr-sqli ",), ("other",)], "issue_id STRING")
    assert {r.issue_id: r.title for r in RP.explain(df).collect()} == {" klr-sqli ": "SQL Injection", "other": None}


@pytest.mark.parametrize("vulnerable, errored, score, want", [
    (1, 0, 100, "HIGH"), (0, 0, 49, "HIGH"), (0, 0, 50, "MEDIUM"), (0, 1, 100, "MEDIUM"), (0, 0, 80, "LOW"), (0, 0, None, "LOW")])
def test_risk(spark, vulnerable, errored, score, want):
    band = DS.risk_band(F.lit(vulnerable), F.lit(errored), F.lit(score).cast("int"))
    assert spark.range(1).select(band).first()[0] == want


def test_safe_value(values):
    assert values(DS.safe_value, ["", "a\x00b", "x" * 49, "y" * 48]) == ["(empty)", "a·b", "x" * 48 + "… (49 chars)", "y" * 48]


def test_input_outcomes(spark):
    df = responses(spark, request("a", 1, 200), request("a", 2, 500), request("a", 3, None, None, "down"))
    r = RE.input_outcome_counts(df, ["case_id"]).first()
    assert (r.total_inputs, r.handled, r.fault, r.unreachable, r.anomalies) == (3, 1, 1, 1, 2)


# --- user rules --------------------------------------------------------------------

DAO = ['def get(cur, user_id):', '    # query("..." + user_id)', '    q = "SELECT"', '    cur.query("SELECT x WHERE id=" + user_id)',
       '    cur.query("SELECT x WHERE id=%s", user_id)', "    cur.query(CONST)", '    return "query" ']


def user_hits(spark, rules, lines=DAO, **kw):
    table = spark.createDataFrame([("p", "dao.py", i, t) for i, t in enumerate(lines, 1)], "project STRING, path STRING, line_no INT, text STRING")
    out = UR.user_rule_findings(table, spark.createDataFrame(rules, LINE_RULES), **kw)
    return sorted((r.rule, r.line_no, r.severity, r.message) for r in out.collect())


def test_user_rules(spark):
    rules = [("unsafe", ["QUERY("], "query", ["sanitization"], "critical", "msg"), ("empty", [], None, ["x"], "low", None)]
    assert user_hits(spark, rules) == [("unsafe", 4, "CRITICAL", "msg")]
    assert user_hits(spark, [("only sink", [], "query(", [], "odd", None)]) == [
        ("only sink", 4, "HIGH", "only sink")]


def holds(low, rule):
    """A rule's clauses on a lower-cased line, its words for input and placeholders aside."""
    _, needles, sink, without, _, _ = rule
    return (needles or sink is not None) and all(n.lower() in low for n in needles) and (sink is None or sink.lower() in low)


def test_odd_rules(spark):
    rules = [("a", ["select", "ID="], None, [], "low", None), ("c", ["x"], None, [], "info", None), ("c", ["x"], None, [], "info", None),
             ("d", ["%s"], None, [], "info", None), ("e", [""], None, [], "info", None), ("f", ["é", "ret"], None, [], "info", None),
             ("g", ["🙂]"], None, [], "info", None), ("h", ["\\", "-]"], None, [], "info", None), ("i", ["", "return"], None, [], "info", None),
             ("none", None, None, None, None, None)]
    lines = DAO + ["é ret", "", "a🙂]b", "x \\ [a-] ^", "X" * 5000 + "é" * 3 + "ret"]
    want = sorted((r[0], i, "INFO", r[0]) for r in rules[:-1] for i, t in enumerate(lines, 1) if not t.strip().startswith("#") and holds(t.lower(), r))
    assert user_hits(spark, rules, lines) == want and len(want) > 20
    assert user_hits(spark, [], lines) == [] or user_hits(spark, rules[-1:], lines) == []
    assert user_hits(spark, rules[:1], [""]) == []


def test_any_number_of_rules_is_one_plan(spark):
    """5 and 5,000 rules give the same operators, no nested loop, and what trying each rule on each line gives."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh_(.", k=rng.randrange(2, 9))) for _ in range(4000)]
    rules = [(f"r{i}", rng.sample(words, rng.choice([1, 1, 2])), None, [], "low", None) for i in range(5000)]
    lines = [" ".join(rng.choices(words, k=8)) for _ in range(60)] + ["plain text of no rule"] * 20
    table = spark.createDataFrame([("p", "f", i, t) for i, t in enumerate(lines)], "project STRING, path STRING, line_no INT, text STRING")
    plans = []
    for some in (rules[:5], rules):
        out = UR.user_rule_findings(table, spark.createDataFrame(some, LINE_RULES))
        got = sorted((r.rule, r.line_no) for r in out.collect())
        assert got == sorted((r[0], i) for r in some for i, t in enumerate(lines) if holds(t, r))
        shape = out._jdf.queryExecution().sparkPlan().toString()
        assert "NestedLoop" not in shape and "Cartesian" not in shape
        plans.append(re.findall(r"[A-Z][a-zA-Z]+Join|Generate|Filter|HashAggregate|SortAggregate", shape))
    assert plans[0] == plans[1]


def test_a_rule_is_indexed_under_its_rarest_piece(spark):
    rules = spark.createDataFrame([("a", ["return qzx"], None, [], "low", None), ("b", ["re"], "turn", [], "low", None)], LINE_RULES)
    counts = spark.createDataFrame([("ret", 9), ("etu", 9), ("tur", 9), ("urn", 9), ("re", 3), ("rn ", 2), ("n q", 1)], "piece STRING, seen BIGINT")
    assert {r.rule: r.piece for r in UR.rule_index(rules, counts).collect()} == {"a": " qz", "b": "re"}
