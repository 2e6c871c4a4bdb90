"""Personal data: rule findings, and boosted trees over the other candidates, in DataFrame functions throughout.

Rules: ``email``, ``ip``, ``card`` and ``phone``; their findings always stay. Two high-recall generators
propose further, overlapping spans: anything around an @ sign or a spelled-out one (``model_email``), and any
longer run of digits, separators and brackets, also with letters before it (``model_number``). Trees score each
candidate by its format and the characters around it. They are fitted on a bounded sample of candidates, half of them
positive where there are enough, and on made-up ones: personal data in other dress than the rules ask for, and
look-alikes. A candidate is positive if a rule holds inside; one in the dress of the made-up positives has no label
and isn't shown. Per generator the threshold is the lowest one that is PRECISION right on the held-out
candidates that no rule covers, as only these are scored.
The fitted trees become a Column, so that texts never leave the JVM. Only the sample's
small feature rows reach the driver.

Offsets are code points, ends exclusive. Null and empty texts have no findings; repeated rows give
equal rows, and rows with a null id are handled like others. A text's matches are rows of their own until they
are joined to one string, so a text with very many of them is no large value. With no candidates
there are no trees, and the rules stand alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .tables import free_name, stored

#: In the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "model_email", "model_number")
GENERATORS = ("model_email", "model_number")
#: Candidates that the trees are fitted on at most; which ones is decided by a hash.
TRAIN_CANDIDATES = 20000
#: Made-up candidates that are added to them.
MADE_UP = 4000
PRECISION = 0.98
BEFORE, AFTER = 24, 8

_LOCAL = r"A-Za-z0-9._%+\-\x04"
_DOMAIN = r"A-Za-z0-9\-"
#: A match begins where the last one ended or after a character that can't belong to it; both ways
#: of writing find what the plain patterns find, without trying every start inside a long run.
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_DOMAIN}]++\x04[{_DOMAIN}\x04]++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9\x03])[0-9][0-9\x03]{13,}"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SPELLED_AT = r"(?:\x20?[(\[{<]\x20?at\x20?[)\]}>]\x20?|\x20at\x20)"
_SPELLED_DOT = r"(?:\x20?[(\[{<]\x20?dot\x20?[)\]}>]\x20?|\x20dot\x20)"
_SPELLED = rf"(?i:(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_SPELLED_AT}[A-Za-z0-9-]++(?:(?:{_SPELLED_DOT}|\.)[A-Za-z0-9-]++)+)"
_AROUND_AT = rf"(?:\G|(?<![^\s@<>()\[\],;:\x22]))[^\s@<>()\[\],;:\x22]++@[^\s@<>()\[\],;:\x22]++|{_SPELLED}"
_IBAN = r"[A-Z]{2}[0-9]{2}(?:[\x20\x03]?[A-Z0-9]{4}){2,7}(?:[\x20\x03]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_NUMBER = rf"(?<![0-9A-Za-z\x03])(?:{_IBAN}|[A-Z]{{1,3}}[0-9][0-9\x03]{{4,}}[0-9]|[+(]{{0,2}}[0-9][0-9\x03().]{{4,}}[0-9])"


def _clean(text: Column) -> Column:
    """The text with the marks used below put out of the way, character for character."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[\x01-\x04]"), F.translate(text, "\x01\x02\x03\x04", "\x05\x05\x05\x05")).otherwise(text)


def _inner_dots(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<=[{_DOMAIN}])\.(?=[{_DOMAIN}])", "\x04")


def _inner_gaps(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", "\x03")


def _bracket_gaps(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[0-9)])[\x20-](?=[0-9(])", "\x03")


def _marked(kind: str, text: Column) -> Column:
    """The text with each match of a kind set between \\x01 and \\x02; null where a cheap test excludes a match."""
    around = lambda prepared, pattern: F.regexp_replace(prepared, f"({pattern})", "\x01$1\x02")
    digits = text.rlike(r"[0-9][0-9\x20-]{12}")
    return {
        "email": F.when(text.contains("@"), around(_inner_dots(text), _EMAIL)),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), around(text, _IP)),
        "card": F.when(digits, around(_inner_gaps(text), _CARD)),
        "phone": F.when(text.contains("+"), around(text, _PHONE)),
        "model_email": F.when(text.contains("@") | text.rlike(rf"(?i){_SPELLED_AT}"), around(text, _AROUND_AT)),
        "model_number": F.when(text.rlike(r"[0-9][0-9\x20().-]{5}"), around(_bracket_gaps(text), _NUMBER)),
    }[kind]


def _described(cut: Column) -> Column:
    """Of a text cut before each match: (place, length, found, before, after) of the pieces, place 0 being what precedes the first."""

    def one(piece: Column, i: Column) -> Column:
        size = F.when(i > 0, F.instr(piece, "\x02") - 1)
        last = F.when(i > 0, F.translate(F.element_at(cut, i), "\x02", ""))
        return F.struct(
            i.alias("place"), (F.length(piece) - F.when(i > 0, 1).otherwise(0)).alias("length"), piece.substr(F.lit(1), size).alias("found"),
            F.right(last, F.lit(BEFORE)).alias("before"), piece.substr(size + 2, F.lit(AFTER)).alias("after"),
        )

    return F.transform(cut, one)


def matches(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """doc_id, cls, kind, start, end, found, before, after: what the patterns match. ``cls`` stands for the text."""
    texts = docs.select("doc_id", text_class(F.col("text")).alias("cls"), _clean(F.col("text")).alias("text"))
    cuts = F.array(*[F.struct(F.lit(k).alias("kind"), F.split(_marked(k, F.col("text")), "\x01", -1).alias("cut")) for k in kinds])
    # once exploded, the cut text is a value of its own and isn't worked out again for each piece
    rows = texts.select("doc_id", "cls", F.inline(cuts)).where(F.size("cut") > 1)
    rows = rows.select("doc_id", "cls", "kind", F.inline(_described(F.col("cut")))).distinct()
    earlier = Window.partitionBy("doc_id", "cls", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.sum("length").over(earlier)).where("place > 0")
    back = lambda c: F.translate(c, "\x03\x04", " .")
    return rows.select("doc_id", "cls", "kind", "start", (F.col("start") + F.length("found")).alias("end"), *[back(F.col(c)).alias(c) for c in ("found", "before", "after")])


def text_class(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: Column, found: Column) -> Column:
    """Whether a match of a rule's pattern holds."""
    digits = digits_of(found)
    n = F.length(digits)
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", found.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when((kind == "card") & n.between(14, 19), luhn(digits))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(False)
    )


def _holds(found: Column) -> Column:
    """Whether a rule holds inside a candidate."""
    digits = digits_of(found)
    ip = F.regexp_extract(found, r"(?<![0-9])([0-9]++\.[0-9]++\.[0-9]++\.[0-9]++)", 1)
    phone = F.regexp_extract(found, rf"({_PHONE})", 1)
    email = _inner_dots(found).rlike(_EMAIL)
    plain = found.rlike(r"^[0-9][0-9\x20-]*$") & ~found.rlike(r"[\x20-]{2}|[\x20-]$")
    card = F.when(plain & F.length(digits).between(14, 19), luhn(digits))
    return email | ((ip != "") & valid(F.lit("ip"), ip)) | F.coalesce(card, F.lit(False)) | ((phone != "") & valid(F.lit("phone"), phone))


def _iban(found: Column) -> Column:
    """Whether a candidate passes the check of international account numbers."""
    plain = F.regexp_replace(found, r"[\x20-]", "")
    moved = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))

    def add(total: Column, i: Column) -> Column:
        code = F.ascii(moved.substr(i, F.lit(1)))
        return (total * F.when(code < 58, 10).otherwise(100) + code - F.when(code < 58, 48).otherwise(55)) % 97

    check = F.aggregate(F.sequence(F.lit(1), F.length(plain)), F.lit(0), add) == 1
    return F.when(plain.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), check).otherwise(False)


def _dress(found: Column) -> dict[str, Column]:
    """Formats of personal data that no rule asks for."""
    return {
        "as_phone": found.rlike(r"^(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}$"),
        "as_person": found.rlike(r"^[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}$"),
        "as_account": _iban(found),
        "as_card": found.rlike(r"^[0-9]{4}(?:\.[0-9]{4}){3}$") & luhn(digits_of(found)),
        "as_address": found.rlike(rf"(?i){_SPELLED_AT}") & (found.rlike(rf"(?i){_SPELLED_DOT}") | found.rlike(r"(?i)[(\[{<]\x20?at\x20?[)\]}>]")),
    }


def _features(found: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a candidate, as small whole numbers."""
    count = lambda text, chars: F.least(F.length(F.regexp_replace(text, f"[^{chars}]", "")), F.lit(40))
    domain = F.regexp_extract(found, r"@([^@]*)$", 1)
    near = F.lower(before)
    flags = {
        "has_at": found.contains("@"), "plus": found.startswith("+"), "bracket": found.startswith("("),
        "leading_zero": found.startswith("0"), "in_word": before.rlike(r"[A-Za-z0-9_]$"), "sign_before": before.rlike(r"[$#=/-]\x20?$"),
        "word_after": after.rlike(r"^[A-Za-z0-9_]"), "unit_after": after.rlike(r"^\x20?(?:%|[a-z]{1,2}\b)"),
        "call_near": near.rlike("phone|tel|call|mobil|fax"), "mail_near": near.rlike("mail|contact|write"),
        "card_near": near.rlike("card|visa|credit|account|iban|pay"), "address_near": near.rlike(r"\bip\b|host|server|address"),
        "number_near": near.rlike("order|version|page|isbn|invoice|serial"), "person_near": near.rlike("passport|ssn|social|tax|identity"),
        "date": found.rlike(r"^(?:19|20)[0-9]{2}[\x20.-][0-9]{1,2}[\x20.-]|[\x20.](?:19|20)[0-9]{2}$"), "capital": found.rlike("^[A-Z]"), **_dress(found), "final_label": domain.rlike(r"\.[A-Za-z]{2,}$"),
    }
    numbers = {
        "length": F.least(F.length(found), F.lit(60)), "digits": count(found, "0-9"), "letters": count(found, "A-Za-z"), "dots": count(found, "."),
        "gaps": count(found, r"\x20-"), "brackets": count(found, "()"), "groups": F.least(F.size(F.split(found, "[^0-9]+")), F.lit(12)),
        "domain": F.least(F.length(domain), F.lit(40)), "domain_dots": count(domain, "."),
        "longest_group": F.least(F.array_max(F.transform(F.split(found, "[^0-9]+"), F.length)), F.lit(30)),
    }
    return {**numbers, **{k: v.cast("int") for k, v in flags.items()}}


def _column(trees: Trees, names: list[str]) -> Column:
    """The trees' log odds as nested CASE expressions."""

    def node(root: int, i: int, level: int) -> str:
        at = root + i
        if level == trees.depth:
            return repr(float(trees.value[at]))
        if not np.isfinite(trees.cut[at]):
            return node(root, 2 * i + 1, level + 1)
        low, high = node(root, 2 * i + 1, level + 1), node(root, 2 * i + 2, level + 1)
        return low if low == high else f"if({names[trees.feature[at]]} > {float(trees.cut[at])!r}D, {high}, {low})"

    terms = [node(root, 0, 0) for root in range(0, len(trees.feature), trees.width)]
    as_double = " + ".join(f"cast({t} as double)" for t in [repr(trees.base), *terms])
    return F.expr(as_double)


def made_up(n: int = MADE_UP) -> list[tuple[str, int, str, str, str]]:
    """(kind, label, found, before, after): personal data in other dress, and as many look-alikes; equal in each run.

    ``found`` is written as ``matches`` gives it: a hyphen between digits is a space.
    """
    rng = np.random.default_rng(13)
    pick = lambda *options: options[rng.integers(len(options))]
    digits = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    letters = lambda k, of="abcdefghijklmnopqrstuvwxyz": "".join(of[i] for i in rng.integers(0, len(of), k))
    word = lambda: letters(rng.integers(2, 9))
    number = lambda low, high: str(rng.integers(low, high))

    def account() -> str:
        land, body = letters(2).upper(), pick(letters(4).upper(), "") + digits(rng.integers(11, 19))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        plain = f"{land}{check:02}{body}"
        return pick(plain, " ".join(plain[i : i + 4] for i in range(0, len(plain), 4)))

    def card() -> str:
        body = digits(15)
        last = next(d for d in "0123456789" if sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(body + d))) % 10 == 0)
        return ".".join((body + last)[i : i + 4] for i in range(0, 16, 4))

    def address() -> str:
        at, dot = pick((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), (" AT ", " DOT "))
        return f"{word()}{pick('', '.' + word(), number(1, 99))}{at}{word()}{dot}{pick('com', 'org', 'net', 'de', 'es', 'co')}"

    def personal() -> tuple[str, str, str]:
        kind = rng.integers(6)
        if kind == 0:
            return "model_number", pick("{} {} {}", "({}) {} {}", "({}){} {}", "{}.{}.{}", "1 {} {} {}").format(digits(3), digits(3), digits(4)), pick("", "", "call", "tel:", "phone")
        if kind == 1:
            return "model_number", f"{digits(3)} {digits(2)} {digits(4)}", pick("", "", "SSN", "social security")
        if kind == 2:
            return "model_number", account(), pick("", "", "IBAN", "account")
        if kind == 3:
            return "model_number", card(), pick("", "card", "visa")
        if kind == 4:
            return "model_number", letters(rng.integers(1, 3)).upper() + digits(rng.integers(7, 10)), pick("passport", "passport no", "identity card", "tax id")
        return "model_email", address(), pick("", "", "mail", "contact", "write to")

    def other() -> tuple[str, str, str]:
        kind = rng.integers(10)
        near = pick("", "", "order", "version", "page", "isbn", "invoice", "serial", "on", "since")
        year = number(1900, 2100)
        if kind == 0:
            return "model_number", pick("{0} {1:02} {2:02}", "{2:02}.{1:02}.{0}", "{0} {1:02} {2:02} 12").format(year, rng.integers(1, 13), rng.integers(1, 29)), near
        if kind == 1:
            return "model_number", pick(f"{year} {number(1900, 2100)}", f"{year} {digits(5)}"), near
        if kind == 2:
            return "model_number", ".".join(number(0, 999) for _ in range(rng.integers(2, 6))) + digits(3), near
        if kind == 3:
            return "model_number", f"978 {digits(1)} {digits(2)} {digits(6)} {digits(1)}", near
        if kind == 4:
            return "model_number", digits(rng.integers(6, 24)), near
        if kind == 5:
            return "model_number", " ".join(digits(rng.integers(1, 6)) for _ in range(rng.integers(3, 9))), near
        if kind == 6:
            return "model_number", letters(rng.integers(1, 4)).upper() + digits(rng.integers(6, 12)), near
        if kind == 7:
            land = letters(2).upper() + digits(2)
            return "model_number", land + "".join(pick("", " ") + digits(4) for _ in range(rng.integers(3, 6))), near
        if kind == 8:
            return "model_email", f"{word()} at {word()}.{pick(word(), 'com', 'org')}", pick("", "we looked", "have a look")
        return "model_email", pick(f"{word()}@{word()}", f"{word()}@{digits(2)}", f"{word()}@{word()}_{word()}"), near

    out = []
    for i in range(n):
        kind, found, near = (personal, other)[i % 2]()
        before = (" ".join(word() for _ in range(3)) + " " + near + pick(" ", " ", ": "))[-BEFORE:]
        out.append((kind, 1 - i % 2, found, before, pick("", " ", ". ", ", ", "\n") + word()[:6]))
    return out


def train(found: DataFrame, rows: int = TRAIN_CANDIDATES) -> tuple[Trees, dict[str, float]] | None:
    """Trees and thresholds (in log odds, by generator) from a bounded sample of candidates and made-up ones."""
    features = _features(F.col("found"), F.col("before"), F.col("after"))
    shown = [F.col("kind"), F.col("label"), *[c.cast("int").alias(k) for k, c in features.items()]]
    proposed = found.where(F.col("kind").isin(*GENERATORS)).withColumn("label", _holds(F.col("found")).cast("int"))
    dressed = F.lit(False)
    for flag in _dress(F.col("found")).values():
        dressed = dressed | flag
    table = []
    for label in (proposed.where("label = 1"), proposed.where((F.col("label") == 0) & ~dressed)):
        chosen = label.orderBy(F.xxhash64("cls", "start", "kind"), "doc_id").limit(rows // 2)
        table += chosen.select(*shown).collect()
    if not table and proposed.isEmpty():
        return None
    ruled = np.array([r["label"] == 1 for r in table] + [False] * MADE_UP)
    made = found.sparkSession.createDataFrame([(i, *m) for i, m in enumerate(made_up())], "i int, kind string, label int, found string, before string, after string")
    table += made.orderBy("i").select(*shown).collect()
    x, y = np.array([r[2:] for r in table], float), np.array([r["label"] for r in table], float)
    kind, held = np.array([r["kind"] for r in table]), np.random.default_rng(17).random(len(table)) < 0.2
    trees = fit(x[~held], y[~held], trees=24, depth=3, bins=24, rate=0.3)
    scores, cuts = trees.raw(x[held]), {}
    for k in GENERATORS:
        own = (kind[held] == k) & ~ruled[held]
        order = np.argsort(-scores[own], kind="stable")
        s, right = scores[own][order], np.cumsum(y[held][own][order])
        good = np.flatnonzero((right / np.arange(1, len(s) + 1) >= PRECISION) & np.append(s[1:] != s[:-1], True)) if len(s) else []
        cuts[k] = max(0.0, float(s[good[-1]])) if len(good) else float("inf")
    return trees, cuts


def spans(docs: DataFrame, rows: int = TRAIN_CANDIDATES) -> DataFrame:
    """doc_id, cls, kind, start, end of all findings: the rules', and what the trees add to them."""
    found = stored(matches(docs), "pii")
    base = found.where(~F.col("kind").isin(*GENERATORS) & valid(F.col("kind"), F.col("found"))).select("doc_id", "cls", "kind", "start", "end")
    model = train(found, rows)
    if model is None:
        return base
    trees, cuts = model
    features = _features(F.col("found"), F.col("before"), F.col("after"))
    others = found.where(F.col("kind").isin(*GENERATORS) & ~_holds(F.col("found")))
    scored = others.select("doc_id", "cls", "kind", "start", "end", *[c.alias(k) for k, c in features.items()])
    cut = F.when(F.col("kind") == GENERATORS[0], cuts[GENERATORS[0]]).otherwise(cuts[GENERATORS[1]])
    added = scored.where(_column(trees, list(features)) >= cut).select("doc_id", "cls", "kind", "start", "end")
    return base.union(added)


def _per_text(found: DataFrame) -> DataFrame:
    """doc_id, cls, all: a text's findings in order of start and kind."""
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    return found.groupBy("doc_id", "cls").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind"))).alias("all"))


def findings(docs: DataFrame, rows: int = TRAIN_CANDIDATES) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    found = _per_text(spans(docs, rows)).withColumnRenamed("doc_id", "id").withColumnRenamed("cls", "own")
    ids = docs.select("doc_id", text_class(F.col("text")).alias("cls"))
    joined = ids.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("cls") == F.col("own")), "left")
    empty = F.expr("cast(array() as array<struct<start: bigint, order: int, end: bigint, kind: string>>)")
    all_ = F.coalesce(F.col("all"), empty)
    text = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    joined = joined.select("doc_id", all_.alias("all"))
    of = lambda i: F.filter("all", lambda x: x["order"] == i)
    base = F.filter("all", lambda x: x["order"] <= 4)
    return joined.select(
        "doc_id", *[F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4], 1)],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("all")).alias("spans"),
    )


def redact(docs: DataFrame, rows: int = TRAIN_CANDIDATES) -> DataFrame:
    """The documents with every finding replaced by its kind in brackets; n_chars follows where there is one.

    Findings that overlap are replaced as one, under the first one's kind.
    """

    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (x["start"] < F.coalesce(F.when(F.size(done) > 0, last["end"]), F.lit(0)))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(own)))

    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, kind: string>>)")
    own_id, own_text, held = (free_name(docs, n) for n in ("found_id", "found_text", "found"))
    merged = _per_text(spans(docs, rows)).select(F.col("doc_id").alias(own_id), F.col("cls").alias(own_text), F.aggregate("all", none, merge).alias(held))
    joined = docs.join(merged, docs["doc_id"].eqNullSafe(F.col(own_id)) & (text_class(docs["text"]) == F.col(own_text)), "left")
    text = docs["text"]

    def rest(x: Column, i: Column) -> Column:
        after = F.get(F.col(held), i + 1)["start"]
        left = F.coalesce(after, F.length(text).cast("long")) - x["end"]
        label = F.concat(F.lit("["), F.upper(F.replace(x["kind"], F.lit("model_"))), F.lit("]"))
        return F.concat(label, text.substr((x["end"] + 1).cast("int"), left.cast("int")))

    first = text.substr(F.lit(1), F.get(F.col(held), F.lit(0))["start"].cast("int"))
    new = F.when(F.col(held).isNull(), text).otherwise(F.concat(first, F.array_join(F.transform(held, rest), "")))
    named = free_name(docs, "redacted")
    out = joined.select(*[docs[c] for c in docs.columns], new.alias(named))
    change = {"text": F.col(named), "n_chars": F.when(F.col("text").isNotNull(), F.length(named).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[change[c].alias(c) if c in change else F.col(c) for c in docs.columns])
