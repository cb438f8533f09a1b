"""Personal data and secrets: regular expressions propose, checks confirm, context scores.

Only DataFrame functions run here. A pattern's matches and the pieces between them
(regexp_extract_all and split use the same matcher) give every match's place as a
running sum of lengths, in code points.

The patterns are anchored so that a scan is linear in the text: a match can start only
where its run of characters starts or where the last match ended, and quantifiers that
cannot give anything back are possessive. An account number (IBAN) has no sign of its end: each
start is proposed with the run of groups behind it, and of the group ends in it mod-97
chooses, that of the country's length before others and then the longest. Of overlapping
ones the first stays.

Defined cases: a null or empty text has no spans; rows are independent, so repeated
rows and ties give repeated results; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 48
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    """pattern: what proposes a span. prior: score of a confirmed span without context.
    bonus: added where one of the context words stands within CONTEXT_CHARS before it.
    base: kept whatever its score."""

    name: str
    pattern: str
    prior: float
    bonus: float
    context: str
    base: bool = True


_LOCAL = r"[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, 0.1, r"mail|contact|write to|reach"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", 0.6, 0.3, r"\bip\b|address|host|server|login"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", 0.8, 0.2, r"card|visa|credit|payment|mastercard|debit"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, 0.2, r"phone|call|tel|mobile|fax|contact"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", 0.9, 0.1, r"iban|account|konto|bank|transfer", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, 0.5, r"ssn|social security|tax id", base=False),
    # what issuers' keys look like, the head of a private key, and any string that might be a
    # secret: long, of mixed characters, and named as one in front of it
    Kind("key", r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{34}[A-Za-z0-9_])(?![A-Za-z0-9_])", 0.9, 0.1, r"key|token|secret", base=False),
    Kind("private_key", r"-----BEGIN (?:[A-Z]{2,9} )?PRIVATE KEY-----", 1.0, 0.0, r"key", base=False),
    Kind("secret", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+", 0.2, 0.6, r"token|secret|password|passwd|api.?key|access.?key|private.?key|credential|bearer|authorization", base=False),
)
#: how many different characters a secret has at least
DISTINCT = 8


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return (F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10) == 0


def mod97(code: Column) -> Column:
    """Whether an account number (no spaces) passes the ISO 7064 mod-97 check."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


#: Lengths of account numbers by country, as registered.
_IBAN = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20"
).split()


def account(found: Column) -> Column:
    """The part of a run of groups that is an account number, or null."""
    groups = F.split(found, " ")
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    ends = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
    good = F.filter(ends, lambda x: x.rlike("^[A-Z0-9 ]+$") & F.length(plain(x)).between(15, 34) & mod97(plain(x)))
    own = lambda x: F.concat(F.substring(x, 1, 2), F.length(plain(x)).cast("string")).isin(_IBAN)
    return F.coalesce(F.get(F.filter(good, own), F.lit(0)), F.get(good, F.size(good) - 1))


def confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return _let(_digits(found), luhn)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind == "iban":
        return found.isNotNull()
    if kind == "ssn":
        return ~found.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(F.substring(found, 1, 256), ""))) >= DISTINCT)
    return F.lit(True)


def running(x: Column) -> Column:
    """Running sums of an array of long, in blocks of about the root of its size, so that
    an array of n costs n**1.5 and not n**2."""
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))

    def one(b: Column) -> Column:
        before = F.aggregate(F.slice(x, F.lit(1), b * block), F.lit(0).cast("long"), lambda a, v: a + v)
        run = F.aggregate(F.slice(x, b * block + 1, block), F.array(before), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
        return F.slice(run, F.lit(2), F.size(run))

    blocks = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int"))
    return F.when(F.size(x) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(F.transform(blocks, one)))


#: A character without which a kind cannot match: cheaper to look for than the pattern.
_MARKS = {"email": "@", "phone": "+", "private_key": "PRIVATE KEY-----"}


def _found(text: Column, kind: Kind) -> Column:
    """array<struct<gap, own, found>>: each match after the text between it and the last."""
    rx = F.lit(kind.pattern)
    size = lambda x: F.length(x).cast("long")
    pairs = F.zip_with(F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, kind.pattern, -1), lambda h, p: F.struct(size(p).alias("gap"), size(h).alias("own"), h.alias("found")))
    if kind.name == "iban":  # the match is the start alone
        pairs = F.zip_with(pairs, F.regexp_extract_all(text, rx, F.lit(1)), lambda s, r: s.withField("found", account(F.concat(s["found"], r))))
    some = text.rlike(kind.pattern)
    if kind.name in _MARKS:
        some = F.contains(text, F.lit(_MARKS[kind.name])) & some
    none = F.array().cast("array<struct<gap:bigint,own:bigint,found:string>>")
    # the piece behind the last match has none of its own
    return F.when(some, F.filter(pairs, lambda s: s["own"].isNotNull())).otherwise(none)


def _gaps(found: Column) -> Column:
    """From the start of the last match (or of the text) to each start."""
    before = F.concat(F.array(F.lit(0).cast("long")), F.transform(found, lambda s: s["own"]))
    return F.zip_with(found, F.slice(before, F.lit(1), F.size(found)), lambda s, o: s["gap"] + o)


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(body: Column, found: Column, at: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind with their places and scores."""

    def span(s: Column, start: Column) -> Column:
        near = F.lower(F.substring(body, F.greatest(start - CONTEXT_CHARS, F.lit(0)).cast("int") + 1, F.least(start, F.lit(CONTEXT_CHARS)).cast("int")))
        score = F.lit(kind.prior) + F.when(near.rlike(kind.context), F.lit(kind.bonus)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + (F.length(s["found"]) if kind.name == "iban" else s["own"])).alias("end"), s["found"].alias("found"), F.round(score, 3).alias("score"), F.lit(kind.base).alias("base"))

    out = F.filter(F.zip_with(found, at, span), lambda s: confirmed(kind.name, s["found"]) & (s["base"] | (s["score"] >= THRESHOLD)))
    if kind.name == "iban":
        return _let(out, lambda x: F.filter(x, lambda s, i: (i == 0) | (F.get(x, i - 1)["end"] <= s["start"])))
    return out


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `spans`: array<struct<kind, start, end, found, score, base>>, by
    kind in the order of KINDS and then by start; places are code points, end exclusive.
    Spans of a kind that is not base are there when their score reaches THRESHOLD."""
    body = F.coalesce(F.col(text), F.lit(""))
    names = [k.name for k in KINDS]
    out = docs.withColumns({f"__q_{k.name}": _found(body, k) for k in KINDS})
    out = out.withColumns({f"__q_gap_{n}": _gaps(F.col(f"__q_{n}")) for n in names})
    out = out.withColumns({f"__q_at_{n}": running(F.col(f"__q_gap_{n}")) for n in names})
    every = [_placed(body, F.col(f"__q_{k.name}"), F.col(f"__q_at_{k.name}"), k) for k in KINDS]
    return out.withColumn("spans", F.concat(*every)).drop(*[f"__q_{p}{n}" for p in ("", "gap_", "at_") for n in names])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def digest(docs: DataFrame) -> DataFrame:
    """The per-document digest of detect()."""
    found = detect(docs.select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), score.alias("score"))


#: The same result in DuckDB SQL, from the plain patterns and list functions.
def oracle() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "key": r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{34}[A-Za-z0-9_])\b",
        "private_key": r"-----BEGIN (?:[A-Z]{2,9} )?PRIVATE KEY-----",
        "secret": r"[A-Za-z0-9_/+-]{20,}",
    }
    luhn_sql = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(d, length(d) - i + 1, 1)::INT ELSE (2 * substr(d, length(d) - i + 1, 1)::INT) // 10 + (2 * substr(d, length(d) - i + 1, 1)::INT) % 10 END)) % 10 = 0"
    mod_sql = "list_reduce(list_prepend(0, list_transform(range(1, length(c) + 1), lambda i: CASE WHEN ascii(substr(c, i, 1)) >= 65 THEN ascii(substr(c, i, 1)) - 55 ELSE ascii(substr(c, i, 1)) - 48 END)), lambda a, b: CASE WHEN b >= 10 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1"
    tests = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(h, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INT), 0) <= 255))",
        "card": f"length(d) BETWEEN 13 AND 19 AND {luhn_sql}",
        "phone": "length(d) BETWEEN 9 AND 15",
        "iban": f"length(c) BETWEEN 15 AND 34 AND {mod_sql}",
        "ssn": "NOT regexp_matches(h, '^(?:000|666|9)|-00-|-0000$')",
        "key": "true",
        "private_key": "true",
        "secret": f"regexp_matches(h, '[0-9]') AND regexp_matches(h, '[A-Za-z]') AND len(list_distinct(string_split(substr(h, 1, 256), ''))) >= {DISTINCT}",
    }
    parts, names = [], list(plain)
    for n, k in enumerate(KINDS):
        rx = plain[k.name].replace("'", "''")
        score = f"round({k.prior} + CASE WHEN regexp_matches(lower(substr(t, greatest(s - {CONTEXT_CHARS}, 0) + 1, least(s, {CONTEXT_CHARS}))), '{k.context}') THEN {k.bonus} ELSE 0 END, 3)::DOUBLE"
        parts.append(f"""
        SELECT doc_id, {n} AS k, '{k.name}' AS kind, {k.base} AS base, s, s + length(h) AS e, {score} AS score FROM (
          SELECT doc_id, t, h, regexp_replace(h, '[^0-9]', '', 'g') AS d, '' AS c0,
                 substr(replace(h, ' ', ''), 5) || substr(replace(h, ' ', ''), 1, 4) AS c,
                 (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
          FROM (SELECT doc_id, t, hits, pieces, unnest(hits) AS h, unnest(range(1, len(hits) + 1)) AS i
                FROM (SELECT doc_id, t, regexp_extract_all(t, '{rx}') AS hits, string_split_regex(t, '{rx}') AS pieces FROM d0)))
        WHERE {tests[k.name]} AND ({k.base} OR {score} >= {THRESHOLD})""")
    assert names == [k.name for k in KINDS]
    return f"""
    WITH d0 AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({' UNION ALL '.join(parts)}),
    per AS (SELECT doc_id,
        count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
        count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (base) AS b,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans,
        count(*) AS n_spans, max(score) AS score
      FROM found GROUP BY doc_id)
    SELECT d0.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
           coalesce(n_phone, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans,
           coalesce(n_spans, 0) AS n_spans, coalesce(score, 0) AS score
    FROM d0 LEFT JOIN per USING (doc_id)"""
