"""Source divergence audit: which sources of a language differ, and by which terms.

Terms are runs of letters and of code points beyond ASCII, only A-Z lowered. A language
keeps the terms that occur in at least MIN_DOCS of its documents; every (lang, source)
group and every language gives each kept term a smoothed share
p = 1 + floor(10^9 (count + 1) / (N + V)), and f(p, q) = floor((p - q)^2 / q) tells how far
p lies from q. All arithmetic is on whole numbers.

Pairs of sources are summed over all V terms without a row for each: a term that neither
source has contributes the same f of the two baselines, a term that only one has
contributes by its count alone, so histograms of counts settle both, and only terms that
both have meet in a join, where they add what the histograms got wrong.

A group's first `top` terms are found by radix selection: histograms over 16 bits of the
values at a time, aggregated before they are shuffled, narrow each group to its k-th
value; terms of just that value are narrowed by the bytes of their UTF-8 in the same way.
No group is ever sorted: only the chosen terms are ranked.

Defined cases: null text, lang and source count as ''; an empty text has no terms, but its
group exists; repeated rows are separate documents; a language without kept terms has
pairs of value 0 and no terms; an empty table gives an empty result; doc_id and other
columns are ignored.

The table of groups (lang, source) is numbered in one task, and each group's list of other
sources is ranked in one; Spark broadcasts the table where its own size limit allows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, bound_batches, discard, stash, tidy

MIN_DOCS = 3
TOP = 200
UNIT = 1_000_000_000
#: Bits of a value that one histogram looks at.
DIGIT = 16
#: Bytes of a text that are counted at a time, and counts that a task holds before it hands them on.
PIECE = 1 << 20
HELD = 400_000

_TERM = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_COUNTS = "lang string, source string, term binary, n long, docs long"


def _pieces(text: bytes) -> Iterator[bytes]:
    """text with spaces for all that is no term, in pieces that cut no term."""
    text = text.translate(_TERM)
    at = 0
    while len(text) - at > PIECE:
        end = text.find(b" ", at + PIECE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts of a task's documents by group: [occurrences, documents]; each group is
    also there with the empty term, whose counts are 0."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(terms), pa.string()), "source": pa.array([source] * len(terms), pa.string()), "term": pa.array(terms, pa.binary()),
                "n": pa.array([n[t] for t in terms], pa.int64()), "docs": pa.array([docs[t] for t in terms], pa.int64())})
        held.clear()

    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for i, (lang, source) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            if (lang, source) not in held:
                held[lang, source] = (Counter({b"": 0}), Counter())
            n, docs = held[lang, source]
            before = len(n)
            own: Counter = Counter()
            for piece in _pieces(texts[i].as_py()):
                own.update(piece.split())
            n.update(own)
            docs.update(own.keys())
            size += len(n) - before
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), a row for each that
    occurs, and one with the term '' for each group."""
    bound_batches(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in ("text", "lang", "source")])
    found = texts.mapInArrow(tidy(_count), _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return found.withColumn("term", F.col("term").cast("string"))


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The counts of kept terms (and the groups' rows of the term ''), with the language's
    count of the term and a mark on one row of each term."""
    term = Window.partitionBy("lang", "term")
    out = term_counts(docs).withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term), "first": (F.min("source").over(term) == F.col("source")).cast("int")})
    return out.where((F.col("lang_docs") >= min_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "lang_n", "first")


def groups(kept: DataFrame) -> DataFrame:
    """gid, lang, source, size (N), lang_size, terms (V), present (kept terms that the group
    has), base (its share of a term that it lacks)."""
    real = F.col("term") != ""
    per = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum((real & (F.col("n") > 0)).cast("long")).alias("present"), F.sum(F.when(real, F.col("first")).otherwise(0)).alias("firsts"))
    lang = Window.partitionBy("lang")
    per = per.select("lang", "source", "size", "present", F.sum("size").over(lang).alias("lang_size"), F.sum("firsts").over(lang).alias("terms"))
    return per.withColumn("base", share(F.lit(0), F.col("size"), F.col("terms"))).withColumn("gid", F.row_number().over(Window.orderBy("lang", "source")))


def share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (size + terms)) in longs: the quotient three digits at a time,
    exact while size + terms stays below 9e15; null without terms."""
    whole = F.nullif(size + terms, F.lit(0).cast("long"))
    left, out = (n + 1).cast("long"), F.lit(1).cast("long")
    for k in (1_000_000, 1_000, 1):
        out = out + _div(left * 1000, whole) * k
        left = left * 1000 % whole
    return out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def apart(p: Column, q: Column) -> Column:
    """f(p, q)"""
    return _div((p - q) * (p - q), q)


def pairs(shares: DataFrame, of: DataFrame) -> DataFrame:
    """a, b (gids of two sources of one language), value: the sum of f(share in a, share in b)
    over all kept terms. shares: lang, term, gid, p, base of terms that occur."""
    total = lambda c, name: F.sum(c).alias(name)
    # what a term of one source counts against the other's baseline, by the histogram of its shares
    hist = shares.groupBy("lang", "gid", "p").agg(F.count(F.lit(1)).alias("k"))
    other = of.select("lang", F.col("gid").alias("o"), F.col("base").alias("o_base"))
    alone = hist.join(other, "lang").where("gid <> o").groupBy("gid", "o").agg(
        total(F.col("k") * apart(F.col("p"), F.col("o_base")), "to_base"), total(F.col("k") * apart(F.col("o_base"), F.col("p")), "from_base"))
    # terms of both: what is right, less what the histograms count for them
    x = shares.select("lang", "term", F.col("gid").alias("x"), F.col("p").alias("xp"), F.col("base").alias("xb"))
    y = shares.select("lang", "term", F.col("gid").alias("y"), F.col("p").alias("yp"), F.col("base").alias("yb"))
    xp, xb, yp, yb = (F.col(c) for c in ("xp", "xb", "yp", "yb"))
    correction = lambda p, p0, q, q0: apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)
    both = x.join(y, ["lang", "term"]).where("x < y").groupBy("x", "y").agg(total(correction(xp, xb, yp, yb), "there"), total(correction(yp, yb, xp, xb), "back"))
    both = both.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b"), F.col("there").alias("add")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"), F.col("back").alias("add")))).alias("r")).select("r.*")
    side = lambda a, b, name: alone.select(F.col("gid").alias(a), F.col("o").alias(b), name)
    left = of.select("lang", F.col("gid").alias("a"), F.col("base").alias("a_base"), F.col("present").alias("a_present"), "terms")
    right = of.select("lang", F.col("gid").alias("b"), F.col("base").alias("b_base"), F.col("present").alias("b_present"), F.col("source").alias("item"))
    out = left.join(right, "lang").where("a <> b").join(side("a", "b", "to_base"), ["a", "b"], "left").join(side("b", "a", "from_base"), ["a", "b"], "left").join(both, ["a", "b"], "left")
    zero = F.lit(0).cast("long")
    lacking = (F.col("terms") - F.col("a_present") - F.col("b_present")) * apart(F.col("a_base"), F.col("b_base"))
    value = sum((F.coalesce(F.col(c), zero) for c in ("to_base", "from_base", "add")), F.coalesce(lacking, zero))
    return out.select("a", "b", "item", value.alias("value"))


def radix_threshold(rows: DataFrame, top: int) -> DataFrame:
    """gid, least (the value of rank `top`), need (how many rows of just that value belong to
    the first `top`), ties (how many there are), for each gid with more than `top` rows.
    rows: gid, value (0 to 2^63 - 1)."""
    state = None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftright("value", shift) if state is None else F.shiftright("value", shift).bitwiseAND((1 << DIGIT) - 1)
        live = rows if state is None else rows.join(state, "gid").where(F.shiftright("value", shift + DIGIT) == F.col("least"))
        state_columns = [F.lit(0).cast("long").alias("least"), F.lit(top).cast("long").alias("need")] if state is None else [F.first("least").alias("least"), F.first("need").alias("need")]
        bins = live.groupBy("gid", digit.alias("digit")).agg(F.count(F.lit(1)).alias("ties"), *state_columns)
        upto = F.sum("ties").over(Window.partitionBy("gid").orderBy(F.col("digit").desc()).rowsBetween(Window.unboundedPreceding, 0))
        bins = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("ties") < F.col("need")))
        found = stash(bins.select("gid", (F.shiftleft("least", DIGIT) + F.col("digit")).alias("least"), (F.col("need") - F.col("upto") + F.col("ties")).alias("need"), "ties"), "radix")
        if state is not None:
            discard(state)
        state = found
        if shift:
            state = state.drop("ties")
            state._stashed = found._stashed
    return state


def _common(a: Column, b: Column) -> Column:
    """Hex digits of whole bytes that a and b share from their start."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    differ = F.array_position(same, F.lit(False))
    n = F.when(differ > 0, differ - 1).otherwise(F.length(a))
    return F.substring(a, F.lit(1), (n - n % 2).cast("int"))


def tie_borders(ties: DataFrame) -> DataFrame:
    """gid, last: of the rows of a gid, those with hex <= last are its first `need` by bytes.
    ties: gid, need, hex (distinct in a gid, more than need of them)."""
    state = stash(ties.groupBy("gid").agg(F.first("need").alias("need"), _common(F.min("hex"), F.max("hex")).alias("prefix")), "ties")
    done: list[DataFrame] = []
    while not state.isEmpty():
        # all rows behind the prefix differ within two bytes of it for some of them
        live = ties.drop("need").join(state, "gid").where(F.col("hex").startswith(F.col("prefix")))
        piece = F.substring("hex", F.length("prefix") + 1, F.lit(4))
        bins = live.groupBy("gid", piece.alias("piece")).agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"), F.min("hex").alias("low"), F.max("hex").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("gid").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0))
        bins = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        found = stash(bins.withColumn("need", F.col("need") - F.col("upto") + F.col("n")), "ties")
        done.append(found.where("need = n").select("gid", F.col("high").alias("last")))
        discard(state)
        state = stash(found.where("need < n").select("gid", "need", _common(F.col("low"), F.col("high")).alias("prefix")), "ties")
    discard(state)
    out = ties.sparkSession.createDataFrame([], f"gid {ties.schema['gid'].dataType.simpleString()}, last string")
    for more in done:
        out = out.unionByName(more)
    return out


def top_terms(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` rows of each gid by value, falling, then by the bytes of their term.
    rows: gid, term, value; read several times, so it should be a written table."""
    border = radix_threshold(rows.select("gid", "value"), top)
    exact = rows.join(border, "gid", "left")
    above = F.col("least").isNull() | (F.col("value") > F.col("least"))
    tied = rows.join(border.where("need < ties"), "gid").where(F.col("value") == F.col("least"))
    ties = stash(tied.select("gid", "need", F.hex(F.col("term").cast("binary")).alias("hex")), "tied")
    last = tie_borders(ties)
    exact = exact.join(last, "gid", "left")
    at = (F.col("value") == F.col("least")) & (F.col("last").isNull() | (F.hex(F.col("term").cast("binary")) <= F.col("last")))
    return exact.where(above | at).select("gid", "term", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    kept = stash(kept_counts(docs, min_docs), "kept-terms")
    of = stash(groups(kept), "groups")
    found = kept.where("term <> '' and n > 0").join(of, ["lang", "source"])
    shares = found.select("gid", "lang", "term", "base", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_size"), F.col("terms")).alias("q"))
    high = stash(shares.where("p > q").select("gid", "term", apart(F.col("p"), F.col("q")).alias("value")), "high-terms")
    pair = pairs(shares, of).select(F.col("a").alias("gid"), F.lit("pair").alias("part"), "item", "value")
    term = top_terms(high, top).select("gid", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("gid", "part").orderBy(F.col("value").desc(), "item"))
    return pair.unionByName(term).withColumn("rank", rank).join(of.select("gid", "lang", "source"), "gid").select("lang", "source", "part", "item", "value", "rank")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS size FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
        (1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.size + l.v)) AS p, (1 + ({UNIT}::HUGEINT * (k.n + 1)) // (l.size + l.v)) AS q
      FROM s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
two AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(two.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
