"""The audit against its definition in plain loops, radix selection against a sort."""

import random
import re
from collections import Counter

import pytest
from llm_frames import SCHEMA
from pyspark.sql import functions as F

from quarry.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def by_hand(rows, min_docs=3, top=200):
    """rows (text, lang, source)"""
    rows = [tuple(v or "" for v in r) for r in rows]
    counts, docs, lang_counts = {}, Counter(), Counter()
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        counts.setdefault((lang, source), Counter()).update(terms)
        docs.update((lang, t) for t in set(terms))
        lang_counts.update((lang, t) for t in terms)
    out = []
    for lang in {k[0] for k in counts}:
        kept = [t for (g, t), n in docs.items() if g == lang and n >= min_docs]
        per = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        share = lambda n: {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}  # noqa: B023,E731
        p = {s: share(n) for s, n in per.items()}
        q = share({t: lang_counts[lang, t] for t in kept})
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in p if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if per[s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def documents(n, seed=1):
    rng = random.Random(seed)
    words = [rng.choice(["Wort", "é", "漢", "x", "straße", "I"]) + rng.choice(["", "a", "bb", "É"]) * rng.randint(0, 3) for _ in range(90)]
    sep = lambda: rng.choice([" ", "\n", "1", "_", "-", "\x7f", "[", "\x00"])
    text = lambda: "".join(rng.choice(words[: rng.choice([5, 40, 90])]) + sep() for _ in range(rng.randint(0, 60)))
    return [(rng.choice([text(), text(), text(), None, ""]), rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "ü", None, "", "z"])) for _ in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "text string, lang string, source string").repartition(parts)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("n", [1, 5, 60, 250])
def test_against_plain_loops(spark, n):
    rows = documents(n, seed=n)
    assert got(divergence.audit(frame(spark, rows))) == by_hand(rows)


def test_short_lists_of_terms_with_many_ties(spark):
    rng = random.Random(7)
    # every word equally often: all values of a group tie, and only bytes decide
    words = ["".join(rng.choice("ab漢") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    rows = [(" ".join(words), "en", s) for s in "abc"] + [("a " * 30, "en", "d"), (" ".join(words[:50]), "en", "a")]
    for top in (1, 7, 40):
        assert got(divergence.audit(frame(spark, rows), top=top)) == by_hand(rows, top=top)


def test_a_language_without_kept_terms_has_pairs_of_nothing(spark):
    rows = [("a b", "xx", "s"), (None, "xx", "t"), ("c", "xx", None), ("d d d", "yy", "s")]
    assert got(divergence.audit(frame(spark, rows))) == by_hand(rows)
    assert {r[4] for r in by_hand(rows)} == {0}


def test_pieces_cut_no_term(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "é漢", "X" * 30, " ", "7", "\n"]) for _ in range(4000)).encode()
    want = text.translate(divergence._TERM).split()
    for size in (1, 17, 1000):
        monkeypatch.setattr(divergence, "PIECE", size)
        assert [t for piece in divergence._pieces(text) for t in piece.split()] == want


def test_radix_threshold_against_a_sort(spark):
    rng = random.Random(11)
    values = {1: [rng.randrange(2**62) for _ in range(300)], 2: [5] * 50, 3: [rng.choice([0, 1, 2**61, 2**61 + 1, 70000, 65536]) for _ in range(200)], 4: [3, 2, 1], 5: [9] * 9 + [8] * 11}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "gid int, value long").repartition(4)
    for top in (1, 10, 150):
        found = {r.gid: (r.least, r.need, r.ties) for r in divergence.radix_threshold(df, top).collect()}
        want = {}
        for g, vs in values.items():
            if len(vs) >= top:
                least = sorted(vs, reverse=True)[top - 1]
                want[g] = (least, top - sum(v > least for v in vs), vs.count(least))
        assert found == want


def test_tie_borders_against_a_sort(spark):
    rng = random.Random(13)
    texts = {1: {"a" * 5000 + rng.choice("xyz") + str(i) for i in range(40)}, 2: {"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(60)}, 3: {"a" * i for i in range(1, 30)}, 4: {"é" * i + "漢" for i in range(20)}}
    for need in (1, 6, 15):
        rows = [(g, need, t.encode().hex().upper()) for g, ts in texts.items() for t in ts]
        found = {r.gid: r.last for r in divergence.tie_borders(spark.createDataFrame(rows, "gid int, need long, hex string")).collect()}
        assert found == {g: sorted(t.encode() for t in ts)[need - 1].hex().upper() for g, ts in texts.items()}


def test_empty_table_nulls_and_other_columns(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = documents(40, seed=2)
    docs = frame(spark, rows).withColumns({c: F.lit(1) for c in ("term", "n", "gid", "value", "part", "doc_id", "rank", "least", "need")})
    assert got(divergence.audit(docs)) == by_hand(rows)
    long = [("lang " * 900_000 + "w" * 1_500_000, "en", "s"), ("lang", "en", "t"), ("lang x", "en", "t")]
    assert got(divergence.audit(frame(spark, long))) == by_hand(long)
