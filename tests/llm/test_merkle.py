"""The manifest against a tree built by hand, in any ranges, and the monoid's laws."""

import hashlib
import random
import zlib

import pytest
from llm_frames import SCHEMA, frame

from quarry.llm import merkle

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, arity=2):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(tree, i, arity=2):
    """(those before, those behind) level by level"""
    for row in tree[:-1]:
        first = i - i % arity
        yield row[first:i], row[i + 1 : first + arity]
        i //= arity


def by_hand(rows, arity=2):
    """rows (doc_id, source, lang, n_chars, text) -> the operator's rows"""
    leaf = lambda r, more=0: H(*map(said, (*r[:3], None if r[3] is None else r[3] + more, r[4])))
    first = lambda v: (v is not None, v)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    inside = {g: sorted((r for r in rows if r[2] == g), key=lambda r: ((first(r[0])[0], r[0] or 0), leaf(r))) for g in langs}
    trees = {g: levels([leaf(r) for r in inside[g]], arity) for g in langs}
    top = levels([trees[g][-1][0] for g in langs], arity) if langs else [[None]]
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(inside[g]):
            way = [*siblings(trees[g], i, arity), *siblings(top, k, arity)]
            digest = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for before, after in way:
                digest = H(*before, digest, *after)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H(*[x for b, a in way for x in b + a]), digest, digest == top[-1][0]))
    return sorted(out, key=str)


def documents(n, langs=("en", "de", None, "", "é", "zh"), seed=1):
    rng = random.Random(seed)
    text = lambda: rng.choice(["", "a", "é漢 \n", "x" * rng.randint(0, 40), None])
    rows = [(rng.choice([None, *range(n)]) if rng.random() < 0.2 else i, rng.choice(["s", None, "ü"]), rng.choices(langs, [9, 3, 2, 1, 1, 1][: len(langs)])[0], rng.choice([None, 3, i]), text()) for i in range(n)]
    return rows + [rows[0]] * 3 if rows else rows


def got(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(parts)
    return sorted((tuple(r) for r in merkle.digest(docs).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 40, 333])
def test_against_trees_by_hand(spark, n):
    rows = documents(n, seed=n)
    assert got(spark, rows) == by_hand(rows)


def test_one_language_and_one_row_each(spark):
    for rows in (documents(65, ("en",)), [(i, None, f"l{i}", i, "t") for i in range(21)]):
        assert got(spark, rows) == by_hand(rows)


@pytest.mark.parametrize(("size", "fan"), [(9, 2), (7, 3), (7, 64)])
def test_many_ranges_and_rounds_of_small_merges(spark, monkeypatch, size, fan):
    rows = documents(300, seed=size)
    monkeypatch.setattr(merkle, "RANGE_ROWS", size)
    monkeypatch.setattr(merkle, "FAN", fan)
    assert got(spark, rows) == by_hand(rows)


def test_subroots(spark):
    rows = documents(90, seed=9)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaf = merkle.leaf_of({c: docs[c] for c in merkle.COLUMNS})
    made = merkle.build(docs.select("lang", "doc_id", leaf.alias("leaf"), leaf.alias("shown")))
    want = by_hand(rows)
    assert made.root == want[0][3] and {r.subroot for r in made.subroots().collect()} == {w[2] for w in want}
    assert all(r.folded_root == made.root for r in made.proofs().collect())


def test_wider_runs(monkeypatch):
    monkeypatch.setattr(merkle, "ARITY", 5)
    for n in (1, 4, 5, 6, 26, 131):
        leaves = [H(str(i)) for i in range(n)]
        forest = merkle.Forest(1, {}, [])
        for i in random.Random(n).sample(range(n), n):
            forest.add((0, n, 0, i), leaves[i])
        assert list(forest.nodes.values()) == levels(leaves, 5)[-1]


def test_merging_is_associative_and_order_does_not_matter():
    rng = random.Random(5)
    for _ in range(60):
        trees = rng.randint(1, 4)
        width = [rng.randint(1, 20) for _ in range(trees)]
        leaves = [((t, width[t], 0, i), H(str((t, i)))) for t in range(trees) for i in range(width[t])]
        rng.shuffle(leaves)
        parts = [leaves[i::5] for i in range(5)]

        def forest(part):
            out = merkle.Forest(trees, {}, [])  # noqa: B023
            for k, d in part:
                out.add(k, d)
            return out

        a = forest(parts[0]).merge(forest(parts[1])).merge(forest(parts[2])).merge(forest(parts[3])).merge(forest(parts[4]))
        b = forest(parts[0]).merge(forest(parts[1]).merge(forest(parts[2]).merge(forest(parts[3]).merge(forest(parts[4])))))
        c = forest(parts[4]).merge(forest(parts[2])).merge(forest(parts[0]).merge(forest(parts[3]))).merge(forest(parts[1]))
        assert a.nodes == b.nodes == c.nodes and len(a.nodes) == 1
        assert sorted(a.born) == sorted(b.born) == sorted(c.born)


def test_a_forest_of_consecutive_leaves_is_small():
    forest = merkle.Forest(1, {}, [])
    for i in range(1000, 9000):
        forest.add((0, 100_000, 0, i), H(str(i)))
    assert len(forest.nodes) <= 2 * 14


def test_empty_table_and_extra_columns(spark):
    empty = merkle.digest(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and empty.count() == 0
    rows = [(1, "a b"), (None, None), (2, ""), (2, ""), (3, "x" * 2_000_000)]
    docs = frame(spark, rows).selectExpr("*", "'q' AS part", "1 AS pos", "2 AS leaf", "3 AS shown", "4 AS tree", "5 AS digest")
    plain = [tuple(r) for r in frame(spark, rows).select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted((tuple(r) for r in merkle.digest(docs).collect()), key=str) == by_hand(plain)
