import numpy as np
import pytest
import hashlib
import random
import re

from llm_frames import frame
from test_dedup import WORD, as_dict

import corpus_pipeline
from quarry.llm import decontam, fingerprint, jaccard, license_scan, pii
from quarry.llm.common import CHUNK_BYTES


def grams_of(text, words):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def near_groups(rows, words, num, den):
    """doc_id: (shingles, least doc_id reachable by links), pair by pair."""
    sets = {d: grams_of(t, words) for d, t in rows}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b])
            if a < b and common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    return {d: (len(sets[d]), root[d]) for d in sets}


def test_near_duplicates_stage_takes_five_words_and_08(spark):
    base = [f"n{i}" for i in range(104)]
    near = base[:30] + ["x"] + base[31:70] + ["y"] + base[71:]
    five, three = (len(grams_of(" ".join(base), k) & grams_of(" ".join(near), k)) / len(grams_of(" ".join(base), k) | grams_of(" ".join(near), k)) for k in (5, 3))
    assert five >= 0.8 and three < 0.9
    docs = frame(spark, [(4, " ".join(base)), (9, " ".join(near)), (11, "other words stand here alone")])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()) == [4, 11]
    assert sorted(r.doc_id for r in jaccard.representatives(docs).collect()) == [4, 9, 11]


def test_jaccard_rule_of_the_stage_equals_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for size in (1, 2, 4, 5, 6, 7, 8, 9, 10, 13, 17, 24, 40, 75, 160, 300):
        base = [f"v{rng.randrange(900)}" for _ in range(size)]
        for _ in range(10):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                i, r = rng.randrange(len(w)), rng.random()
                w[i : i + 1] = [f"v{rng.randrange(900)}"] if r < 0.6 else [] if r < 0.8 and len(w) > 1 else [w[i], "more"]
            rows.append((len(rows), " ".join(w)))
    rule = corpus_pipeline.NEAR
    want = near_groups(rows, 5, 4, 5)
    assert as_dict(jaccard.classes(frame(spark, rows), rule)) == want
    assert 20 < len({r for _, r in want.values()}) < 140


def test_decontamination_budget_is_12_percent(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnoprstuvwy"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    rows, items, most = [], [], {60: 6, 100: 11, 200: 23, 394: 47}
    for k, (size, edits) in enumerate(most.items()):
        t = " ".join(word() for _ in range(size))[:size].strip()
        t += "z" * (size - len(t))
        items.append((k, t))
        step = size / edits
        at = [int(j * step) for j in range(edits)]
        for d, every in ((10 * k, at), (10 * k + 1, at[:-1]), (10 * k + 2, at[: edits // 2])):
            w = list(t)
            for i in every:
                w[i] = "q"  # no item has it
            rows.append((d, "X " + "".join(w) + " and more"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(frame(spark, rows), bench).collect()}
    assert got == {(d, d // 10) for d, _ in rows}
    assert decontam.clean(frame(spark, rows), bench).count() == 0


def test_bit_vectors_equal_plain_edit_distance():
    rng = random.Random(3)
    text = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    for _ in range(300):
        p, z = text(rng.randint(1, 12)), text(rng.randint(0, 20))
        for fixed in (False, True):
            row = list(range(len(p) + 1))
            want = [row[-1]]
            for j, c in enumerate(z):
                new = [j + 1 if fixed else 0]
                for i, x in enumerate(p):
                    new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
                row = new
                want.append(row[-1])
            assert list(decontam.distances(p, z, fixed)) == want
        got = decontam.placed(p, z, len(p))
        assert min(decontam.distances(p, z[got[1] : got[2]], True)) == got[0] == list(decontam.distances(p, z[got[1] : got[2]], True))[-1]


def test_fingerprints_of_a_partition_that_begins_with_a_long_text(spark):
    long = "w1 longer " * (CHUNK_BYTES // 10 + 10)
    for rows in ([(5, long), (4, "b c d e f g"), (3, "h i j k l m n")], [(3, "short first"), (2, long), (1, "last of all")], [(2, long), (1, long + "x")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        usual = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        try:
            got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", usual)
        assert sorted(got) == sorted(d for d, _ in rows)
        for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
            edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())


def test_pii_finds_account_numbers_whatever_follows(spark):
    de, gb, no = "DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947"
    spaced = "DE89 3704 0044 0532 0130 00"
    cases = {
        f"pay to {de} Please": [de], f"pay to {de} 2024 or so": [de], f"pay to {de} AND THEN": [de], f"pay to {spaced} EUR 100": [spaced], f"{spaced} GB82 WEST 1234 5698 7654 32": [spaced, "GB82 WEST 1234 5698 7654 32"],
        f"{de} {gb} {no}": [de, gb, no], f"é {no} X": [no], f"{de}a {de}0": [], f"x{de}": [], f"{de}, {de}": [de, de], f"{de[:-1]}1 Please": [], spaced: [spaced], "AB12 3456": [],
    }
    got = {r.doc_id: r.spans for r in pii.detect(frame(spark, list(enumerate(cases)))).collect()}
    for d, (text, want) in enumerate(cases.items()):
        spans = [s for s in got[d] if s.kind == "iban"]
        assert [s.found for s in spans] == want == [text[s.start : s.end] for s in spans], text


def test_license_notices_at_word_borders_and_before_better_ones():
    one = license_scan.scanner()
    found = lambda t: [(x["label"], x["found"], x["edits"]) for x in one.scan(t.encode())["spans"]]
    assert found("released under the mit licenses here") == [("mit", "under the mit licenses", 1)]
    assert found("released xunder the mit license") == [("mit", "xunder the mit license", 1)]
    assert found("released under the mit licence and thunder the mit license text")[0] == ("mit", "under the mit licence", 1)
    assert found("undr the mit licence or under the mit license") == [("mit", "undr the mit licence", 2), ("mit", "under the mit license", 0)]
    assert found("wander the mittens license") == []
    assert len(found("under the mit licence " * 40)) == 40


def test_license_matches_equal_plain_edit_distance():
    rng = random.Random(14)
    one = license_scan.scanner()
    for _ in range(150):
        n = rng.choice(license_scan.NOTICES)
        s = list(n.phrase)
        for _ in range(rng.randint(0, n.edits + 2)):
            i, r = rng.randrange(len(s) + 1), rng.random()
            s[i : i + (r < 0.6)] = rng.choice(["q", "x", ""]) if r < 0.6 else "z"
        line = " ".join(f"aa a {''.join(s)} bb b".split())
        w = line.split()
        spans = [" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)]
        least = min(list(decontam.distances(n.phrase.encode(), x.encode(), True))[-1] for x in spans)
        got = [k for i, _, _, k in one.fuzzy(line) if one.notices[i] == n]
        assert (min(got) == least) if least <= n.edits else not got, line


@pytest.mark.parametrize("rule", [jaccard.OP8, jaccard.Rule(5, 4, 5), jaccard.Rule(2, 3, 4)])
def test_linked_sets_share_a_block_of_the_index(rule):
    """Sets that are only just linked, of all sizes; whatever differs."""
    rng = np.random.default_rng(11)
    for size in [*range(1, 60), 90, 200, 471, 1500]:
        ids, h, n = [], [], []
        for _ in range(6):
            most = size * rule.den // rule.num
            y = np.unique(rng.integers(0, 1 << 63, most + 8, dtype=np.uint64))[:most]
            more = int(rng.integers(size, most + 1))
            common = -(-rule.num * (size + more) // (rule.den + rule.num))
            if common > size:
                continue
            x = np.concatenate([y[:common], rng.integers(0, 1 << 63, size - common, dtype=np.uint64)])
            for z in (x, y[:more]):
                if rule.linked(common, size + more - common):
                    ids.append(np.full(len(z), len(n)))
                    h.append(np.sort(z))
                    n.append(len(z))
        if not n:
            continue
        owner, key, before = jaccard.blocks(np.concatenate(ids), np.concatenate(h), np.array(n), rule)
        assert (before <= np.array(n)[owner]).all()
        for i in range(0, len(n), 2):
            assert set(key[owner == i].tolist()) & set(key[owner == i + 1].tolist()), (size, n[i], n[i + 1])


def test_lists_over_many_batches_tell_the_same_as_one():
    """_led over batches of any size: the pairs with leaders, and the lists that go on."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = sorted((int(g), int(rng.integers(0, 40)), int(rng.integers(40, 60)) << 32 | int(rng.integers(0, 12))) for g in np.sort(rng.integers(0, 60, 400)))
    rows = list({(g, d): (g, d, at) for g, d, at in rows}.values())
    cols = [np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)]

    def told(step):
        batches = (pa.RecordBatch.from_arrays([pa.array(c[i : i + step]) for c in cols], ["g", "doc", "at"]) for i in range(0, len(rows), step))
        lists, pairs = set(), set()
        for b in jaccard._led(batches, jaccard.OP8):
            for r in b.to_pylist():
                (lists if r["kind"] == jaccard.LIST else pairs).add((r["g"], r["a"], r["b"]) if r["kind"] == jaccard.LIST else (r["a"], r["b"]))
        return lists, pairs

    whole = told(len(rows))
    near = lambda x, y: bool(jaccard._near(jaccard.OP8, np.array([x]), np.array([y]))[0])
    for step in (1, 2, 3, 7, 50):
        lists, pairs = told(step)
        assert pairs == whole[1]
        # what a list in parts tells more than it needs is harmless; it never tells less
        assert whole[0] <= lists
    by_list = {}
    for g, d, at in rows:
        by_list.setdefault(g, []).append((d, at))
    for g, members in by_list.items():
        several = [(x, y) for i, x in enumerate(members) for y in members[i + 1 :] if near(x[1], y[1])]
        kept = {d for h, d, _ in whole[0] if h == g}
        if several and len(members) > 2:
            assert kept == {d for d, _ in members}
        elif several:
            assert {(x[0], y[0]) for x, y in several} <= whole[1]
        else:
            assert not kept


def test_licence_base_search_equals_a_plain_one():
    from quarry.llm import license_scan

    rng = random.Random(17)
    parts = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "x", "MIT", "License", "é", "2a"]
    one = license_scan.scanner()
    seen = set()
    for _ in range(1500):
        text = "".join(rng.choice(parts) + rng.choice([" ", "  ", "-", ".\n", "/", "_", ""]) for _ in range(rng.randint(0, 30)))
        if rng.random() < 0.5:
            text += rng.choice([p for p, _ in license_scan.BASE]).replace(" ", rng.choice([" ", "-", "; "])).upper()
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        got = one.scan(text.encode())
        assert got["n_words"] == len(words) and got["n_base"] == len(places)
        assert (got["first_word"], got["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert got["base_labels"] == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(got["labels"].split(","))
        for s in got["spans"]:
            assert " ".join(words[s["first_word"] : s["end_word"]]) == s["found"]
        seen |= {x for _, x in places}
    assert len(seen) == 3
