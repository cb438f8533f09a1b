"""Licence notices in short, possibly damaged wording.

Words are compared, lower-cased, joined by single spaces. For a notice that may have k
edits, the pigeonhole principle gives k + 1 pieces of which one must occur exactly; one
search automaton finds all pieces of all notices, and only around such seeds the regex
library's bounded-error matching ({e<=k}) verifies the edits and reports the span. Word
borders are part of the search; the best match of a stretch is taken first, then what lies
before and behind it is searched again.

Defined cases: a null or empty text has no words and no labels; rows are independent; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, bound_batches, passes, tidy

#: phrase -> label, as the base search takes them
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int


#: What the fuzzy search looks for; edits counts letters.
NOTICES = (
    Notice("under the mit license", "mit", 2),
    Notice("apache license version 2", "apache-2", 2),
    Notice("licensed under cc by nc", "cc-by-nc", 1),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 3),
    Notice("creative commons attribution sharealike", "cc-by-sa", 3),
    Notice("gnu general public license", "gpl", 2),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("mozilla public license", "mpl", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("all rights reserved", "proprietary", 1),
)

# a-z0-9 and bytes of non-ASCII characters are kept, A-Z lowered, the rest separates
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of the phrase and where they start; at most edits can be damaged."""
    n, k = len(phrase), edits + 1
    cuts = [round(i * n / k) for i in range(k + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        import ahocorasick
        import regex

        self.notices = notices
        self.match = [regex.compile(f"(?<![^ ])(?:{regex.escape(n.phrase, special_only=True)}){{e<={n.edits}}}(?![^ ])", regex.BESTMATCH) for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for at, piece in pieces(n.phrase, n.edits):
                seeds.setdefault(piece, []).append((i, at))
        self.auto = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.auto.add_word(piece, (len(piece), where))
        self.auto.make_automaton()

    def best(self, i: int, line: str, padded: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) of a notice's matches in line[a:b], whole words at both ends;
        padded is ". " and the line."""
        # words that a or b cuts are left out
        if 0 < a < len(line) and line[a - 1] != " ":
            a = line.find(" ", a, b) + 1 or b
        if b < len(line) and line[b] != " ":
            b = line.rfind(" ", a, b)
        todo = [(a, b)]
        least = len(self.notices[i].phrase) - self.notices[i].edits
        while todo:
            a, b = todo.pop()
            if b - a < least:
                continue
            # from the space before: the library allows no insertion where a search starts
            m = self.match[i].search(padded, a + 1, b + 2)
            if m:
                s, e = m.start() - 2, m.end() - 2
                yield s, e, sum(m.fuzzy_counts)
                todo += [(e + 1, b), (a, s - 1)]

    def fuzzy(self, line: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in line, whole words at both ends."""
        zones: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.auto.iter(line):
            for i, at in where:
                n = self.notices[i]
                a = max(0, last + 1 - size - at - n.edits - 1)
                b = last + 1 - size - at + len(n.phrase) + n.edits + 1
                own = zones.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        found, padded = [], ". " + line
        for i, spans in zones.items():
            n = self.notices[i]
            for a, b in spans:
                # a zone of many seeds is searched in steps: every match ends within one
                step = 4 * len(n.phrase)
                own = set()
                for c in range(a, min(b, len(line)), step):
                    own.update(self.best(i, line, padded, c, min(b, c + step + 2 * len(n.phrase))))
                # steps overlap: of two matches in one place that of fewer edits stays
                last = None
                for s, e, k in sorted(own):
                    if last and s < last[1]:
                        last = min(last, (s, e, k), key=lambda x: x[2])
                    else:
                        if last:
                            found.append((i, *last))
                        last = (s, e, k)
                if last:
                    found.append((i, *last))
        return found

    def scan(self, text: bytes) -> dict:
        words = words_of(text)
        line = b" ".join(words)
        padded = b" " + line + b" "
        base: list[tuple[int, str]] = []
        for phrase, label in BASE:
            key, at = b" " + phrase.encode() + b" ", -1
            while (at := padded.find(key, at + 1)) >= 0:
                base.append((at, label))
        if base:
            begin = [0, *accumulate(len(w) + 1 for w in words)]
            base = [(bisect_left(begin, at), label) for at, label in base]
        spans = []
        if line:
            whole = line.decode()
            fuzzy = self.fuzzy(whole)
            if fuzzy:
                begin = [0, *accumulate(len(w) + 1 for w in whole.split(" "))]
                spans = sorted((bisect_left(begin, s), bisect_left(begin, e), self.notices[i].label, whole[s:e], n, 1.0 - n / len(self.notices[i].phrase)) for i, s, e, n in fuzzy)
        places = [p for p, _ in base]
        base_labels = sorted({x for _, x in base})
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(base_labels), "labels": ",".join(sorted({*base_labels, *(x[2] for x in spans)})), "score": max([1.0] * bool(base) + [x[5] for x in spans], default=0.0),
            "spans": [{"first_word": a, "end_word": b, "label": x, "found": t, "edits": n} for a, b, x, t, n, _ in spans],
        }


@lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...] = NOTICES) -> Scanner:
    return Scanner(notices)


_FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word: long, end_word: long, label: string, found: string, edits: int>>"


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id and, of every whole text, the word count, the base search's places and
    labels, all labels, a score in 0..1 and the fuzzy spans (words first_word to
    end_word - 1) with their edits."""
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("found", pa.string()), ("edits", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scanner(notices)
        for batch in batches:
            for i, j in passes(batch, "text"):
                part = batch.slice(i, j - i)
                rows = [{"doc_id": d} | one.scan(t) for d, t in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, " + _FIELDS)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document; spans as label:first_word:end_word:edits, comma-joined."""
    written = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first_word"].cast("string"), s["end_word"].cast("string"), s["edits"].cast("string"))), ",")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", written.alias("spans"))
