"""Keyword search ranked by BM25 with field weights: over documents (bm25, which reads them
all), and over a stored index (keyword_index.py)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quarry.functions import scalars as S

K1, B = 1.2, 0.75
#: lower-case letters with marks, and the letters without them
_MARKED = "".join(c for c in map(chr, range(0xE0, 0x250)) if c.islower() and len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii())
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)
# Weights of the fields of a catalog document.
WEIGHTS = {"name": 1.0, "description": 1.0, "table_text": 1.4, "cluster_context": 0.2}


def _measure(stem: str) -> int:
    """How many vowel-consonant sequences a stem has."""
    kinds = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _short_end(w: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    n = len(w)
    return n >= 3 and not _vowel(w, n - 1) and _vowel(w, n - 2) and not _vowel(w, n - 3) and w[-1] not in "wxy"


# The suffixes of the published algorithm (Porter 1980), steps 2 to 4.
_STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split())
_STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """Porter's English stemmer."""
    w = word
    if len(w) <= 2 or not w.isascii():
        return w
    has_vowel = lambda x: any(_vowel(x, i) for i in range(len(x)))
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if has_vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short_end(w):
                        w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def folded(text: Column) -> Column:
    """Lower case without the marks of composed Latin letters."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


def plain_words(query: str) -> list[str]:
    """The words of a query, folded."""
    plain = query.lower().translate(str.maketrans(_MARKED, _PLAIN))
    return "".join(c if c.isalnum() else " " for c in plain).split()


@pandas_udf(StringType())
def stemmed(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for s in words:
        yield s.map(lambda w: known.setdefault(w, porter(w)) if w is not None else None)


def tokens(docs: DataFrame, key: str, fields: tuple[str, ...], stem: bool = False) -> DataFrame:
    """key, field, token: every word of every field."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("t")) for f in fields])
    x = docs.select(key, F.explode(parts).alias("p")).select(key, "p.field", F.explode(F.split(folded(F.col("p.t")), "[^\\p{L}\\p{N}]+")).alias("token")).where(F.col("token") != "")
    return x.withColumn("token", stemmed("token")) if stem else x


def bm25(docs: DataFrame, key: str, query: str, fields: dict[str, float] | None = None, stem: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """key, score (higher is better): documents with any word of the query.

    Only postings of the query's words are shuffled; lengths are summed before.
    """
    weights = {f: w for f, w in (fields or WEIGHTS).items() if f in docs.columns}
    every = tokens(docs, key, tuple(weights), stem)
    words = sorted({porter(w) if stem else w for w in plain_words(query)})
    weight = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(w))])
    length = every.groupBy(key).agg(F.count(F.lit(1)).alias("dl"))
    total = docs.agg(F.count(F.lit(1)).alias("n")).crossJoin(length.agg(F.sum("dl").alias("dl_sum")))
    tf = every.where(F.col("token").isin(*words)).groupBy(key, "token").agg(F.sum(F.element_at(weight, F.col("field"))).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    x = tf.join(F.broadcast(df), "token").join(length, key).crossJoin(F.broadcast(total))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") * F.col("n") / F.col("dl_sum")))
    return x.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def search(docs: DataFrame, key: str, query: str, k: int = 10, **how) -> DataFrame:
    """The k best documents with their rank; ties by key."""
    hits = bm25(docs, key, query, **how).orderBy(F.desc("score"), key).limit(k)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def similar(docs: DataFrame, key: str, name: str, k: int = 5, **how) -> DataFrame:
    """What a search for a document's own name finds besides itself."""
    return bm25(docs, key, name.replace("_", " "), **how).where(F.col(key) != name).orderBy(F.desc("score"), key).limit(k)


def catalog_documents(tables: DataFrame, columns: DataFrame, clusters: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """table_name, node_type, name, description, table_text, cluster_context: what the index
    holds of a catalog. A table's description tells its comment, description, tags, entity type
    and common values; its text the terms of its name and columns and its entities;
    clusters(table_name, label, description) give the context. entities(name, description,
    table_name) are documents of their own."""
    has = lambda c: c in tables.columns
    schema = F.when(F.col("table_name").contains("."), F.substring_index("table_name", ".", 1)).otherwise(F.lit("main"))
    bare = F.substring_index("table_name", ".", -1)
    struct = F.struct(F.coalesce("ordinal", F.lit(0)).alias("o"), F.col("column_name").alias("c"))
    names = F.transform(F.array_sort(F.collect_list(struct)), lambda x: x["c"])
    per = columns.groupBy("table_name").agg(names.alias("names"), *([F.flatten(F.collect_list(S.json_to_list(F.col("most_common_values")))).alias("values")] if "most_common_values" in columns.columns else []))
    x = tables.join(per, "table_name", "left")
    none = F.array().cast("array<string>")
    terms = S.distinct_words(F.concat(F.coalesce("names", none), F.flatten(F.transform(F.coalesce("names", none), S.name_tokens))))
    parts = [F.concat(F.lit("identifier: "), S.identifier_terms(schema, bare)), F.concat(F.lit("columns: "), F.array_join(terms, " "))]
    if entities is not None:
        said = entities.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "name", "description"))), " ").alias("_entity"))
        x = x.join(said, "table_name", "left")
        parts.append(F.concat(F.lit("entity: "), F.col("_entity")))
    context = F.lit("")
    if clusters is not None:
        c = clusters.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "label", S.first_tokens(F.col("description"))))), " ").alias("_cluster"))
        x = x.join(c, "table_name", "left")
        context = F.coalesce("_cluster", F.lit(""))
    told = [F.nullif(F.col(c), F.lit("")) for c in ("comment", "description") if has(c)]
    told += [F.concat(F.lit("tags: "), F.nullif(F.array_join("tags", " "), F.lit("")))] if has("tags") else []
    told += [F.concat(F.lit("entity_type: "), F.col("entity_type"))] if has("entity_type") else []
    told += [F.concat(F.lit("common_values: "), F.nullif(F.array_join(S.distinct_words(F.coalesce("values", none)), " "), F.lit("")))] if "values" in x.columns else []
    out = x.select("table_name", F.lit("SchemaTable").alias("node_type"), F.regexp_replace("table_name", "[_.]", " ").alias("name"), F.concat_ws(" ", *told, F.lit("")).alias("description"), F.concat_ws(" ", *parts).alias("table_text"), context.alias("cluster_context"))
    if entities is not None:
        docs = entities.select("name", "description").dropDuplicates(["name"])
        out = out.unionByName(docs.select(F.concat(F.lit("entity:"), F.col("name")).alias("table_name"), F.lit("Entity").alias("node_type"), "name", F.coalesce("description", F.lit("")).alias("description"), F.lit("").alias("table_text"), F.lit("").alias("cluster_context")))
    return out


class SearchIndex(Protocol):
    """What a search index answers: hits as frames, best first."""

    def search(self, q: str, k: int = 10, database: str | None = None) -> DataFrame: ...

    def similar(self, name: str, k: int = 5) -> DataFrame: ...
