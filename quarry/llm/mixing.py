"""Mixing sources to target weights, exactly to the word, with DataFrame functions only.

Each document gets a hash-random key. Within a source, documents lie in ranges of that
key (a range holds about RANGE_ROWS documents, whatever share of the rows the source
has); running sums within a range and totals of the ranges before it give every
document's place in its source's key order without bringing a source into one task.
A source is read in that order, over and over, until its budget is spent: whole
repeats first, then the cut, which falls inside one document.

Defined cases: a null or empty text has size 0 and takes 0 words; null is a source of
its own, the last; repeated rows are separate documents; an empty table gives an empty
result; other columns are ignored by mix() and kept by apply_mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
RANGE_ROWS = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, n_rows, source_size, target.

    The reshared limits are the water level: sources in order of limit over weight are
    filled while the level that the rest would have lies above. Works on the table of
    sources only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    choice = F.get(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    per = per.withColumn("weight", choice).withColumn("limit", F.col("source_size") * most)
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", level)
    # the level rises while sources fill and falls from the first that does not
    water = F.max("level").over(everything) * F.col("weight")
    return per.select("source", "n_rows", "source_size", F.least(F.col("limit").cast("double"), water).alias("target"))


def place(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """docs with __q_size, __q_before (words before it in its source's order), source_size
    and target as columns __q_*; no row is lost or added."""
    sized = docs.withColumns({"__q_size": size_of(F.col("text")), "__q_key": F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":" + seed)).cast("binary"))})
    per = targets(sized.select("source", F.col("__q_size").alias("size")), **how).select(
        F.col("source").alias("__q_source"), F.col("source_size").alias("__q_source_size"), F.col("target").alias("__q_target"), F.ceil(F.col("n_rows") / RANGE_ROWS).cast("long").alias("__q_ranges"))
    # written, the table of sources has a known size, so that Spark broadcasts it while it is
    # small; planned without, all texts would be dealt by their source first
    per = stash(per, "sources")
    out = sized.join(per, sized["source"].eqNullSafe(per["__q_source"]), "left").drop("__q_source")
    unit = F.conv(F.substring(F.coalesce("__q_key", F.lit("00000000")), 1, 8), 16, 10).cast("long")
    return out.withColumn("__q_range", F.floor(unit * F.col("__q_ranges") / F.lit(float(1 << 32))).cast("long"))


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of each document in the mix."""
    at = place(docs.select("doc_id", "text", "source"), seed, **how).drop("text")
    return _taken(at).select("doc_id", F.col("__q_size").alias("size"), F.col("__q_source_size").alias("source_size"), F.col("__q_target").alias("target"), F.col("__q_taken").alias("taken"))


def _taken(at: DataFrame) -> DataFrame:
    # null is a source of its own: a key that plain equality compares, so that the join below
    # finds the rows where the windows have put them
    at = at.withColumn("__q_name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    keys = ["__q_name", "__q_range"]
    totals = at.groupBy(*keys).agg(F.sum("__q_size").alias("__q_total"))
    up = Window.partitionBy("__q_name").orderBy("__q_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("__q_total").over(up), F.lit(0)).alias("__q_offset"))
    within = Window.partitionBy(*keys).orderBy("__q_key", "doc_id", "__q_size").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("__q_before", F.coalesce(F.sum("__q_size").over(within), F.lit(0)))
    at = at.join(offsets, keys, "left").drop("__q_name")
    budget = F.round(F.col("__q_target")).cast("long")
    whole = F.when(F.col("__q_source_size") > 0, F.floor(budget / F.col("__q_source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("__q_source_size")
    cut = F.least(F.greatest(rest - F.col("__q_offset") - F.col("__q_before"), F.lit(0)), F.col("__q_size"))
    return at.withColumn("__q_whole", whole).withColumn("__q_cut", cut).withColumn("__q_taken", whole * F.col("__q_size") + cut)


def apply_mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each whole repeat of a document
    and one for the last, partial epoch. The document that a budget ends in keeps its
    first words up to the cut (n_chars follows, where there is such a column)."""
    at = _taken(place(docs, seed, **how))
    times = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("__q_whole").cast("int")), F.when(F.col("__q_cut") > 0, F.array(F.col("__q_cut"))).otherwise(F.array().cast("array<bigint>")))
    rows = at.where(F.col("__q_size") > 0).withColumn("__q_words", F.explode(times))
    cutting = (F.col("__q_words") >= 0) & (F.col("__q_words") < F.col("__q_size"))
    # the text up to the end of its word number __q_words
    pieces = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*+{WORD}"), F.lit(0))
    part = F.array_join(F.slice(pieces, F.lit(1), F.col("__q_words").cast("int")), "")
    rows = rows.withColumn("text", F.when(cutting, part).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cutting, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5(doc_id::VARCHAR || ':{SEED}') AS key FROM documents),
p0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p1 AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2 * source_size AS lim FROM p0),
p2 AS (SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(lim) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
       FROM p1 WINDOW b AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT source, source_size, least(lim::DOUBLE, max(level) OVER () * w) AS target FROM p2),
r AS (SELECT doc_id, size, source_size, target, round(target)::BIGINT AS budget,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + least(greatest(budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before, 0), size))::BIGINT AS taken
FROM r"""
