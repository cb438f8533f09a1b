"""Enrichment from a dbt manifest: tables, lineage, consumers, tests, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.reach import reached

# Manifest versions that are known, and freshness statuses that count.
VERSIONS = ("9", "10", "11", "12")
STATUSES = ("pass", "warn", "error", "runtime error")
_NODE = "struct<resource_type:string,name:string,alias:string,schema:string,description:string,tags:array<string>,attached_node:string,columns:map<string,struct<description:string>>>"
_SOURCE = "struct<name:string,source_name:string,schema:string,identifier:string,description:string>"
SCHEMA = f"metadata struct<dbt_schema_version:string>, nodes map<string,{_NODE}>, sources map<string,{_SOURCE}>, exposures map<string,struct<name:string,depends_on:struct<nodes:array<string>>>>, parent_map map<string,array<string>>"


class Manifest:
    """Frames of a manifest: models, sources, parents, exposures, tests."""

    def __init__(self, raw: DataFrame):
        entry = lambda field, key, value: raw.select(F.explode(field).alias(key, value))
        node = entry("nodes", "id", "n")
        self.models = node.where("n.resource_type = 'model'").select("id", F.coalesce(F.nullif("n.alias", F.lit("")), "n.name").alias("table_name"), F.col("n.schema").alias("schema_name"), F.col("n.description").alias("description"), F.coalesce("n.tags", F.array().cast("array<string>")).alias("tags"), F.col("n.columns").alias("columns"))
        self.tests = node.where("n.resource_type = 'test'").select("id", F.col("n.attached_node").alias("node"))
        self.sources = entry("sources", "id", "s").select("id", F.coalesce(F.nullif("s.identifier", F.lit("")), "s.name").alias("table_name"), F.col("s.schema").alias("schema_name"), F.col("s.description").alias("description"))
        self.exposures = entry("exposures", "id", "e").select("id", F.explode("e.depends_on.nodes").alias("node"))
        self.parents = entry("parent_map", "child", "ps").select("child", F.explode("ps").alias("parent"))
        self.version = raw.select("metadata.dbt_schema_version")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Manifest:
        return cls(spark.read.schema(SCHEMA).json(path, multiLine=True))

    @classmethod
    def parse(cls, spark: SparkSession, text: str) -> Manifest:
        return cls(spark.createDataFrame([(text,)], "t string").select(F.from_json("t", SCHEMA).alias("m")).select("m.*"))

    def tables(self) -> DataFrame:
        """id, schema_name, table_name of models and sources."""
        return self.models.select("id", "schema_name", "table_name").unionByName(self.sources.select("id", "schema_name", "table_name"))


def lineage(m: Manifest) -> DataFrame:
    """src_table, dst_table of parents whose both ends are known."""
    t = m.tables().select("id", F.concat_ws(".", "schema_name", "table_name").alias("t"))
    x = m.parents.join(t.select(F.col("id").alias("parent"), F.col("t").alias("src_table")), "parent").join(t.select(F.col("id").alias("child"), F.col("t").alias("dst_table")), "child")
    return x.select("src_table", "dst_table").where("src_table <> dst_table").distinct()


def external_consumers(m: Manifest) -> DataFrame:
    """table_name of everything that an exposure reaches upstream."""
    seed = m.exposures.select(F.col("node").alias("seed")).distinct()
    # one seed for all: what matters is whether an exposure leads there
    up = reached(seed.select(F.lit("exposures").alias("seed")).distinct(), m.parents.unionByName(seed.select(F.lit("exposures").alias("child"), F.col("seed").alias("parent"))))
    ids = up.select(F.col("node").alias("id"))
    return m.tables().join(ids, "id", "left_semi").select(F.concat_ws(".", "schema_name", "table_name").alias("table_name")).distinct()


def test_counts(m: Manifest) -> DataFrame:
    """table_name, n_tests of models; tests of anything else do not count."""
    n = m.tests.where(F.startswith("node", F.lit("model."))).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("n_tests"))
    return m.models.join(n, "id").select(F.concat_ws(".", "schema_name", "table_name").alias("table_name"), "n_tests")


def enrich(tables: DataFrame, m: Manifest) -> DataFrame:
    """tables(table_name as schema.table, description, tags) with descriptions where there
    were none, and the union of tags."""
    d = m.models.select(F.concat_ws(".", "schema_name", "table_name").alias("table_name"), F.col("description").alias("d"), F.col("tags").alias("g"))
    x = tables.join(d, "table_name", "left")
    empty = F.coalesce(F.trim("description"), F.lit("")) == ""
    return x.select("table_name", F.when(empty, F.col("d")).otherwise(F.col("description")).alias("description"), F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("g", F.array().cast("array<string>")))).alias("tags"))


def freshness(results: DataFrame, m: Manifest) -> DataFrame:
    """results(unique_id, status) -> table_name, status, as_of, for the statuses that count."""
    ok = results.where(F.col("status").isin(*STATUSES))
    as_of = F.col("max_loaded_at") if "max_loaded_at" in results.columns else F.lit(None).cast("string")
    return m.sources.join(ok, m.sources["id"] == ok["unique_id"]).select(F.concat_ws(".", "schema_name", "table_name").alias("table_name"), "status", as_of.alias("as_of"))


def source_results(raw: DataFrame) -> DataFrame:
    """unique_id, status, max_loaded_at of a freshness file's text (one row, column t): a list
    of results, or the older map from id to result."""
    one = "struct<unique_id:string,status:string,state:string,max_loaded_at:string>"
    listed = raw.select(F.explode(F.from_json("t", f"results array<{one}>")["results"]).alias("r")).select("r.*")
    mapped = raw.select(F.explode(F.from_json("t", f"sources map<string,{one}>")["sources"]).alias("id", "r")).select(F.coalesce("r.unique_id", "id").alias("unique_id"), "r.status", "r.state", "r.max_loaded_at")
    both = listed.unionByName(mapped)
    return both.select("unique_id", F.lower(F.coalesce("status", "state")).alias("status"), "max_loaded_at").where("unique_id IS NOT NULL AND status IS NOT NULL")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    return source_results(spark.read.text(path, wholetext=True).withColumnRenamed("value", "t"))


def column_descriptions(columns: DataFrame, m: Manifest) -> DataFrame:
    """columns(table_name, column_name, ...) with `description` from the manifest where the
    column has none; names are compared whatever their case."""
    d = m.models.select(F.concat_ws(".", "schema_name", "table_name").alias("table_name"), F.explode("columns").alias("c", "v")).select(F.lower("table_name").alias("_t"), F.lower("c").alias("_c"), F.trim("v.description").alias("_d")).where("_d <> ''").dropDuplicates(["_t", "_c"])
    own = F.col("description") if "description" in columns.columns else F.lit(None).cast("string")
    x = columns.withColumn("description", own).join(d, (F.lower("table_name") == F.col("_t")) & (F.lower("column_name") == F.col("_c")), "left")
    return x.withColumn("description", F.when(F.coalesce(F.trim("description"), F.lit("")) == "", F.col("_d")).otherwise(F.col("description"))).drop("_t", "_c", "_d")


def run(m: Manifest, tables: DataFrame, columns: DataFrame, lineage_rows: DataFrame, results: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Everything that a manifest tells of a catalog: (tables, columns, lineage, summary). tables
    get description, tags, test_count, has_external_consumers, staleness_status and
    staleness_as_of; lineage of an earlier manifest is replaced. Steps: lineage, metadata,
    freshness, exposures, tests."""
    t = tables
    for c, kind in (("description", "string"), ("tags", "array<string>")):
        t = t if c in t.columns else t.withColumn(c, F.lit(None).cast(kind))
    known = t.select("table_name")
    edge = lineage(m)
    for end in ("src_table", "dst_table"):
        edge = edge.join(known.withColumnRenamed("table_name", end), end, "left_semi")
    made = edge.select("src_table", "dst_table", F.lit("DBT_MODEL").alias("lineage_type"), F.lit(1.0).alias("confidence"))
    lines = lineage_rows.where(F.col("lineage_type") != "DBT_MODEL").select("src_table", "dst_table", "lineage_type", "confidence").unionByName(made)
    meta = enrich(t.select("table_name", "description", "tags"), m).withColumnsRenamed({"description": "_d", "tags": "_g"})
    fresh = freshness(results, m).groupBy("table_name").agg(F.max_by("status", "as_of").alias("staleness_status"), F.max("as_of").alias("staleness_as_of")) if results is not None else None
    out = t.join(meta, "table_name", "left")
    added = out.agg(F.sum(F.size(F.array_except(F.coalesce("_g", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>"))))).alias("tags"), F.count_if((F.coalesce(F.trim("description"), F.lit("")) == "") & (F.coalesce(F.trim("_d"), F.lit("")) != "")).alias("descriptions"), F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.trim("_d"), F.lit("")) != "").alias("covered")).first()
    out = out.drop("description", "tags").withColumnsRenamed({"_d": "description", "_g": "tags"})
    if fresh is not None:
        out = out.drop("staleness_status", "staleness_as_of").join(fresh, "table_name", "left")
    outside = external_consumers(m).withColumn("has_external_consumers", F.lit(True))
    out = out.drop("has_external_consumers").join(outside, "table_name", "left").withColumn("has_external_consumers", F.coalesce("has_external_consumers", F.lit(False)))
    tests = test_counts(m).withColumnRenamed("n_tests", "test_count")
    out = out.drop("test_count").join(tests, "table_name", "left")
    cols = column_descriptions(columns, m)
    version = m.version.first()
    summary = {
        "lineage_edges": made.count(), "descriptions_added": added["descriptions"], "tags_added": int(added["tags"] or 0), "tables": added["n"], "description_coverage": round(added["covered"] / max(added["n"], 1), 6),
        "external_consumers": outside.join(known, "table_name", "left_semi").count(), "tested_models": tests.join(known, "table_name", "left_semi").count(), "sources_fresh": fresh.count() if fresh is not None else 0,
        "warnings": [] if version and any(f"/v{k}." in (version[0] or "") for k in VERSIONS) else [f"manifest version {version[0] if version else None!r} is not one of {VERSIONS}"],
    }
    return out, cols, lines, summary
