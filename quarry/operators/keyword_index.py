"""The stored search index over the documents of catalogs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import search
from quarry.operators.postings import InvertedIndex
from quarry.sources import files

#: the layout of a stored index
LAYOUT = 3


class KeywordIndex:
    """Documents of catalogs and their postings under a path, with the versions of the graphs
    that they tell of. Scores count words over all connections."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _meta(self) -> dict:
        at = f"{self.path}/_META"
        return json.loads(files.read_text(self.spark, at)) if files.exists(self.spark, at) else {}

    def needs_rebuild(self, versions: dict[str, int]) -> bool:
        """Whether there is no index, or one of another layout or of older graphs (versions by
        connection)."""
        meta = self._meta()
        return meta.get("layout") != LAYOUT or meta.get("versions") != versions

    def build(self, documents: dict[str, DataFrame], versions: dict[str, int]) -> None:
        """documents by connection, as catalog_documents gives them."""
        parts = [d.withColumn("database", F.lit(k)).withColumn("doc", F.concat_ws("::", F.lit(k), "table_name")) for k, d in sorted(documents.items())]
        every = reduce(DataFrame.unionByName, parts)
        every.write.mode("overwrite").parquet(f"{self.path}/documents")
        index = self._postings()
        index.create(self.documents(), "doc", search.WEIGHTS, stem=True)
        index.vacuum()
        files.write_text(self.spark, f"{self.path}/_META", json.dumps({"layout": LAYOUT, "versions": versions}))

    def _postings(self) -> InvertedIndex:
        return InvertedIndex(self.spark, f"{self.path}/postings")

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def search(self, q: str, k: int = 10, database: str | None = None, visible: DataFrame | None = None) -> DataFrame:
        """node_type, table_name, database, description, snippet, score of the k best tables
        that are visible (filtered before the cut, so that k are found)."""
        docs = self.documents().where("node_type = 'SchemaTable'")
        docs = docs.where(F.col("database") == database) if database else docs
        docs = docs.join(visible.select("database", "table_name").distinct(), ["database", "table_name"], "left_semi") if visible is not None else docs
        hits = self._postings().top(q, k, docs.select("doc")).join(docs, "doc")
        return hits.orderBy(F.desc("score"), "doc").limit(k).select("node_type", "table_name", "database", "description", S.snippet(F.col("description"), 160).alias("snippet"), "score")

    def similar(self, name: str, k: int = 5) -> DataFrame:
        return self.search(name.replace("_", " ").replace(".", " "), k + 1).where(F.col("table_name") != name).orderBy(F.desc("score"), "table_name").limit(k)
