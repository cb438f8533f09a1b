"""What can be set or exchanged, in one place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from importlib.metadata import entry_points
from typing import Any, Protocol

from pyspark.sql import DataFrame

from quarry.operators import discover, keyword_index, paths, semantic


@dataclass(frozen=True)
class GraphConfig:
    """Defaults of the graph's operators."""

    stale_after_days: int = 7
    resolution: float | None = None  # of the clustering; by the number of tables where none is set
    path_depth: int = paths.MAX_DEPTH
    least_cluster: int = 3
    collapse_aliases: bool = True
    alias_sources: int = 1
    merge_profiles: bool = False  # profile files once each, by sketches that merge, in place of exact passes
    measure_overlaps: bool = True  # blend guessed joins with the values of tables that can be read


class RelationshipClient(Protocol):
    """A language model's guesses of joins: rows of (src_table, src_column, dst_table,
    dst_column, confidence, reasoning) for a catalog's columns."""

    def infer(self, columns: DataFrame) -> DataFrame | None: ...


class NoRelationships:
    def infer(self, columns: DataFrame) -> DataFrame | None:
        return None


class EmbeddingClient(Protocol):
    """Texts to vectors, as a frame's added column."""

    def embed(self, texts: DataFrame, column: str, into: str) -> DataFrame: ...


def model_scorer(client: RelationshipClient) -> discover.Scorer | None:
    """A scorer of a client's guesses; none for a client without any."""
    if isinstance(client, NoRelationships):
        return None

    def score(columns: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        got = client.infer(columns)
        empty = discover.naming_candidates(columns).limit(0)
        return empty if got is None else got.select(F.lit("llm").alias("kind"), "src_table", "src_column", "dst_table", "dst_column", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence"), "reasoning").select(*empty.columns)

    return score


@dataclass(frozen=True)
class Config:
    graph: GraphConfig = field(default_factory=GraphConfig)
    scorers: tuple[tuple[str, discover.Scorer], ...] = ()
    combine: Callable[[DataFrame], DataFrame] = discover.strongest
    search_index: type = keyword_index.KeywordIndex
    layer: semantic.Layer = field(default_factory=lambda: semantic.Layer(()))
    relationships: RelationshipClient = field(default_factory=NoRelationships)

    def every_scorer(self) -> dict[str, discover.Scorer]:
        model = model_scorer(self.relationships)
        return discover.SCORERS | dict(self.scorers) | ({"llm": model} if model else {})

    def with_graph(self, **changes: Any) -> Config:
        return replace(self, graph=replace(self.graph, **changes))


def plugins(group: str = "quarry.commands") -> dict[str, Callable]:
    """Commands that installed packages add; one that cannot be loaded is left out."""
    out = {}
    for e in entry_points(group=group):
        try:
            out[e.name] = e.load()
        except Exception:  # another package's fault does not stop the others
            continue
    return out
