"""What a database holds: collections, edges, indexes, analyzers.  Everything is an immutable DataFrame."""

from __future__ import annotations

import dataclasses
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.values import LanguageError
from .operators.search import STANDARD, Analyzer

#: Hidden column of written collections: the names of the fields that a document has (a null field is had, a missing one not).
HAS = "__has"


@dataclass(frozen=True)
class Index:
    name: str
    fields: tuple[str, ...]
    form: str = "btree"  # btree, unique, fulltext, hnsw
    options: tuple[tuple[str, Any], ...] = ()


Source = DataFrame | Callable[[], DataFrame]


class _Lazy:
    """Tables given as functions are opened when first asked for."""

    source: Source

    @property
    def df(self) -> DataFrame:
        if not isinstance(self.source, DataFrame):
            object.__setattr__(self, "source", self.source())
        return self.source


@dataclass(frozen=True)
class Collection(_Lazy):
    """``df`` has a string column ``id`` (``collection:key``); ``refs`` maps paths to the collections they refer to."""

    name: str
    source: Source
    refs: dict[tuple[str, ...], frozenset[str]] = field(default_factory=dict)
    mode: str | None = None  # None: schemaless; STRICT or FLEXIBLE
    fields: tuple[dict, ...] = ()
    indexes: tuple[Index, ...] = ()
    attributes: tuple[tuple[str, str], ...] = ()
    key: str | None = None  # the column that alone makes the id, where the scan can filter on it

    def index(self, form: str, fields: tuple[str, ...] | None = None) -> Index | None:
        return next((i for i in self.indexes if i.form == form and (fields is None or set(fields) <= set(i.fields))), None)


@dataclass(frozen=True)
class Edges(_Lazy):
    """``df`` has id, from, to and the edges' own fields."""

    label: str
    source: Source
    directed: bool = True
    single: bool = True
    on_delete: str = "cascade"  # cascade, restrict, none
    ends: tuple[frozenset[str], frozenset[str]] | None = None  # the collections that ``from`` and ``to`` refer to, where known


@dataclass
class Catalog:
    spark: SparkSession
    collections: dict[str, Collection] = field(default_factory=dict)
    edges: dict[str, Edges] = field(default_factory=dict)
    analyzers: dict[str, Analyzer] = field(default_factory=lambda: {"standard": STANDARD})
    versions: dict[str, int] = field(default_factory=dict)

    def put(self, name: str, df: Source, refs: dict[str, str] | None = None, indexes: list[Index] | None = None, **more: Any) -> Catalog:
        """Register a collection; ``refs`` maps dotted paths to collection names."""
        known = {tuple(k.split(".")): frozenset([v]) for k, v in (refs or {}).items()}
        self.collections[name] = Collection(name, df, known, indexes=tuple(indexes or ()), **more)
        return self

    def put_edges(self, label: str, df: Source, **more: Any) -> Catalog:
        self.edges[label] = Edges(label, df, **more)
        return self

    def collection(self, name: str) -> Collection:
        if name in self.collections:
            return self.collections[name]
        return Collection(name, self.spark.createDataFrame([], T.StructType([T.StructField("id", T.StringType())])))

    def need(self, name: str) -> Collection:
        if name not in self.collections:
            raise LanguageError(f"collection {name} does not exist")
        return self.collections[name]

    def change(self, name: str, **parts: Any) -> None:
        self.collections[name] = dataclasses.replace(self.need(name), **_renamed(parts))
        self.versions[name] = self.versions.get(name, 0) + 1

    def change_edges(self, label: str, **parts: Any) -> None:
        self.edges[label] = dataclasses.replace(self.edges[label], **_renamed(parts))
        self.versions["->" + label] = self.versions.get("->" + label, 0) + 1

    def copy(self) -> Catalog:
        return Catalog(self.spark, dict(self.collections), dict(self.edges), dict(self.analyzers), dict(self.versions))


def _renamed(parts: dict[str, Any]) -> dict[str, Any]:
    return {"source" if k == "df" else k: v for k, v in parts.items()}


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``; only a session on one machine (tests) gets a
    temporary one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="facet-checkpoint-"))
    return df.checkpoint(eager=True)


def keyed(df: DataFrame, collection: str, *key: str) -> DataFrame:
    """``df`` with ``id`` made of the collection's name and the key columns."""
    return df.withColumn("id", F.concat(F.lit(collection + ":"), F.concat_ws("-", *[F.col(k).cast("string") for k in key])))
