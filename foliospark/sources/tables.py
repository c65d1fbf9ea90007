"""Tables that change under a manifest: rows by key with base and deltas, and rows that are only added.

Every layer of a keyed table is bucketed and sorted by the key, in the same number of buckets. A read takes of each
layer the keys that no later layer has; layers meet bucket by bucket, so no history is shuffled or sorted anew, and
a join of two tables by the key needs no exchange.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.manifest import Manifest, Section

DATABASE = "foliospark_layers"
MOST_DELTAS = 4


class MergeTable:
    """One row a key: the last one written."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "book_id", buckets: int = 8, manifest: Manifest | Section | None = None):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        self.columns = [c.split()[0] for c in schema.split(",")]
        self.manifest = manifest or Manifest(spark, self.root)

    def layers(self) -> list[str]:
        """Names of the layers, the base first."""
        return self.manifest.latest()[1].get("layers", [])

    def _layer(self, name: str) -> DataFrame:
        """A layer as a bucketed table of the session's catalogue, which knows it by its folder."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
        place = f"{self.manifest.files.root.toString()}/{name}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {DATABASE}.t{name} ({self.schema}) USING parquet CLUSTERED BY ({self.key}) "
            f"SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        return self.spark.table(f"{DATABASE}.t{name}")

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
        place = f"{self.manifest.files.root.toString()}/{name}"
        dealt = rows.select(*self.columns).repartition(self.buckets, self.key)
        dealt.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", place).format("parquet").saveAsTable(f"{DATABASE}.t{name}")
        return name

    def read(self) -> DataFrame:
        """The last row of every key."""
        return self._merged(self.layers())

    def _parts(self, names: list[str]) -> list[DataFrame]:
        """Of each layer the rows whose keys no later layer has."""
        layers = [self._layer(n) for n in names]
        out = []
        for i, rows in enumerate(layers):
            for later in layers[i + 1 :]:
                rows = rows.join(later.select(self.key), self.key, "left_anti")
            out.append(rows.select(*self.columns))
        return out

    def _merged(self, names: list[str]) -> DataFrame:
        parts = self._parts(names)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def join(self, other: MergeTable, how: str = "inner") -> DataFrame:
        """Rows of both tables by their common key (inner or left): each pair of layers meets in its buckets."""
        right = other._parts(other.layers())
        out = []
        for rows in self._parts(self.layers()):
            inner = [rows.join(r, self.key) for r in right]
            if how == "left":
                rest = rows
                for r in right:
                    rest = rest.join(r.select(self.key), self.key, "left_anti")
                kinds = dict(other.spark.createDataFrame([], other.schema).dtypes)
                inner.append(rest.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in other.columns if c != self.key]))
            out += inner
        if out:
            return reduce(DataFrame.unionByName, out)
        return self.read().join(other.read(), self.key, how)

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Puts rows in as one delta; of several rows of a key the last by `order` counts (any, if there is none).

        A row with a null key is left out. Beyond MOST_DELTAS deltas the deltas become one, so a read meets few layers.
        """
        base, state = self.manifest.latest()
        rest = [c for c in self.columns if c != self.key]
        one = rows.where(F.col(self.key).isNotNull())
        one = one.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.col(order) if order else F.lit(0)).alias("_r")).select(self.key, "_r.*")
        layers = [*state.get("layers", []), self._write(one)]
        if len(layers) > MOST_DELTAS + 1:
            layers = [layers[0], self._write(self._merged(layers[1:]))]
        self.manifest.commit(base, {**state, "layers": layers})

    def compact(self) -> None:
        """Makes all layers one base; the rows stay as they are."""
        base, state = self.manifest.latest()
        layers = state.get("layers", [])
        if len(layers) > 1:
            self.manifest.commit(base, {**state, "layers": [self._write(self._merged(layers))]})

    def drop_unnamed(self, states: list[dict]) -> None:
        """Removes the layers that none of these states names."""
        named = {n for s in states for n in s.get("layers", [])}
        for name in self.manifest.files.names():
            if name not in named and not name.startswith("_"):
                self.spark.sql(f"DROP TABLE IF EXISTS {DATABASE}.t{name}")
                self.manifest.files.delete(name)


class AppendTable:
    """Rows that are only ever added, in parts."""

    def __init__(self, spark: SparkSession, root: str, schema: str, manifest: Manifest | Section | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.manifest = manifest or Manifest(spark, self.root)

    def read(self) -> DataFrame:
        paths = [f"{self.root}/{n}" for n in self.manifest.latest()[1].get("parts", [])]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> None:
        base, state = self.manifest.latest()
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{name}")
        self.manifest.commit(base, {**state, "parts": [*state.get("parts", []), name]})

    def compact(self, most: int = 16) -> None:
        """Makes more than `most` parts one."""
        base, state = self.manifest.latest()
        if len(state.get("parts", [])) > most:
            name = uuid.uuid4().hex
            self.read().write.parquet(f"{self.root}/{name}")
            self.manifest.commit(base, {**state, "parts": [name]})

    def drop_unnamed(self, states: list[dict]) -> None:
        named = {n for s in states for n in s.get("parts", [])}
        for name in self.manifest.files.names():
            if name not in named and not name.startswith("_"):
                self.manifest.files.delete(name)
