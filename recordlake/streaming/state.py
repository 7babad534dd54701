"""Tables that a stream adds to, batch by batch: all of a batch, exactly once.

A batch writes its rows into folders of their own and then puts one version in place
that names them, so a batch that fails half way leaves nothing behind, and one that is
delivered again after its version was written changes nothing.

Keyed tables answer what earlier batches know of the keys of this one (seen keys, sums,
last positions).  Their rows are dealt into buckets by a hash of the key, sorted, and
written with Bloom filters; a batch opens only the buckets that it touches.  Folders of
one size class are merged when there are ``FAN_IN`` of them, as in a log-structured
tree: a bucket has a few files per class, and a row is rewritten once per class.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.snapshots import SnapshotLog

#: Folders of one size class before they are merged.
FAN_IN = 8
#: Batches of at most so many keys look them up by value, which Bloom filters and statistics of the files answer.
FEW_KEYS = 200


@dataclass(frozen=True)
class KeyedTable:
    """``schema`` names all columns; those that are no keys have the SQL aggregate that merges them in ``merge``."""

    name: str
    schema: str
    keys: tuple[str, ...]
    merge: dict[str, str]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row for each key."""
        if not self.merge:
            return rows.select(*self.keys).distinct()
        return rows.groupBy(*self.keys).agg(*[F.expr(sql).alias(c) for c, sql in self.merge.items()])


class StreamTarget:
    """Keyed and plain tables under one path, with one version for each batch."""

    def __init__(self, spark: SparkSession, path: str, keyed: Sequence[KeyedTable] = ()):
        self.spark, self.path = spark, path
        self.keyed = {t.name: t for t in keyed}
        self.log = SnapshotLog(spark, path)

    def begin(self, batch_id: int) -> "Batch | None":
        """The batch to fill, or None if it is in the table already."""
        if self.log.has(batch_id):
            return None
        before = self.log.latest(before=batch_id) or {"tables": {}}
        return Batch(self, batch_id, before["tables"])

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """All rows of a plain table, or one row for each key of a keyed one."""
        now = self.log.latest() or {"tables": {}}
        folders = now["tables"].get(name, [])
        table = self.keyed.get(name)
        schema = table.schema if table else schema
        paths = self.places(folders)
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        rows = reader.parquet(*paths)
        return table.merged(rows) if table else rows

    def places(self, folders: list[dict], touched: set[int] | None = None) -> list[str]:
        """Folders to read; of keyed tables their buckets, all or the touched ones."""
        out = []
        for f in folders:
            if "buckets" in f:
                out += [f"{self.path}/{f['path']}/bucket={b}" for b in f["buckets"] if touched is None or b in touched]
            else:
                out.append(f"{self.path}/{f['path']}")
        return out

    def remove_unused(self) -> list[str]:
        """Remove folders that the newest version does not name; nobody may still read an older one."""
        now = self.log.latest()
        named = {f["path"] for fs in now["tables"].values() for f in fs} if now else set()
        gone = [f"{t}/{f}" for t in self.log.folders("") if t != "_log" for f in self.log.folders(t) if f"{t}/{f}" not in named]
        for path in gone:
            self.log.remove(path)
        return gone


class Batch:
    """One batch of a ``StreamTarget``; nothing is seen before ``commit``."""

    def __init__(self, target: StreamTarget, batch_id: int, tables: dict[str, list[dict]]):
        self.target, self.batch_id = target, batch_id
        self.tables = {name: list(folders) for name, folders in tables.items()}

    def earlier(self, name: str, rows: DataFrame) -> DataFrame:
        """What the batches before know of the keys of ``rows``: one row for each key they know.

        The driver reads the numbers of the touched buckets, and the keys themselves
        if there are only ``FEW_KEYS``.
        """
        table, spark = self.target.keyed[name], self.target.spark
        keys = rows.select(*table.keys).distinct()
        touched = {r[0] for r in keys.select(table.bucket()).distinct().collect()}
        paths = self.target.places(self.tables.get(name, []), touched)
        if not paths:
            return spark.createDataFrame([], table.schema)
        known = spark.read.schema(table.schema).parquet(*paths)
        last = table.keys[-1]
        few = [r[0] for r in keys.select(last).distinct().limit(FEW_KEYS + 1).collect()]
        if len(few) <= FEW_KEYS:
            # Files are sorted by key: their statistics and Bloom filters rule most of them out.
            spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(FEW_KEYS))
            known = known.filter(F.col(last).isin(few))
        return table.merged(known.join(keys, list(table.keys), "left_semi"))

    def add(self, name: str, rows: DataFrame) -> DataFrame:
        """Write rows of this batch; returns them as written."""
        return self._write(name, rows, 0)

    def _write(self, name: str, rows: DataFrame, tier: int) -> DataFrame:
        table, path = self.target.keyed.get(name), f"{name}/{self.batch_id:020d}-{uuid.uuid4().hex[:8]}"
        place = f"{self.target.path}/{path}"
        folder = {"path": path, "tier": tier}
        if table is None:
            rows.write.parquet(place)
        else:
            placed = rows.withColumn("bucket", table.bucket()).repartition("bucket").sortWithinPartitions("bucket", *table.keys[::-1])
            writer = placed.write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{table.keys[-1]}", "true")
            writer.parquet(place)
            folder["buckets"] = [int(f.split("=")[1]) for f in self.target.log.folders(path) if f.startswith("bucket=")]
        self.tables.setdefault(name, []).append(folder)
        schema = table.schema if table else rows.schema
        return self.target.spark.read.schema(schema).parquet(place)

    def commit(self) -> bool:
        """Merge folders where there are many of a class, then put the batch's version in place."""
        for name, table in self.target.keyed.items():
            tier = 0
            while len(same := [f for f in self.tables.get(name, []) if f["tier"] == tier]) >= FAN_IN:
                paths = self.target.places(same)
                self.tables[name] = [f for f in self.tables[name] if f["tier"] != tier]
                if paths:
                    self._write(name, table.merged(self.target.spark.read.schema(table.schema).parquet(*paths)), tier + 1)
                tier += 1
        return self.target.log.commit(self.batch_id, {"tables": self.tables})
