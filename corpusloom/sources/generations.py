"""Tables that grow by generations: plain Parquet folders, and of each key the newest generation counts.

A write adds one folder of rows and one of the keys it replaces, and touches nothing that is there: its cost is that of its own rows, readers of what was there
aren't disturbed, and two writers never meet, as each has a folder of its own name. The folder of keys is written last, and a generation counts once that
job has succeeded, so a write that broke off is not seen. Of two writes to one key the later name counts; names begin with the time,
and come after all names that the writer saw. A write that carries a tag runs once: a tag that is there already is left alone. ``compact`` makes one
generation of all.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_KEYS = 500_000  # keys of up to KEY_CHARS characters on average are broadcast to readers, more are joined by a shuffle
KEY_CHARS = 64


class Generations:
    def __init__(self, spark: SparkSession, path: str, key: str = "source", order: str | None = None):
        """key: the column whose rows are replaced together. order: the column that files are ranged by, so that filters on it skip most of them."""
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order or key

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        """The generations that count, oldest first: those since the last one that replaced everything."""
        fs = self._fs()
        if not fs.exists(self._at("keys")):
            return []
        found = sorted(s.getPath().getName().removeprefix("gen=") for s in fs.listStatus(self._at("keys")) if fs.exists(self._at(f"keys/{s.getPath().getName()}/_SUCCESS")))
        first = max((i for i, n in enumerate(found) if n.endswith("-whole")), default=0)
        return found[first:]

    def exists(self) -> bool:
        return bool(self.names())

    def _read(self, part: str, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/{part}/gen={n}" for n in names]
        return self.spark.read.option("basePath", f"{self.path}/{part}").option("mergeSchema", "true").parquet(*paths)

    def rows(self) -> tuple[DataFrame, DataFrame] | None:
        """All rows with their gen, and key, gen, gone: the newest generation of each key. None if nothing was ever written."""
        names = self.names()
        if not names:
            return None
        keys = self._read("keys", names)
        self.key = next(c for c in keys.columns if c not in ("_n", "gone", "gen"))  # as the table was written
        newest = keys.groupBy(self.key).agg(F.max(F.struct("gen", "gone")).alias("_k")).select(self.key, "_k.gen", "_k.gone")
        return self._read("rows", names), newest

    def living(self, rows: DataFrame, newest: DataFrame) -> DataFrame:
        """The rows of each key's newest generation, without gen."""
        if len(self.names()) > 1:
            kept = newest.filter("not gone").select(F.col(self.key).alias("_key"), F.col("gen").alias("_gen"))
            if kept.count() <= BROADCAST_KEYS and (kept.agg(F.avg(F.length(F.col("_key").cast("string")))).first()[0] or 0) <= KEY_CHARS:
                kept = F.broadcast(kept)
            rows = rows.join(kept, (F.col("gen") == F.col("_gen")) & F.col(self.key).eqNullSafe(F.col("_key")), "left_semi")
        return rows.drop("gen")

    def read(self) -> DataFrame | None:
        both = self.rows()
        return None if both is None else self.living(*both)

    def append(self, new: DataFrame, gone: DataFrame | None = None, tag: str = "", whole: bool = False) -> None:
        """The keys in new, and those in gone, have the rows of new and no others from now on. With whole, the table has no other keys either."""
        names = self.names()
        if tag and any(f"-{tag}-" in n for n in names):
            return
        stamp = max([time.time_ns(), *[int(n[1:20]) + 1 for n in names]])
        name = f"t{stamp:019d}-{tag + '-' if tag else ''}{uuid.uuid4().hex[:12]}{'-whole' if whole else ''}"
        at = f"{self.path}/rows/gen={name}"
        # ranges are as many as the rows need: the adaptive plan joins small ones
        new.repartitionByRange(self.order).sortWithinPartitions(self.order).write.parquet(at)
        keys = self.spark.read.schema(new.schema).parquet(at).groupBy(self.key).agg(F.count("*").alias("_n"), F.lit(False).alias("gone"))
        if gone is not None:
            left = gone.select(self.key).distinct().join(keys.select(F.col(self.key).alias("_key")), F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
            keys = keys.unionByName(left.select(self.key, F.lit(0).cast("long").alias("_n"), F.lit(True).alias("gone")))
        keys.write.parquet(f"{self.path}/keys/gen={name}")

    def replace_all(self, rows: DataFrame) -> None:
        self.append(rows, whole=True)

    def delete(self, gone: DataFrame) -> None:
        """The keys in gone lose their rows."""
        both = self.rows()
        if both is not None:
            self.append(both[0].drop("gen").limit(0), gone)

    def compact(self) -> None:
        """One generation of all that counts; older folders go. Readers and writers of these must be done."""
        names, rows = self.names(), self.read()
        if len(names) > 1:
            self.replace_all(rows)
        fs, kept = self._fs(), set(self.names())
        for part in ("keys", "rows"):
            for s in fs.listStatus(self._at(part)) if fs.exists(self._at(part)) else []:
                if s.getPath().getName().removeprefix("gen=") not in kept:
                    fs.delete(s.getPath(), True)
