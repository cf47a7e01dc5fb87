"""A table of running sums that a stream keeps in Parquet, and that survives restarts.

Every batch writes its own sums once, under its number: a batch that is run again after a failure
writes the same again. Readers add up the base and the batches after it. Now and then the batches
are put into a new base, which counts from the moment it has its name; a reader or writer that dies
before that changes nothing. So what a batch costs follows the batch, not the table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class SumTable:
    """``keys`` and ``sums`` (columns that add up) at ``path``. One stream writes it; anyone may read."""

    path: str
    keys: tuple[str, ...]
    sums: tuple[str, ...]
    #: Batches beside the base before they are put into a new one.
    most_batches: int = 20

    def _fs(self, spark: SparkSession):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _listed(self, spark: SparkSession) -> tuple[int | None, list[int]]:
        """(number of the base, batches after it)."""
        fs, path = self._fs(spark)
        if not fs.exists(path(self.path)):
            return None, []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        base = max((int(n[5:]) for n in names if n.startswith("base-")), default=None)
        return base, sorted(int(n[6:]) for n in names if n.startswith("batch-") and (base is None or int(n[6:]) > base))

    def _written(self, df: DataFrame, name: str) -> None:
        """All of it or nothing, under its name; what stands there already stays, as it is the same."""
        fs, path = self._fs(df.sparkSession)
        if fs.exists(path(f"{self.path}/{name}")):
            return
        making = f"{self.path}/.making-{name}-{uuid.uuid4().hex}"
        df.write.parquet(making)
        fs.rename(path(making), path(f"{self.path}/{name}"))

    def _added(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])

    def add(self, rows: DataFrame, batch: int) -> None:
        """The sums of one batch; for foreachBatch. Batches come in the order of their numbers."""
        spark = rows.sparkSession
        self._written(self._added(rows.select(*self.keys, *self.sums)), f"batch-{batch}")
        base, later = self._listed(spark)
        if len(later) >= self.most_batches:
            self._written(self.read(spark, rows.select(*self.keys, *self.sums).schema), f"base-{later[-1]}")
            self.clean(spark)

    def clean(self, spark: SparkSession, keep: int = 1) -> None:
        """Delete what older bases held, but for the last ``keep`` bases, which a reader may still be at."""
        fs, path = self._fs(spark)
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        bases = sorted(int(n[5:]) for n in names if n.startswith("base-"))
        if len(bases) > keep:
            oldest = bases[-1 - keep]
            for n in names:
                if n.startswith(("base-", "batch-")) and int(n.split("-")[1]) <= oldest and n != f"base-{oldest}":
                    fs.delete(path(f"{self.path}/{n}"), True)

    def read(self, spark: SparkSession, schema: StructType | None = None) -> DataFrame:
        """The sums of all batches that are there now. An empty table needs ``schema``."""
        base, later = self._listed(spark)
        names = ([f"base-{base}"] if base is not None else []) + [f"batch-{n}" for n in later]
        if not names:
            if schema is None:
                raise ValueError(f"nothing was written to {self.path} yet")
            return spark.createDataFrame([], schema)
        return self._added(spark.read.parquet(*[f"{self.path}/{n}" for n in names]))


def keep(stream: DataFrame, table: SumTable, checkpoint: str, wait: bool = True) -> StreamingQuery:
    """Add what the stream has now to the table; started again with the same checkpoint it goes on where it
    stopped. ``stream`` has the table's columns, one row for each thing to be added up."""
    query = stream.writeStream.foreachBatch(table.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query
