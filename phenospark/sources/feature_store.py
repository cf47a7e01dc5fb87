"""A feature store of snapshots: all of a version is visible, or nothing.

A version's tables lie in a folder of their own, which no one knows until its manifest is there. The
manifest is one small file that gets its name in one step, so a writer that dies leaves only
tables that nobody reads. Readers take the newest manifest or the one of a version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.operators.features import hit_counts


@dataclass(frozen=True)
class Snapshot:
    """``long`` (entity, feature), ``catalog`` (feature, n_entities), ``index`` (entity, n_features),
    ``kinds`` (counts of the hits), and the manifest."""

    version: int
    manifest: dict
    long: DataFrame
    catalog: DataFrame
    index: DataFrame
    kinds: DataFrame


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def _claim(spark: SparkSession, path: str) -> int:
    """A version's number for this writer alone: the file of a number can be made once."""
    number = max(versions(spark, path), default=0) + 1
    while True:
        fs, p = _fs(spark, f"{path}/.claim-{number}")
        try:
            fs.create(p, False).close()
            return number
        except Exception as e:
            if not fs.exists(p):
                raise e
            number += 1


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    making = f"{path}/.making-{uuid.uuid4().hex}"
    fs, p = _fs(spark, making)
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    fs.rename(p, _fs(spark, f"{path}/manifest-{manifest['version']}.json")[1])


def write(long: DataFrame, hits: DataFrame, path: str, entity: str, feature: str, kinds: list[str], entities: DataFrame | None = None) -> int:
    """Write and commit a snapshot; the number of its version.

    ``long`` is the matrix, its repeated rows count once; ``entities`` names all entities, those
    without a feature included, else those of ``long`` and ``hits``. ``hits`` is counted by each of ``kinds`` (type, subtype,
    method, ...). Older versions stay as they are.
    """
    spark = long.sparkSession
    version, folder = _claim(spark, path), f"tables-{uuid.uuid4().hex}"
    at = f"{path}/{folder}"
    long.select(entity, feature).distinct().write.parquet(f"{at}/long")
    matrix = spark.read.parquet(f"{at}/long")
    matrix.groupBy(feature).agg(F.count(F.lit(1)).alias("n_entities")).write.parquet(f"{at}/catalog")
    known = matrix.select(entity)
    for more in [entities] if entities is not None else [hits] if entity in hits.columns else []:
        known = known.unionByName(more.select(entity))
    held = matrix.groupBy(entity).agg(F.count(F.lit(1)).alias("n_features"))
    known.distinct().join(held, entity, "left").select(entity, F.coalesce("n_features", F.lit(0)).alias("n_features")).write.parquet(f"{at}/index")
    hit_counts(hits, kinds).write.parquet(f"{at}/kinds")
    catalog, index = spark.read.parquet(f"{at}/catalog"), spark.read.parquet(f"{at}/index")
    size = index.agg(F.count(F.lit(1)), F.count(F.when(F.col("n_features") == 0, 1)), F.sum("n_features")).first()
    manifest = {"version": version, "tables": folder, "entity": entity, "feature": feature, "kinds": kinds, "n_entities": size[0], "n_without_features": size[1], "n_values": size[2] or 0, "n_features": catalog.count(), "n_hits": hits.count()}
    _commit(spark, path, manifest)
    return version


def read(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest snapshot, or that of a version; it stays the same whatever is written meanwhile."""
    have = versions(spark, path)
    if not have or version is not None and version not in have:
        raise ValueError(f"{path} has no version {'' if version is None else version}")
    number = have[-1] if version is None else version
    manifest = read_manifest(spark, path, number)
    table = lambda name: spark.read.parquet(f"{path}/{manifest['tables']}/{name}")
    return Snapshot(number, manifest, table("long"), table("catalog"), table("index"), table("kinds"))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` versions; names of what went. Tables without a manifest stay, as they
    may be of a writer at work."""
    gone = []
    for number in versions(spark, path)[: -keep or None]:
        folder = read_manifest(spark, path, number)["tables"]
        for name in (f"manifest-{number}.json", folder):
            fs, p = _fs(spark, f"{path}/{name}")
            fs.delete(p, True)
            gone.append(name)
    return gone


def read_manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest-{version}.json", wholetext=True).first().value)
