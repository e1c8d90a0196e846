"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session, where driver and executors are one process, may do without the setting and gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_loomgrid_shared", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: the executors share no folder for intermediate tables")
        found = "file://" + tempfile.mkdtemp(prefix="loomgrid-")
        spark.sparkContext._loomgrid_shared = found
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This computes an intermediate result once and cuts its lineage, so that a lost executor costs a
    reread and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(column: pa.Array, rows: int = 128) -> Iterator:
    """The values of a column as Python's, so many rows at a time, as texts may be long."""
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).to_pylist()


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def runs_of_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cut batches that are sorted by ``key`` so that no run of one key is split.

    Yields tables holding whole runs. Beside one batch, only the run at hand is held.
    """
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        keys = now.column(key).to_numpy()
        start = int(np.searchsorted(keys, keys[-1], side="left"))
        if held and keys[0] == last and start == 0:
            held.append(now)
            continue
        if start or held:
            yield pa.concat_tables([*held, now.slice(0, start)] if start else held)
        held, last = [now.slice(start)], keys[-1]
    if held:
        yield pa.concat_tables(held)


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the edges (u, v)."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        keep = label[u] != label[v]
        if not keep.any() or np.array_equal(before, label):
            break
        u, v = u[keep], v[keep]
    return label


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Alternates the large-star and small-star steps, each a min aggregation and a join, until the
    links are stars. Every round is written to the shared folder. Star centres with very many links
    are aggregated before the shuffle, and the joins are left to Spark, which can split their skew.
    """
    links = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links"
    )
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        links = staged(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "links",
        )
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def stable_fold(key: str, folds: int) -> F.Column:
    """crc32 of the key's decimal text, modulo ``folds``; null keys fall in fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)).cast("int"), F.lit(-1))


ArrowFn = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
LONG, INT, DOUBLE, STRING, BINARY = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BinaryType()
