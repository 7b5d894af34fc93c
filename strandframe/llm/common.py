"""Helpers shared by the corpus operators: shared folder, staged tables, components, bounded sampling."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have at most to be broadcast; beyond it the joins go by (salted) shuffle.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (one machine) gets a temporary folder; a cluster session is refused, as a
    machine-local folder is not seen by the other executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = getattr(spark.sparkContext, "_strandframe_shared", None)
    if path is None:
        path = "file://" + tempfile.mkdtemp(prefix="strandframe-")
        spark.sparkContext._strandframe_shared = path
        atexit.register(remove_local, path)
    return path


def remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark takes it to have, for readers and writers outside Spark."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a table of links that one task takes, where their number is known.
TASK_ROWS = 50_000


def staged(df: DataFrame, name: str = "stage", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and the table survives lost executors.

    rows: about how many there are, if known; tasks get TASK_ROWS each then, instead of many next to nothing.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(1 + rows // TASK_ROWS)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again: what was made of them has itself been written."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished phases."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What empties the caches of this Python process, by module.
CACHES: dict[str, Callable[[], None]] = {}


def resting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose worker gives back its memory when a task ends: workers are reused by later stages.

    keeps: the module of CACHES whose cache the tasks use; it stays for further tasks, those of other modules go.
    """

    def rested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandframe.llm import common  # the worker's own

        for name, forget in common.CACHES.items():
            if name != keeps:
                forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return rested


def give_back() -> None:
    """Freed memory of this Python process goes to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own rules
        pass


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """Join a staged ``small`` (one row per key) to ``big``, whose keys may be skewed.

    Up to BROADCAST_ROWS rows (counted) it is broadcast; beyond, ``big`` is salted and ``small`` repeated per salt.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.floor(F.rand(7) * salts).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all nodes of links (u, v), which one task holds."""
    held = [pa.Table.from_batches([b]) for b in batches]
    if not held:
        return
    u, v = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, least = at[: len(u)], at[len(u):], np.arange(len(nodes))
    while len(u):
        np.minimum.at(least, np.maximum(u, v), np.minimum(u, v))
        while (further := least[least]).tobytes() != least.tobytes():
            least = further
        u, v = least[u], least[v]
        u, v = u[u != v], v[u != v]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[least], pa.int64())], ["node", "component"])


def components(edges: DataFrame, rounds: int = 40, at_once: int = 0) -> DataFrame:
    """Connected components of ``edges (a, b)`` as (node, component): the smallest node of each.

    Up to at_once distinct edges are joined by one task in its memory, which writes one table in place of five a round.
    Alternating large-star / small-star rounds over staged tables; each round is two joins on the node. Tables are
    written between the steps, so both sides of each join are plain exchanges, which adaptive execution can split if
    a node has very many neighbours. Edges with nulls or equal ends are ignored; no edges give an empty table.
    """
    e = staged(edges.where("a is not null and b is not null and a <> b")
               .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    if seen[0] <= at_once:
        found = staged(e.coalesce(1).mapInArrow(resting(_joined), "node long, component long"), "components")
        discard(e)
        return found
    for _ in range(rounds):
        n = seen[0]
        if not n:
            break
        # large star: larger neighbours of u point to the least of u and its neighbours
        both = staged(e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both", 2 * n)
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low", 2 * n)
        large = staged(both.join(least, "u").where("v > u and v <> m")
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", n)
        # small star: smaller neighbours of u, and u itself, point to the least of them
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low", n)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = e
        e = staged(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges", n)
        discard(last, both, least, large, low)
        before, seen = seen, e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
