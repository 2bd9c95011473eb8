"""Shared helpers: scratch tables in the shared folder, schema checks, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..staging import drop_path, drop_stage, free_name, numbered, scratch_path, scratch_root, stage  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and the next operator needs what they would keep."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def trimmed(batches: Iterator) -> Iterator:
    """Passes ``batches`` on, then gives freed memory back."""
    try:
        yield from batches
    finally:
        give_back()


def give_back_driver(spark: SparkSession) -> bool:
    """The same for the driver: its Python, and native memory that its JVM has freed. Whether the JVM could do it."""
    give_back()
    sc = spark.sparkContext
    jvm, array = sc._jvm, sc._gateway.new_array
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    given = array(jvm.java.lang.Object, 4)
    given[0], given[1], given[2], given[3] = command, "systemTrimNativeHeap", array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    # the server's own class isn't open to callers, only its interface is
    (invoke,) = (m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:  # only some JVMs have the command, of 17 those from 17.0.9 on, on Linux
        return False
    return True


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of ``edges`` (u, v), root being the smallest node reachable.

    Alternates large-star and small-star steps; each is a map-side combined minimum per node and a join
    back, so that no node's neighbours are gathered in one place. Rounds grow with the logarithm of the
    longest path. Every round is written to the shared folder; the one before is deleted.
    """
    cur = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    nodes = None
    while True:
        # large star: each larger neighbour, and the node itself, points to the smallest of the neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        )
        # small star: all smaller neighbours and the node point to the smallest of them
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = stage(small, "cc")
        a = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        b = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stage(cur)
        cur = new
        if tuple(a) == tuple(b):
            break
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
