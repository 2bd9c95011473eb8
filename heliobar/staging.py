"""Tables written to the shared folder: they cut lineage, survive lost executors and fix what is drawn or numbered."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns it reread."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], name: str) -> str:
    """``name``, made longer until no column has it; Spark tells columns apart without regard to case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stage(df: DataFrame) -> None:
    """Deletes what ``stage`` wrote, once nothing reads it any more."""
    for f in df.inputFiles()[:1]:
        drop_path(df.sparkSession, f.rsplit("/", 1)[0])


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Row numbers from 0 in a global order: sorted ranges are written once, then each takes its offset."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part, place, base = (free_name(df.columns, n) for n in ("part", "place", "base"))
    cut = stage(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "numbered")
    inside = cut.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut.groupBy(part).agg(F.count("*").alias("n")).withColumn(base, before).drop("n")  # a row for each range
    return inside.join(F.broadcast(offsets), part).withColumn(name, (F.col(base) + F.col(place)).cast("long")).drop(part, place, base)
