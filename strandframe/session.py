"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: A side is broadcast only when it has at most this many rows and characters.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one disk, may fall
    back to a temporary folder.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="strandframe-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def run_folder(spark: SparkSession) -> str:
    """Folder of everything that this application writes on its way to a result."""
    return f"{shared_dir(spark).rstrip('/')}/strandframe/{spark.sparkContext.applicationId}"


def run_path(spark: SparkSession) -> str:
    """A path in the run folder that nothing uses yet."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def drop_run(spark: SparkSession) -> None:
    """Delete the run folder. DataFrames of this application that were not stored elsewhere are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a local checkpoint the result outlives its executors, and unlike
    ``checkpoint()`` the plan is computed a single time. ``drop_run`` deletes the files.
    """
    spark = df.sparkSession
    path = run_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count rows and characters of ``df``, stopping just past the row bound."""
    text = [F.length(c.name) for c in df.schema if c.dataType.simpleString() == "string"]
    nested = [c.name for c in df.schema if isinstance(c.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:  # their size as text stands for their size
        text.append(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in nested]))))
    size = sum((F.coalesce(t, F.lit(0)) for t in text), F.lit(0))
    row = (
        df.select(size.alias("_chars"))
        .limit(max_rows + 1)
        .agg(F.count("*").alias("n"), F.sum("_chars").alias("chars"))
        .first()
    )
    return row["n"] <= max_rows and (row["chars"] or 0) <= BROADCAST_CHARS


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when measured small; otherwise the shuffle join stands."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the input has fewer pieces than the cluster has cores.

    Matters for costly per-row work on a small file that Spark reads as one piece; a large
    input already has many pieces and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df
