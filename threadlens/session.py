"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20

# Settings the operators count on.  AQE turns a shuffled join into a broadcast
# only after it has seen the real size of the small side, and splits skewed
# join partitions; nothing in the library forces a broadcast by hint.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Where nothing is set, a
    temporary folder serves a local master; any other raises, as its executors
    would not see the driver's folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, pins values that must not change on recomputation (such
    as the partition number of a range split) and survives executor loss.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/threadlens/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    layer = spark.read.schema(df.schema).parquet(path)
    layer.layer_path = path
    return layer


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, which may hold very long texts, to be sent to Python in batches bounded by bytes."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return rows


def drop_layer(layer: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned, after its last use."""
    jvm = layer.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(layer.layer_path)
    path.getFileSystem(layer.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
