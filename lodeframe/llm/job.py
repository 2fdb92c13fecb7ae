"""What the operators need of the session: shared folders, batch sizes, inputs."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches that go to Python hold about this many bytes, so that a worker's memory doesn't grow with the length of the texts.
BATCH_BYTES = 4 << 20


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches, has the shuffle files of each finished query deleted, and lets Python workers find this package where they share the driver's disk; all are session settings."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (here, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share. Only where that isn't set and all runs in one machine, a temporary folder serves."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir() + "/lodeframe-checkpoints"
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "part", **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names, whatever else the table holds."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
