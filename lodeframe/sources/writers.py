"""Sinks: tables, summaries, reports and names of outputs."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare


def image_stack(spark: SparkSession, path: str, mode: str, saved: list[tuple[int, np.ndarray]]) -> None:
    """Saved images as a table (mode, iter, pixel_id, v), a folder for each mode and iteration."""
    rows = [(mode, i, j, float(v)) for i, image in saved for j, v in enumerate(image)]
    spark.createDataFrame(rows, "mode string, iter int, pixel_id int, v float").write.mode("overwrite").partitionBy("mode", "iter").parquet(path)


def event_rows(rows: DataFrame, path: str) -> None:
    """Event rows, a folder for each view: a later read prunes to the views it needs, and the files' statistics are the manifest."""
    rows.repartition("view").write.mode("overwrite").partitionBy("view").parquet(path)


def metrics_csv(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def summary_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def report(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as text; more than ``most`` rows are an error, not cut off."""
    rows = [r.asDict() for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} rows: write the table instead")
    return "\n".join([title, *[json.dumps(r, default=str) for r in rows]])


def volume(df: DataFrame, path: str, shape: tuple[int, int, int]) -> None:
    """A volume (ix, iy, iz, v), a file a plane, each a row of little-endian float32 values with ix running first."""
    plane = df.groupBy("iz").agg(F.sort_array(F.collect_list(F.struct((F.col("iy") * shape[0] + F.col("ix")).alias("at"), "v"))).alias("cells"))
    plane.select("iz", F.transform("cells", lambda c: c["v"].cast("float")).alias("v")).write.mode("overwrite").partitionBy("iz").parquet(path)


def scientific(n: float) -> str:
    """1e9 for 1000000000, 2.5e8 for 250000000."""
    if n == 0:
        return "0"
    mantissa, exponent = f"{n:.6e}".split("e")
    return f"{mantissa.rstrip('0').rstrip('.')}e{int(exponent)}"


def output_name(mode: str, iterations: int, saves: int, views: int, energy_kev: int, count: float) -> str:
    return f"Image_{mode}_{energy_kev}keV_RotNum{views}_{scientific(count)}_Iter_{iterations}_{saves}"


def tensors(named: dict[str, DataFrame], path: str) -> None:
    """A bundle of tensors (index columns and v) as one long table, a folder each: name, index (an array) and v."""
    for name, df in named.items():
        index = F.array(*[F.col(c).cast("int") for c in df.columns if c != "v"])
        df.select(index.alias("index"), F.col("v").cast("double").alias("v")).write.mode("overwrite").parquet(f"{path}/name={name}")


def samples_csv(df: DataFrame, path: str) -> None:
    """Samples, a file a partition, each with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def projection_csv(counts: DataFrame, path: str, bins: int) -> None:
    """Counts (view, bin_id from 1, y) as CSV rows of a view, a column a bin; bins without a row are 0. A row has the machine's size."""
    cells = F.map_from_entries(F.collect_list(F.struct(F.col("bin_id").cast("int"), "y")))
    row = counts.groupBy("view").agg(cells.alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0.0)).cast("string")), ",")
    row.select("view", line.alias("line")).orderBy("view").select("line").write.mode("overwrite").text(path)


def flat_text(df: DataFrame, order: list[str], value: str, path: str) -> None:
    """Values in order, parted by tabs, in one line: of a table of the machine's size."""
    cells = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    df.agg(F.array_join(F.transform(cells, lambda c: c["__v"].cast("string")), "\t").alias("line")).coalesce(1).write.mode("overwrite").text(path)


def meta_volume(df: DataFrame, path: str, shape: tuple[int, int, int], spacing: tuple[float, float, float]) -> None:
    """A volume (ix, iy, iz, v) as a MetaImage: ``path``.raw has its planes as little-endian float32, ix running first, and ``path``.mhd says so. Voxels without a row are 0.

    Planes are packed in tasks; the driver puts them into the file one after
    another, so it holds one plane at a time.
    """

    def pack(table: pa.Table) -> pa.Table:
        plane = np.zeros(shape[0] * shape[1], "<f4")
        plane[table.column("iy").to_numpy().astype(int) * shape[0] + table.column("ix").to_numpy()] = table.column("v").to_numpy()
        return pa.table({"iz": table.column("iz").slice(0, 1).cast(pa.int32()), "data": pa.array([plane.tobytes()], pa.binary())})

    spark = df.sparkSession
    prepare(spark)
    planes = df.groupBy("iz").applyInArrow(pack, "iz int, data binary").orderBy("iz")
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()

    def create(name: str):
        return hadoop(name).getFileSystem(conf).create(hadoop(name), True)

    out, at, empty = create(f"{path}.raw"), 0, bytes(4 * shape[0] * shape[1])
    for r in planes.toLocalIterator():
        for _ in range(r["iz"] - at):
            out.write(empty)
        out.write(bytes(r["data"]))
        at = r["iz"] + 1
    for _ in range(shape[2] - at):
        out.write(empty)
    out.close()
    head = {"ObjectType": "Image", "NDims": 3, "BinaryData": "True", "BinaryDataByteOrderMSB": "False", "DimSize": " ".join(map(str, shape)), "ElementSpacing": " ".join(f"{s:g}" for s in spacing), "ElementType": "MET_FLOAT", "ElementDataFile": path.rpartition("/")[2] + ".raw"}
    out = create(f"{path}.mhd")
    out.write("".join(f"{k} = {v}\n" for k, v in head.items()).encode())
    out.close()
