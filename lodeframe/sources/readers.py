"""Readers for the domain's file formats; all paths go through Spark, so any of its file systems serves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import prepare

LIST_SCHEMA = "cp1 double, e1 double, cp2 double, e2 double"




def file_name(path: Column | None = None) -> Column:
    return F.regexp_extract(path if path is not None else F.input_file_name(), r"([^/]+)$", 1)


def list_mode(spark: SparkSession, folder: str, recursive: bool = False, exclude: str | None = "compton_") -> DataFrame:
    """view, cp1, e1, cp2, e2 of headerless CSV files <view>.csv; further columns and unreadable rows' values are dropped. Files whose names start with ``exclude`` or aren't numbers go."""
    reader = spark.read.schema(LIST_SCHEMA).option("header", "false").option("enforceSchema", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.csv(folder).withColumn("__file", file_name())
    if exclude:
        rows = rows.filter(~F.col("__file").startswith(exclude))
    view = F.regexp_extract("__file", r"^(\d+)\.csv$", 1).try_cast("int")
    return rows.select(view.alias("view"), F.col("cp1").try_cast("int").alias("cp1"), "e1", F.col("cp2").try_cast("int").alias("cp2"), "e2").filter("view is not null")


def file_order(files: DataFrame, name: str = "name") -> DataFrame:
    """``place`` of each file: numeric names first, by number, then the others by text. A listing."""
    number = F.regexp_extract(name, r"^(\d+)\.[^.]*$", 1).try_cast("long")
    return files.withColumn("place", F.row_number().over(Window.orderBy(number.asc_nulls_last(), name)))


def detectors(spark: SparkSession, path: str) -> DataFrame:
    """det_id (the line's place, from 1), x, y, z of a headerless CSV whose columns 2 to 4 hold them. One small file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("i", "line"))
    part = lambda k: F.get(F.split("line", ","), F.lit(k)).try_cast("double")
    return lines.select((F.col("i") + 1).cast("int").alias("det_id"), part(1).alias("x"), part(2).alias("y"), part(3).alias("z"))


def cross_sections(spark: SparkSession, path: str) -> DataFrame:
    """line_no, energy, incoherent, photo, total of a white-space table; lines that don't parse are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    words = F.split(F.trim("line"), r"\s+")
    part = lambda k, n: F.get(words, F.lit(k)).try_cast("double").alias(n)
    return lines.select("line_no", *[part(k, n) for k, n in enumerate(("energy", "incoherent", "photo", "total"))]).dropna()


def _length(spark: SparkSession, path: str) -> int:
    """Bytes of a file; its content isn't read."""
    return spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first()["n"] or 0


def float_matrix(spark: SparkSession, path: str, pixels: int, scale: float = 1.0) -> DataFrame:
    """bin_id (from 0) and h of a raw float32 matrix with bins running first; the number of bins comes from the file's length. Tasks read ranges of the file (see ``matrix_slice``)."""
    size = _length(spark, path)
    if size % (4 * pixels):
        raise ValueError(f"{size} bytes don't hold rows of {pixels} pixels")
    bins = size // (4 * pixels)
    return matrix_slice(spark, path, pixels, bins, 0, bins, scale) if bins else spark.createDataFrame([], "bin_id long, h array<double>")


def float_tensor(spark: SparkSession, path: str, shape: tuple[int, ...], kind: str = "<f4", order: str = "F") -> DataFrame:
    """i0, i1, .. (from 0) and v of a raw tensor of a fixed shape; another number of elements is an error. Tasks read slabs of the file, one for each place on the axis that runs last."""
    names, size = [f"i{k}" for k in range(len(shape))], _length(spark, path)
    if size != np.prod(shape) * np.dtype(kind).itemsize:
        raise ValueError(f"{size} bytes, not {shape} of {kind}")
    slab = int(size // (shape[-1] if order == "F" else shape[0]))
    rest = shape[:-1] if order == "F" else shape[1:]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, last in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(data, kind)
                at = [x.astype(np.int32) for x in np.unravel_index(np.arange(v.size), rest, order=order)] if rest else []
                own = np.full(v.size, last, np.int32)
                at = [*at, own] if order == "F" else [own, *at]
                yield pa.RecordBatch.from_pydict(dict(zip(names, at, strict=True)) | {"v": v.astype(float)})

    prepare(spark)
    records = spark.sparkContext.binaryRecords(path, slab).zipWithIndex().map(lambda x: (x[0], int(x[1])))
    return spark.createDataFrame(records, "data binary, last long").mapInArrow(parse, ", ".join(f"{n} int" for n in names) + ", v double")


def counts_csv(spark: SparkSession, path: str) -> DataFrame:
    """view, bin_id (from 1) and y of a headerless CSV with a row a view and a column a bin. One file of the machine's size."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("v", "line"))
    return lines.select((F.col("v") + 1).alias("view"), F.posexplode(F.split("line", ",")).alias("b", "y")).select("view", (F.col("b") + 1).alias("bin_id"), F.col("y").try_cast("double").alias("y"))


def json_value(spark: SparkSession, path: str, key: str, stat: str) -> float:
    """A positive number summary[key][stat] of a JSON file."""
    row = spark.read.text(path, wholetext=True).select(F.get_json_object("value", f"$.{key}.{stat}").try_cast("double").alias("v")).first()
    if not row or row["v"] is None or row["v"] <= 0:
        raise ValueError(f"{key}.{stat} isn't a positive number")
    return row["v"]


def headers(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value of ``key = value`` header lines."""
    lines = spark.read.text(path).withColumn("file", file_name())
    return lines.filter(F.col("value").contains("=")).select("file", F.trim(F.split("value", "=", 2)[0]).alias("key"), F.trim(F.split("value", "=", 2)[1]).alias("value"))


def name_tokens(name: Column) -> list[Column]:
    """iterations, saves, views and energy named in a file's name; null where they aren't."""
    token = lambda p, g: F.regexp_extract(name, p, g).try_cast("int")
    return [token(r"_Iter_(\d+)_(\d+)(?:\.|$)", 1).alias("iterations"), token(r"_Iter_(\d+)_(\d+)(?:\.|$)", 2).alias("saves"), token(r"RotNum(\d+)", 1).alias("views"), token(r"_(\d+)keV_", 1).alias("energy_kev")]


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of some paths that exists on its file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(f"none of {paths}")


def matrix_slice(spark: SparkSession, path: str, pixels: int, bins: int, first: int, last: int, scale: float = 1.0, step: int = 4096) -> DataFrame:
    """bin_id and h of the bins first..last-1 of a raw float32 matrix with bins running first, read in place.

    Spark reads the file as fixed-length records, one a pixel (the file's own
    layout), split over tasks; each record gives only the asked bins, in steps of
    ``step``, which meet again by step. So a file of any size is no single task.
    """
    if not 0 <= first < last <= bins:
        raise ValueError(f"no bins {first} to {last} of {bins}")
    prepare(spark)
    records = spark.sparkContext.binaryRecords(path, 4 * bins).zipWithIndex()

    def cut(part):
        for data, pixel in part:
            row = np.frombuffer(data, "<f4")[first:last].astype(float) * scale
            for a in range(0, len(row), step):
                yield (a // step, int(pixel), row[a : a + step].tobytes())

    parts = spark.createDataFrame(records.mapPartitions(cut), "step long, pixel int, data binary")

    def join(table: pa.Table) -> pa.Table:
        at = np.argsort(table.column("pixel").to_numpy())
        if len(at) != pixels:
            raise ValueError(f"{len(at)} pixels, not {pixels}")
        data = table.column("data").to_pylist()
        m = np.stack([np.frombuffer(data[i], float) for i in at], axis=1)
        low = first + table.column("step")[0].as_py() * step
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * pixels), pa.array(m.ravel()))
        return pa.table({"bin_id": np.arange(low, low + len(m)), "h": flat})

    return parts.groupBy("step").applyInArrow(join, "bin_id long, h array<double>")


def detector_binary(spark: SparkSession, path: str, count: int) -> DataFrame:
    """det_id (from 1) and p0..p11 of a float32 file that holds the number of detectors and twelve numbers of each. One small file; another number or length is an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                v = np.frombuffer(data, "<f4").astype(float)
                if not len(v) or round(v[0]) != count or len(v) != 1 + 12 * count:
                    raise ValueError(f"{len(v)} numbers don't hold {count} detectors")
                m = v[1:].reshape(count, 12)
                yield pa.RecordBatch.from_pydict({"det_id": np.arange(1, count + 1, dtype=np.int32)} | {f"p{k}": np.ascontiguousarray(m[:, k]) for k in range(12)})

    prepare(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "det_id int, " + ", ".join(f"p{k} double" for k in range(12)))


def named_array(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A table from the first of some paths that exists: Parquet, or CSV without a header."""
    path = first_existing(spark, paths)
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("inferSchema", "true").csv(path)


def kept_or_built(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at ``path`` if it was written in full before and isn't to be rebuilt; else it is built and written there."""
    try:
        first_existing(spark, [f"{path}/_SUCCESS"])
        found = not rebuild
    except FileNotFoundError:
        found = False
    if not found:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
