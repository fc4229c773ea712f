"""Reading by format, writing layers of a lake, content hashes and incremental state."""

from __future__ import annotations

import fnmatch
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartulary.session import shared_folder

#: Bytes of a file that is hashed whole, as one value of a row.
HASHED_BYTES = 1 << 30


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def is_file(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _fs(spark, path)
    return fs.exists(hadoop) and fs.getFileStatus(hadoop).isFile()


def stored(df: DataFrame, name: str = "cartulary") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of tables that ``stored`` wrote, once nothing reads them any more."""
    for frame in frames:
        fs, path = _fs(frame.sparkSession, frame.stored_at)
        fs.delete(path, True)


def read_any(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Parquet, CSV (header, every column a string: codes keep their zeros), JSON or JSON lines.

    By format or by suffix; a folder without one is Parquet.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    kind = kind or (name.rsplit(".", 1)[-1].lower() if "." in name else "parquet")
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    if kind == "jsonl":
        return spark.read.option("mode", "DROPMALFORMED").json(path)
    raise ValueError(f"format not supported: {kind}")


def latest_file(spark: SparkSession, folder: str, patterns: list[str]) -> str | None:
    """The last name, in descending order, that matches the first pattern with any match."""
    fs, path = _fs(spark, folder)
    names = sorted((s.getPath().getName() for s in fs.listStatus(path)), reverse=True) if fs.exists(path) else []
    return next((f"{folder}/{n}" for p in patterns for n in names if fnmatch.fnmatch(n, p)), None)


def append_partitioned(df: DataFrame, folder: str, source: str, run_id: str, default_year: int | None, default_state: str) -> None:
    """Appends rows under ``fonte=/ano=/uf=``: years coerced (0 if unknown), states upper case with a default.

    Rows are dealt by the partition columns and a salt, so a large state is written by several tasks; an empty frame
    writes nothing.
    """
    year = F.coalesce(F.col("ano").try_cast("int"), F.lit(0)) if "ano" in df.columns else F.lit(default_year or 0)
    state = F.upper(F.trim(F.col("uf").cast("string"))) if "uf" in df.columns else F.lit(default_state)
    rows = df.withColumns({"ano": year, "uf": F.coalesce(F.nullif(state, F.lit("")), F.lit(default_state)), "fonte": F.lit(source), "run_id": F.lit(run_id)})
    if not rows.isEmpty():
        rows.repartition("ano", "uf", F.floor(F.rand(7) * 4)).write.mode("append").partitionBy("fonte", "ano", "uf").parquet(folder)


def publish(df: DataFrame, path: str, sort_key: str | None = None) -> None:
    """Overwrites a dataset; sorted within files by a key, so that their statistics prune point look-ups."""
    (df.sortWithinPartitions(sort_key) if sort_key else df).write.mode("overwrite").parquet(path)


def serve(df: DataFrame, table: str, key: str, buckets: int = 16, path: str | None = None) -> None:
    """Saves a mart as a table, bucketed and sorted by its key, with statistics; in a folder of its own if one is given."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    df.sparkSession.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def content_hash(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(fonte, hash) of a source from the hashes of its files: of the files in each folder first, then of the folders.

    A file larger than ``HASHED_BYTES``, which no row can hold, is told by its name, size and time instead of its bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name, folder = F.element_at(F.split("path", "/"), -1).alias("n"), F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    small = files.where(F.col("length") <= HASHED_BYTES).select(F.sha2("content", 256).alias("h"), name, folder)
    stamp = F.concat_ws(":", F.col("length").cast("string"), F.unix_millis("modificationTime").cast("string"))
    each = small.union(files.where(F.col("length") > HASHED_BYTES).select(stamp.alias("h"), name, folder))
    digest = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ","), 256)
    folders = each.groupBy("folder").agg(digest(F.concat_ws(":", "n", "h")).alias("h"))
    return folders.agg(digest(F.col("h")).alias("hash")).select(F.lit(source).alias("fonte"), "hash")


def copy_raw(spark: SparkSession, source: str, target: str) -> dict:
    """Copies a source as it is, by the file system, and says where to and when the source was last changed."""
    (fs, path), (other, copy) = _fs(spark, source), _fs(spark, target)
    if not fs.exists(path):
        raise FileNotFoundError(source)
    changed = fs.getFileStatus(path).getModificationTime()
    other.delete(copy, True)
    other.mkdirs(copy.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path, other, copy, False, True, spark._jsc.hadoopConfiguration())
    return {"path": target, "source_last_modified_utc": datetime.fromtimestamp(changed / 1000, UTC).isoformat()}


def inside(spark: SparkSession, path: str, roots: list[str]) -> bool:
    """Whether a path is one of some folders or in one of them, links and ``..`` followed by name only."""
    place = lambda p: _fs(spark, p)[0].makeQualified(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.org.apache.hadoop.fs.Path(p).toUri().normalize())).toString()
    return any(place(path) == place(r) or place(path).startswith(place(r).rstrip("/") + "/") for r in roots)


def save_report(df: DataFrame, name: str, folders: list[str]) -> str:
    """Saves a report in the first of some folders that can be written to, and says where."""
    error: Exception | None = None
    for folder in folders:
        try:
            publish(df, f"{folder}/{name}")
            return f"{folder}/{name}"
        except Exception as failed:  # whatever keeps one folder from being written, the next is tried
            error = failed
    raise error or ValueError("no folder to save to")


def find_report(spark: SparkSession, name: str, folders: list[str]) -> str | None:
    """The report in the first folder that has it."""
    return next((f"{f}/{name}" for f in folders if _fs(spark, f"{f}/{name}")[0].exists(_fs(spark, f"{f}/{name}")[1])), None)


def register_views(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """Temporary views of the session by name, of the paths that exist; the names that were registered."""
    there = [n for n, p in paths.items() if _fs(spark, p)[0].exists(_fs(spark, p)[1])]
    for name in there:
        read_any(spark, paths[name]).createOrReplaceTempView(name)
    return there


def incremental_status(found: DataFrame, state: DataFrame) -> DataFrame:
    """``skipped_unchanged`` for sources whose hash is the state's, else ``loaded_changed``."""
    known = state.select("fonte", F.col("hash").alias("__old"))
    return found.join(known, "fonte", "left").withColumn("status", F.when(F.col("hash") == F.col("__old"), "skipped_unchanged").otherwise("loaded_changed")).drop("__old")


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    fs, hadoop = _fs(spark, path)
    stream = fs.create(hadoop, True)
    stream.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    stream.close()


def read_json(spark: SparkSession, path: str) -> dict:
    fs, hadoop = _fs(spark, path)
    if not fs.exists(hadoop):
        return {}
    stream = fs.open(hadoop)  # Spark's readers skip names that start with _
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def register_version(spark: SparkSession, catalog: str, metadata: dict) -> None:
    """Appends an entry to the catalogue of versions."""
    spark.createDataFrame([(metadata["dataset_name"], metadata["dataset_version"], metadata["timestamp_utc"], json.dumps(metadata, ensure_ascii=False))], "dataset_name string, dataset_version string, timestamp_utc string, metadata string").coalesce(1).write.mode("append").json(catalog)


def latest_versions(spark: SparkSession, catalog: str) -> DataFrame:
    """The newest entry of each dataset."""
    rows = read_any(spark, catalog, "jsonl")
    newest = Window.partitionBy("dataset_name").orderBy(F.desc("timestamp_utc"), F.desc("dataset_version"))
    return rows.withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn")


def previous_version(spark: SparkSession, catalog: str, dataset: str, version: str) -> str | None:
    """Path of the newest version of a dataset besides one, if its files are still there."""
    fs, path = _fs(spark, catalog)
    if not fs.exists(path):
        return None
    rows = read_any(spark, catalog, "jsonl").where((F.col("dataset_name") == dataset) & (F.col("dataset_version") != version))
    for row in rows.orderBy(F.desc("timestamp_utc")).toLocalIterator():
        place = json.loads(row.metadata)["path"]
        fs, hadoop = _fs(spark, place)
        if fs.exists(hadoop):
            return place
    return None


def expire(spark: SparkSession, folder: str, before_ms: int) -> list[str]:
    """Deletes entries of a folder changed before a moment; names that start with _ hold state and stay."""
    fs, path = _fs(spark, folder)
    old = [s.getPath() for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getModificationTime() < before_ms and not s.getPath().getName().startswith("_")]
    for p in old:
        fs.delete(p, True)
    return [p.getName() for p in old]
