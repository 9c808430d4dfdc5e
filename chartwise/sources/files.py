"""File, folder and database sources and sinks.

* ``read_csv_strings``     CSV with header, every column a string          (A1)
* ``register_views``       named temp views                                (A2)
* ``read_subject_folder``  every ``*.parquet`` in a folder, all columns of
                           all files by name; no folder → empty frame      (A3)
* ``folder_schema``        the union of the files' schemas, types widened  (A3)
* ``read_dimension``       typed dimension CSV; missing file → empty        (A4)
* ``read_observation_files`` observation / covariate / label CSVs with the
                           column contract (ID first, label second)       (A5)
* ``jdbc_reader``          query a database through Spark's JDBC source    (A7)
* ``write_per_subject``    one directory per subject, NULL values dropped  (A10)
* ``preview``              first rows in a total order, and the shape      (A13)
* ``write_metric_log``     (run, step, tag, value) rows, one folder per (run, step) (A12)

Sinks replace the partitions they write and leave others alone, so a job that
runs twice leaves the same files.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartwise.operators.ranking import positions


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with no type inference: every column is a string."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def register_views(frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def read_subject_folder(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """All ``*.parquet`` under ``folder`` stacked by column name (one scan, not a loop).

    Without ``schema`` every column of every file is kept (``folder_schema``);
    with it no footer is read, and other columns are not read. Columns a
    file lacks are NULL. No folder, or none with such files, is an empty
    table (with ``schema``'s columns, if given).
    """
    if not paths_of(spark, folder):
        return spark.createDataFrame([], schema or T.StructType([]))
    schema = schema or folder_schema(spark, folder)
    if not schema.fields:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(folder)


# The wider of two types that Spark's Parquet reader can read the narrower as.
_WIDER = {
    ("tinyint", "smallint"): "smallint", ("tinyint", "int"): "int", ("smallint", "int"): "int", ("tinyint", "bigint"): "bigint",
    ("smallint", "bigint"): "bigint", ("int", "bigint"): "bigint", ("float", "double"): "double", ("tinyint", "double"): "double",
    ("smallint", "double"): "double", ("int", "double"): "double", ("date", "timestamp_ntz"): "timestamp_ntz",
}


def _wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    x, y = a.simpleString(), b.simpleString()
    if x == y or y == "void":
        return a
    if x == "void":
        return b
    name = _WIDER.get((x, y)) or _WIDER.get((y, x))
    return T._parse_datatype_string(name) if name else None


def _is_conflict(e: Exception) -> bool:
    return "CANNOT_MERGE_SCHEMAS" in str(e) or "CANNOT_MERGE_INCOMPATIBLE_DATA_TYPE" in str(e)


def folder_schema(spark: SparkSession, folder: str) -> T.StructType:
    """The union of the Parquet files' schemas by column name, in order of first appearance, types widened.

    Footers are read by Spark jobs (``mergeSchema``), over all files at once.
    Only where types differ are the files halved, until the halves agree in
    themselves; their schemas are then joined here: int and bigint give
    bigint, float and double double, and so on. Types without a common one
    raise ValueError with the column and both files.
    """
    files = sorted(r.path for r in _parquet_files(spark, folder).collect())
    found = _merged(spark, files) if files else {}
    return T.StructType([T.StructField(name, kind) for name, (kind, _) in found.items()])


def _parquet_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the Parquet files below ``folder``: a listing, no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder).select("path")


def _merged(spark: SparkSession, files: list[str]) -> dict[str, tuple[T.DataType, str]]:
    """Column name -> (type, a file that has the column)."""
    try:
        schema = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*files).schema
        return {f.name: (f.dataType, files[0]) for f in schema.fields}
    except (PySparkException, Py4JJavaError) as e:
        if len(files) == 1 or not _is_conflict(e):
            raise
    half = len(files) // 2
    left, right = _merged(spark, files[:half]), _merged(spark, files[half:])
    for name, (kind, file) in right.items():
        if name not in left:
            left[name] = (kind, file)
            continue
        wide = _wider(left[name][0], kind)
        if wide is None:
            first, second = (_file_with(spark, part, name, k) for part, k in ((files[:half], left[name][0]), (files[half:], kind)))
            raise ValueError(f"column {name!r} is {left[name][0].simpleString()} in {first} and {kind.simpleString()} in {second}")
        left[name] = (wide, left[name][1])
    return left


def _file_with(spark: SparkSession, files: list[str], name: str, kind: T.DataType) -> str:
    """A file in which column ``name`` has type ``kind`` (only asked to report a conflict)."""
    for file in files:
        if any(f.name == name and f.dataType == kind for f in spark.read.parquet(file).schema.fields):
            return file
    return files[0]


def with_file_position(spark: SparkSession, path: str) -> DataFrame:
    """A stored Parquet table with ``file_path`` and ``file_row``: where each row stands, files ordered by path."""
    return spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("file_row"))


def paths_of(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a path or glob, asked from the file system it belongs to (not the driver's disk)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return [f.getPath().toString() for f in found or []]


ITEM_SCHEMA = T.StructType([T.StructField("itemid", T.StringType()), T.StructField("label", T.StringType())])


def read_dimension(spark: SparkSession, path: str, schema: T.StructType = ITEM_SCHEMA) -> DataFrame:
    """Dimension CSV with its key as text and ``pos``, its load order; a missing file gives an empty table.

    ``pos`` orders rows by file name and then by place in the file: a row's
    running number within its task is its place in its split. Positions come
    from range slices, so no task numbers the whole file.
    """
    full = T.StructType([*schema.fields, T.StructField("pos", T.LongType())])
    if not paths_of(spark, path):
        return spark.createDataFrame([], full)
    rows = spark.read.option("header", True).schema(schema).csv(path).select(
        *schema.names, F.input_file_name().alias("_file"), F.input_file_block_start().alias("_start"),
        F.monotonically_increasing_id().alias("_id"))
    return positions(rows, ["_file", "_start", "_id"], out="pos").select(*schema.names, "pos")


def _number(c: str):
    """Text as a double; what is no number, and NaN, is NULL."""
    v = F.col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def _check_columns(df: DataFrame, first: str, second: str | None = None, what: str = "table") -> DataFrame:
    cols = df.columns
    if not cols or cols[0] != first:
        raise ValueError(f"{what}: first column must be {first!r}, got {cols[:1]}")
    if second is not None and (len(cols) < 2 or cols[1] != second):
        raise ValueError(f"{what}: second column must be {second!r}, got {cols[1:2]}")
    return df


def read_observation_files(spark: SparkSession, obs_path: str, cov_path: str | None = None,
                           label_path: str | None = None) -> dict[str, DataFrame]:
    """Observations (ID, Time, Value_*, Mask_*), covariates and labels with a checked contract.

    Columns are typed on read (``ID`` bigint, the rest double, NaN as NULL)
    and renamed to the library's names (``Time`` becomes ``t``); the path
    given is the path read.
    """
    def typed(path):
        raw = spark.read.option("header", True).csv(path)
        return raw.select(*[
            (F.col(c).try_cast("bigint") if c == "ID" else _number(c)).alias("t" if c == "Time" else c.lower())
            for c in raw.columns
        ]), raw

    obs, raw = typed(obs_path)
    _check_columns(raw, "ID", what="observations")
    out = {"obs": obs}
    if cov_path:
        cov, raw = typed(cov_path)
        _check_columns(raw, "ID", what="covariates")
        out["cov"] = cov
    if label_path:
        lab, raw = typed(label_path)
        _check_columns(raw, "ID", "label", what="labels")
        out["labels"] = lab
    return out


def jdbc_options(url: str, query: str, user: str | None = None, password: str | None = None,
                 driver: str | None = None, fetchsize: int = 10000, partition_column: str | None = None,
                 lower: int | None = None, upper: int | None = None, partitions: int | None = None) -> dict[str, str]:
    """Options of Spark's JDBC source for ``query``.

    With a numeric ``partition_column`` and bounds the read is split over
    ``partitions`` parallel connections instead of one. Credentials come
    from the caller, never from code.
    """
    o = {"url": url, "fetchsize": fetchsize, "user": user, "password": password, "driver": driver}
    if partition_column:
        o |= {"dbtable": f"({query}) AS q", "partitionColumn": partition_column, "lowerBound": lower,
              "upperBound": upper, "numPartitions": partitions or 8}
    else:
        o["query"] = query
    return {k: str(v) for k, v in o.items() if v is not None}


def jdbc_reader(spark: SparkSession, url: str, query: str, **options):
    """A configured (not yet loaded) JDBC reader (see ``jdbc_options``)."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **options))


def replace_partitions(df: DataFrame, path: str, keys) -> None:
    """Write ``df`` in one folder per ``keys``; folders it has rows for are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_per_subject(df: DataFrame, path: str, key: str = "subject_id", order: str = "charttime",
                      value: str = "valuenum") -> None:
    """One directory per subject, rows with NULL ``value`` dropped, one job.

    Range-partitioned on (key, order) so a subject with many rows is
    written by several tasks instead of one. Subjects without a row in
    ``df`` keep their directories.
    """
    kept = df.where(F.col(value).isNotNull())
    replace_partitions(kept.repartitionByRange(key, order).sortWithinPartitions(key, order), path, [key])


def preview(df: DataFrame, order, n: int = 10) -> DataFrame:
    """First ``n`` rows in a total order (the limit is the feature here)."""
    return df.orderBy(*order).limit(n)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def write_metric_log(log: DataFrame, path: str) -> None:
    """Put (run, step, tag, value) rows into a Parquet metric log (A12).

    One folder per (run, step): logging a step again replaces its rows, a
    retried job adds none twice.
    """
    replace_partitions(log.repartition("run", "step"), path, ["run", "step"])


METRIC_LOG_SCHEMA = "run bigint, step int, tag string, value double"


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_LOG_SCHEMA).parquet(path).select("run", "step", "tag", "value")
