"""Observation exports (CSV with header) -> typed raw observations."""

from __future__ import annotations

import csv
import datetime as dt
import re
from collections import defaultdict
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.text import to_date_or_null, to_utc_timestamp_ntz
from sightline.schema import RAW_OBSERVATION, REQUIRED_EXPORT_COLUMNS

_LONGS = ("id", "user_id", "taxon_id")
_TIMESTAMPS = ("time_observed_at", "created_at")
_QUOTING = {"quote": '"', "escape": '"'}  # a quote inside quotes is doubled
EARLIEST_DATE = dt.date(1900, 1, 1)  # dates before it are taken for typing errors


def validate_columns(df: DataFrame, required: Iterable[str] = REQUIRED_EXPORT_COLUMNS) -> DataFrame:
    """Raise ``ValueError`` naming every required column the frame lacks.

    Runs on the schema only (no Spark job) and before any projection, so the
    message lists all missing columns instead of failing on the first.
    """
    present = set(df.columns)
    missing = [c for c in required if c not in present]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df


def project_required(df: DataFrame, required: Sequence[str] = REQUIRED_EXPORT_COLUMNS) -> DataFrame:
    """Keep the required export columns (plus ``source_file`` when present)."""
    extra = ["source_file"] if "source_file" in df.columns else []
    return df.select(*required, *extra)


def type_export(df: DataFrame) -> DataFrame:
    """Export text -> typed columns. Bad text becomes null, never an error."""
    cols = []
    for field in RAW_OBSERVATION.fields:
        c = F.col(field.name)
        if field.name in _LONGS:
            c = c.try_cast("bigint")
        elif field.name == "observed_on":
            c = to_date_or_null(c)
        elif field.name in _TIMESTAMPS:
            c = to_utc_timestamp_ntz(c)
        else:
            c = F.nullif(c.cast("string"), F.lit(""))
        cols.append(c.alias(field.name))
    if "source_file" in df.columns:
        cols.append(F.col("source_file"))
    return df.select(*cols)


def _first_line(spark: SparkSession, path) -> str:
    """First line of a file, through the file system that holds it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        data = codec.createInputStream(stream) if codec is not None else stream
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(data, "UTF-8")).readLine()
    finally:
        stream.close()
    return (line or "").removeprefix("\ufeff")


def file_headers(spark: SparkSession, path: str, glob: str = "*.csv") -> dict[tuple[str, ...], list[str]]:
    """header -> its files, of the files under ``path`` that match ``glob``.
    One short read per file; empty files are left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(conf)
    found = store.globStatus(jvm.org.apache.hadoop.fs.Path(root, glob)) or store.globStatus(root) or []
    files = [s.getPath() for s in found if s.isFile() and s.getLen() and not s.getPath().getName().startswith(("_", "."))]
    by_header: dict[tuple[str, ...], list[str]] = defaultdict(list)
    with ThreadPoolExecutor(16) as pool:
        for file, line in zip(files, pool.map(lambda f: _first_line(spark, f), files)):
            by_header[tuple(next(csv.reader([line]), ()))].append(file.toString())
    return dict(by_header)


def _header_schema(header: Sequence[str], required: Sequence[str]) -> T.StructType:
    """Text columns in the file's own order; only the first column of a
    required name keeps the name."""
    names = []
    for i, name in enumerate(header):
        names.append(name if name in required and name not in names else f"_c{i}")
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def unbalanced_lines(spark: SparkSession, files: Sequence[str]) -> dict[str, int]:
    """file -> number of its lines with an odd number of quotes, of the files
    that have any: a quoted field goes on after the end of such a line. One
    scan that splits large files into blocks."""
    text = spark.read.text(list(files)).select("value", F.col("_metadata.file_path").alias("file"))
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = text.groupBy("file").agg(F.count_if(odd % 2 == 1).alias("n")).where("n > 0").collect()
    return {_plain_path(r.file): r.n for r in found}


def _plain_path(path: str) -> str:
    """One spelling of a file's address, as listings and scans differ in it."""
    return re.sub(r"^file:/+", "/", unquote(path))


def read_observations_csv(
    spark: SparkSession, path: str, glob: str = "*.csv", multi_line: bool | None = None
) -> DataFrame:
    """All export files under ``path`` -> typed raw observations.

    Every file is read by its own header: files are grouped by header, each
    distinct header is one scan, and the scans are combined by name, so files
    may order their columns differently or carry more of them. A file that
    lacks a required column is an error that names it.

    Large files are split into blocks. Only a file in which a quoted field
    goes on over a line break (``unbalanced_lines``, one more scan) is read by
    one task. ``multi_line=False`` leaves out that scan for exports known to
    have no such fields, ``True`` reads every file by one task.
    """
    headers = file_headers(spark, path, glob)
    if not headers:
        raise FileNotFoundError(f"no observation export files matching {glob!r} under {path}")
    listed = [f for files in headers.values() for f in files]
    broken = unbalanced_lines(spark, listed) if multi_line is None else {}
    whole = {f: bool(multi_line) or _plain_path(f) in broken for f in listed}
    frames = []
    for header, files in sorted(headers.items()):
        for together in (False, True):
            part = [f for f in files if whole[f] is together]
            if part:
                frames.append(_read_files(spark, header, part, together))
    return type_export(union_files(frames))


def _read_files(spark: SparkSession, header: Sequence[str], files: list[str], multi_line: bool) -> DataFrame:
    """The required columns of files that share a header."""
    schema = _header_schema(header, REQUIRED_EXPORT_COLUMNS)
    reader = spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
    raw = reader.options(**_QUOTING).csv(files)
    try:
        validate_columns(raw)
    except ValueError as exc:
        raise ValueError(f"{exc} (in {files[0]})") from None
    return project_required(raw.withColumn("source_file", F.col("_metadata.file_name")))


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """Combine frames by column name; every frame has the same columns."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(DataFrame.unionByName, frames)


def write_observations_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write observations in export form: header, ISO dates, ``... UTC`` times
    to the microsecond, blanks and quotes kept."""
    out = []
    for name in df.columns:
        dtype = df.schema[name].dataType.typeName()
        c = F.col(name)
        if dtype == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif dtype.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS 'UTC'")
        out.append(c.cast("string").alias(name))
    keep_blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(*out).write.mode(mode).option("header", True).options(**_QUOTING, **keep_blanks).csv(path)


def load_audit(
    df: DataFrame, date_col: str = "observed_on", earliest: dt.date = EARLIEST_DATE, latest: dt.date | None = None
) -> DataFrame:
    """Rows per source file and in total, in one aggregation job.

    Counts rows, rows whose id is missing or unreadable (an ingest rejects
    them), rows whose date is missing or unreadable, rows dated outside
    ``earliest`` .. ``latest`` (today when omitted; a mistyped year stretches
    a calendar that is derived from the data), rows without a user and rows
    without a taxon. The total row has ``source_file`` null and ``is_total``
    true.
    """
    last = F.lit(latest) if latest is not None else F.current_date()
    return (
        df.rollup("source_file")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("id").isNull()).alias("null_ids"),
            F.count_if(F.col(date_col).isNull()).alias("null_dates"),
            F.count_if((F.col(date_col) < F.lit(earliest)) | (F.col(date_col) > last)).alias("out_of_range_dates"),
            F.count_if(F.col("user_id").isNull()).alias("null_users"),
            F.count_if(F.col("taxon_id").isNull()).alias("null_taxa"),
            (F.grouping("source_file") == 1).alias("is_total"),
        )
    )
