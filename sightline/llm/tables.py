"""Written intermediate tables and row identity shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import release_shuffles, scratch_path  # noqa: F401

ROW_KEY, ROW_ID, ROW, ROW_COUNT = "_row_key", "_row_id", "_row", "_row_count"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage, survives lost executors. Returns (frame, path)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


_SIMPLE = {"bigint": T.LongType, "double": T.DoubleType, "boolean": T.BooleanType, "string": T.StringType}


def map_text(
    df: DataFrame,
    text: str,
    new: list[tuple[str, str]],
    work: Callable[[pa.Array], Iterator[list[pa.Array]]],
    keep_text: bool = True,
) -> DataFrame:
    """All columns of ``df`` (without its text column unless ``keep_text``)
    plus ``new`` (name, type) columns under free names. ``work`` turns the
    texts of a batch into these columns, in pieces, in order. The other columns
    pass through in a struct, so their names and types do not matter."""
    kept = [f for f in df.schema if keep_text or f.name != text]
    names = [free_name([f.name for f in kept], n) for n, _ in new]
    row = F.struct(*[quoted(f.name) for f in kept]) if kept else F.struct(F.lit(True).alias("_"))
    packed = df.select(row.alias("row"), quoted(text).alias("text"))
    places = [f"n{i}" for i in range(len(new))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for arrays in work(batch.column(1)) if batch.num_rows else ():
                size = len(arrays[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, size), *arrays], names=["row", *places])
                at += size

    fields = [T.StructField("row", packed.schema["row"].dataType)]
    fields += [T.StructField(p, _SIMPLE[kind]()) for p, (_, kind) in zip(places, new)]
    out = packed.mapInArrow(run, T.StructType(fields))
    return out.select(*(["row.*"] if kept else []), *[F.col(p).alias(n) for p, n in zip(places, names)])


def _unhashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _unhashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unhashable(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def hashable(column: Column, kind: T.DataType) -> Column:
    """``column`` in a form that Spark can hash: maps as lists of entries (in
    their stored order), variants as text, also inside arrays and structs."""
    if not _unhashable(kind):
        return column
    if isinstance(kind, T.VariantType):
        return column.cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: hashable(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return hashable(F.map_entries(column), T.ArrayType(entry)) if _unhashable(entry) else F.map_entries(column)
    fields = [hashable(column.getField(f.name), f.dataType).alias(f"_{i}") for i, f in enumerate(kind)]
    return F.when(column.isNotNull(), F.struct(*fields))


def keyed_rows(df: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """``_row_key`` (a 64-bit hash over every column), ``_row_id`` (the
    doc_id) and ``_row`` (a struct of the columns, or of those in ``kept``, so
    that no column name can clash). Rows that agree on key and id are
    identical rows."""
    inside = [quoted(c) for c in (df.columns if kept is None else kept)]
    hashed = [hashable(quoted(f.name), f.dataType) for f in df.schema]
    return df.select(
        F.xxhash64(*hashed).alias(ROW_KEY), F.col("doc_id").alias(ROW_ID), F.struct(*inside).alias(ROW)
    )


def distinct_rows(keyed: DataFrame) -> DataFrame:
    """One row per identical row, with its multiplicity. Combines map-side,
    so a row that makes up a third of the table is one row per task before
    the shuffle."""
    return keyed.groupBy(ROW_KEY, ROW_ID).agg(F.count(F.lit(1)).alias(ROW_COUNT), F.first(ROW).alias(ROW))


REPEAT_RANGE = 1 << 20


def repeat_rows(df: DataFrame, count: str, number: str, most: int, limit: int = REPEAT_RANGE) -> DataFrame:
    """Every row as often as its column ``count`` (long) says, null or below
    one: never; the new column ``number`` counts the copies of a row from 0.
    ``most`` is the largest count there is.

    Beyond ``limit`` copies a row is dealt out as ranges of at most ``limit``
    which are shuffled before they are expanded, so that no array holds more
    than ``limit`` elements and no task writes all copies of one row. In that
    case ``df`` is read twice and should be a written table."""
    at = free_name(df.columns, "_range_at")

    def expand(part: DataFrame) -> DataFrame:
        last = F.least(F.col(at) + limit, F.col(count)) - 1
        return part.withColumn(number, F.explode(F.sequence(F.col(at), last))).drop(at)

    few = expand(df.where(F.col(count).between(1, limit)).withColumn(at, F.lit(0).cast("long")))
    if most <= limit:
        return few
    starts = F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(limit).cast("long"))
    ranges = df.where(F.col(count) > limit).withColumn(at, F.explode(starts))
    return few.unionByName(expand(ranges.repartition(F.xxhash64(count, at))))


def same_row(left: str, right: str):
    """Join condition on key and id of two aliased frames."""
    return (F.col(f"{left}.{ROW_KEY}") == F.col(f"{right}.{ROW_KEY}")) & F.col(f"{left}.{ROW_ID}").eqNullSafe(
        F.col(f"{right}.{ROW_ID}")
    )


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or the first numbered variant the columns do not use."""
    taken, name, i = {c.lower() for c in columns}, wanted, 1
    while name.lower() in taken:
        name, i = f"{wanted}_{i}", i + 1
    return name
