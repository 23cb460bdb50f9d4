"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: The characters that separate words, as a Java regex class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that ``spark.checkpoint.dir`` names.

    Where that is unset, local mode (tests) uses a folder under the SQL warehouse;
    a cluster has to name one, as a folder of one machine would not do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share.")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/.checkpoints"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below :func:`shared_dir`, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a read of the files, not the
    work that made them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct, ``row``; texts as strings."""
    return F.struct(*[named(c).cast("string").alias(c) if c == "text" else named(c).alias(c) for c in docs.columns]).alias("row")


def _holds(kind: DataType, wanted: type) -> bool:
    if isinstance(kind, StructType):
        return any(_holds(f.dataType, wanted) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _holds(kind.elementType, wanted)
    if isinstance(kind, MapType):
        return wanted is MapType or _holds(kind.keyType, wanted) or _holds(kind.valueType, wanted)
    return isinstance(kind, wanted)


def row_hash(docs: DataFrame) -> Column:
    """A hash of the struct ``row`` over all columns of ``docs``; maps and variants, which have no hash, by their text."""

    def hashable(name: str) -> Column:
        column, kind = F.col("row")[name], docs.schema[name].dataType
        if _holds(kind, VariantType):
            return F.to_json(F.struct(column.alias("v")))
        return column.cast("string") if _holds(kind, MapType) else column

    return F.xxhash64(*map(hashable, docs.columns))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    A lambda over a one-element array binds the value; without it the optimizer
    may put the expression of ``value`` into another lambda, which then computes
    it for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def doc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
