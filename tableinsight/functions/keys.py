"""Narrow grouping keys: shuffle at most 64 characters per text column, whatever the text length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableinsight.names import col

_DIGEST_LENGTH = 64  # hex characters of SHA-256


def compact_key(value: Column, data_type: T.DataType) -> Column:
    """Equal keys if and only if equal values, and never wider than a SHA-256 in hex.

    Values shorter than the digest stay as they are, so a short value can never be taken for a
    digest. NULL stays NULL.
    """
    if isinstance(data_type, T.VariantType):
        return compact_key(F.to_json(value), T.StringType())
    if isinstance(data_type, T.StringType):
        return F.when(F.length(value) < _DIGEST_LENGTH, value).otherwise(
            F.sha2(value.cast("binary"), 256)
        )
    if isinstance(data_type, T.BinaryType):
        digest = F.sha2(value, 256).cast("binary")
        return F.when(F.octet_length(value) < _DIGEST_LENGTH, value).otherwise(digest)
    return value


def _spelled(value: Column, data_type: T.DataType) -> Column:
    """Equal text if and only if equal values of one type; both zeros and all NaN are alike."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        # Adding zero turns -0.0 into 0.0.
        return (value + F.lit(0.0)).cast("string")
    if isinstance(data_type, T.BinaryType):
        return F.hex(value)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(F.struct(value.alias("v")))
    return value.cast("string")


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a row, 32 bytes however wide it is. Values are tagged with their length, NULL
    with a tag of its own, so no two different rows spell the same."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    parts = []
    for f in fields:
        text = _spelled(col(f.name), f.dataType)
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(F.lit(""), *parts).cast("binary"), 256))


_MASK_BITS = 62


def row_groups(df: DataFrame, keep: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per distinct row: ``n`` copies, bit masks ``m0, m1, ...`` of the NULL columns, and
    the kept columns as ``k0, k1, ...``. Only these and the digest are shuffled."""
    names = df.columns
    masks = []
    for start in range(0, len(names), _MASK_BITS):
        bits = [
            F.when(col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0).cast("bigint"))
            for i, c in enumerate(names[start : start + _MASK_BITS])
        ]
        masks.append(sum(bits[1:], bits[0]).cast("bigint").alias(f"m{start // _MASK_BITS}"))
    kept = [compact_key(col(c), df.schema[c].dataType).alias(f"k{i}") for i, c in enumerate(keep)]
    return df.groupBy(row_digest(df, columns).alias("digest"), *masks, *kept).agg(
        F.count(F.lit(1)).alias("n")
    )


def null_in(i: int) -> Column:
    """Whether the column number ``i`` of the table is NULL in a row of ``row_groups``."""
    return F.col(f"m{i // _MASK_BITS}").bitwiseAND(F.lit(1 << (i % _MASK_BITS))) != 0
