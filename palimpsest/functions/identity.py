"""Content identity of rows: canonical encoding, object ids, hash buckets and bucket digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks in the canonical encoding: a null is not an empty string.
NULL_MARK, VALUE_MARK = "\x00", "\x01"


def canonical(column: str, kind: T.DataType) -> Column:
    """One value as text with a mark; values of one type are equal exactly when their encodings are.

    Doubles go by their shortest text with -0.0 as 0.0, times by microseconds, structs, maps and arrays as JSON.
    """
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = (c + F.lit(0.0)).cast("string")
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(c).cast("string")
    elif isinstance(kind, T.BinaryType):
        text = F.hex(c)
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit(NULL_MARK)).otherwise(F.concat(F.lit(VALUE_MARK), text))


def object_id(df: DataFrame, attrs: list[str]) -> Column:
    """SHA-1 over the typed values in order; the type names take part, so 1 and '1' differ."""
    parts = [F.concat(F.lit(df.schema[a].dataType.simpleString()), canonical(a, df.schema[a].dataType)) for a in attrs]
    return F.sha1(F.concat_ws("\x02", *parts).cast("binary"))


def metadata_id(df: DataFrame, attrs: list[str]) -> str:
    """Identity of a feature type: its ordered names, types and nullability."""
    import hashlib

    return hashlib.sha1("|".join(f"{a}:{df.schema[a].dataType.simpleString()}:{df.schema[a].nullable}" for a in attrs).encode()).hexdigest()


def with_identity(df: DataFrame, key: str, attrs: list[str] | None = None) -> DataFrame:
    """Adds object_id and metadata_id columns."""
    attrs = attrs or [c for c in df.columns if c != key]
    return df.withColumn("object_id", object_id(df, attrs)).withColumn("metadata_id", F.lit(metadata_id(df, attrs)))


def hash_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def bucket_digests(df: DataFrame, key: str, buckets: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, rows, digest): equal digests mean equal rows, so a diff can skip the bucket.

    The digest is the sum and the xor of a 64-bit hash of (key, object_id): both are summed up before the shuffle.
    """
    h = F.xxhash64(F.col(key).cast("string"), "object_id")
    return df.groupBy(*by, hash_bucket(key, buckets).alias("hash_bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.concat_ws(":", F.sum(h.cast("decimal(20,0)")).cast("string"), F.bit_xor(h).cast("string")).alias("digest")
    )


def changed_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets whose digests differ or that one side lacks."""
    return left.alias("l").join(right.alias("r"), "hash_bucket", "full").where(~F.col("l.digest").eqNullSafe(F.col("r.digest"))).select("hash_bucket")
