"""The change-log: what every operator of this package reads and returns.

A change is (key, value, op, seq): `op` is UPDATE or DELETE, `seq` a BIGINT that grows with time and does not repeat
for a key. Keys and values are BINARY in stores; operators on DataFrames take any orderable type. BINARY and STRING
keys order by unsigned bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPDATE, DELETE = 0, 1

CHANGE = T.StructType([
    T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), True),
    T.StructField("op", T.ByteType(), False), T.StructField("seq", T.LongType(), False),
])


def op_of(deleted: Column) -> Column:
    """Op code of a boolean; null is an update."""
    return F.when(deleted, F.lit(DELETE)).otherwise(F.lit(UPDATE)).cast("byte")


def effective(value: Column, op: Column, empty: object = None) -> Column:
    """The value a change carries: null for a deletion; with `empty`, a null value of an update is that (present)."""
    kept = value if empty is None else F.coalesce(value, F.lit(empty))
    return F.when(op == UPDATE, kept)


def changes(df: DataFrame) -> DataFrame:
    """`df` (key, value, and op and seq) as BINARY changes; strings are taken as UTF-8.

    A missing `op` column means updates. A null value of an update is the empty value.
    """
    op = F.coalesce(F.col("op").cast("byte"), F.lit(UPDATE).cast("byte")) if "op" in df.columns else F.lit(UPDATE).cast("byte")
    value = effective(F.col("value").cast("binary"), op, bytearray(b""))
    return df.select(F.col("key").cast("binary").alias("key"), value.alias("value"), op.alias("op"), F.col("seq").cast("long").alias("seq"))
