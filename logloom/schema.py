"""The one record type: a log line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("structured", T.BooleanType()),
        T.StructField("raw_data", T.StringType()),
        T.StructField("indexes", T.ArrayType(T.StringType())),
        T.StructField("json_keys", T.ArrayType(T.StringType())),
    ]
)
#: A pushed line, and the body of a push: every field is mandatory.
PUSHED = T.StructType([f for f in LINE.fields if f.name not in ("source", "seq")])
PUSH = T.StructType([T.StructField("source", T.StringType(), False), T.StructField("lines", T.ArrayType(PUSHED, False), False)])
COLUMNS = tuple(LINE.names)


def conform(df: DataFrame) -> DataFrame:
    """The columns of a log line in order and type; missing index columns become null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in LINE.fields])
