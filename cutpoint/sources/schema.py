"""The two fact tables, as delivered by a source and as staged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CREDITS = T.DecimalType(38, 9)

# Source columns of the query history: one row per executed statement. Times are in milliseconds.
QUERY_HISTORY_SOURCE = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("query_id", T.StringType()),
        T.StructField("query_text", T.StringType()),
        T.StructField("query_parameterized_hash", T.StringType()),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("execution_time", T.LongType()),
        T.StructField("warehouse_name", T.StringType()),
        T.StructField("warehouse_size", T.StringType()),
        T.StructField("execution_status", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("role_name", T.StringType()),
        T.StructField("database_name", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("query_type", T.StringType()),
        T.StructField("total_elapsed_time", T.LongType()),
        T.StructField("bytes_scanned", T.LongType()),
        T.StructField("bytes_written", T.LongType()),
        T.StructField("rows_produced", T.LongType()),
        T.StructField("queued_overload_time", T.LongType()),
        T.StructField("queued_provisioning_time", T.LongType()),
        T.StructField("queued_repair_time", T.LongType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)

# Source columns of the metering history: one row per warehouse and metering interval.
METERING_SOURCE = T.StructType(
    [
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("warehouse_id", T.LongType()),
        T.StructField("warehouse_name", T.StringType()),
        T.StructField("credits_used", CREDITS),
        T.StructField("credits_used_compute", CREDITS),
        T.StructField("credits_used_cloud_services", CREDITS),
    ]
)

TIME_DIMENSIONS = T.StructType(
    [
        T.StructField("activity_date", T.DateType()),
        T.StructField("day_num", T.IntegerType()),
        T.StructField("day_of_week", T.StringType()),
        T.StructField("year_iso", T.IntegerType()),
        T.StructField("week_iso", T.IntegerType()),
        T.StructField("week_start_date", T.TimestampNTZType()),
    ]
)

LOAD_STAMP = T.StructType([T.StructField("last_inserted_at", T.TimestampNTZType())])


def staged(source: T.StructType) -> T.StructType:
    return T.StructType([*source.fields, *TIME_DIMENSIONS.fields, *LOAD_STAMP.fields])


QUERY_HISTORY = staged(QUERY_HISTORY_SOURCE)
METERING = staged(METERING_SOURCE)


#: Without these columns every report would be empty or zero, so a source must have them.
REQUIRED = frozenset(
    {
        "start_time",
        "warehouse_name",
        "execution_status",
        "execution_time",
        "bytes_scanned",
        "query_parameterized_hash",
        "credits_used",
    }
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, cast to its types; absent ones become NULL, unless REQUIRED.

    Timestamps keep their kind (instant or zone-less): staging turns both into UTC wall-clock time.
    """

    missing = [f.name for f in schema.fields if f.name in REQUIRED and f.name not in df.columns]
    if missing:
        raise ValueError(f"the source lacks {', '.join(missing)}")

    def column(f: T.StructField) -> str:
        if f.name in df.columns and isinstance(f.dataType, T.TimestampNTZType):
            return f.name
        value = f.name if f.name in df.columns else "NULL"
        return f"CAST({value} AS {f.dataType.simpleString()}) AS {f.name}"

    return df.selectExpr(*[column(f) for f in schema.fields])


def read_staged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A staged table, with its declared schema: no inference pass over the files."""
    return spark.read.schema(schema).parquet(path)
