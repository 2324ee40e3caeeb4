"""Declared schemas of the input relations and the checks on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TWEETS = T.StructType(
    [
        T.StructField("tweet_id", T.LongType(), False),
        T.StructField("author_id", T.StringType(), False),
        T.StructField("inbound", T.BooleanType(), False),
        T.StructField("created_at", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("response_tweet_id", T.StringType()),
        T.StructField("in_response_to_tweet_id", T.StringType()),
    ]
)

THREADS = T.StructType(
    [
        T.StructField("customer_tweet_id", T.LongType()),
        T.StructField("customer_text", T.StringType()),
        T.StructField("customer_created_at", T.StringType()),
        T.StructField("brand_tweet_id", T.LongType()),
        T.StructField("brand_reply_text", T.StringType()),
        T.StructField("brand_reply_created_at", T.StringType()),
        T.StructField("has_followup", T.BooleanType()),
        T.StructField("followup_text", T.StringType()),
        T.StructField("thread_length", T.IntegerType()),
        T.StructField("response_time_minutes", T.DoubleType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("total_golden_examples", T.LongType()),
        T.StructField("dev_count", T.LongType()),
        T.StructField("test_count", T.LongType()),
        T.StructField("seed", T.LongType()),
        T.StructField("dev_golden_ids", T.ArrayType(T.LongType())),
        T.StructField("test_golden_ids", T.ArrayType(T.LongType())),
    ]
)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """SRC6: fail before any job runs when a column is missing, naming all that are."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
