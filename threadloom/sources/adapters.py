"""Views of the driver's tables as the relations the operators expect.

Each adapter is a plain projection of a whole table: no window, no shuffle, no rows left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN_SPACE = 1_000_000
N_BRANDS = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as it lies; split sizes are the session's."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_tweets(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation as messages with pointers in both directions.

    The pointers are those of the turn before and after.  Short texts lose their forward pointer, long
    ones their backward pointer, and texts with a line break list a second reply that does not exist, so
    every link class and dangling pointers occur.  System turns are outbound messages of an author of their own.
    """
    tweet_id = F.col("conv_id") * TURN_SPACE + F.col("turn")
    chars = F.char_length("text")
    after = (tweet_id + 1).cast("string")
    forward = F.when(chars < 200, None).when(F.contains("text", F.lit("\n")), F.concat(after, F.lit(", -1"))).otherwise(after)
    backward = F.when((F.col("turn") > 0) & (chars <= 900), (tweet_id - 1).cast("string"))
    inbound = F.col("role") == "user"
    # Wall-clock arithmetic, so that the text does not depend on the session's time zone.
    start = F.lit("2017-10-01 00:00:00").cast("timestamp_ntz")
    created = F.timestamp_add("SECOND", F.col("conv_id") * 3600 + F.col("turn") * 1200 + chars, start)
    return conversations.select(
        tweet_id.alias("tweet_id"),
        F.when(inbound, F.concat(F.lit("c"), F.col("conv_id")))
        .when(F.col("role") == "system", F.lit("system"))
        .otherwise(F.concat(F.lit("brand_"), F.pmod(F.col("conv_id"), F.lit(N_BRANDS))))
        .alias("author_id"),
        inbound.alias("inbound"),
        F.date_format(created, "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"),
        "text",
        forward.alias("response_tweet_id"),
        backward.alias("in_response_to_tweet_id"),
    )


# The same projection for the DuckDB checks.
TWEETS_SQL = """
SELECT conv_id * 1000000 + turn AS tweet_id,
       CASE WHEN role = 'user' THEN 'c' || conv_id WHEN role = 'system' THEN 'system' ELSE 'brand_' || (conv_id % 15) END AS author_id,
       role = 'user' AS inbound,
       strftime(TIMESTAMP '2017-10-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 1200 + length(text)),
                '%a %b %d %H:%M:%S +0000 %Y') AS created_at,
       text,
       CASE WHEN length(text) < 200 THEN NULL
            WHEN contains(text, chr(10)) THEN (conv_id * 1000000 + turn + 1)::VARCHAR || ', -1'
            ELSE (conv_id * 1000000 + turn + 1)::VARCHAR END AS response_tweet_id,
       CASE WHEN turn > 0 AND length(text) <= 900 THEN (conv_id * 1000000 + turn - 1)::VARCHAR END
           AS in_response_to_tweet_id
FROM conversations
"""


def order_line_minutes(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Labelled durations: minutes from the order to each of its shipments, by order priority."""
    from threadloom.functions.scoring import minutes_between

    joined = lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").join(
        orders.select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return joined.select(
        "l_orderkey", "l_linenumber", F.col("o_orderpriority").alias("label"),
        minutes_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("minutes"),
    )


MINUTES_SQL = """
SELECT l_orderkey, l_linenumber, o_orderpriority AS label,
       (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 6.0e7::DOUBLE AS minutes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def line_scores(lineitem: DataFrame) -> DataFrame:
    """Ordinal 1..5 scores of two scorers on each order line for five criteria.

    The last criterion is constant on one side, so the undefined correlation occurs.
    """
    clip = lambda c: F.greatest(F.lit(1), F.least(F.lit(5), c.cast("int")))
    q, ln = F.col("l_quantity"), F.col("l_linenumber")
    return lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.cast("int")).alias("example_id"),
        F.concat(F.lit("part "), F.col("l_partkey")).alias("customer_text"),
        F.concat(F.lit("dm "), F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus")).alias("agent_draft"),
        clip(ln).alias("human_correctness"),
        clip(ln + F.col("l_tax") * 25 - 1).alias("human_groundedness"),
        clip(q / 10 + 1).alias("human_completeness"),
        clip(F.col("l_discount") * 50).alias("human_brand_voice"),
        clip(F.col("l_tax") * 60).alias("human_tone"),
        clip(q / 10 + 1).alias("judge_v1_correctness"),
        clip(ln + 1).alias("judge_v1_groundedness"),
        clip(q / 12 + 1 + F.col("l_tax") * 10).alias("judge_v1_completeness"),
        clip(F.col("l_discount") * 50 + F.col("l_tax") * 12).alias("judge_v1_brand_voice"),
        F.lit(4).alias("judge_v1_tone"),
        clip(F.col("l_tax") * 25 + ln).alias("judge_v2_correctness"),
        clip(ln).alias("judge_v2_groundedness"),
        clip(q / 11 + 1).alias("judge_v2_completeness"),
        clip(F.col("l_discount") * 45).alias("judge_v2_brand_voice"),
        F.lit(4).alias("judge_v2_tone"),
    )


_CLIP = "greatest(1, least(5, trunc({0})::INTEGER))"
SCORES_SQL = "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS example_id, 'part ' || l_partkey AS customer_text, 'dm ' || l_returnflag || ' ' || l_linestatus AS agent_draft, " + ", ".join(
    f"{_CLIP.format(expr)} AS {name}"
    for name, expr in {
        "human_correctness": "l_linenumber",
        "human_groundedness": "l_linenumber + l_tax * 25 - 1",
        "human_completeness": "l_quantity / 10 + 1",
        "human_brand_voice": "l_discount * 50",
        "human_tone": "l_tax * 60",
        "judge_v1_correctness": "l_quantity / 10 + 1",
        "judge_v1_groundedness": "l_linenumber + 1",
        "judge_v1_completeness": "l_quantity / 12 + 1 + l_tax * 10",
        "judge_v1_brand_voice": "l_discount * 50 + l_tax * 12",
        "judge_v1_tone": "4",
        "judge_v2_correctness": "l_tax * 25 + l_linenumber",
        "judge_v2_groundedness": "l_linenumber",
        "judge_v2_completeness": "l_quantity / 11 + 1",
        "judge_v2_brand_voice": "l_discount * 45",
        "judge_v2_tone": "4",
    }.items()
) + " FROM lineitem"
