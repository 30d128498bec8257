"""Tracks derived from the star-schema tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _event_points(spark: SparkSession, folder: str) -> DataFrame:
    """Events with day and hour of their time in UTC."""
    events = table(spark, folder, "events")
    ts = F.col("ts")
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        hour, day = F.hour(ts), F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date"))
    else:
        micros = F.unix_micros(ts)
        hour, day = F.pmod(F.floor(micros / 3_600_000_000), F.lit(24)), F.floor(micros / 86_400_000_000) - 19723
    return events.select("event_id", "ts", F.col("user_id").alias("object_id"), day.cast("double").alias("day"), F.col("value").alias("x"), hour.cast("double").alias("y"), (F.col("event_id") % 100).cast("double").alias("z"))


def day_points(spark: SparkSession, folder: str) -> DataFrame:
    """Several points per object and day."""
    return _event_points(spark, folder).select("object_id", F.col("day").alias("time"), "x", "y", "z")


def day_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """One mean point per object and day, with gaps.

    Points are added in order of event, since sums of floats depend on their order in the last bit, which decides
    between places just in reach and just out of it: so files and tasks don't change who meets.
    """
    w = Window.partitionBy("object_id", "time").orderBy("event_id", *"xyz")
    points = _event_points(spark, folder).select("event_id", "object_id", F.col("day").alias("time"), *"xyz")
    # The running mean of the last point; a window adds row by row.
    means = points.select("object_id", "time", *(F.avg(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in "xyz"), F.lead(F.lit(True)).over(w).isNull().alias("last"))
    return means.where("last").drop("last")


def step_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """An object's events in order, without gaps."""
    w = Window.partitionBy("object_id").orderBy("ts", "event_id")
    return _event_points(spark, folder).select("object_id", F.row_number().over(w).cast("double").alias("time"), "x", "y", "z")


def supplier_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Long tracks: each supplier's items by date and all other columns."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("object_id"), F.row_number().over(w).cast("double").alias("time"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


def user_categories(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("object_id")).distinct().select("object_id", F.concat(F.lit("c"), (F.col("object_id") % 5).cast("string")).alias("category"))


def embedding_features(spark: SparkSession, folder: str, width: int = 64) -> DataFrame:
    """The dimensions of the embeddings as features, labels as categories."""
    values = F.struct(*(F.col("embedding")[i].cast("double").alias(f"d{i:02d}") for i in range(width)))
    # Taken out of a list of one: columns of a generator, unlike 64 aliases of items, are no burden for the optimizer.
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("object_id"), F.col("label").cast("string").alias("category"), F.inline(F.array(values)))


SQL = {
    "day_points": "select user_id as object_id, date_diff('day', timestamp '2024-01-01', date_trunc('day', ts))::double as time, value as x, hour(ts)::double as y, (event_id % 100)::double as z from events",
    "day_tracks": "select object_id, time, avg(x) as x, avg(y) as y, avg(z) as z from day_points group by object_id, time",
    "step_tracks": "select user_id as object_id, (row_number() over (partition by user_id order by ts, event_id))::double as time, value as x, hour(ts)::double as y, (event_id % 100)::double as z from events",
    "supplier_tracks": "select l_suppkey as object_id, (row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus))::double as time, l_quantity as x, l_extendedprice / 1000 as y, l_discount * 100 as z from lineitem",
    "user_categories": "select distinct user_id as object_id, 'c' || (user_id % 5)::varchar as category from events",
}
