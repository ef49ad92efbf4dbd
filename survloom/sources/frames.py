"""Survival frames made from order tables, and the reading of those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Last day of observation: an order not shipped by then is censored.
HORIZON = "2001-12-31"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_after(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders with ``first_ship``: the earliest shipping day after the order day.

    Line items collapse to distinct days per order before the join, so an order
    with a huge number of lines sends at most one row per day to its task.
    """
    days = lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("_day")
    ).distinct()
    # Both sides grow with the data, so neither is to be broadcast. The aggregation
    # finds its rows already partitioned and sorted by o_orderkey. The order's
    # own columns are aggregates, not keys, so that unused ones are never read.
    later = F.min(F.when(F.col("_day") > F.to_date("o_orderdate"), F.col("_day")))
    own = [F.first(c).alias(c) for c in orders.columns if c != "o_orderkey"]
    return (
        orders.join(days.hint("merge"), "o_orderkey", "left")
        .groupBy("o_orderkey")
        .agg(*own, later.alias("first_ship"))
    )


def survival_frame(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: time in days to its first shipment, or to the horizon.

    ``efs`` 1 = shipped, 0 = censored; ``stratum`` is the market segment and
    ``pred`` a risk score with ties.
    """
    orders = first_after(
        table(spark, folder, "orders"), table(spark, folder, "lineitem")
    )
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left")
    end = F.coalesce("first_ship", F.lit(HORIZON).cast("date"))
    return joined.select(
        F.col("o_orderkey").alias("ID"),
        F.col("first_ship").isNotNull().cast("int").alias("efs"),
        F.datediff(end, F.to_date("o_orderdate")).cast("double").alias("efs_time"),
        F.col("c_mktsegment").alias("stratum"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("balance"),
        F.round(F.col("o_totalprice") / 1000, 0).alias("pred"),
        F.when(F.col("o_orderkey") % 10 == 9, "TEST").otherwise("TRAIN").alias("dataset"),
    )


def training_rows() -> Column:
    return F.col("dataset") == "TRAIN"


def line_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as a survival table with almost unique times; it has no key."""
    return table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("efs_time"),
        (F.col("l_returnflag") != "N").cast("int").alias("efs"),
        F.col("l_linestatus").alias("stratum"),
        F.col("l_quantity").alias("quantity"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100, 0).alias("pred"),
    )
