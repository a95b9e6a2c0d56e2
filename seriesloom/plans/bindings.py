"""The research model's tables over the sample star schema, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series

AS_OF = "2001-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, d, v, seq1, seq2 and the split columns of every observation, all revisions."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("d"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"),
        F.col("l_orderkey").alias("seq1"), F.col("l_linenumber").alias("seq2"), "l_returnflag", "l_linestatus", "l_discount",
    )


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, d, v: the current revision of each day."""
    return series.current(observations(spark, sf_dir), ["code", "d"], ["seq1", "seq2"], ["v"])


def payouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, d, amount of payout events, one for each day."""
    rows = observations(spark, sf_dir).where("l_returnflag = 'R'").withColumn("amount", F.col("l_discount") * F.col("v"))
    return series.current(rows, ["code", "d"], ["seq1", "seq2"], ["amount"]).where("amount > 0")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, house, class, product of every series."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    both = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    product = F.when(F.col("s_suppkey") % 7 == 0, "index_fund").otherwise("mutual_fund")
    return both.select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("house"), F.col("r_name").alias("class"), product.alias("product"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, d, v: the latest revision of each day of each index."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderpriority").alias("code"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))
    return series.current(rows, ["code", "d"], ["seq"], ["v"])


NAV_SQL = """obs AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS v, l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_discount FROM lineitem),
nav AS (SELECT code, d, v FROM (SELECT *, row_number() OVER (PARTITION BY code, d ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM obs) WHERE rn = 1)"""
PAYOUT_SQL = """pay AS (SELECT code, d, amount FROM (SELECT code, d, l_discount * v AS amount, row_number() OVER (PARTITION BY code, d ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM obs WHERE l_returnflag = 'R') WHERE rn = 1 AND amount > 0)"""
MEMBER_SQL = """mem AS (SELECT s_suppkey AS code, s_name AS name, n_name AS house, r_name AS class, CASE WHEN s_suppkey % 7 = 0 THEN 'index_fund' ELSE 'mutual_fund' END AS product FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
BENCH_SQL = """bench AS (SELECT code, d, v FROM (SELECT o_orderpriority AS code, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)"""
