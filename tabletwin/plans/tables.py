"""Driver tables and the tables Spark derives from them for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customer_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer joined to nation and region (nation/region are 25/5-row dimensions: broadcast)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
             .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
             .select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
                     "n_nationkey", "n_name", "n_regionkey", "r_name"))


CUSTOMER_GEO_SQL = """(SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, n_nationkey, n_name, n_regionkey, r_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def labels_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with Yes/No string flags (the reference's flag form) next to the 0/1 ints."""
    lb = table(spark, sf_dir, "labels")
    yn = lambda c: F.when(F.col(c) == 1, F.lit("Yes")).when(F.col(c) == 0, F.lit("No"))
    return lb.select("doc_id", yn("quality").alias("is_quality"), yn("toxic").alias("is_toxic"),
                     F.when(F.col("toxic") == 1, F.lit("Yes")).alias("is_toxic_or_null"), "quality")


LABELS_FLAGS_SQL = """(SELECT doc_id, CASE WHEN quality = 1 THEN 'Yes' WHEN quality = 0 THEN 'No' END AS is_quality,
  CASE WHEN toxic = 1 THEN 'Yes' WHEN toxic = 0 THEN 'No' END AS is_toxic,
  CASE WHEN toxic = 1 THEN 'Yes' END AS is_toxic_or_null, quality FROM labels)"""


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insurance-style table Spark derives from customer, nation, region and orders (one row per customer):
    ``model`` and the attributes it determines come from the customer's nation, the region code from the
    market segment, age from the balance, subscription length and vehicle age from the customer's orders,
    and the label from whether the customer has a finished urgent order."""
    g = customer_geo(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("avg_price"),
        F.max(((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).cast("int")).alias("urgent_f"))
    d = g.join(per, g.c_custkey == per.o_custkey, "left")
    k = F.col("n_nationkey")
    yn = lambda cond: F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))
    seg = F.element_at(F.array(*[F.lit(s) for s in ["A", "B1", "B2", "C1", "C2", "Utility"]]), (k % 6 + 1).cast("int"))
    fuel = F.element_at(F.array(F.lit("CNG"), F.lit("Petrol"), F.lit("Diesel")), (F.col("n_regionkey") % 3 + 1).cast("int"))
    steer = F.element_at(F.array(F.lit("Power"), F.lit("Electric"), F.lit("Manual")), (k % 3 + 1).cast("int"))
    region = F.element_at(F.create_map(*[x for i, s in enumerate(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
                                         for x in (F.lit(s), F.lit(f"C{i + 1}"))]), F.col("c_mktsegment"))
    return d.select(
        F.format_string("POL%06d", F.col("c_custkey")).alias("policy_id"),
        F.round(F.coalesce(F.col("avg_price"), F.lit(0.0)) / 25000.0, 1).alias("subscription_length"),
        (F.coalesce(F.col("n_orders"), F.lit(0)) / 2.0).alias("vehicle_age"),
        (F.lit(18) + F.floor((F.col("c_acctbal") + 1000.0) / 11000.0 * 62.0)).cast("bigint").alias("customer_age"),
        region.alias("region_code"),
        (F.length(F.col("c_mktsegment")) * 1000 + 7).cast("bigint").alias("region_density"),
        F.concat(F.lit("M"), k.cast("string")).alias("model"),
        seg.alias("segment"), fuel.alias("fuel_type"),
        F.when(k % 2 == 0, F.lit("Manual")).otherwise(F.lit("Automatic")).alias("transmission_type"),
        steer.alias("steering_type"),
        F.when(k % 4 < 2, F.lit("Drum")).otherwise(F.lit("Disc")).alias("rear_brakes_type"),
        yn(k % 2 == 1).alias("is_esc"), yn(k % 5 < 2).alias("is_parking_camera"), yn(k % 3 != 0).alias("is_tpms"),
        (F.lit(2) + 2 * (k % 3)).cast("bigint").alias("airbags"),
        (F.lit(1000) + 37 * k).cast("bigint").alias("displacement"),
        (F.col("n_regionkey") + 1).cast("bigint").alias("ncap_rating"),
        F.coalesce(F.col("urgent_f"), F.lit(0)).cast("bigint").alias("claim_status"))


POLICIES_SQL = """(SELECT printf('POL%06d', c_custkey) AS policy_id,
  round(coalesce(avg_price, 0.0) / 25000.0, 1) AS subscription_length,
  coalesce(n_orders, 0) / 2.0 AS vehicle_age,
  CAST(18 + floor((c_acctbal + 1000.0) / 11000.0 * 62.0) AS BIGINT) AS customer_age,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'C1' WHEN 'BUILDING' THEN 'C2' WHEN 'FURNITURE' THEN 'C3' WHEN 'HOUSEHOLD' THEN 'C4' WHEN 'MACHINERY' THEN 'C5' END AS region_code,
  CAST(length(c_mktsegment) * 1000 + 7 AS BIGINT) AS region_density,
  'M' || CAST(n_nationkey AS VARCHAR) AS model,
  ['A', 'B1', 'B2', 'C1', 'C2', 'Utility'][n_nationkey % 6 + 1] AS segment,
  ['CNG', 'Petrol', 'Diesel'][n_regionkey % 3 + 1] AS fuel_type,
  CASE WHEN n_nationkey % 2 = 0 THEN 'Manual' ELSE 'Automatic' END AS transmission_type,
  ['Power', 'Electric', 'Manual'][n_nationkey % 3 + 1] AS steering_type,
  CASE WHEN n_nationkey % 4 < 2 THEN 'Drum' ELSE 'Disc' END AS rear_brakes_type,
  CASE WHEN n_nationkey % 2 = 1 THEN 'Yes' ELSE 'No' END AS is_esc,
  CASE WHEN n_nationkey % 5 < 2 THEN 'Yes' ELSE 'No' END AS is_parking_camera,
  CASE WHEN n_nationkey % 3 <> 0 THEN 'Yes' ELSE 'No' END AS is_tpms,
  CAST(2 + 2 * (n_nationkey % 3) AS BIGINT) AS airbags,
  CAST(1000 + 37 * n_nationkey AS BIGINT) AS displacement,
  CAST(n_regionkey + 1 AS BIGINT) AS ncap_rating,
  CAST(coalesce(urgent_f, 0) AS BIGINT) AS claim_status
FROM (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) g
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS avg_price,
  max(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 ELSE 0 END) AS urgent_f FROM orders GROUP BY o_custkey) p
ON g.c_custkey = p.o_custkey)"""
