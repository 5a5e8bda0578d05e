"""Registered source/sink queries (SRC1-SRC4, SNK1-SNK7, PF15) and the streaming contract check."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tabletwin.operators import contract as CT
from tabletwin.operators import fd as FD
from tabletwin.operators.profile import Profiler
from tabletwin.plans.contract_plans import VIOL_SQL
from tabletwin.plans.fd_plans import fd_sql, GEO_COLS
from tabletwin.plans.profile_plans import CUST_ALL, whole_profile
from tabletwin.plans.profile_sql import whole_profile_sql
from tabletwin.plans.registry import query
from tabletwin.plans.synth_plans import POL, SYNTH_TABLE_SQL, _synth_table
from tabletwin.plans.tables import CUSTOMER_GEO_SQL, customer_geo, policies, table
from tabletwin.session import ensure_checkpoint_dir
from tabletwin.sources import io as IO
from tabletwin.streaming import contract_stream as ST


def _scratch(spark, what):
    return os.path.join(ensure_checkpoint_dir(spark), f"{what}-{uuid.uuid4().hex}")


@query("csv_roundtrip", "SELECT * FROM orders")
def csv_roundtrip(spark, sf):
    """SRC1/SNK4: orders written as CSV with a header and read back with the schema."""
    o = table(spark, sf, "orders")
    path = _scratch(spark, "csv")
    IO.write_table(o, path, "csv")
    return IO.read_table(spark, path, "csv", schema=o.schema)


@query("json_roundtrip", "SELECT * FROM customer")
def json_roundtrip(spark, sf):
    """SNK5: customer rows as JSON lines and back."""
    c = table(spark, sf, "customer")
    path = _scratch(spark, "json")
    IO.write_table(c, path, "json")
    return IO.read_table(spark, path, "json", schema=c.schema)


@query("profile_roundtrip", whole_profile_sql(CUSTOMER_GEO_SQL, CUST_ALL))
def profile_roundtrip(spark, sf):
    """SNK1/SRC4: the whole profile (fits of all six families, top values) saved as JSON and read back."""
    prof = whole_profile(Profiler(customer_geo(spark, sf)))
    path = _scratch(spark, "profile")
    IO.save_artifact(prof, path)
    IO.save_artifact(prof.limit(0), path, mode="ignore")  # SNK6: a finished stage is skipped
    return IO.load_artifact(spark, path, prof.schema)


@query("fd_roundtrip", fd_sql(CUSTOMER_GEO_SQL, GEO_COLS) + "SELECT lhs, rhs, confidence, kind FROM fds")
def fd_roundtrip(spark, sf):
    """SNK2/SRC4: the FD list saved as JSON and read back."""
    fds = FD.discover(customer_geo(spark, sf))
    path = _scratch(spark, "fds")
    IO.save_artifact(fds, path)
    back = IO.load_artifact(spark, path, fds.schema)
    return back.select(F.concat_ws(",", "lhs").alias("lhs"), "rhs", "confidence", "kind")


@query("run_metadata", f"""SELECT count(*) AS rows, 20 AS columns, round(avg(claim_status::DOUBLE), 4) AS label_rate,
  count(DISTINCT model) AS distinct_keys, 42 AS seed FROM ({SYNTH_TABLE_SQL})""")
def run_metadata(spark, sf):
    """SNK7: run record of the synthetic table."""
    return IO.run_metadata(_synth_table(spark, sf), "claim_status", "model", 42)


@query("preview_columns", f"""SELECT policy_id, fuel_type, transmission_type, steering_type, rear_brakes_type
  FROM {POL} ORDER BY policy_id LIMIT 200""")
def preview_columns(spark, sf):
    """PF15: the columns whose name contains 'type' (plus the key), first 200 rows in key order."""
    p = policies(spark, sf)
    cols = [c for c in p.columns if "type" in c.lower()]
    return p.select("policy_id", *cols).orderBy("policy_id").limit(200)


@query("validate_stream", VIOL_SQL + "SELECT column_name, check_name, failure_case, row_key FROM v")
def validate_stream(spark, sf):
    """CT13 on Structured Streaming: customer files streamed, faults planted per micro-batch, violations
    against the contract learned from the batch table, collected with an available-now trigger."""
    from tabletwin.plans.contract_plans import customer_bad
    cust = table(spark, sf, "customer")
    stream = (spark.readStream.schema(cust.schema).option("pathGlobFilter", "customer.parquet")
              .option("maxFilesPerTrigger", 1).parquet(sf))
    contract = CT.learn(customer_geo(spark, sf))

    def faults(df):
        return customer_bad_frame(df)

    v = ST.violations_stream(stream, contract, "c_custkey", faults)
    return ST.schema_violations(stream, contract, faults).unionByName(ST.run_available(spark, v))


def customer_bad_frame(c):
    k = F.col("c_custkey")
    return c.select(
        "c_custkey",
        F.when(k % 101 == 0, F.lit("Nobody")).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 83 == 0, F.lit(None).cast("string")).when(k % 79 == 0, F.lit("x"))
         .otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey"),
        F.when(k % 97 == 0, F.col("c_acctbal") + 1_000_000).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 89 == 0, F.lit("UNKNOWN")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
