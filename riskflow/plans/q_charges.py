"""Registered queries: card-charge flattening (I6-I8) over the orders feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.constants import CATEGORY_MAPPING
from riskflow.plans.registry import query
from riskflow.sources import charges


def _lst(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


CH = f"""WITH ch AS (
  SELECT printf('ch_%08d', o_orderkey) AS id,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE printf('cus_%06d', o_custkey) END AS customer,
         CAST(epoch(o_orderdate) AS BIGINT) AS created,
         CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
         {_lst(charges.DESCRIPTIONS)}[o_orderkey % 8 + 1] AS description,
         CASE WHEN o_orderkey % 4 = 0
              THEN ['gas_station', 'toys', 'hotel', 'restaurant', 'gambling'][(o_orderkey // 4) % 5 + 1] END
           AS meta_category,
         CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN n.n_name END AS city,
         CASE WHEN o_custkey % 5 <> 0 THEN r.r_name END AS country,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 100 AS INTEGER) END AS risk_score,
         CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 100 >= 65 THEN 'elevated' ELSE 'normal' END END
           AS risk_level,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'card' END AS payment_method
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
                LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
                LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""

MAP_SQL = "CASE meta_category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_MAPPING) + " END"
DESC_SQL = "CASE " + " ".join(f"WHEN contains(lower(description), '{k}') THEN '{v}'" for k, v in CATEGORY_MAPPING) + " END"
CATEGORY_SQL = (f"COALESCE(CASE WHEN meta_category IS NOT NULL THEN COALESCE({MAP_SQL}, meta_category) END, "
                f"CASE WHEN NULLIF(description, '') IS NOT NULL THEN {DESC_SQL} END, 'Unknown')")
LOCATION_SQL = "COALESCE(NULLIF(city, ''), NULLIF(country, ''), 'Unknown')"


@query("charge_transactions", CH + f"""
SELECT 'STRIPE_' || id AS transaction_id,
       COALESCE(NULLIF(customer, ''), 'GUEST_' || substr(id, 1, 8)) AS account_id,
       make_timestamp(created * 1000000) AS "timestamp",
       amount / 100.0 AS amount,
       {CATEGORY_SQL} AS merchant_category,
       {LOCATION_SQL} AS location,
       0 AS is_fraud, risk_score AS stripe_risk_score, risk_level AS stripe_risk_level,
       payment_method, CASE WHEN id IS NULL OR id = '' THEN 'Missing charge id' END AS reject_reason
FROM ch""")
def q_charge_transactions(spark, d):
    return charges.flatten_charges(charges.order_charges(spark, d))


@query("charge_location", CH + f"\nSELECT id, {LOCATION_SQL} AS location FROM ch")
def q_charge_location(spark, d):
    c = charges.order_charges(spark, d)
    return c.select("id", charges.charge_location(F.col("billing_details.address.city"),
                                                  F.col("billing_details.address.country")).alias("location"))


@query("charge_category", CH + f"\nSELECT id, {CATEGORY_SQL} AS merchant_category FROM ch")
def q_charge_category(spark, d):
    c = charges.order_charges(spark, d)
    return c.select("id", charges.charge_category(F.col("metadata"), F.col("description")).alias("merchant_category"))
