"""Card charges -> transactions.

``flatten_charges`` works on the nested charge schema (metadata map,
billing address, outcome, payment method); every missing struct or key
yields NULL rather than an error. ``order_charges`` derives a charge feed
from the orders history (a join with customer, nation and region) so the
mapping runs over data that grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.constants import CATEGORY_MAPPING
from riskflow.sources.tables import read_table

# Charge descriptions used by the derived feed, by o_orderkey % 8.
DESCRIPTIONS = ["Hotel and Restaurant", "Online shopping order", "Monthly subscription renewal",
                "Gas_station fuel", "Entertainment tickets", "Toys and games", "", "Utilities bill"]


def charge_location(city: Column, country: Column) -> Column:
    """City, else country, else 'Unknown' (empty text counts as missing)."""
    return F.coalesce(F.nullif(city, F.lit("")), F.nullif(country, F.lit("")), F.lit("Unknown"))


def charge_category(metadata: Column, description: Column) -> Column:
    """I8: metadata category through the map (unmapped values pass through);
    else the first map key (in map order) found in the lower-cased
    description; else 'Unknown'."""
    key = F.element_at(metadata, F.lit("category")) if metadata is not None else F.lit(None)
    mapping = F.create_map(*[F.lit(x) for kv in CATEGORY_MAPPING for x in kv])
    mapped = F.coalesce(F.element_at(mapping, key), key)
    desc = F.lower(description)
    from_desc = None
    for k, v in CATEGORY_MAPPING:
        cond = desc.contains(k)
        from_desc = F.when(cond, F.lit(v)) if from_desc is None else from_desc.when(cond, F.lit(v))
    from_desc = F.when(F.nullif(description, F.lit("")).isNotNull(), from_desc)
    return F.coalesce(F.when(key.isNotNull(), mapped), from_desc, F.lit("Unknown"))


def flatten_charges(charges: DataFrame) -> DataFrame:
    """I6 (+I9): nested charges -> TRANSACTION + risk fields; a charge
    without an id is kept as a reject reason instead of failing the run."""
    bd = F.col("billing_details.address")
    return charges.select(
        F.concat(F.lit("STRIPE_"), F.col("id")).alias("transaction_id"),
        F.coalesce(F.nullif(F.col("customer"), F.lit("")),
                   F.concat(F.lit("GUEST_"), F.substring(F.col("id"), 1, 8))).alias("account_id"),
        F.timestamp_seconds(F.col("created")).cast("timestamp_ntz").alias("timestamp"),
        (F.col("amount") / 100.0).alias("amount"),
        charge_category(F.col("metadata"), F.col("description")).alias("merchant_category"),
        charge_location(bd.getField("city"), bd.getField("country")).alias("location"),
        F.lit(0).alias("is_fraud"),
        F.col("outcome.risk_score").alias("stripe_risk_score"),
        F.col("outcome.risk_level").alias("stripe_risk_level"),
        F.col("payment_method_details.type").alias("payment_method"),
        F.when(F.col("id").isNull() | (F.col("id") == ""), F.lit("Missing charge id")).alias("reject_reason"),
    )


def split_charges(charges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transactions of the readable charges, rejects with their reason)."""
    flat = flatten_charges(charges)
    return flat.where("reject_reason is null").drop("reject_reason"), flat.where("reject_reason is not null")


def order_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A charge feed derived from orders ⋈ customer ⋈ nation ⋈ region.

    nation (25 rows) and region (5 rows) are fixed-size dimensions, so
    broadcasting them is size-safe; customer is joined by AQE's choice."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                             "o_orderdate", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
          .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
          .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    key = F.col("o_orderkey")
    cats = ["gas_station", "toys", "hotel", "restaurant", "gambling"]
    city = (F.when(F.pmod(F.col("o_custkey"), F.lit(3)) == 0, F.lit(""))
             .when(F.pmod(F.col("o_custkey"), F.lit(3)) == 1, F.col("n_name")))
    country = F.when(F.pmod(F.col("o_custkey"), F.lit(5)) != 0, F.col("r_name"))
    risk = F.pmod(key, F.lit(100)).cast("int")
    return j.select(
        F.format_string("ch_%08d", key).alias("id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string"))
         .otherwise(F.format_string("cus_%06d", "o_custkey")).alias("customer"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"),
        F.element_at(F.array(*[F.lit(x) for x in DESCRIPTIONS]), (F.pmod(key, F.lit(8)) + 1).cast("int"))
         .alias("description"),
        F.when(F.pmod(key, F.lit(4)) == 0,
               F.create_map(F.lit("category"),
                            F.element_at(F.array(*[F.lit(x) for x in cats]),
                                         (F.pmod(F.floor(key / 4), F.lit(5)) + 1).cast("int"))))
         .alias("metadata"),
        F.struct(F.struct(city.alias("city"), country.alias("country")).alias("address")).alias("billing_details"),
        F.when(F.col("o_orderstatus") != "P",
               F.struct(risk.alias("risk_score"),
                        F.when(risk >= 65, F.lit("elevated")).otherwise(F.lit("normal")).alias("risk_level")))
         .alias("outcome"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED",
               F.struct(F.lit("card").alias("type"))).alias("payment_method_details"),
    )
