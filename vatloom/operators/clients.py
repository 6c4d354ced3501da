"""Clients: match by tax code, direction of a document, uniqueness, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import tax_code


def match(documents: DataFrame, clients: DataFrame) -> DataFrame:
    """Documents (doc_id, org_id, client_id, seller_tax_code, buyer_tax_code) with ``matched``: an own client stays; else the active client of the
    organization with the seller's digits, or the buyer's if the seller has none."""
    active = clients.where("is_active").withColumn("code", tax_code(F.col("tax_code"))).where("code IS NOT NULL").groupBy("org_id", "code").agg(F.min("client_id").alias("found"))
    d = documents.withColumns({"seller": tax_code(F.col("seller_tax_code")), "buyer": tax_code(F.col("buyer_tax_code"))})
    s = active.select("org_id", F.col("code").alias("seller"), F.col("found").alias("by_seller"))
    b = active.select("org_id", F.col("code").alias("buyer"), F.col("found").alias("by_buyer"))
    return d.join(s, ["org_id", "seller"], "left").join(b, ["org_id", "buyer"], "left").withColumn("matched", F.coalesce("client_id", "by_seller", "by_buyer")).drop("seller", "buyer", "by_seller", "by_buyer")


def direction(documents: DataFrame, clients: DataFrame) -> DataFrame:
    """Purchase if the client's digits are the buyer's, else Sale if the seller's, else Unknown."""
    own = clients.select(F.col("client_id"), tax_code(F.col("tax_code")).alias("own"))
    d = documents.join(own, "client_id", "left")
    is_buyer, is_seller = F.col("own") == tax_code(F.col("buyer_tax_code")), F.col("own") == tax_code(F.col("seller_tax_code"))
    return d.withColumn("direction", F.when(is_buyer, "Purchase").when(is_seller, "Sale").otherwise("Unknown")).drop("own")


def duplicate_tax_codes(clients: DataFrame) -> DataFrame:
    """Tax codes that several clients of an organization have."""
    return clients.where("tax_code IS NOT NULL").groupBy("org_id", "tax_code").agg(F.count("*").alias("n"), F.min("client_id").alias("first_id")).where("n > 1")


def taken(asked: DataFrame, clients: DataFrame) -> DataFrame:
    """Requests (request_id, org_id, tax_code, client_id: the client that is edited, null for a new one) with ``taken``: another client
    of the organization has the tax code. A null code is never taken."""
    held = clients.where("tax_code IS NOT NULL").groupBy("org_id", "tax_code").agg(F.count("*").alias("_n"), F.max("client_id").alias("_hi"), F.min("client_id").alias("_lo"))
    other = F.col("client_id").isNull() | (F.col("_n") > 1) & (F.col("_hi") != F.col("_lo")) | (F.col("_lo") != F.col("client_id"))
    return asked.join(held, ["org_id", "tax_code"], "left").withColumn("taken", F.col("_n").isNotNull() & other).drop("_n", "_hi", "_lo")


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace rows of the same key; others stay; new ones are added."""
    return current.join(changes, key, "left_anti").unionByName(changes.select(*current.columns))
