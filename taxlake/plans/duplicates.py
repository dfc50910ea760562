"""Exact duplicates over the text corpus, near duplicates over the derived documents."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxlake.operators import duplicates
from taxlake.plans import books
from taxlake.plans.catalog import flat, query
from taxlake.plans.oracle_base import DOCS, with_ctes


@query(
    "exact_duplicates",
    """WITH d AS (SELECT doc_id, sha256(text) AS sha, doc_id % 10 = 0 AS forced FROM documents),
o AS (SELECT sha, MIN(doc_id) AS oldest FROM d GROUP BY sha)
SELECT doc_id, oldest AS existing_id, sha AS sha256 FROM d JOIN o USING (sha) WHERE doc_id <> oldest AND NOT forced""",
)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = books.table(spark, sf_dir, "documents").select(
        F.lit(0).alias("tenant_id"),
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("created_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        F.when(F.col("doc_id") % 10 == 0, "import_anyway").alias("duplicate_action"),
        duplicates.content_hash(F.col("text")).alias("sha256"),
    )
    found = duplicates.exact_duplicates(docs).filter(F.col("existing_id").isNotNull())
    return found.select(F.col("id").alias("doc_id"), "existing_id", "sha256")


_NEAR = """
pool AS (
  SELECT id, tenant_id, direction, invoice_date, CAST(gross_amount_original * 100 AS BIGINT) AS cents, invoice_number,
    lower(CASE WHEN direction = 'income' THEN recipient_name ELSE issuer_name END) AS party, sha256, is_deleted, created_at
  FROM docs
  UNION ALL
  SELECT 'C' || id, tenant_id, direction, invoice_date, CAST(gross_amount_original * 100 AS BIGINT) + k % 5 - 2,
    CASE WHEN k % 2 = 0 THEN invoice_number END,
    lower(CASE WHEN direction = 'income' THEN recipient_name ELSE issuer_name END), sha256('copy|' || sha256), FALSE, created_at + INTERVAL 1 DAY
  FROM docs WHERE k % 6 = 5
)
"""


@query(
    "near_duplicates",
    with_ctes(DOCS, _NEAR)
    + """SELECT a.id, arg_min(b.id, (b.created_at, b.id)) AS possible_duplicate_id
FROM pool a JOIN pool b ON a.tenant_id = b.tenant_id AND a.direction = b.direction AND a.invoice_date = b.invoice_date
  AND abs(a.cents - b.cents) <= 1 AND a.sha256 <> b.sha256 AND NOT b.is_deleted AND b.created_at < a.created_at
  AND (a.invoice_number = b.invoice_number OR a.party = b.party)
GROUP BY a.id""",
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = books.documents(spark, sf_dir)
    k = F.col("k")
    # copies of some documents, up to two cents apart, half of them without a number
    copies = docs.filter(k % 6 == 5).withColumns(
        {
            "id": F.concat(F.lit("C"), "id"),
            "gross_amount_original": (
                F.col("gross_amount_original") + (k % 5 - 2) * F.lit(Decimal("0.01"))
            ).cast("decimal(18,2)"),
            "invoice_number": F.when(k % 2 == 0, F.col("invoice_number")),
            "sha256": F.sha2(F.concat(F.lit("copy|"), "sha256"), 256),
            "deleted_at": F.lit(None).cast("timestamp"),
            "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY"),
        }
    )
    wanted = [
        "id", "tenant_id", "direction", "invoice_date", "gross_amount_original", "invoice_number",
        "issuer_name", "recipient_name", "sha256", "created_at", "deleted_at",
    ]
    pool = docs.select(*wanted).unionByName(copies.select(*wanted))
    found = duplicates.near_duplicates(pool).filter(F.col("possible_duplicate_id").isNotNull())
    return found.select("id", "possible_duplicate_id")
