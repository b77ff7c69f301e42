"""Input tables of the registered queries. The same SQL text runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIRTY_CUSTOMER = """
WITH base AS (
  SELECT c_custkey AS k, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
  UNION ALL
  SELECT c_custkey AS k, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 0
)
SELECT k AS id,
  CASE WHEN k % 7 = 0 THEN '  ' || c_name || ' ' WHEN k % 31 = 0 THEN NULL ELSE c_name END AS name,
  CASE WHEN k % 11 = 0 THEN 'NA' WHEN k % 11 = 1 THEN ' null ' WHEN k % 11 = 2 THEN 'None'
       WHEN k % 11 = 3 THEN NULL ELSE c_mktsegment END AS segment,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 101 = 0 THEN c_acctbal * 50 ELSE c_acctbal END AS balance,
  CASE WHEN k % 17 = 0 THEN '-' ELSE CAST(k % 90 AS STRING) END AS age_text,
  CASE WHEN k % 19 = 0 THEN 'n/a' ELSE '2024-01-' || lpad(CAST(1 + k % 28 AS STRING), 2, '0') END AS signup_text,
  'user' || CAST(k AS STRING) || CASE WHEN k % 5 = 0 THEN ' at example' ELSE '@example.com' END AS email,
  lpad(CAST(k % 1000 AS STRING), 3, '0') || '.222.333-' || lpad(CAST(k % 100 AS STRING), 2, '0') AS cpf,
  CAST(c_nationkey AS INT) AS nation_key,
  CAST(c_nationkey % 5 AS INT) AS region_key,
  'BR' AS country,
  CAST(NULL AS STRING) AS empty_col
FROM base
"""

ORDERS_REF = """
SELECT o_totalprice AS price, o_orderpriority AS priority, o_orderstatus AS status, o_custkey AS cust
FROM orders WHERE o_orderkey % 2 = 0
"""

ORDERS_NEW = """
SELECT o_totalprice * 1.2 AS price,
  CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS priority,
  o_orderstatus AS status, o_orderkey AS okey
FROM orders WHERE o_orderkey % 2 = 1
"""

# Invented contact table: one column per semantic pattern, a tenth of the cells off-pattern.
CONTACTS = """
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 10 = 9 THEN 'unknown' ELSE 'User.' || CAST(c_custkey AS STRING) || '@Mail.example.com' END AS email,
  CASE WHEN c_custkey % 10 = 9 THEN '?' ELSE lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '111222' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') END AS cpf,
  CASE WHEN c_custkey % 10 = 9 THEN '?' ELSE lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || '.345.678/0001-' || lpad(CAST(c_custkey % 97 AS STRING), 2, '0') END AS cnpj,
  CASE WHEN c_custkey % 10 = 9 THEN '?' ELSE lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') || '-' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') END AS cep,
  CASE WHEN c_custkey % 10 = 9 THEN '?' ELSE '(' || CAST(11 + c_custkey % 80 AS STRING) || ') 9' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || '-' || lpad(CAST(c_nationkey AS STRING), 4, '0') END AS phone,
  CASE WHEN c_custkey % 10 = 9 THEN '?' WHEN c_custkey % 2 = 0 THEN 'ABC' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
       ELSE 'xyz' || CAST(c_custkey % 10 AS STRING) || 'k' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') END AS plate,
  CASE WHEN c_custkey % 10 = 9 THEN '?' ELSE CAST(1 + c_custkey % 28 AS STRING) || '/' || CAST(1 + c_custkey % 12 AS STRING) || '/2023' END AS visit,
  CASE WHEN c_custkey % 10 = 9 THEN 'none' ELSE 'https://example.com/c/' || CAST(c_custkey AS STRING) END AS site,
  CASE WHEN c_custkey % 2 = 0 THEN 'a@b.co' ELSE 'free text' END AS mixed
FROM customer
"""

VIEWS = {
    "dirty_customer": DIRTY_CUSTOMER,
    "orders_ref": ORDERS_REF,
    "orders_new": ORDERS_NEW,
    "contacts": CONTACTS,
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one of the derived views over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    sources = {t: table(spark, sf_dir, t) for t in TABLES if f"FROM {t}" in sql}
    marked = sql
    for t in sources:
        marked = marked.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(marked, **sources)
