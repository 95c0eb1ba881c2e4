"""Genome-shaped views over the driver's tables, the same in Spark and in DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "features": """
SELECT l_suppkey AS seqid, l_partkey * 40 + l_linenumber + 1 AS start, l_partkey * 40 + l_linenumber + CAST(l_quantity AS BIGINT) AS stop,
  CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS strand, CASE l_returnflag WHEN 'A' THEN 'CDS' WHEN 'N' THEN 'exon' ELSE 'gene' END AS type,
  'g' || CAST(l_orderkey AS STRING) AS parent, l_extendedprice AS score
FROM lineitem""",
    "reads": """
SELECT event_id, event_id % 100 AS seqid, 1 + (event_id * 7919) % 80000 AS start, 1 + (event_id * 7919) % 80000 + 17 + event_id % 13 AS stop,
  CASE WHEN event_type IN ('click', 'view') THEN '+' ELSE '-' END AS strand, 1 + event_id % 5 AS weight, 'L' || CAST(user_id % 3 AS STRING) AS lib,
  SUBSTR('ACGT', CAST(1 + event_id % 4 AS INT), 1) AS base5, SUBSTR('ACGT', CAST(1 + event_id % 7 % 4 AS INT), 1) AS base3
FROM events""",
    "genome": "SELECT l_suppkey AS seqid, MAX(l_partkey * 40 + l_linenumber + CAST(l_quantity AS BIGINT)) + 1000 AS length FROM lineitem GROUP BY l_suppkey",
    "seqs": "SELECT doc_id AS id, UPPER(REGEXP_REPLACE(LOWER(text), '[^acgt]', ''{G})) AS seq FROM documents",
    "orthogroups": "SELECT l_orderkey AS group_id, 'S' || CAST(l_suppkey % 7 AS STRING) AS species, 'p' || CAST(l_partkey AS STRING) AS gene FROM lineitem",
    "alleles": """
SELECT p_partkey % 5 AS chrom, 1 + p_partkey * 37 AS pos, 'G' || CAST(CAST(FLOOR(p_partkey / 20.0) AS BIGINT) AS STRING) AS gene,
  CASE WHEN p_size % 3 = 0 THEN 'Synonymous' ELSE 'Non-Synonymous' END AS snptype, CASE WHEN n_nationkey < 6 THEN 'CI' ELSE 'CP' END AS pop, n_nationkey AS sample,
  SUBSTR('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS ref,
  CASE WHEN (p_partkey + n_nationkey) % 11 = 0 THEN NULL
    WHEN (p_partkey * (n_nationkey + 3) + p_size) % 7 < 3 THEN SUBSTR('ACGT', CAST(1 + (p_partkey + 1) % 4 AS INT), 1)
    ELSE SUBSTR('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) END AS allele
FROM part CROSS JOIN nation WHERE n_nationkey < 12""",
    "edges": """
SELECT 'N' || CAST(n_nationkey AS STRING) AS child, 'R' || CAST(n_regionkey AS STRING) AS parent FROM nation
UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'N' || CAST(c_nationkey AS STRING) FROM customer
UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'M' || c_mktsegment FROM customer
UNION ALL SELECT DISTINCT 'M' || c_mktsegment, 'ROOT' FROM customer
UNION ALL SELECT 'R' || CAST(r_regionkey AS STRING), 'ROOT' FROM region""",
    "assoc": "SELECT 'C' || CAST(o_custkey AS STRING) AS term, 'IEA' AS evidence, 'P' || CAST(o_orderkey % 500 AS STRING) AS gene FROM orders",
    "hits": """
SELECT 'S' || CAST(l_orderkey % 7 AS STRING) || '_' || CAST(l_orderkey AS STRING) AS query, 'S' || CAST(l_partkey % 7 AS STRING) || '_' || CAST(l_partkey AS STRING) AS hit,
  100 * (1 - l_discount) AS pid, l_quantity AS aln_len, l_tax AS evalue, l_extendedprice AS bits, l_linenumber AS line_no, l_suppkey * 50 + l_partkey % 900 AS qstart
FROM lineitem""",
    "aln": """
SELECT b.block, 'r' || CAST(b.r AS STRING) AS row_id, RPAD(CASE WHEN b.r = 2 THEN REPLACE(b.s, 'T', '-') ELSE b.s END, CAST(k.n AS INT), '-') AS aln
FROM (SELECT CAST(FLOOR(doc_id / 3.0) AS BIGINT) AS block, doc_id % 3 AS r, UPPER(REGEXP_REPLACE(LOWER(COALESCE(text, '')), '[^acgt]', ''{G})) AS s FROM documents) b
JOIN (SELECT block, MAX(n) AS n FROM (SELECT CAST(FLOOR(doc_id / 3.0) AS BIGINT) AS block, LENGTH(REGEXP_REPLACE(LOWER(text), '[^acgt]', ''{G})) AS n FROM documents) x GROUP BY block HAVING COUNT(*) = 3 AND MAX(n) > 0) k
ON b.block = k.block""",
}

READ = re.compile(r"\b(FROM|JOIN) (region|nation|customer|supplier|part|orders|lineitem|events|documents)\b")


class Views:
    """The views over one folder of tables, by attribute; lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the driver's tables, which are read where they are named after FROM or JOIN."""
        used = {}

        def put(m):
            used[m[2]] = self.table(m[2])
            return f"{m[1]} {{{m[2]}}}"

        text = READ.sub(put, text.replace("{G}", ""))
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)


QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(views) -> DataFrame`` under a name, with DuckDB SQL over the same views."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
            views = ", ".join(f"{v} AS ({VIEWS[v].replace('{G}', chr(44) + ' ' + repr('g'))})" for v in used)
            text = sql.strip()
            recursive = re.match(r"WITH RECURSIVE\b", text)
            text = re.sub(r"^WITH( RECURSIVE)?\s", ", ", text) if text.startswith("WITH") and views else text
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{views}{'' if text.startswith(',') else ' '}{text}" if views else text
        return f

    return put
