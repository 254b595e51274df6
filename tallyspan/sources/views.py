"""The domain's tables as views over the driver's, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def chromosome(k: str) -> str:
    return f"CASE {k} % 25 WHEN 22 THEN 'chrX' WHEN 23 THEN 'chrY' WHEN 24 THEN 'chrM' ELSE concat('chr', CAST(1 + {k} % 25 AS VARCHAR(8))) END"


START = "(l_orderkey*37 + l_partkey*11) % 1000000"
VIEWS = {
    "reads": f"""
SELECT l_linenumber AS sample, {chromosome("l_suppkey")} AS chrom, {START} AS r_start,
       {START} + 25 + CAST(l_quantity AS BIGINT) AS r_end,
       CASE WHEN l_returnflag='R' THEN '-' ELSE '+' END AS strand,
       CAST(round(l_discount*100) AS INT) = 10 AS is_duplicate,
       CAST(round(l_tax*100) AS INT) <> 8 AS is_aligned,
       (CASE WHEN l_returnflag='R' THEN -1 ELSE 1 END) * (CAST(floor(l_extendedprice) AS BIGINT) % 600) AS tlen
FROM lineitem""",
    "piled_reads": f"""
SELECT sample, CASE WHEN piled THEN 'chr3' ELSE chrom END AS chrom, CASE WHEN piled THEN 100000 + r_start % 2000 ELSE r_start END AS r_start,
       CASE WHEN piled THEN 100000 + r_start % 2000 ELSE r_start END + size AS r_end, strand, false AS is_duplicate, true AS is_aligned
FROM (SELECT l_linenumber AS sample, {chromosome("l_suppkey")} AS chrom, {START} AS r_start, 25 + CAST(l_quantity AS BIGINT) AS size,
             CASE WHEN l_returnflag='R' THEN '-' ELSE '+' END AS strand, l_orderkey % 2 = 0 AS piled FROM lineitem)""",
    "windows": f"""
SELECT concat('peak_', CAST(p_partkey AS VARCHAR(12))) AS name, {chromosome("p_partkey")} AS chrom,
       (p_partkey*7919) % 1000000 AS w_start,
       (p_partkey*7919) % 1000000 + CASE WHEN p_size < 5 THEN 1500 ELSE 2000 END AS w_end,
       CASE p_size % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS w_strand
FROM part""",
    "called_peaks": f"""
SELECT l_linenumber AS sample, {chromosome("l_suppkey")} AS chrom, {START} AS p_start,
       {START} + 200 + CAST(l_quantity AS BIGINT) AS p_end,
       CAST(round(l_extendedprice*100) AS BIGINT) AS q, l_orderkey AS peak_id
FROM lineitem""",
    "regions": f"""
SELECT concat('region_', CAST(p_partkey AS VARCHAR(12))) AS name, {chromosome("p_partkey")} AS chrom, (p_partkey*7919) % 1000000 AS g_start,
       (p_partkey*7919) % 1000000 + CASE p_size % 10 WHEN 0 THEN 1 WHEN 1 THEN 50 WHEN 2 THEN 3000000 WHEN 3 THEN 100000 WHEN 4 THEN 17000 ELSE 2000 END AS g_end
FROM part""",
    "window_coverage": """
SELECT l_linenumber AS sample, l_partkey AS win, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n
FROM lineitem GROUP BY l_linenumber, l_partkey""",
    "fragment_histogram": """
SELECT l_linenumber AS sample, CAST(floor(l_extendedprice) AS BIGINT) % 600 AS length, count(*) AS n
FROM lineitem GROUP BY l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) % 600""",
    "small_sheet": """
SELECT * FROM (VALUES
 (1,'CTCF','10M','CM',0,0),(2,'CTCF','10M','CHIP',0,0),(3,'CTCF','500K','CM',0,0),
 (4,'CTCF','10M','CM',1,0),(5,'CTCF','10M','CM',2,0),(6,'IGG','10M','CM',0,0),(7,'PU1','10M','CM',0,0))
 AS t(sample, ip, number_cells, technique, bio_rep, tech_rep)""",
    "sheet": """
SELECT c_custkey AS id, CASE WHEN c_nationkey < 20 THEN 'K562' ELSE 'PBMC' END AS cell_line,
       CASE c_custkey % 4 WHEN 0 THEN '10M' WHEN 1 THEN '500K' WHEN 2 THEN '100K' ELSE '10K' END AS number_cells,
       CASE c_custkey % 3 WHEN 0 THEN 'CM' WHEN 1 THEN 'CHIP' ELSE 'ATAC' END AS technique,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CTCF' WHEN 'BUILDING' THEN 'H3K4ME3'
            WHEN 'MACHINERY' THEN 'PU1' WHEN 'HOUSEHOLD' THEN 'IGG' ELSE NULL END AS ip,
       CASE WHEN c_nationkey % 5 = 0 THEN concat(CAST(c_nationkey AS VARCHAR(4)), 'ULTN5_PE') ELSE NULL END AS treatment,
       c_nationkey % 3 AS bio_rep, 1 AS tech_rep, 'hg19' AS genome
FROM customer""",
    "qc": """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'CM' ELSE 'CHIP' END AS technique,
       o_orderpriority AS ip, o_custkey AS peak_number,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL
            ELSE CAST(CAST(round(o_totalprice*100) AS BIGINT) % 1100 AS DOUBLE)/1000 END AS frip
FROM orders""",
    "series": """
SELECT event_type AS sample, user_id AS x, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS v
FROM events GROUP BY event_type, user_id""",
    "sites": "SELECT concat('peak_', CAST(p_partkey AS VARCHAR(12))) AS name, p_retailprice AS score, 1 AS intercept FROM part",
}


def used_tables(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = re.sub(r"VARCHAR\(\d+\)", "STRING", VIEWS[name])
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used_tables(sql)}
    for t in frames:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **frames)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNA-like sequences (name, seq): the a, c, g, t of texts in upper case."""
    from pyspark.sql import functions as F

    letters = F.regexp_replace("text", "[^acgt]", "")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("name"), F.translate(letters, "acgt", "ACGT").alias("seq"))


SEQUENCES_SQL = "SELECT doc_id AS name, translate(regexp_replace(text, '[^acgt]', '', 'g'), 'acgt', 'ACGT') AS seq FROM documents"


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views in front."""
    parts = [f"{n} AS ({SEQUENCES_SQL if n == 'dna' else VIEWS[n]})" for n in names]
    if not parts:
        return "WITH " + sql
    return "WITH " + ",\n".join(parts) + (",\n" if sql.lstrip()[:6].upper() != "SELECT" else "\n") + sql
