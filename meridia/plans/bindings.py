"""Domain tables derived from the star schema, by SQL that both Spark and the oracle understand.

Nulls are put in by rule, so that every null rule of the operators is exercised.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "features": """
        SELECT p_partkey AS cell_key, CAST(floor(p_partkey / 50e0) AS INT) AS grid_row, CAST(p_partkey % 50 AS INT) AS grid_col,
               'g1000m-r' || lpad(CAST(CAST(floor(p_partkey / 50e0) AS INT) AS STRING), 4, '0') || '-c' || lpad(CAST(p_partkey % 50 AS STRING), 4, '0') AS grid_id,
               p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS price,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_size + 10) / 60e0 END AS land,
               CAST((p_partkey * 13) % 60 AS DOUBLE) AS transmission,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE ((p_partkey * 7) % 55) / 10e0 END AS stress,
               100e0 + (p_partkey * 17) % 500 AS carbon,
               CASE WHEN p_partkey % 13 = 0 THEN 9e-1 ELSE 1e0 END AS coverage,
               CASE WHEN p_partkey % 17 = 0 THEN 'unknown' WHEN p_partkey % 3 = 0 THEN 'calculated' ELSE 'observed' END AS status,
               CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'documented' END AS method,
               CASE WHEN p_partkey % 5 = 0 THEN 'src_b' ELSE 'src_a' END AS source_id
        FROM {part}""",
    "designs": "SELECT * FROM (VALUES ('air', 12e-1, 0e0), ('wet', 12e-1, 3e-1)) AS t(design_id, pue, wue)",
    "scenarios": "SELECT * FROM (VALUES ('base', 1e0), ('high', 125e-2)) AS t(scenario_id, carbon_factor)",
    "texts": """
        SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' . ' WHEN 2 THEN 'N/A' WHEN 3 THEN CAST(p_size AS STRING) || ',000'
                 WHEN 4 THEN '-' || CAST(p_size AS STRING) ELSE CAST(p_size AS STRING) || '.5' END AS raw_number,
               CASE p_partkey % 4 WHEN 0 THEN '  Unknown ' WHEN 1 THEN 'a   b  ' || p_brand WHEN 2 THEN '' ELSE p_name END AS raw_text,
               'Campus ' || CAST(p_partkey AS STRING) || ', Town ' || CAST(p_size AS STRING) || ', ST' AS place,
               'Power: ' || CAST(p_size AS STRING) || ' MW since ' || CAST(1990 + p_size AS STRING) AS label,
               CASE p_partkey % 3 WHEN 0 THEN 'Ada County' WHEN 1 THEN 'Orleans Parish' ELSE 'Nome Census Area' END AS county
        FROM {part}""",
    "points": """
        SELECT c_custkey AS point_id, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS weight,
               25e0 + ((c_custkey * 7919) % 24000) / 1000e0 AS lat, -124e0 + ((c_custkey * 104729) % 57000) / 1000e0 AS lon FROM {customer}""",
    "sites": """
        SELECT s_suppkey AS site_id, s_nationkey AS nation, s_acctbal AS balance,
               25e0 + ((s_suppkey * 6991) % 24000) / 1000e0 AS lat, -124e0 + ((s_suppkey * 94261) % 57000) / 1000e0 AS lon FROM {supplier}""",
    "globe_points": """
        SELECT c_custkey AS point_id, ((c_custkey * 7919) % 17990) / 100e0 - 8995e-2 AS lat, ((c_custkey * 104729) % 36000) / 100e0 - 180e0 AS lon FROM {customer}""",
    "globe_sites": """
        SELECT s_suppkey AS site_id, ((s_suppkey * 6991) % 17990) / 100e0 - 8995e-2 AS lat, ((s_suppkey * 94261) % 36000) / 100e0 - 180e0 AS lon FROM {supplier}""",
    "squares": "SELECT p_partkey AS square_id, CAST((p_partkey % 50) * 10 AS DOUBLE) AS xmin, CAST((p_partkey % 50) * 10 + 10 AS DOUBLE) AS xmax, floor(p_partkey / 50e0) * 10e0 AS ymin, floor(p_partkey / 50e0) * 10e0 + 10e0 AS ymax FROM {part}",
    "boxes": """
        SELECT s_suppkey AS box_id, 'b' || CAST(s_nationkey AS STRING) AS code, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal END AS value,
               CAST((s_suppkey * 37) % 460 + 3 AS DOUBLE) AS xmin, CAST((s_suppkey * 37) % 460 + 3 + 15 + s_suppkey % 20 AS DOUBLE) AS xmax,
               CAST((s_suppkey * 53) % 380 + 4 AS DOUBLE) AS ymin, CAST((s_suppkey * 53) % 380 + 4 + 12 + s_suppkey % 17 AS DOUBLE) AS ymax FROM {supplier}""",
    "vectors": "SELECT p_partkey AS vec_id, p_brand AS brand, p_retailprice AS a, CAST(p_size AS DOUBLE) AS b, CAST((p_partkey * 31) % 97 AS DOUBLE) AS c FROM {part}",
    "prices": """
        SELECT c_nationkey AS state, CAST(year(o_orderdate) AS INT) AS yr, CAST(month(o_orderdate) AS INT) AS mon, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS sales, CAST(count(*) AS BIGINT) AS n
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "scores": """
        SELECT doc_id, source, lang, CAST(n_chars AS DOUBLE) AS score, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST(n_chars % 50 AS DOUBLE) END AS valued, doc_id % 9 = 0 AS positive FROM {documents}""",
    "selected": """
        SELECT 'x' || CAST(p_size % 2 AS STRING) AS scenario_id, p_partkey AS cell_key, CAST(floor(p_partkey / 50e0) AS INT) AS grid_row, CAST(p_partkey % 50 AS INT) AS grid_col,
               'g1000m-r' || lpad(CAST(CAST(floor(p_partkey / 50e0) AS INT) AS STRING), 4, '0') || '-c' || lpad(CAST(p_partkey % 50 AS STRING), 4, '0') AS grid_id FROM {part} WHERE p_size <= 22""",
    "items": """
        SELECT l_orderkey AS alt_id, l_linenumber AS item, CASE l_linenumber % 3 WHEN 0 THEN 'A1-A3' WHEN 1 THEN 'A4' ELSE 'B1' END AS module,
               CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS kg FROM {lineitem}""",
}


def needed(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", SQL[name])))


class Domain:
    """Domain tables and driver tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.spark.sql(SQL[name], **{t: self[t] for t in needed(name)})


def plain_counts(text: str) -> str:
    """count_if(x) as count(CASE WHEN x THEN 1 END): the same number, as BIGINT."""
    out, at = [], 0
    while (i := text.find("count_if(", at)) >= 0:
        depth, j = 1, i + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        out += [text[at:i], f"count(CASE WHEN {text[i + 9 : j - 1]} THEN 1 END)"]
        at = j
    return "".join(out) + text[at:]


def oracle(names: str, text: str) -> str:
    """SQL text with the named domain tables before it."""
    made = [f"{n} AS ({SQL[n].replace('{', '').replace('}', '')})" for n in names.split()]
    text = plain_counts(text.strip())
    if text[:5].upper() == "WITH ":
        recursive = text[5:14].upper() == "RECURSIVE"
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*made, text[15 if recursive else 5 :]])
    return (f"WITH {', '.join(made)}\n" if made else "") + text
