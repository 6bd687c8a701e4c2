"""The library's input tables, derived from the given Parquet tables by SQL that Spark and DuckDB share.

``GROUPED`` and ``FEES`` are the two expressions that the dialects write differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings")
SPARK = {
    "GROUPED": "concat_ws(CASE WHEN id_agenda % 2 = 0 THEN ',' ELSE '+' END, array_sort(collect_set(code)))",
    "FEES": "concat_ws(',', array_sort(collect_set(concat(code,'(',pct,')'))))",
}
DUCK = {
    "GROUPED": "CASE WHEN id_agenda % 2 = 0 THEN array_to_string(list_sort(list(DISTINCT code)), ',') ELSE array_to_string(list_sort(list(DISTINCT code)), '+') END",
    "FEES": "array_to_string(list_sort(list(DISTINCT concat(code,'(',pct,')'))), ',')",
}

TABLES = {
    "audit_detail": """
WITH li AS (
 SELECT l_orderkey AS id_agenda, l_linenumber AS linea, l_partkey, l_suppkey, l_shipdate, l_returnflag,
  CAST(l_quantity AS INT) AS q, CAST(round(l_discount*100) AS INT) AS dsc,
  CAST(round(l_extendedprice*100) AS BIGINT) AS cents,
  CAST(43000 + CASE WHEN l_partkey % 97 = 3 THEN 10000 + l_orderkey % 5000 WHEN l_partkey % 4 = 0 THEN 0
     WHEN l_partkey % 4 = 1 THEN l_partkey % 20 WHEN l_partkey % 4 = 2 THEN 20 + l_partkey % 200 ELSE 300 + l_partkey END AS STRING) AS code
 FROM lineitem),
li2 AS (SELECT *, CASE WHEN dsc < 5 THEN '100' WHEN dsc < 8 THEN '50' WHEN dsc = 8 THEN '0.5' WHEN dsc = 9 THEN '50%' ELSE '75,5' END AS pct FROM li),
ag AS (SELECT id_agenda, GROUPED AS grupo, FEES AS hon FROM li2 WHERE linea <= 4 GROUP BY id_agenda)
SELECT md5(concat_ws('|', CAST(li2.id_agenda AS STRING), CAST(linea AS STRING), CAST(li2.l_partkey AS STRING), CAST(li2.l_suppkey AS STRING), CAST(cents AS STRING))) AS id,
 li2.id_agenda, substring(CAST(o.o_orderdate AS STRING),1,7) AS mes_plano, CAST(o.o_orderdate AS DATE) AS fecha, l_shipdate AS updated_at,
 CASE WHEN c.c_nationkey = 24 THEN NULL ELSE CAST(c.c_nationkey AS STRING) END AS id_empresa, o.o_custkey % 7 AS id_seguro,
 CASE WHEN l_returnflag = 'R' AND li2.l_partkey % 3 = 0 THEN 0 ELSE 1 END AS estado,
 CASE WHEN li2.l_partkey % 50 = 7 THEN NULL WHEN li2.l_partkey % 50 = 9 THEN '' WHEN li2.l_partkey % 10 = 3 THEN concat('CPT-', code) ELSE code END AS codigo,
 CASE WHEN li2.id_agenda % 53 = 0 THEN '' ELSE grupo END AS codigo_grupo_auditor,
 CASE WHEN q % 11 = 0 THEN NULL ELSE pct END AS porcentaje,
 CASE WHEN q % 13 = 0 THEN '' WHEN q % 7 = 0 THEN '24' WHEN q % 5 = 0 THEN '2,0' ELSE CAST(q % 10 AS STRING) END AS tiempo_anestesia,
 CASE WHEN li2.id_agenda % 3 = 0 THEN pct ELSE hon END AS honorario_auditor,
 p.p_name AS nombre_procedimiento, concat(p.p_type, ' ', p.p_name) AS procedimiento_auditor,
 CASE WHEN li2.id_agenda % 41 = 0 THEN NULL ELSE substring(d.text, CAST(1 + li2.id_agenda % 300 AS INT), 400) END AS hallazgo,
 substring(d.text, CAST(701 + li2.id_agenda % 300 AS INT), 200) AS conclusion, CAST(NULL AS STRING) AS observacion_auditor
FROM li2 JOIN orders o ON o.o_orderkey = li2.id_agenda JOIN customer c ON c.c_custkey = o.o_custkey
JOIN part p ON p.p_partkey = li2.id_agenda % 200 JOIN documents d ON d.doc_id = li2.id_agenda % 200
LEFT JOIN ag ON ag.id_agenda = li2.id_agenda
""",
    "historiaclinica": """
SELECT 700000 + o_orderkey AS hcid, o_orderkey AS id_agenda FROM orders WHERE o_orderkey % 17 <> 0
""",
    "archivo_plano_cabecera": """
SELECT o_orderkey AS id, 700000 + o_orderkey AS id_hc, substring(CAST(o_orderdate AS STRING),1,7) AS mes_plano, CASE WHEN c_nationkey = 24 THEN NULL ELSE CAST(c_nationkey AS STRING) END AS id_empresa, CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE 1 END AS estado FROM orders JOIN customer ON c_custkey = o_custkey
""",
    "archivo_plano_detalle": """
SELECT md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice*100) AS BIGINT) AS STRING))) AS id, l_orderkey AS id_ap_cabecera,
 CASE WHEN l_partkey % 61 = 5 THEN '0' WHEN l_partkey % 61 = 6 THEN 'ABC' ELSE CAST(43000 + CASE WHEN l_partkey % 97 = 3 THEN 10000 + l_orderkey % 5000 WHEN l_partkey % 4 = 0 THEN 0 WHEN l_partkey % 4 = 1 THEN l_partkey % 20 WHEN l_partkey % 4 = 2 THEN 20 + l_partkey % 200 ELSE 300 + l_partkey END AS STRING) END AS codigo,
 CASE WHEN l_suppkey % 2 = 0 THEN 'TA' ELSE 'P' END AS tipo, CASE WHEN l_suppkey % 3 = 0 THEN concat('Tiempo de Anestesia ', CAST(l_linenumber AS STRING)) ELSE 'procedimiento' END AS descripcion,
 CAST(1 + CAST(l_quantity AS INT) % 8 AS STRING) AS cantidad, CASE WHEN l_returnflag = 'N' AND l_partkey % 5 = 0 THEN 0 ELSE 1 END AS estado FROM lineitem
""",
    "ap_plantilla": """
SELECT concat('T', CAST(s_suppkey AS STRING)) AS codigo, s_name AS descripcion, concat('plantilla  ', s_name) AS desc_comp, CASE WHEN s_suppkey % 9 = 8 THEN 0 ELSE 1 END AS estado FROM supplier
""",
    "ap_procedimiento": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 4 THEN 'I' ELSE 'P' END AS tipo, CASE WHEN p_partkey % 40 = 1 THEN '99204' WHEN p_partkey % 40 = 2 THEN '' WHEN p_partkey % 10 = 3 THEN concat('CPT-', CAST(43000 + p_partkey % 300 AS STRING)) ELSE CAST(43000 + p_partkey % 300 AS STRING) END AS codigo, concat(p_type, ' ', p_name) AS descripcion FROM part
""",
    "ap_plantilla_items": """
SELECT concat('T', CAST(l_suppkey AS STRING)) AS cod_plantilla, l_partkey AS procedimiento, CAST(l_quantity AS INT) AS cantidad, l_linenumber AS orden, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS estado FROM lineitem WHERE l_orderkey % 10 = 0
""",
    "solicitudes": """
SELECT o_orderkey AS id_agenda, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey AS STRING) END AS id_empresa, CASE WHEN o_orderkey % 4 = 3 THEN o_custkey % 7 ELSE NULL END AS id_seguro, p_name AS procedimiento_sistema, substring(text, CAST(51 + o_orderkey % 300 AS INT), 300) AS hallazgos_conclusion, '' AS descripcion_estudio_013 FROM orders JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = o_orderkey % 200 JOIN documents ON doc_id = o_orderkey % 200 WHERE o_orderkey % 50 = 7
""",
    "code_scores": """
SELECT id_agenda, codigo, CAST((id_agenda * 7919 + CAST(codigo AS BIGINT) * 104729) % 10007 AS DOUBLE) / 10007 AS prob FROM (SELECT DISTINCT l_orderkey AS id_agenda FROM lineitem WHERE l_orderkey % 10 = 0) a CROSS JOIN (SELECT DISTINCT CAST(43000 + p_partkey % 12 AS STRING) AS codigo FROM part) b
""",
}

#: The same joins of ``audit_detail`` as Spark takes them: what meets by visit comes first, so rows are dealt by visit once
#: and get their texts after that, from tables that are looked up.
JOINS = (
    """FROM li2 JOIN orders o ON o.o_orderkey = li2.id_agenda JOIN customer c ON c.c_custkey = o.o_custkey
JOIN part p ON p.p_partkey = li2.id_agenda % 200 JOIN documents d ON d.doc_id = li2.id_agenda % 200
LEFT JOIN ag ON ag.id_agenda = li2.id_agenda""",
    """FROM li2 LEFT JOIN ag ON ag.id_agenda = li2.id_agenda JOIN (orders o JOIN customer c ON c.c_custkey = o.o_custkey) ON o.o_orderkey = li2.id_agenda
JOIN part p ON p.p_partkey = li2.id_agenda % 200 JOIN documents d ON d.doc_id = li2.id_agenda % 200""",
)
#: Derived tables whose rows meet a part and a document by a visit's number modulo 200. Remainders lie between -199 and
#: 199, so the rows that can be met are few at every size and are broadcast.
LOOKING_UP, LOOKED_UP, MODULUS = ("audit_detail", "solicitudes"), {"part": "p_partkey", "documents": "doc_id"}, 200
#: Characters of a looked-up document that a visit with a positive number can reach: 701 + 299 and 199 more. A cut out of a
#: text costs a pass over the whole of it, so this is taken off once a document and not once a row.
REACHED = 1200
#: Lines of visits that one task holds at most, so that its memory and what it reads stay as they are when tables grow.
DEALT_ROWS = 400_000


def _filled(sql: str, dialect: dict[str, str]) -> str:
    for name, text in dialect.items():
        sql = sql.replace(f"{name} AS", f"{text} AS")
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a given one, as a DataFrame; no catalog entry is left behind."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _filled(TABLES[name], SPARK).replace(*JOINS)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE_TABLES if re.search(rf"(FROM|JOIN) \(?{t}\b", sql)}
    for t in used:
        sql = re.sub(rf"(FROM|JOIN) (\(?){t}\b", rf"\1 \2{{{t}}}", sql)
        if name in LOOKING_UP and t in LOOKED_UP:
            found = used[t].where(F.col(LOOKED_UP[t]).between(1 - MODULUS, MODULUS - 1))
            if t == "documents":  # remainders under 1 may be those of negative numbers, which count places from the end
                found = found.withColumn("text", F.when(F.col("doc_id") > 0, F.substring("text", 1, REACHED)).otherwise(F.col("text")))
            used[t] = F.broadcast(found)
    if name == "audit_detail":
        parts = -(-used["lineitem"].count() // DEALT_ROWS)
        if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
            used["lineitem"] = used["lineitem"].repartition(parts, "l_orderkey")
    return spark.sql(sql, **used)


def with_tables(sql: str, *names: str) -> str:
    """DuckDB text of ``sql`` with the derived tables it names put before it."""
    head = ", ".join(f"{n} AS MATERIALIZED ({_filled(TABLES[n], DUCK)})" for n in names)
    return f"WITH {head} {sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {head}, {sql.lstrip()[5:]}"
