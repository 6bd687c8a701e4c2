"""Queries of the scalar functions, each over every row of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from procaudit.functions import text as T
from procaudit.functions import values as V
from procaudit.operators.grams import spread
from procaudit.plans import registry as R
from procaudit.plans.registry import query
from procaudit.sources.fixtures import table


@query(f"SELECT doc_id, {R.clean('text')} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({R.words('text')}) AS token FROM documents) GROUP BY ALL")
def token_bag(spark, sf_dir):
    from procaudit.operators.matching import token_bag as bag

    return bag(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query(f"SELECT id, place, c AS codigo FROM (SELECT id, unnest({R.codes('codigo_grupo_auditor')}) AS c, unnest(range(len({R.codes('codigo_grupo_auditor')}))) AS place FROM audit_detail)", "audit_detail")
def split_codes(spark, sf_dir):
    return table(spark, sf_dir, "audit_detail").select("id", F.posexplode(V.split_codes(F.col("codigo_grupo_auditor"))).alias("place", "codigo"))


def _scalar(name, column, spark_f, duck):
    def f(spark, sf_dir):
        return table(spark, sf_dir, "audit_detail").select("id", spark_f(F.col(column)).alias("value"))

    f.__name__ = name
    query(f"SELECT id, {duck(column)} AS value FROM audit_detail", "audit_detail")(f)


_scalar("normalize_code", "codigo", V.normalize_code, R.code)
_scalar("normalize_percent", "porcentaje", V.normalize_percent, R.percent)
_scalar("normalize_time", "tiempo_anestesia", V.normalize_time, R.hours)
_scalar("normalize_number", "tiempo_anestesia", V.normalize_number, R.number)
_scalar("normalize_scalar", "honorario_auditor", V.normalize_scalar, R.scalar)

LENIENT = f"""
p AS (SELECT id, {R.codes('codigo_grupo_auditor')} AS cs, regexp_extract_all(coalesce(honorario_auditor, ''), '([^(),+]+)\\(([^()]*)\\)', 1) AS ks,
  regexp_extract_all(coalesce(honorario_auditor, ''), '([^(),+]+)\\(([^()]*)\\)', 2) AS vs FROM audit_detail),
e AS (SELECT id, {R.strip('k')} AS codigo, {R.strip('v')} AS v, i FROM (SELECT id, unnest(ks) AS k, unnest(vs) AS v, unnest(range(len(ks))) AS i FROM p)),
found AS (SELECT id, codigo, max_by(v, i) AS valor FROM e WHERE codigo <> '' AND v <> '' GROUP BY ALL),
listed AS (SELECT id, unnest(cs) AS codigo FROM p)
SELECT coalesce(f.id, l.id) AS id, coalesce(f.codigo, l.codigo) AS codigo, coalesce(valor, '100') AS valor FROM found f FULL JOIN listed l ON f.id = l.id AND f.codigo = l.codigo"""


@query("WITH " + LENIENT, "audit_detail")
def parse_fees_lenient(spark, sf_dir):
    d = table(spark, sf_dir, "audit_detail")
    pairs = V.parse_fees_lenient(F.col("honorario_auditor"), V.split_codes(F.col("codigo_grupo_auditor")))
    return d.select("id", F.explode(pairs).alias("p")).select("id", F.col("p.k").alias("codigo"), F.col("p.v").alias("valor"))


@query(f"""WITH p AS (SELECT id, regexp_extract_all(coalesce(honorario_auditor, ''), '([0-9]+)\\s*\\(\\s*([0-9,.]+)\\s*\\)', 1) AS ks,
  regexp_extract_all(coalesce(honorario_auditor, ''), '([0-9]+)\\s*\\(\\s*([0-9,.]+)\\s*\\)', 2) AS vs FROM audit_detail),
 e AS (SELECT id, {R.code('k')} AS codigo, {R.number('v')} AS v, i FROM (SELECT id, unnest(ks) AS k, unnest(vs) AS v, unnest(range(len(ks))) AS i FROM p))
 SELECT id, codigo, max_by(v, i) AS valor FROM e WHERE codigo <> '' AND v <> '' GROUP BY ALL""", "audit_detail")  # fmt: skip
def parse_fees_numeric(spark, sf_dir):
    d = table(spark, sf_dir, "audit_detail")
    return d.select("id", F.explode(V.parse_fees_numeric(F.col("honorario_auditor"))).alias("p")).select("id", F.col("p.k").alias("codigo"), F.col("p.v").alias("valor"))


@query(r"SELECT codigo, trim(regexp_replace(coalesce(desc_comp, ''), '\s+', ' ', 'g')) AS texto FROM ap_plantilla", "ap_plantilla")
def squeeze_text(spark, sf_dir):
    return table(spark, sf_dir, "ap_plantilla").select("codigo", T.squeeze_text(F.col("desc_comp")).alias("texto"))


@query(f"SELECT id_agenda, {R.joined('procedimiento_sistema', 'hallazgos_conclusion', 'descripcion_estudio_013')} AS texto, {R.strip(R.joined('procedimiento_sistema', 'hallazgos_conclusion', 'descripcion_estudio_013'))} AS recortado FROM solicitudes", "solicitudes")
def request_text(spark, sf_dir):
    return table(spark, sf_dir, "solicitudes").select("id_agenda", T.request_text().alias("texto"), T.request_text(trimmed=True).alias("recortado"))


@query(f"SELECT id, {R.joined('nombre_procedimiento', 'procedimiento_auditor', 'hallazgo', 'conclusion')} AS texto FROM audit_detail", "audit_detail")
def history_text(spark, sf_dir):
    return table(spark, sf_dir, "audit_detail").select("id", T.history_text().alias("texto"))


TRAINING = R.strip(R.joined("procedimiento_auditor", "nombre_procedimiento", "hallazgo", "conclusion"))


@query(f"SELECT id, {TRAINING} AS texto FROM audit_detail", "audit_detail")
def training_text(spark, sf_dir):
    return table(spark, sf_dir, "audit_detail").select("id", T.training_text().alias("texto"))


@query(f"SELECT id, {R.strip('concat(' + chr(39) + 'CODIGO_' + chr(39) + ', ' + R.code('codigo') + ', ' + chr(39) + ' ' + chr(39) + ', ' + TRAINING + ')')} AS texto FROM audit_detail", "audit_detail")
def code_text(spark, sf_dir):
    return table(spark, sf_dir, "audit_detail").select("id", T.code_text(T.training_text(), V.normalize_code(F.col("codigo"))).alias("texto"))


@query("""SELECT codigo, count(*) AS n, CASE WHEN count(*) >= 1000 THEN 'ALTA_FRECUENCIA' WHEN count(*) >= 100 THEN 'MEDIA_FRECUENCIA' WHEN count(*) >= 10 THEN 'BAJA_FRECUENCIA' ELSE 'RARA_REVISAR' END AS clase
 FROM audit_detail WHERE estado = 1 AND codigo <> '' GROUP BY codigo""", "audit_detail")  # fmt: skip
def freq_class(spark, sf_dir):
    from procaudit.operators.history import active_coded

    return active_coded(table(spark, sf_dir, "audit_detail")).groupBy("codigo").agg(F.count("*").alias("n")).withColumn("clase", V.freq_class(F.col("n")))


@query("WITH " + LENIENT.rsplit("SELECT", 1)[0] + """, v AS (SELECT coalesce(f.id, l.id) AS id, coalesce(f.codigo, l.codigo) AS codigo, coalesce(valor, '100') AS valor FROM found f FULL JOIN listed l ON f.id = l.id AND f.codigo = l.codigo),
 o AS (SELECT id, unnest(cs) AS codigo, unnest(range(len(cs))) AS i FROM p)
 SELECT p.id, coalesce(string_agg(o.codigo || '(' || valor || ')', ',' ORDER BY i), '') AS honorario FROM p LEFT JOIN o ON o.id = p.id LEFT JOIN v ON v.id = o.id AND v.codigo = o.codigo GROUP BY p.id""", "audit_detail")  # fmt: skip
def fee_string(spark, sf_dir):
    d, codes = table(spark, sf_dir, "audit_detail"), V.split_codes(F.col("codigo_grupo_auditor"))
    return d.select("id", V.fee_string(codes, V.parse_fees_lenient(F.col("honorario_auditor"), codes)).alias("honorario"))


@query(f"SELECT id_agenda, CASE WHEN m IS NULL THEN '' ELSE {R.two_places('m')} END AS tiempo FROM (SELECT id_agenda, max(TRY_CAST(nullif({R.hours('tiempo_anestesia')}, '') AS DOUBLE)) AS m FROM audit_detail GROUP BY id_agenda)", "audit_detail")
def time_summary(spark, sf_dir):
    d = table(spark, sf_dir, "audit_detail").groupBy("id_agenda").agg(F.collect_set(V.normalize_time(F.col("tiempo_anestesia"))).alias("t"))
    return d.select("id_agenda", V.time_summary(F.col("t")).alias("tiempo"))


@query(f"SELECT p_partkey, g AS gram, count(*) AS n FROM (SELECT p_partkey, unnest({R.grams('p_name')}) AS g FROM part) GROUP BY ALL")
def char_ngrams(spark, sf_dir):
    # dealt by part before the grams are made, so no task makes those of a whole file
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    return parts.select("p_partkey", F.explode(T.char_ngrams(F.col("p_name"))).alias("gram")).groupBy("p_partkey", "gram").agg(F.count("*").alias("n"))


@query("SELECT id_agenda, codigo, round(1 / (1 + exp(-(prob * 8 - 4))), 4) AS p FROM code_scores", "code_scores")
def sigmoid_score(spark, sf_dir):
    return table(spark, sf_dir, "code_scores").select("id_agenda", "codigo", F.round(V.sigmoid(F.col("prob") * 8 - 4), 4).alias("p"))


@query("SELECT id_agenda, rtrim(coalesce(procedimiento_sistema, '') || '..', '.') || '; honorarios sugeridos.' AS nota FROM solicitudes", "solicitudes")
def observation_note(spark, sf_dir):
    return table(spark, sf_dir, "solicitudes").select("id_agenda", T.observation_note(F.concat(F.coalesce("procedimiento_sistema", F.lit("")), F.lit("..")), "; honorarios sugeridos.").alias("nota"))
