"""Queries of the sources, filters, joins, groupings and template tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from procaudit.functions import values as V
from procaudit.operators import history as H
from procaudit.operators import templates as P
from procaudit.plans import registry as R
from procaudit.plans.registry import query
from procaudit.sources.fixtures import table
from procaudit.sources.tables import BILLING, TEMPLATES, conformed, scratch_path

ACTIVE = "estado = 1 AND codigo IS NOT NULL AND codigo <> ''"


def detail(spark, sf_dir):
    return table(spark, sf_dir, "audit_detail")


@query("SELECT * FROM audit_detail", "audit_detail")
def read_history(spark, sf_dir):
    from procaudit.sources import tables as S

    return S.read_history(spark, stored(spark, sf_dir, ("audit_detail",)) + "/audit_detail.parquet")


def stored(spark, sf_dir, names):
    """The derived tables written to a folder, as the readers take them."""
    folder = scratch_path(spark, "tables")
    for name in names:
        conformed(table(spark, sf_dir, name), name).write.parquet(f"{folder}/{name}.parquet")
    return folder


def _counted(spark, sf_dir, keys):
    from procaudit.sources.tables import read_group

    out = None
    for name, df in read_group(spark, tuple(keys), stored(spark, sf_dir, keys)).items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct(keys[name]).alias("keys"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT 'archivo_plano_cabecera' AS name, count(*) AS n, count(DISTINCT id) AS keys FROM archivo_plano_cabecera UNION ALL SELECT 'archivo_plano_detalle', count(*), count(DISTINCT id) FROM archivo_plano_detalle UNION ALL SELECT 'historiaclinica', count(*), count(DISTINCT hcid) FROM historiaclinica", *BILLING)
def read_billing(spark, sf_dir):
    return _counted(spark, sf_dir, {"archivo_plano_cabecera": "id", "archivo_plano_detalle": "id", "historiaclinica": "hcid"})


@query("SELECT 'ap_plantilla' AS name, count(*) AS n, count(DISTINCT codigo) AS keys FROM ap_plantilla UNION ALL SELECT 'ap_plantilla_items', count(*), count(DISTINCT cod_plantilla) FROM ap_plantilla_items UNION ALL SELECT 'ap_procedimiento', count(*), count(DISTINCT id) FROM ap_procedimiento", *TEMPLATES)
def read_templates(spark, sf_dir):
    return _counted(spark, sf_dir, {"ap_plantilla": "codigo", "ap_plantilla_items": "cod_plantilla", "ap_procedimiento": "id"})


@query(f"SELECT id, id_agenda, codigo FROM audit_detail WHERE {ACTIVE}", "audit_detail")
def active_coded(spark, sf_dir):
    return H.active_coded(detail(spark, sf_dir)).select("id", "id_agenda", "codigo")


@query("SELECT id, id_agenda FROM audit_detail WHERE estado = 1 AND hallazgo <> '' AND codigo_grupo_auditor <> ''", "audit_detail")
def trainable_rows(spark, sf_dir):
    return H.trainable_rows(detail(spark, sf_dir)).select("id", "id_agenda")


REQUESTS = "r AS (SELECT id_agenda AS r_id, nullif(id_empresa, '') AS e, nullif(id_seguro, 0) AS s FROM solicitudes)"


@query(f"WITH {REQUESTS} SELECT r_id, count(*) AS n, count(DISTINCT h.id_agenda) AS visits FROM r JOIN audit_detail h ON h.{ACTIVE.replace('codigo', 'h.codigo').replace('estado', 'estado')} AND h.id_agenda <> r_id AND (e IS NULL OR h.id_empresa = e) AND (s IS NULL OR h.id_seguro = s) GROUP BY r_id", "audit_detail", "solicitudes")
def optional_filters(spark, sf_dir):
    r = table(spark, sf_dir, "solicitudes").select(F.col("id_agenda").alias("r_id"), F.col("id_empresa").alias("r_empresa"), F.col("id_seguro").alias("r_seguro"))
    return H.filter_counts(r, H.active_coded(detail(spark, sf_dir)))


@query(f"SELECT id, {R.code('codigo')} AS codigo_norm FROM audit_detail WHERE {ACTIVE} AND {R.code('codigo')} <> '' AND mes_plano = '1995-03'", "audit_detail")
def backfill_filters(spark, sf_dir):
    return H.backfill_filters(detail(spark, sf_dir), mes_plano="1995-03").select("id", "codigo_norm")


FEES = f"""fr AS (SELECT id_agenda, codigo, max(fecha) AS fecha, max(porcentaje) AS porcentaje, max(procedimiento_auditor) AS procedimiento_auditor, max(nombre_procedimiento) AS nombre_procedimiento, max(hallazgo) AS hallazgo, max(conclusion) AS conclusion FROM audit_detail WHERE {ACTIVE} AND porcentaje <> '' GROUP BY id_agenda, codigo),
 fee AS (SELECT *, {R.code('codigo')} AS codigo_norm, {R.percent('porcentaje')} AS porcentaje_norm FROM fr),
 fees AS (SELECT * FROM fee WHERE codigo_norm <> '' AND porcentaje_norm IN ('50', '100'))"""
TIMES = f"""tr AS (SELECT id, id_agenda, {R.code('codigo')} AS codigo_norm, {R.hours('tiempo_anestesia')} AS tiempo_norm FROM audit_detail WHERE {ACTIVE} AND tiempo_anestesia <> ''),
 times AS (SELECT * FROM tr WHERE codigo_norm <> '' AND tiempo_norm IN ('1','2','3','4','5','6','7','8','24'))"""


@query(f"WITH {FEES}, {TIMES} SELECT 'fee' AS kind, porcentaje_norm AS value, count(*) AS n FROM fees GROUP BY ALL UNION ALL SELECT 'time', tiempo_norm, count(*) FROM times GROUP BY ALL", "audit_detail")
def allowed_values(spark, sf_dir):
    d = detail(spark, sf_dir)
    fees = H.allowed_values(H.fee_rows(d), V.normalize_percent(F.col("porcentaje")), H.PERCENTAGES, "value").groupBy(F.lit("fee").alias("kind"), "value")
    times = H.allowed_values(H.active_coded(d).where(H.filled("tiempo_anestesia")), V.normalize_time(F.col("tiempo_anestesia")), H.HOURS, "value").groupBy(F.lit("time").alias("kind"), "value")
    return fees.agg(F.count("*").alias("n")).union(times.agg(F.count("*").alias("n")))


TRAIN = """t AS (SELECT id_agenda, codigo_grupo_auditor, max(fecha) AS fecha, max(id_empresa) AS id_empresa, max(id_seguro) AS id_seguro, max(procedimiento_auditor) AS procedimiento_auditor,
 max(hallazgo) AS hallazgo, max(conclusion) AS conclusion, max(honorario_auditor) AS honorario_auditor, max(nombre_procedimiento) AS nombre_procedimiento, max(tiempo_anestesia) AS tiempo_anestesia, count(*) AS detalles
 FROM audit_detail WHERE estado = 1 AND hallazgo <> '' AND codigo_grupo_auditor <> '' GROUP BY id_agenda, codigo_grupo_auditor)"""
TEXT = R.strip(R.joined("procedimiento_auditor", "nombre_procedimiento", "hallazgo", "conclusion"))


@query(f"WITH {TRAIN}, p AS (SELECT id_agenda, {TEXT} AS texto, {R.codes('codigo_grupo_auditor')} AS cs FROM t) SELECT id_agenda, texto, array_to_string(cs, ',') AS codigos FROM p WHERE texto <> '' AND len(cs) > 0", "audit_detail")
def text_label_pairs(spark, sf_dir):
    from procaudit.plans.shared import text_label_pairs as pairs

    return pairs(spark, sf_dir).select("id_agenda", "texto", F.array_join("codigos", ",").alias("codigos"))


JOINED = """j AS (SELECT pl.codigo AS cod_plantilla, pl.descripcion AS plantilla_descripcion, pl.desc_comp, pr.tipo, pr.codigo, pr.descripcion, pi.cantidad, pi.orden FROM ap_plantilla pl JOIN ap_plantilla_items pi ON pi.cod_plantilla = pl.codigo
 JOIN ap_procedimiento pr ON pr.id = pi.procedimiento WHERE pl.estado = 1 AND pi.estado = 1 AND pr.tipo = 'P' AND pr.codigo <> '')"""
PROCS = "procs AS (SELECT cod_plantilla, tipo, codigo, max(plantilla_descripcion) AS pd, max(desc_comp) AS dc, max(descripcion) AS descripcion, CAST(sum(cantidad) AS BIGINT) AS cantidad_total, min(orden) AS orden FROM j GROUP BY ALL)"
KEPT = f"kept AS (SELECT *, {R.code('codigo')} AS norm FROM procs WHERE {R.code('codigo')} NOT IN ('', '99204'))"
SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
ASSEMBLED = f"""firsts AS (SELECT cod_plantilla, norm, min(struct_pack(o := orden, c := codigo)) AS f FROM kept GROUP BY ALL),
 tt AS (SELECT cod_plantilla, max({SQUEEZED.format('pd')}) AS descripcion, max({SQUEEZED.format('dc')}) AS desc_comp, string_agg(norm || ' ' || {SQUEEZED.format('descripcion')}, ' ' ORDER BY orden, codigo) AS procs FROM kept GROUP BY cod_plantilla),
 texts AS (SELECT cod_plantilla, trim(descripcion || ' ' || desc_comp || ' ' || procs) AS texto FROM tt)"""


def joined(spark, sf_dir):
    return P.template_join(*[table(spark, sf_dir, t) for t in TEMPLATES])


@query(f"WITH {JOINED} SELECT cod_plantilla, codigo, orden, cantidad FROM j", *TEMPLATES)
def template_join(spark, sf_dir):
    return joined(spark, sf_dir).select("cod_plantilla", "codigo", "orden", "cantidad")


@query(f"WITH {JOINED}, {PROCS} SELECT cod_plantilla, tipo, codigo, cantidad_total, orden, descripcion AS procedimiento_descripcion FROM procs", *TEMPLATES)
def template_procs(spark, sf_dir):
    return P.template_procs(joined(spark, sf_dir)).select("cod_plantilla", "tipo", "codigo", "cantidad_total", "orden", "procedimiento_descripcion")


@query(f"WITH {JOINED}, {PROCS}, {KEPT} SELECT cod_plantilla, codigo, norm AS codigo_norm FROM kept", *TEMPLATES)
def template_rows(spark, sf_dir):
    return P.template_rows(P.template_procs(joined(spark, sf_dir))).select("cod_plantilla", "codigo", "codigo_norm")


def assembled(spark, sf_dir):
    return P.template_assembly(P.template_rows(P.template_procs(joined(spark, sf_dir))))


@query(f"WITH {JOINED}, {PROCS}, {KEPT}, {ASSEMBLED} SELECT cod_plantilla, norm AS codigo, row_number() OVER (PARTITION BY cod_plantilla ORDER BY f) - 1 AS place FROM firsts", *TEMPLATES)
def template_assembly(spark, sf_dir):
    return assembled(spark, sf_dir).select("cod_plantilla", F.posexplode("codigos").alias("place", "codigo")).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {JOINED}, {PROCS}, {KEPT}, {ASSEMBLED} SELECT * FROM texts", *TEMPLATES)
def template_text(spark, sf_dir):
    return assembled(spark, sf_dir).select("cod_plantilla", P.template_text(F.col("descripcion"), F.col("desc_comp"), F.col("procedimientos")).alias("texto"))


@query(f"""SELECT codigo, count(*) AS frecuencia, count(DISTINCT id_agenda) AS agendas, string_agg(DISTINCT porcentaje, ' | ' ORDER BY porcentaje) AS porcentajes_usados,
 string_agg(DISTINCT tiempo_anestesia, ' | ' ORDER BY tiempo_anestesia) AS tiempos_anestesia_usados,
 CASE WHEN count(*) >= 1000 THEN 'ALTA_FRECUENCIA' WHEN count(*) >= 100 THEN 'MEDIA_FRECUENCIA' WHEN count(*) >= 10 THEN 'BAJA_FRECUENCIA' ELSE 'RARA_REVISAR' END AS clase_frecuencia
 FROM audit_detail WHERE {ACTIVE} GROUP BY codigo""", "audit_detail")  # fmt: skip
def code_report(spark, sf_dir):
    return H.code_report(detail(spark, sf_dir))


@query(f"""SELECT id_agenda, id_empresa, id_seguro, codigo_grupo_auditor, honorario_auditor, tiempo_anestesia, nombre_procedimiento, observacion_auditor, procedimiento_auditor,
 string_agg(DISTINCT codigo, ',' ORDER BY codigo) AS codigos, max(hallazgo) AS hallazgo, max(conclusion) AS conclusion, count(*) AS detalles FROM audit_detail WHERE {ACTIVE} GROUP BY ALL""", "audit_detail")  # fmt: skip
def history_groups(spark, sf_dir):
    return H.history_groups(detail(spark, sf_dir)).drop("recent", "group_id")


@query(f"WITH {TRAIN} SELECT * FROM t", "audit_detail")
def training_set(spark, sf_dir):
    return H.training_set(detail(spark, sf_dir))


@query(f"WITH {FEES} SELECT id_agenda, codigo_norm, porcentaje, porcentaje_norm, fecha, hallazgo FROM fees", "audit_detail")
def fee_training_set(spark, sf_dir):
    return H.fee_training_set(detail(spark, sf_dir)).select("id_agenda", "codigo_norm", "porcentaje", "porcentaje_norm", "fecha", "hallazgo")


@query(f"WITH {TIMES} SELECT * FROM times", "audit_detail")
def time_training_set(spark, sf_dir):
    return H.time_training_set(detail(spark, sf_dir)).select("id", "id_agenda", "codigo_norm", "tiempo_norm")


def _majority(source: str, value: str) -> str:
    return f"SELECT codigo_norm, {value} AS value FROM (SELECT codigo_norm, {value}, row_number() OVER (PARTITION BY codigo_norm ORDER BY count(*) DESC, {value}) AS r FROM {source} GROUP BY codigo_norm, {value}) WHERE r = 1"


@query(f"WITH {FEES}, {TIMES} SELECT 'fee' AS kind, * FROM ({_majority('fees', 'porcentaje_norm')}) UNION ALL SELECT 'time', * FROM ({_majority('times', 'tiempo_norm')})", "audit_detail")
def majority_by_code(spark, sf_dir):
    d = detail(spark, sf_dir)
    fee, time = H.majority_by_code(H.fee_training_set(d), "porcentaje_norm"), H.majority_by_code(H.time_training_set(d), "tiempo_norm")
    return fee.select(F.lit("fee").alias("kind"), "*").union(time.select(F.lit("time").alias("kind"), "*"))


@query(f"WITH {FEES}, {TIMES} SELECT 'fee' AS kind, (SELECT porcentaje_norm FROM fees GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS value UNION ALL SELECT 'time', (SELECT tiempo_norm FROM times GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "audit_detail")
def majority_global(spark, sf_dir):
    d = detail(spark, sf_dir)
    fee, time = H.majority_global(H.fee_training_set(d), "porcentaje_norm"), H.majority_global(H.time_training_set(d), "tiempo_norm")
    return fee.select(F.lit("fee").alias("kind"), "value").union(time.select(F.lit("time").alias("kind"), "value"))


@query(f"WITH {FEES}, m AS ({_majority('fees', 'porcentaje_norm')}) SELECT d.id, coalesce(nullif(m.value, ''), '100') AS value FROM audit_detail d LEFT JOIN m ON m.codigo_norm = {R.code('d.codigo')} WHERE {R.code('d.codigo')} <> ''", "audit_detail")
def code_default_lookup(spark, sf_dir):
    d = detail(spark, sf_dir)
    rows = d.select("id", V.normalize_code(F.col("codigo")).alias("codigo_norm")).where("codigo_norm <> ''")
    return H.code_default_lookup(rows, H.majority_by_code(H.fee_training_set(d), "porcentaje_norm"), None, "100").select("id", "value")


@query(f"WITH {TRAIN}, {FEES}, c AS (SELECT {R.codes('codigo_grupo_auditor')} AS cs FROM t) SELECT (SELECT count(*) FROM c) AS filas, (SELECT count(DISTINCT cs) FROM c) AS grupos, (SELECT count(DISTINCT x) FROM (SELECT unnest(cs) AS x FROM c)) AS codigos, (SELECT count(*) FROM fees) AS filas_honorarios, (SELECT count(DISTINCT codigo_norm) FROM fees) AS codigos_honorarios", "audit_detail")
def dataset_counts(spark, sf_dir):
    d = detail(spark, sf_dir)
    sets = H.training_set(d).select(V.split_codes(F.col("codigo_grupo_auditor")).alias("cs"))
    a = sets.agg(F.count("*").alias("filas"), F.count_distinct("cs").alias("grupos"))
    b = sets.select(F.explode("cs").alias("c")).agg(F.count_distinct("c").alias("codigos"))
    c = H.fee_training_set(d).agg(F.count("*").alias("filas_honorarios"), F.count_distinct("codigo_norm").alias("codigos_honorarios"))
    return a.crossJoin(b).crossJoin(c)


@query(f"WITH {TRAIN} SELECT id_agenda, codigo_grupo_auditor, fecha FROM t ORDER BY fecha NULLS FIRST, id_agenda, codigo_grupo_auditor LIMIT 2000", "audit_detail")
def ordered_limit(spark, sf_dir):
    rows = H.training_set(detail(spark, sf_dir)).select("id_agenda", "codigo_grupo_auditor", "fecha")
    return H.ordered_limit(rows, [F.col("fecha"), F.col("id_agenda"), F.col("codigo_grupo_auditor")], 2000)


@query(f"WITH {FEES} SELECT *, (SELECT count(*) FROM fees) AS training_rows FROM ({_majority('fees', 'porcentaje_norm')})", "audit_detail")
def write_model(spark, sf_dir):
    """The fee majority model written as a version to the shared folder and read back."""
    from procaudit.sources.versions import read_version, write_version

    rows = H.fee_training_set(detail(spark, sf_dir))
    write_version(path := scratch_path(spark, "model"), "porcentaje", rows.count(), {"by_code": H.majority_by_code(rows, "porcentaje_norm")})
    model = read_version(spark, path, target="porcentaje")
    return model.table("by_code").withColumn("training_rows", F.lit(model.meta["training_rows"]).cast("long"))
