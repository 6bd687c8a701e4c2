"""Procedure templates: selection, assembly and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procaudit.functions.text import squeeze_text, strip
from procaudit.functions.values import normalize_code

EXCLUDED_CODES = ("99204",)


def template_join(templates: DataFrame, items: DataFrame, procedures: DataFrame) -> DataFrame:
    """Active templates with their active items and type-P procedures that carry a code."""
    t = templates.where("estado = 1").select(F.col("codigo").alias("cod_plantilla"), F.col("descripcion").alias("plantilla_descripcion"), "desc_comp")
    i = items.where("estado = 1").select("cod_plantilla", "procedimiento", "cantidad", "orden")
    p = procedures.where("tipo = 'P' AND codigo IS NOT NULL AND codigo <> ''").select(F.col("id").alias("procedimiento"), "tipo", "codigo", "descripcion")
    return i.join(t, "cod_plantilla").join(p, "procedimiento")


def template_procs(joined: DataFrame) -> DataFrame:
    return joined.groupBy("cod_plantilla", "tipo", "codigo").agg(
        F.max("plantilla_descripcion").alias("plantilla_descripcion"), F.max("desc_comp").alias("plantilla_desc_comp"),
        F.max("descripcion").alias("procedimiento_descripcion"), F.sum("cantidad").alias("cantidad_total"), F.min("orden").alias("orden"),
    )


def template_rows(procs: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Procedures with a normalized code outside ``excluded``; an empty exclusion means the default one."""
    out = procs.withColumn("codigo_norm", normalize_code(F.col("codigo"))).withColumn("cod_plantilla", strip(F.col("cod_plantilla")))
    return out.where((F.col("cod_plantilla") != "") & (F.col("codigo_norm") != "") & ~F.col("codigo_norm").isin(*(excluded or EXCLUDED_CODES)))


def template_assembly(rows: DataFrame) -> DataFrame:
    """Per template its procedures in order of place and code, and its codes in the order of the first of each."""
    listed = F.array_sort(F.collect_list(F.struct("orden", "codigo", F.col("codigo_norm").alias("norm"), "tipo", squeeze_text(F.col("procedimiento_descripcion")).alias("descripcion"), F.col("cantidad_total").cast("string").alias("cantidad"))))
    out = rows.groupBy("cod_plantilla").agg(F.max(squeeze_text(F.col("plantilla_descripcion"))).alias("descripcion"), F.max(squeeze_text(F.col("plantilla_desc_comp"))).alias("desc_comp"), listed.alias("procedimientos"))
    return out.withColumn("codigos", F.array_distinct(F.transform("procedimientos", lambda p: p["norm"])))


def template_text(descripcion: Column, desc_comp: Column, procedimientos: Column) -> Column:
    parts = F.flatten(F.transform(procedimientos, lambda p: F.array(p["norm"], p["descripcion"])))
    return strip(F.array_join(F.concat(F.array(F.coalesce(descripcion, F.lit("")), F.coalesce(desc_comp, F.lit(""))), parts), " "))
