"""Readers with fixed schemas for the tables the jobs take, from Parquet or JDBC, and the sinks for what they make."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procaudit.sources.versions import files_of

SCHEMAS = {
    "audit_detail": "id string, id_agenda long, mes_plano string, fecha date, updated_at timestamp_ntz, id_empresa string, id_seguro long, estado int, codigo string, codigo_grupo_auditor string, porcentaje string, tiempo_anestesia string, honorario_auditor string, nombre_procedimiento string, procedimiento_auditor string, observacion_auditor string, hallazgo string, conclusion string",
    "archivo_plano_cabecera": "id long, id_hc long, mes_plano string, id_empresa string, estado int",
    "archivo_plano_detalle": "id string, id_ap_cabecera long, codigo string, tipo string, descripcion string, cantidad string, estado int",
    "historiaclinica": "hcid long, id_agenda long",
    "ap_plantilla": "codigo string, descripcion string, desc_comp string, estado int",
    "ap_plantilla_items": "cod_plantilla string, procedimiento long, cantidad int, orden int, estado int",
    "ap_procedimiento": "id long, tipo string, codigo string, descripcion string",
}
BILLING = ("archivo_plano_cabecera", "archivo_plano_detalle", "historiaclinica")
TEMPLATES = ("ap_plantilla", "ap_plantilla_items", "ap_procedimiento")


#: The numbers by which a table's rows are dealt to JDBC partitions.
SPLIT = {"audit_detail": "id_agenda", "archivo_plano_cabecera": "id", "archivo_plano_detalle": "id_ap_cabecera", "historiaclinica": "hcid", "ap_plantilla_items": "procedimiento", "ap_procedimiento": "id"}
ROWS_PER_PARTITION = 500_000


def conformed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns and types of the table called ``name``."""
    return df.to(SparkSession.active().createDataFrame([], SCHEMAS[name]).schema)


def read_jdbc(spark: SparkSession, name: str, jdbc: dict, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """A table over JDBC (``jdbc``: url, driver, user and so on; dbtable where it is not called ``name``), in partitions
    of about ``rows_per_partition`` rows: the source is asked once for the least and largest number of the table's split
    column and for its rows, and the range is cut evenly. Rows without that number come with the first partition. A
    filter on the result that the source can evaluate is sent to it."""
    base = {"dbtable": name, "preferTimestampNTZ": "true"} | jdbc
    load = lambda **more: spark.read.format("jdbc").options(**{k: v for k, v in (base | more).items() if v is not None}).load()
    column = SPLIT.get(name)
    if column is None:
        return conformed(load(), name)
    quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(base["url"]).quoteIdentifier
    asked = f"SELECT MIN({quoted(column)}) AS {quoted('least')}, MAX({quoted(column)}) AS {quoted('most')}, COUNT(*) AS {quoted('n')} FROM {base['dbtable']}"
    low, high, n = load(dbtable=None, query=asked).first()
    parts = -(-n // rows_per_partition)
    if parts < 2 or low is None or low == high:
        return conformed(load(), name)
    return conformed(load(partitionColumn=column, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts)), name)


def read_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict | None = None, **options) -> DataFrame:
    """One table with its fixed schema, from Parquet at ``path`` or over JDBC."""
    return spark.read.schema(SCHEMAS[name]).parquet(path) if path is not None else read_jdbc(spark, name, jdbc or {}, **options)


def read_history(spark: SparkSession, path: str | None = None, jdbc: dict | None = None, **options) -> DataFrame:
    return read_table(spark, "audit_detail", path, jdbc, **options)


def read_group(spark: SparkSession, names: tuple[str, ...], folder: str | None = None, jdbc: dict | None = None, **options) -> dict[str, DataFrame]:
    """``BILLING`` or ``TEMPLATES`` tables by name."""
    return {n: read_table(spark, n, f"{folder}/{n}.parquet" if folder else None, jdbc, **options) for n in names}


def apply_updates(target: DataFrame, updates: DataFrame) -> DataFrame:
    """``target`` with the changed ``tiempo_anestesia`` and ``honorario_auditor`` of ``updates`` (id, new_time,
    new_fee): the dry run."""
    new = updates.select(F.col("id").alias("u_id"), "new_time", "new_fee")
    changed = {"tiempo_anestesia": F.coalesce("new_time", "tiempo_anestesia"), "honorario_auditor": F.coalesce("new_fee", "honorario_auditor")}
    return target.join(new, F.col("id") == F.col("u_id"), "left").withColumns(changed).select(target.columns)


#: Long columns of the history that many of its rows share, and the rows of a month that are dealt to one file.
SHARED, FILE_ROWS = ("nombre_procedimiento", "procedimiento_auditor", "observacion_auditor", "hallazgo", "conclusion"), 300_000


def with_alike(history: DataFrame) -> DataFrame:
    """``history`` with two hashes of its shared columns; nulls leave a hash as it is, so they are told by flags."""
    told = [x for c in SHARED for x in (F.col(c).isNull(), F.col(c))]
    return history.withColumns({f"_alike{k}": F.xxhash64(F.lit(k), *told) for k in (1, 2)})


def by_month(short: DataFrame, long: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """The history of the rows ``short`` (its short columns and those of ``with_alike``) and ``long`` (their shared columns,
    mes_plano and id), the rows of a month together, large months in parts. The short columns of every row are dealt and,
    once a part, the long ones that its rows share; these are put to the rows where both have arrived. So are ``updates``
    (id, mes_plano, new_time, new_fee), as ``apply_updates`` puts them."""
    sizes = long.groupBy("mes_plano").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("_parts")).collect()  # a row a month
    months = F.broadcast(short.sparkSession.createDataFrame(sizes, "_month string, _parts int"))
    of_month = lambda df: df.join(months, F.col("mes_plano").eqNullSafe(F.col("_month"))).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts"))).drop("_month", "_parts")
    key = ("mes_plano", "_part", "_alike1", "_alike2")
    rows = of_month(short).withColumn("_row", F.lit(1))
    texts = of_month(with_alike(long)).select(*key, *SHARED).distinct().withColumn("_row", F.lit(0))
    if updates is not None:
        found = of_month(updates).select("id", "mes_plano", "_part", F.struct("new_time", "new_fee").alias("_change"), F.lit(2).alias("_row"))
        rows = rows.unionByName(found, allowMissingColumns=True)
    both = rows.unionByName(texts, allowMissingColumns=True).repartition(max(2 * sum(r["_parts"] for r in sizes), 1), "mes_plano", "_part")
    group = Window.partitionBy(*key).orderBy("_row")
    if updates is not None:
        changes = F.collect_list("_change").over(Window.partitionBy("mes_plano", "_part", "id"))
        both = both.withColumn("_changes", changes).where("_row < 2")
    out = both.withColumns({c: F.first(c).over(group) for c in SHARED}).where("_row = 1")
    if updates is not None:
        out = out.withColumn("_new", F.explode_outer("_changes")).withColumns({"tiempo_anestesia": F.coalesce("_new.new_time", "tiempo_anestesia"), "honorario_auditor": F.coalesce("_new.new_fee", "honorario_auditor")})
    return out.select(schema_names("audit_detail"))


def schema_names(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


def write_history(history: DataFrame, path: str) -> None:
    """The history as a table with a folder a month; large months are split over files."""
    history = conformed(history, "audit_detail")
    with shuffles_freed(history.sparkSession):
        by_month(with_alike(history).drop(*SHARED), history.select("id", "mes_plano", *SHARED)).write.partitionBy("mes_plano").parquet(path)


def write_updates(spark: SparkSession, path: str, updates: DataFrame, run: str) -> DataFrame:
    """Applies ``updates`` to the table that ``write_history`` made at ``path`` and returns (mes_plano) of the months
    that it put in place; the files of all other months stay as they are.

    The new rows of these months are staged as a whole beside the table first, under ``run``, the name of this run. Only
    then does each staged month take the place of the old one by a rename. A run that failed is to be called again under
    its name: a month is either in its place or still staged, so the table comes out the same. One run at a time."""
    files, where, rename = files_of(spark, path)
    staged = f"{path}/_updates/{run}"
    if not files.util().exists(where(f"{staged}/_SUCCESS")):
        history = read_history(spark, path)
        new = updates.where("new_time IS NOT NULL OR new_fee IS NOT NULL").select("id", "new_time", "new_fee")
        new = saved(history.select("id", "mes_plano").distinct().join(new, "id"), "updates")
        months = new.select(F.col("mes_plano").alias("month")).distinct().collect()  # a row a month
        rows = history.join(F.broadcast(spark.createDataFrame(months, "month string")), F.col("mes_plano").eqNullSafe(F.col("month")), "left_semi")
        with shuffles_freed(spark):
            by_month(with_alike(rows).drop(*SHARED), rows.select("id", "mes_plano", *SHARED), new).write.mode("overwrite").partitionBy("mes_plano").parquet(staged)
    months = spark.read.schema(SCHEMAS["audit_detail"]).parquet(staged).select("mes_plano").distinct().collect()
    for found in files.util().listStatus(where(staged)) if months else ():
        if found.isDirectory():
            old = where(f"{path}/{found.getPath().getName()}")
            files.delete(old, True)
            files.rename(found.getPath(), old, spark.sparkContext._gateway.new_array(rename, 0))
    files.delete(where(staged), True)
    spark.catalog.refreshByPath(path)
    return spark.createDataFrame(months, "mes_plano string")


_unset: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; where none is set, in one of our own if all is local."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if base is None and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if base is None:
        base = _unset.get(context.applicationId) or _unset.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{base}/{name}-{uuid.uuid4().hex}"


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_freeing, _held = Lock(), {}


@contextmanager
def shuffles_freed(spark: SparkSession):
    """While this is open, a query's shuffle files go when it ends, and not when the driver happens to collect its garbage:
    for writes, whose result is read from files. May be open several times at once."""
    with _freeing:
        _held.setdefault("count", 0)
        if not _held["count"]:
            _held["before"] = spark.conf.get(FREED, None)
            spark.conf.set(FREED, "true")
        _held["count"] += 1
    try:
        yield
    finally:
        with _freeing:
            _held["count"] -= 1
            if not _held["count"]:
                spark.conf.unset(FREED) if _held["before"] is None else spark.conf.set(FREED, _held["before"])


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later steps neither compute nor plan it again, and its shuffle files go."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
