"""Filters, groupings and reports over the history of audited codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procaudit.functions.values import freq_class, normalize_code, normalize_percent, normalize_time
from procaudit.sources.tables import saved

GROUP_KEYS = ("id_agenda", "id_empresa", "id_seguro", "codigo_grupo_auditor", "honorario_auditor", "tiempo_anestesia", "nombre_procedimiento", "observacion_auditor", "procedimiento_auditor")
TEXTS = ("procedimiento_auditor", "nombre_procedimiento", "hallazgo", "conclusion")
PERCENTAGES, HOURS = ("50", "100"), ("1", "2", "3", "4", "5", "6", "7", "8", "24")


def filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def active_coded(history: DataFrame) -> DataFrame:
    return history.where((F.col("estado") == 1) & filled("codigo"))


def trainable_rows(history: DataFrame) -> DataFrame:
    return history.where((F.col("estado") == 1) & filled("hallazgo") & filled("codigo_grupo_auditor"))


def given_filters(requests: DataFrame) -> DataFrame:
    """(r_id, f_empresa, f_seguro): an empty company or insurer 0 is no filter."""
    return requests.select("r_id", F.expr("nullif(r_empresa, '')").alias("f_empresa"), F.expr("nullif(r_seguro, 0)").alias("f_seguro"))


def filter_pools(requests: DataFrame, history: DataFrame) -> DataFrame:
    """The history rows of every combination of filters that requests give, each combination once: f_empresa and
    f_seguro (null: no filter) before the columns of ``history``. One pass over the history, whose rows stay where they
    are: each is taken with and without its company and insurer, and combinations are looked up, a row a combination."""
    combos = given_filters(requests).select(F.col("f_empresa").alias("e"), F.col("f_seguro").alias("s")).distinct()
    company, insurer = F.col("id_empresa"), F.col("id_seguro").cast("long")
    ways = [(c, s) for c in (None, company) for s in (None, insurer)]
    every = F.array(*[F.struct((F.lit(True) if c is None else c.isNotNull()).alias("a"), (F.lit(True) if s is None else s.isNotNull()).alias("b"), (F.lit(None) if c is None else c).cast("string").alias("f_empresa"), (F.lit(None) if s is None else s).cast("long").alias("f_seguro")) for c, s in ways])
    rows = history.select("*", F.inline(every)).where("a AND b").drop("a", "b")
    met = rows.join(F.broadcast(combos), F.col("f_empresa").eqNullSafe(F.col("e")) & F.col("f_seguro").eqNullSafe(F.col("s")), "left_semi")
    return met.select("f_empresa", "f_seguro", *history.columns)


def filter_counts(requests: DataFrame, history: DataFrame) -> DataFrame:
    """(r_id, n, visits) of the history rows that a request may use, for requests that may use any: counted once a
    combination of filters, less the rows of the request's own visit."""
    per = history.where(F.col("id_agenda").isNotNull()).groupBy("id_agenda", "id_empresa", "id_seguro").agg(F.count("*").alias("m"))
    visits = filter_pools(requests, per).groupBy("f_empresa", "f_seguro", "id_agenda").agg(F.sum("m").alias("m"))
    every = visits.groupBy("f_empresa", "f_seguro").agg(F.sum("m").alias("n"), F.count("*").alias("visits")).withColumnsRenamed({"f_empresa": "e", "f_seguro": "s"})
    r = given_filters(requests).join(every, F.col("f_empresa").eqNullSafe(F.col("e")) & F.col("f_seguro").eqNullSafe(F.col("s")))
    passes = (F.col("f_empresa").isNull() | (F.col("f_empresa") == F.col("id_empresa"))) & (F.col("f_seguro").isNull() | (F.col("f_seguro") == F.col("id_seguro")))
    own = r.join(per, F.col("r_id") == F.col("id_agenda")).where(passes).groupBy("r_id").agg(F.sum("m").alias("own"))
    out = r.join(own, "r_id", "left").select("r_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n"), (F.col("visits") - F.col("own").isNotNull().cast("long")).alias("visits"))
    return out.where("n > 0")


def optional_filters(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Requests (r_id, r_empresa, r_seguro) with the history rows they may use, a row a pair. An empty company or
    insurer 0 is no filter. Each combination of given filters is an equi-join of its own, so no pair is made that a
    filter drops; to count or rank pairs, ``filter_counts`` and ``filter_pools`` make none."""
    r = requests.select(F.col("r_id"), F.expr("nullif(r_empresa, '')").alias("r_empresa"), F.expr("nullif(r_seguro, 0)").alias("r_seguro"))
    parts = []
    for by_company in (False, True):
        for by_insurer in (False, True):
            mine = r.where((F.col("r_empresa").isNotNull() == by_company) & (F.col("r_seguro").isNotNull() == by_insurer))
            on = F.col("r_id") != F.col("id_agenda")
            if by_company:
                on &= F.col("r_empresa") == F.col("id_empresa")
            if by_insurer:
                on &= F.col("r_seguro") == F.col("id_seguro")
            parts.append(mine.join(history, on))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def backfill_filters(history: DataFrame, mes_plano: str | None = None, id_agenda: int | None = None, id_empresa: str | None = None) -> DataFrame:
    out = active_coded(history).withColumn("codigo_norm", normalize_code(F.col("codigo"))).where("codigo_norm <> ''")
    for name, value in (("mes_plano", mes_plano), ("id_agenda", id_agenda), ("id_empresa", id_empresa)):
        if value:
            out = out.where(F.col(name) == value)
    return out


def code_report(history: DataFrame) -> DataFrame:
    """Per code its rows, visits, percentages and hours in use, and class. Distinct values are reduced per code
    first, so no distinct aggregate expands the rows."""
    rows = active_coded(history)
    by_visit = rows.groupBy("codigo", "id_agenda").agg(F.count("*").alias("n")).groupBy("codigo").agg(F.sum("n").alias("frecuencia"), F.count("id_agenda").alias("agendas"))

    def values(column: str, name: str) -> DataFrame:
        return rows.where(F.col(column).isNotNull()).select("codigo", column).distinct().groupBy("codigo").agg(F.array_join(F.array_sort(F.collect_list(column)), " | ").alias(name))

    out = by_visit.join(values("porcentaje", "porcentajes_usados"), "codigo", "left").join(values("tiempo_anestesia", "tiempos_anestesia_usados"), "codigo", "left")
    return out.withColumn("clase_frecuencia", freq_class(F.col("frecuencia")))


def history_groups(history: DataFrame) -> DataFrame:
    """Per visit, company, insurer, code group, fee, time, name, note and procedure: the codes, texts and recency."""
    return active_coded(history).groupBy(*GROUP_KEYS).agg(
        F.array_join(F.array_sort(F.collect_set("codigo")), ",").alias("codigos"), F.max("hallazgo").alias("hallazgo"), F.max("conclusion").alias("conclusion"),
        F.count("*").alias("detalles"), F.max("updated_at").alias("recent"), F.min("id").alias("group_id"),
    )


def keyed_texts(history: DataFrame) -> DataFrame:
    """``history`` with a hash of its texts; nulls leave a hash as it is, so they are told by flags."""
    return history.withColumn("text_key", F.xxhash64(*[x for c in TEXTS for x in (F.col(c).isNull(), F.col(c))]))


def grouped_texts(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, columns, text_key) of ``rows`` grouped by ``keys``: the greatest of each column and of each text, whose rows
    are given as (text_key, TEXTS); and these with those that come from a group's differing rows. A group whose rows have
    the same texts has their key, so no text is compared there."""
    ends = [F.min("text_key").alias("text_key"), F.max("text_key").alias("_most")]
    groups = saved(rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns], *ends), "text-groups")
    alike, differing = groups.where("text_key = _most").drop("_most"), groups.where("text_key <> _most").select(*keys, *columns)
    if differing.isEmpty():
        return alike, texts
    at = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    each = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], "text_key").distinct().join(texts, "text_key")
    greatest = differing.join(each, at).groupBy(*keys, *columns).agg(*[F.max(c).alias(c) for c in TEXTS])
    made = saved(keyed_texts(greatest), "texts-made")
    return alike.unionByName(made.drop(*TEXTS)), texts.unionByName(made.select("text_key", *TEXTS)).distinct()


def training_set(history: DataFrame) -> DataFrame:
    columns = ("fecha", "id_empresa", "id_seguro", "procedimiento_auditor", "hallazgo", "conclusion", "honorario_auditor", "nombre_procedimiento", "tiempo_anestesia")
    return trainable_rows(history).groupBy("id_agenda", "codigo_grupo_auditor").agg(*[F.max(c).alias(c) for c in columns], F.count("*").alias("detalles"))


def fee_rows(history: DataFrame) -> DataFrame:
    columns = ("fecha", "id_empresa", "id_seguro", "porcentaje", *TEXTS)
    return active_coded(history).where(filled("porcentaje")).groupBy("id_agenda", "codigo").agg(*[F.max(c).alias(c) for c in columns])


def allowed_values(rows: DataFrame, value: Column, allowed: tuple[str, ...], name: str) -> DataFrame:
    """Rows with a code whose normalized value is one of ``allowed``."""
    out = rows.withColumn("codigo_norm", normalize_code(F.col("codigo"))).withColumn(name, value)
    return out.where((F.col("codigo_norm") != "") & F.col(name).isin(*allowed))


def fee_training_set(history: DataFrame, allowed: tuple[str, ...] = PERCENTAGES) -> DataFrame:
    return allowed_values(fee_rows(history), normalize_percent(F.col("porcentaje")), allowed, "porcentaje_norm")


def time_training_set(history: DataFrame, allowed: tuple[str, ...] = HOURS) -> DataFrame:
    rows = active_coded(history).where(filled("tiempo_anestesia"))
    return allowed_values(rows, normalize_time(F.col("tiempo_anestesia")), allowed, "tiempo_norm")


def ordered_limit(rows: DataFrame, keys: list[Column], n: int | None) -> DataFrame:
    """The first ``n`` rows in loader order; all in that order without a limit."""
    out = rows.orderBy(*keys)
    return out.limit(n) if n else out


def majority_by_code(rows: DataFrame, value: str) -> DataFrame:
    """Each code's most frequent value, the smallest of equally frequent ones."""
    return rows.groupBy("codigo_norm").agg(F.mode(value, True).alias("value"))


def majority_global(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.mode(value, True).alias("value"))


#: Parts into which the rows of one code are dealt when they meet its value.
CODE_PARTS = 16


def code_default_lookup(rows: DataFrame, by_code: DataFrame, default: str | None, last: str) -> DataFrame:
    """``rows`` with ``value``: the code's own, else the global default, else ``last``. A frequent code's rows are dealt to
    CODE_PARTS tasks, each of which gets its value."""
    found = by_code.select(F.col("codigo_norm").alias("k"), F.expr("nullif(value, '')").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(CODE_PARTS - 1))).alias("kp"))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(CODE_PARTS)).cast("int"))
    met = dealt.join(found, (F.col("codigo_norm") == F.col("k")) & (F.col("_part") == F.col("kp")), "left")
    return met.withColumn("value", F.coalesce("v", F.lit(default or last))).drop("k", "v", "kp", "_part")
