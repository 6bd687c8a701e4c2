"""Work follows what differs: rows are dealt by visit once, and equal texts are worked on once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from procaudit.operators import tfidf as I
from procaudit.operators.grams import Featurizer, fit_vocabulary
from procaudit.sources import fixtures
from procaudit.sources.tables import saved

SF = "/root/testdata/sf0.001"
with_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data are not here")


@with_data
def test_history_is_dealt_by_visit_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = fixtures.table(spark, SF, "audit_detail").groupBy("id_agenda", "codigo").agg(F.max("hallazgo").alias("h"), F.max("codigo_grupo_auditor").alias("g"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        requests = fixtures.table(spark, SF, "solicitudes")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 5 and not any("% 200" in line or "doc_id" in line for line in shuffles)
    assert plan.count("BroadcastHashJoin") == 2 and requests.count("BroadcastHashJoin") == 2


@with_data
def test_joins_in_another_order_have_the_same_rows(spark, monkeypatch):
    rows = fixtures.table(spark, SF, "audit_detail")
    ours = sorted(map(repr, rows.collect()))
    monkeypatch.setattr(fixtures, "JOINS", ("", ""))
    monkeypatch.setattr(fixtures, "LOOKING_UP", ())
    assert ours == sorted(map(repr, fixtures.table(spark, SF, "audit_detail").select(rows.columns).collect()))


def test_equal_texts_are_worked_on_once(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(30)]
    texts = [" ".join(rng.choices(words, k=6)) for _ in range(12)] + ["", "áb é"]
    rows = spark.createDataFrame([(i, texts[i * 5 % len(texts)] if i % 9 else None) for i in range(300)], "id long, text string")
    different, owners = I.distinct_texts(rows)
    assert different.count() == len(texts) and owners.count() == 300
    assert {r["id"] for r in owners.collect()} == {r["id"] for r in different.collect()}
    once, each = different.select("copies", "text"), rows.select(F.lit(1).alias("copies"), F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = fit_vocabulary(once, 1)
    assert sorted(vocabulary.collect()) == sorted(fit_vocabulary(each, 1).collect())
    packed = Featurizer(vocabulary).lists(different.select("id", "text"))
    counts = I.gram_counts(different)
    tidy = I.tfidf_transform(counts, vocabulary)
    mean = tidy.groupBy("id").agg(F.sum("weight").alias("w"))
    got = {r["id"]: sum(r["weights"]) for r in packed.collect() if r["grams"]}
    assert got == {r["id"]: pytest.approx(r["w"]) for r in mean.collect()}
    again = lambda df: saved(df, "again")
    key = lambda df: sorted((r["q_id"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert key(I.top_matches(I.cosine_top(again(packed), packed))) == key(I.top_matches(I.cosine_top(again(tidy), tidy)))
    assert key(I.nn_tfidf(again(packed), packed, again(different), different)) == key(I.nn_tfidf(again(tidy), tidy, again(different), different))


@with_data
def test_grams_are_dealt_by_part_before_they_are_made(spark):
    from procaudit import catalog

    plan = catalog.queries()["char_ngrams"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("REPARTITION_BY_NUM")


def test_a_history_is_dealt_without_its_long_columns(spark, tmp_path, monkeypatch):
    """whole rows were dealt three times; long texts that rows share now move once a part, nulls told from blanks."""
    from procaudit.sources import tables as S

    names = S.schema_names("audit_detail")
    texts = [(None, "a" * 3000), ("a" * 3000, None), ("", ""), (None, None)]
    rows = [{"id": f"r{i}", "id_agenda": i, "mes_plano": [None, "2024-01", "2024-02"][i % 3], "hallazgo": texts[i % 4][0], "conclusion": texts[i % 4][1]} for i in range(400)]
    history = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], S.SCHEMAS["audit_detail"])
    monkeypatch.setattr(S, "FILE_ROWS", 50)
    S.write_history(history, f"{tmp_path}/h")
    back = S.read_history(spark, f"{tmp_path}/h")
    key = lambda df: sorted(map(repr, df.select(names).collect()))
    assert key(back) == key(history)
    assert len(list((tmp_path / "h" / "mes_plano=2024-01").glob("part-*"))) > 1
    short, long = S.with_alike(history).drop(*S.SHARED), history.select("id", "mes_plano", *S.SHARED)
    dealt = S.by_month(short, long)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and plan.index("Window") < plan.index("RepartitionByExpression") < plan.index("Aggregate")
    changes = spark.createDataFrame([("r4", "3", None), ("r7", None, "50")], "id string, new_time string, new_fee string")
    S.write_updates(spark, f"{tmp_path}/h", changes, "one")
    assert key(S.read_history(spark, f"{tmp_path}/h")) == key(S.apply_updates(history, changes))


@with_data
def test_visits_are_dealt_to_as_many_tasks_as_their_lines_ask_for(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "DEALT_ROWS", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = fixtures.table(spark, SF, "audit_detail")
        plan = rows.groupBy("id_agenda", "codigo").agg(F.max("hallazgo"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    parts = -(-fixtures.table(spark, SF, "lineitem").count() // 500)
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    by_visit = [line for line in shuffles if "custkey" not in line]
    assert by_visit and all(f", {parts})" in line for line in by_visit)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pools_are_cut_before_they_are_ranked(spark):
    """Every group was dealt and ranked in every combination; F19: every pair of a request and a candidate."""
    from procaudit.operators import matching as M

    rows = [(f"g{i}", i % 50, "ab"[i % 2] if i % 7 else None, i % 3, i // 4 if i % 11 else None) for i in range(1200)]
    groups = spark.createDataFrame(rows, "group_id string, id_agenda long, id_empresa string, id_seguro long, day int").selectExpr("group_id", "id_agenda", "id_empresa", "id_seguro", "timestamp_ntz'2024-01-01' + make_dt_interval(day, cast(crc32(group_id) % 24 as int)) AS recent")
    groups = saved(groups, "groups")
    r = spark.createDataFrame([(0, "a", None), (1, None, 1), (2, "b", 2), (3, "", 0), (4, "z", 1)], "r_id long, r_empresa string, r_seguro long")
    near = M.recent_groups(r, groups, 20)
    assert 0 < near.count() < 900
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(M.ranked_pools(r, near, 20).where("place <= 20")) == key(M.ranked_pools(r, groups, 20).where("place <= 20"))
    lists = M.candidate_lists(r, groups, 20)
    assert "Window" not in plan_of(lists) and {x["r_id"]: len(x["candidates"]) for x in lists.collect()} == {0: 20, 1: 20, 2: 20, 3: 20}


def test_combinations_are_counted_in_one_pass(spark):
    """the history was read and dealt once for each way of filtering."""
    from procaudit.operators import history as H

    history = saved(spark.range(50).selectExpr("id AS id_agenda", "cast(id % 3 AS string) AS id_empresa", "id % 4 AS id_seguro"), "history")
    r = spark.createDataFrame([(0, "1", 2), (1, "", 0)], "r_id long, r_empresa string, r_seguro long")
    plan = plan_of(H.filter_pools(r, history))
    assert "Union" not in plan and plan.count("/history-") <= 1


def test_rows_of_one_code_are_dealt_to_many_tasks(spark):
    """F32: one task read all rows of a frequent code."""
    from procaudit.operators import history as H

    rows = saved(spark.range(4000).selectExpr("cast(id AS string) AS id", "if(id % 100 = 0, 'rare', '43000') AS codigo_norm"), "rows")
    by_code = saved(spark.createDataFrame([("43000", "50")], "codigo_norm string, value string"), "values")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = H.code_default_lookup(rows, by_code, None, "100")
        held = found.where("codigo_norm = '43000'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(held) > 1 and found.columns == ["id", "codigo_norm", "value"]
    assert {tuple(x) for x in found.groupBy("value").count().collect()} == {("50", 3960), ("100", 40)}


def test_a_summary_computes_its_plan_once(spark):
    """the plan was computed for each group of figures."""
    from procaudit.operators import backfill as B

    rows = spark.createDataFrame([("1", "5", "7", "50", "1(20)", None)], "id string, codigo_norm string, tiempo_anestesia string, porcentaje string, honorario_auditor string, tiempo_fuente string")
    assert "regexp" not in plan_of(B.run_summary(B.planned(rows), rows))


@with_data
def test_pairs_of_text_and_codes_are_told_before_they_are_made(spark):
    """code lists were split for every line of a visit, below the grouping, and whole documents passed for each cut."""
    from procaudit.functions.values import has_code, split_codes
    from procaudit.plans.shared import text_label_pairs

    plan = text_label_pairs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("transform(split(") < plan.index("Aggregate [id_agenda") and plan.count("transform(split(") == 1 and ", 1, 1200)" in plan
    lists = spark.createDataFrame([(x,) for x in (None, "", " ", ",", "+ ,\t", "1", " 1,", "a+b", "\u00a0", "\x0b")], "c string")
    for r in lists.select(has_code(F.col("c")).alias("told"), (F.size(split_codes(F.col("c"))) > 0).alias("split")).collect():
        assert r["told"] == r["split"]


def test_documents_are_cut_where_no_visit_reaches(spark, tmp_path, monkeypatch):
    """the cut leaves the rows of visits with positive, negative and no remainder as they are."""
    import shutil

    if not os.path.isdir(SF):
        pytest.skip("test data are not here")
    path = f"{tmp_path}/sf"
    shutil.copytree(SF, path, copy_function=shutil.copyfile)
    os.chmod(path, 0o755)
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        spark.read.parquet(f"{SF}/{name}.parquet").withColumn(key, F.col(key) - 700).write.parquet(f"{path}/{name}-new")
        os.remove(f"{path}/{name}.parquet")
        os.rename(f"{path}/{name}-new", f"{path}/{name}.parquet")
    for name, key in (("documents", "doc_id"), ("part", "p_partkey")):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        rows.union(rows.where(F.col(key) > 0).withColumn(key, -F.col(key))).write.parquet(f"{path}/{name}-new")
        os.remove(f"{path}/{name}.parquet")
        os.rename(f"{path}/{name}-new", f"{path}/{name}.parquet")
    key = lambda: sorted(map(repr, fixtures.table(spark, path, "audit_detail").select("id", "id_agenda", "hallazgo", "conclusion").collect()))
    ours = key()
    monkeypatch.setattr(fixtures, "REACHED", 10_000_000)
    assert ours == key() and len(ours) > 1000


def test_training_rows_by_text_key_are_those_of_the_texts(spark, monkeypatch):
    """groups took the greatest of whole texts, and fits a whole text a row. Keys stand for texts now, also where the
    rows of a group differ, have nulls, or are blank."""
    from procaudit.functions import text as T
    from procaudit.operators import evaluation as E
    from procaudit.operators import history as H
    from procaudit.plans import shared

    words = (None, "", " ", "colon", "Polipo  b", "zona\t")
    rows = [
        (None if i % 31 == 0 else i % 23, i % 6 and 1, ("43001", "CPT-7", "", "x", "43002")[i % 5], ("43001,43002", "+", "43003", None)[i // 23 % 4], ("50", "1", "100", "", None, "0.5")[i % 6], ("2", "2,0", "24", "", "30")[i % 5],
         *(words[(i * k + i // k) % 6] if i % 23 > 4 else words[(i % 23 + k) % 6] for k in (1, 3, 4, 5)))
        for i in range(700)
    ]
    columns = "id_agenda long, estado int, codigo string, codigo_grupo_auditor string, porcentaje string, tiempo_anestesia string, procedimiento_auditor string, nombre_procedimiento string, hallazgo string, conclusion string"
    others = [F.lit(None).cast("string").alias(c) for c in ("fecha", "id_empresa", "id_seguro", "honorario_auditor")]
    d = spark.createDataFrame(rows, columns).select("*", *others)
    monkeypatch.setattr(shared, "table", lambda *a: d)
    short, texts = shared.history_by_text(spark, "")
    plain = lambda df: sorted(map(repr, map(tuple, df.collect())))
    pairs = shared.text_label_pairs(spark, "").select(F.concat_ws(":", "id_agenda", "codigo_grupo_auditor").alias("id"), F.col("texto").alias("text"), "codigos")
    assert plain(shared.labelled(short, texts)) == plain(E.split_rows(pairs, F.col("id")).select("id", "text", "codigos", "part"))
    for target, old, value in (("porcentaje", H.fee_training_set(d), "porcentaje_norm"), ("tiempo", H.time_training_set(d), "tiempo_norm")):
        counted, rests = shared.valued(short, texts, target)
        whole = T.code_text(T.training_text(), F.col("codigo_norm"))
        mine = counted.join(rests, "rest_id").select(T.strip(F.concat_ws(" ", "head", "text")).alias("text"), "value", "copies")
        assert plain(mine) == plain(old.groupBy(whole.alias("text"), F.col(value).alias("value")).agg(F.count("*").alias("copies"))) != []
