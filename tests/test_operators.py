"""Invariants of splits, metrics, matching and the backfill, and input guards."""

import random

import pytest
from pyspark.sql import functions as F

from procaudit.operators import backfill as B
from procaudit.operators import evaluation as E
from procaudit.operators import matching as M
from procaudit.operators import models as L
from procaudit.operators import tfidf as I


def test_split_is_disjoint_complete_and_exact(spark):
    rows = spark.range(1003)
    parts = {r["part"]: r["n"] for r in E.split_rows(rows, F.col("id")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"test": 151, "validation": 150, "train": 702}
    assert E.split_rows(rows, F.col("id")).select("id").distinct().count() == 1003
    with pytest.raises(ValueError):
        E.split_rows(rows, F.col("id"), 0.6, 0.5)


def test_topup(spark):
    s = spark.createDataFrame([(1, "1", 0.1), (1, "2", 0.3), (1, "3", 0.2), (2, "1", 0.1), (2, "2", 0.6), (2, "3", 0.2)], "id int, codigo string, prob double")
    two = {(r["id"], r["codigo"]) for r in E.min_labels_topup(s, F.lit(0.5), 2).where("selected").collect()}
    one = {(r["id"], r["codigo"]) for r in E.min_labels_topup(s, F.lit(0.5), 1).where("selected").collect()}
    assert two == {(1, "2"), (1, "3"), (2, "2"), (2, "3")} and one == {(1, "2"), (2, "2")}


def test_metrics(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b")], "id int, codigo string")
    p = spark.createDataFrame([(1, "b"), (1, "c")], "id int, codigo string")
    m = E.multilabel_metrics(E.actual_vs_predicted(a, p), spark.createDataFrame([(1,), (2,)], "id int")).first()
    assert m["avg_dice"] == 0.25 and m["avg_code_overlap"] == 0.1667 and m["exact_code_group_accuracy"] == 0.5
    with pytest.raises(ValueError):
        E.select_best(spark.range(1), "nope", "id")


def test_weighted_jaccard(spark):
    a = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "x int, token string, n int")
    b = spark.createDataFrame([(1, "a", 1), (1, "c", 1)], "y int, token string, n int")
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "x int, y int")
    assert {r["y"]: r["jaccard"] for r in M.weighted_jaccard(pairs, a, b, "x", "y").collect()} == {1: 0.25, 2: 0.0}


def test_pool_equals_ranking_per_request(spark):
    rng = random.Random(3)
    groups = [(f"g{i}", rng.randrange(8), rng.choice(["a", "b", None]), rng.randrange(3), rng.randrange(20)) for i in range(200)]
    requests = [(v, rng.choice([None, "", "a", "b"]), rng.choice([None, 0, 1, 2])) for v in range(8)]
    g = spark.createDataFrame(groups, "group_id string, id_agenda long, id_empresa string, id_seguro long, recent int")
    r = spark.createDataFrame(requests, "r_id long, r_empresa string, r_seguro long")
    got = {(x["r_id"], x["group_id"], x["place"]) for x in M.recent_candidates(r, g, 7).collect()}
    expected = set()
    for v, e, s in requests:
        fit = [x for x in groups if x[1] != v and (not e or x[2] == e) and (not s or x[3] == s)]
        expected |= {(v, x[0], k + 1) for k, x in enumerate(sorted(fit, key=lambda x: (-x[4], x[0]))[:7])}
    assert got == expected


def test_backfill_settles_by_the_third_pass(spark):
    rows = spark.createDataFrame([("1", 1, "43239", "2", "75,5", "43239(50)"), ("2", 1, "1", "3", None, "2(10)"), ("3", 2, "9", "1,0", "100", "100")], "id string, id_agenda long, codigo_norm string, tiempo_anestesia string, porcentaje string, honorario_auditor string").withColumn("tiempo_fuente", F.lit(None).cast("string"))
    for _ in range(2):
        plan = B.planned(rows)
        rows = plan.select("id", "id_agenda", "codigo_norm", F.coalesce("new_time", "tiempo_anestesia").alias("tiempo_anestesia"), "porcentaje", F.coalesce("new_fee", "honorario_auditor").alias("honorario_auditor"), "tiempo_fuente")
    assert B.plan_updates(rows).count() == 0


def test_summary_has_a_sample(spark):
    rows = spark.createDataFrame([("1", "5", "7", "50", "1(20)", None)], "id string, codigo_norm string, tiempo_anestesia string, porcentaje string, honorario_auditor string, tiempo_fuente string")
    out = B.run_summary(B.planned(rows), rows).first()
    assert out["updates"] == 1 and '"new_fee":"50"' in out["sample"]


def test_block_search_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 6)).astype("float32")
    rows = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "id long, v array<float>")
    got = {r["q_id"]: r["id"] for r in I.nn_embeddings(rows.where("id < 10"), rows.where("id >= 10"), 3).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == {q: 10 + int((u[10:] @ u[q]).argmax()) for q in range(10)}


def test_blocks_grow_with_the_rows(spark, monkeypatch):
    """No task gets more than about BLOCK_ROWS rows of either side, and the neighbours are those of brute force."""
    import numpy as np

    monkeypatch.setattr(I, "BLOCK_ROWS", 40, raising=False)
    monkeypatch.setattr(I, "QUERY_ROWS", 7, raising=False)
    inner, sizes = I._dense_best, spark.sparkContext.accumulator(0)

    def noted(left, right):
        sizes.add(max(len(left), len(right)) > 80)
        return inner(left, right)

    monkeypatch.setattr(I, "_dense_best", noted)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 5)).astype("float32")
    rows = spark.createDataFrame([(i, v[i].tolist()) for i in range(900)], "id long, v array<float>")
    got = {r["q_id"]: r["id"] for r in I.nn_embeddings(rows.where("id < 100"), rows.where("id >= 100")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == {q: 100 + int((u[100:] @ u[q]).argmax()) for q in range(100)}
    assert sizes.value == 0


def test_bounded_search_finds_what_the_full_one_finds(spark, monkeypatch):
    """Groups of alike texts, copies that tie, texts of no known gram; blocks that cannot reach the third score are skipped."""
    rng = random.Random(2)
    topics = [[f"{a}{b}word{a}" for b in "abcdefgh"] for a in "qwrtypsdfg"]
    texts = [(i, " ".join(rng.choices(topics[i % 10], k=6)) + (" shared" if i % 2 else "")) for i in range(300)] + [(300 + i, "qaword qbword") for i in range(5)]
    asked = [(i, t) for i, t in texts if i % 7 == 0] + [(1000, "zzzz"), (1001, ""), (1002, "shared")]
    rows, q = (spark.createDataFrame(x, "id long, text string") for x in (texts, asked))
    counts = I.gram_counts(rows)
    vocabulary = I.tfidf_fit(counts, len(texts), 1)
    vectors, queries = I.tfidf_transform(counts, vocabulary), I.tfidf_transform(I.gram_counts(q), vocabulary)
    key = lambda df: sorted((r["q_id"], r["place"], r["id"], r["score"]) for r in I.top_matches(df).collect())
    full = key(I.cosine_top(queries, vectors))
    index = I.BoundedIndex(vectors, 20)
    found, judged = index.search(queries)
    assert key(found) == full and len(full) > 100
    done = {r["done"]: r["n"] for r in judged.groupBy("done").agg(F.count("*").alias("n")).collect()}
    assert done[0] > 0.5 * sum(done.values()) and index.blocks.select("block").distinct().count() > 10
    monkeypatch.setattr(I, "BLOCK_ROWS", 9)
    assert key(index.search(queries)[0]) == full


def test_columns_reach_their_minimum(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    idx = [sorted(rng.choice(12, 4, replace=False).tolist()) for _ in range(30)]
    weights = [(w / np.linalg.norm(w)).tolist() for w in rng.random((30, 4))]
    copies = rng.integers(1, 4, 30).astype(float)
    positives = np.stack([np.minimum(copies, rng.integers(0, 3, 30) * (rng.random(30) < share)) for share in (0.2, 0.5, 0.9)], axis=1)
    c = np.array([0.5, 1.0, 2.0])
    dense = L.fit_columns(L._Rows(idx, weights, 12), copies, positives, c)
    monkeypatch.setattr(L, "DENSE_TEXTS", 0)
    assert np.allclose(L.fit_columns(L._Rows(idx, weights, 12), copies, positives, c), dense, atol=1e-3)
    x = np.zeros((30, 13))
    for i in range(30):
        x[i, idx[i]], x[i, 12] = weights[i], 1
    for k in range(3):  # the slope of sum of losses + w w / (2 C), which is 0 at the minimum
        p, n, pos = 1 / (1 + np.exp(-x @ dense[:, k])), copies.sum(), positives[:, k].sum()
        g = (copies - positives[:, k]) * p * n / (2 * (n - pos)) - positives[:, k] * (1 - p) * n / (2 * pos)
        assert np.abs(x.T @ g + dense[:, k] / c[k]).max() < 1e-2


def test_grid_fits_every_code(spark):
    """Fifteen codes, each told by a word: none is without a model, and the figures are those of the held rows."""
    rows = [(f"{i}:{r}", f"word{'abcdefghijklmno'[i] * 4}", [f"c{i}"] + ["all"] * (i < 14), "test" if r == 0 else "validation" if r == 1 else "train") for i in range(15) for r in range(6)]
    rows.append(("x", "wordaaaa", ["never"], "validation"))  # a code without training rows
    out = L.multilabel_grid(spark.createDataFrame(rows, "id string, text string, codigos array<string>, part string")).collect()
    assert sorted((r["part"], r["c"], r["threshold"]) for r in out if r["part"] == "validation") == [("validation", c, t) for c in (0.5, 1.0, 2.0) for t in (0.2, 0.3, 0.4, 0.5)]
    test = [r for r in out if r["part"] == "test"]
    assert len(test) == 1 and test[0]["recall_micro"] == 1.0 and test[0]["avg_actual_codes"] == round(29 / 15, 4)
    assert sum(r["selected"] for r in out) == 2
    assert max(r["avg_dice"] for r in out if r["part"] == "validation") == next(r["avg_dice"] for r in out if r["part"] == "validation" and r["selected"])


def test_values_are_learned_from_the_findings(spark):
    """The fee and the hours depend on the finding alone, which the models read."""
    from procaudit.plans import matching as P

    rows = [(i, "43000", ("50", "100")[i % 2], ("1", "24")[i % 2], "biopsia", "biopsia", ("polipo", "normal")[i % 2], "") for i in range(200)]
    data = spark.createDataFrame(rows, "id_agenda long, codigo_norm string, porcentaje_norm string, tiempo_norm string, procedimiento_auditor string, nombre_procedimiento string, hallazgo string, conclusion string")
    for value in ("porcentaje_norm", "tiempo_norm"):
        assert next(r["f1"] for r in P.value_report(data, value).collect() if r["clase"] == "accuracy") == 1.0
    assert {"value_model_fit", "time_model_fit"} <= set(P.R.QUERIES)


def test_plans_have_no_cross_products(spark):
    """Products are made only with a grid, a list of labels or one row, all broadcast."""
    from procaudit import catalog

    for name in ("code_report", "plan_updates", "training_set", "threshold_sweep"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan


def test_readers(spark, tmp_path):
    """Parquet by name and by group, with the fixed schemas."""
    from procaudit.sources import tables as S
    from procaudit.sources.fixtures import table

    sf = "/root/testdata/sf0.001"
    for name in ("audit_detail", *S.TEMPLATES):
        S.conformed(table(spark, sf, name), name).write.parquet(f"{tmp_path}/{name}.parquet")
    history = S.read_history(spark, f"{tmp_path}/audit_detail.parquet")
    assert history.columns == [c.split()[0] for c in S.SCHEMAS["audit_detail"].split(", ")] and history.count() == table(spark, sf, "audit_detail").count()
    group = S.read_group(spark, S.TEMPLATES, str(tmp_path))
    assert set(group) == set(S.TEMPLATES) and all(group[n].count() == table(spark, sf, n).count() for n in group)


def test_filters_meet_without_products(spark):
    """Counts by combination of filters are those of the pairs, and no product is planned."""
    from procaudit.operators import history as H

    rows = [(i % 7, str(i % 3) if i % 5 else None, i % 4) for i in range(60)]
    history = spark.createDataFrame(rows, "id_agenda long, id_empresa string, id_seguro long")
    asked = [(0, "1", 2), (1, "", 0), (2, None, 3), (3, "2", None), (99, "", None), (5, "9", 9)]
    requests = spark.createDataFrame(asked, "r_id long, r_empresa string, r_seguro long")
    counted = H.filter_counts(requests, history)
    expected = set()
    for r, e, s in asked:
        mine = [v for v, he, hs in rows if v != r and (not e or he == e) and (not s or hs == s)]
        if mine:
            expected.add((r, len(mine), len(set(mine))))
    assert {tuple(x) for x in counted.collect()} == expected
    plan = counted._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    pairs = H.optional_filters(requests, history).groupBy("r_id").count().collect()
    assert {tuple(x) for x in pairs} == {(r, n) for r, n, _ in expected}


def test_products_are_those_of_dense_rows():
    import numpy as np

    rng = np.random.default_rng(3)

    def rows(n):
        idx = [sorted(rng.choice(300, k, replace=False).tolist()) for k in rng.integers(0, 40, n)]
        return L._Rows(idx, [rng.random(len(i)).tolist() for i in idx], 300), idx

    def full(r):
        row, col, x = r.forward
        out = np.zeros((r.n, r.width))
        out[row, col] = x
        return out

    (a, _), (b, _) = rows(40), rows(25)
    assert np.allclose(L.products(a, b), full(a) @ full(b).T, rtol=1e-5)


def test_grid_of_a_bounded_fit_and_of_held_blocks(spark, monkeypatch):
    """One fitted text leaves the other codes at 0; held texts in several blocks score as in one."""
    rows = [(f"{i}:{r}", f"word{'abc'[i] * 4} n{r}", [f"c{i}"], "test" if r < 3 else "train") for i in range(3) for r in range(8)]
    data = spark.createDataFrame(rows, "id string, text string, codigos array<string>, part string")
    one, *_ = L.grid_scores(data, (1.0,), 0.0)
    monkeypatch.setattr(L, "HELD_TEXTS", 2)
    many, *_ = L.grid_scores(data, (1.0,), 0.0)
    key = lambda df: sorted((r["text_id"], r["codigo"], round(r["prob"], 4)) for r in df.collect())
    assert key(one) == key(many) and one.count() == 27
    few, *_ = L.grid_scores(data, (1.0,), 0.0, fit_texts=1)
    assert few.where("prob > 0.5").select("codigo").distinct().count() == 1


def test_predict_batch_by_fitted_models(spark):
    """Fees by a model of text and code, by a table, or fixed; notes only where there are codes and something given."""
    train = spark.createDataFrame([(f"CODIGO_{c} estudio {i % 5}", v) for i in range(20) for c, v in (("10", "100"), ("20", "50"))], "text string, v string")
    fee = L.value_model_fit(train, "v", c=100.0)
    requests = spark.createDataFrame([(1, "estudio 3"), (2, " "), (3, "estudio 1"), (4, None)], "id int, text string")
    selected = spark.createDataFrame([(1, "20", 0.9), (1, "10", 0.8), (4, "20", 0.7)], "id int, codigo string, score double")
    matches = spark.createDataFrame([(1, "p7", 0.5, 1), (3, "p8", 0.1, 1)], "q_id int, id string, score double, place int")
    times = spark.createDataFrame([("10", "1.5")], "codigo_norm string, value string")
    got = {r["id"]: r.asDict() for r in L.predict_batch(requests, selected, matches, fee, times, "Nota.").collect()}
    assert len(got) == 4 and got[1]["codigos"] == "20,10" and got[1]["honorario"] == "20(50),10(100)" and got[1]["tiempo_anestesia"] == "1.5"
    assert got[1]["plantillas"] == "p7" and got[1]["observacion"].startswith("Nota; plantillas") and "; honorarios" in got[1]["observacion"] and got[1]["observacion"].endswith("; tiempos de anestesia sugeridos por modelo historico.")
    assert got[2]["status"] == "no_text" and got[3]["status"] == "no_codes" and got[2]["observacion"] == got[3]["observacion"] == "Nota." and got[3]["honorario"] == ""
    assert got[4]["honorario"] == "20(50)" and got[4]["tiempo_anestesia"] == "0"
    bare = {r["id"]: r.asDict() for r in L.predict_batch(requests, selected, matches, None, None, "Nota.").collect()}
    assert bare[1]["honorario"] == "20(100),10(100)" and bare[4]["observacion"] == "Nota."


def test_predict_from_history(spark):
    m = spark.createDataFrame([(1, "ok", ["9", "8"], "9(50),8(100)", "2"), (2, "no_history", None, None, None)], "id_agenda int, status string, codigos array<string>, honorario string, tiempo_anestesia string")
    got = sorted(map(tuple, L.predict_from_history(m).collect()))
    assert got == [(1, "ok", "9,8", "9(50),8(100)", "2", "", "Propuesta generada por IA; validar antes de guardar."), (2, "no_history", "", "", "", "", "")]
