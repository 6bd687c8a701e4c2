"""Queries of splits, metrics and label sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from procaudit.functions import values as V
from procaudit.operators import evaluation as E
from procaudit.operators import history as H
from procaudit.plans import registry as R
from procaudit.plans.registry import query
from procaudit.plans.relational import FEES, TIMES, _majority
from procaudit.sources.fixtures import table

#: What stands for the true codes of the score table: those of probability 0.45 to 0.85, by a rule on id and code.
TRUTH = "truth AS (SELECT id_agenda AS id, codigo FROM code_scores WHERE prob >= 0.45 AND prob < 0.85)"


def scores(spark, sf_dir):
    return table(spark, sf_dir, "code_scores").withColumnRenamed("id_agenda", "id")


def truth(spark, sf_dir):
    return scores(spark, sf_dir).where("prob >= 0.45 AND prob < 0.85").select("id", "codigo")


def metrics_sql(pairs: str, ids: str, by: str = "") -> str:
    """The 11 figures; ``pairs`` has (by, id, codigo, a, p), ``ids`` (by, id)."""
    b = f"{by}, " if by else ""
    using = f"({b}id)"
    div = lambda x, y: f"CASE WHEN {y} = 0 THEN 0.0 ELSE ({x}) * 1.0 / ({y}) END"
    p, r = div("sum(tp)", "sum(pred)"), div("sum(tp)", "sum(act)")
    dice = f"avg({div('2 * tp', '(pred + act)')})"
    return f"""SELECT {b}round(avg(CASE WHEN tp = pred AND tp = act THEN 1.0 ELSE 0.0 END), 4) AS exact_code_group_accuracy, round({p}, 4) AS precision_micro, round({r}, 4) AS recall_micro,
 round(CASE WHEN sum(tp) = 0 THEN 0.0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END, 4) AS f1_micro, round(avg({div('tp', 'pred')}), 4) AS precision_samples, round(avg({div('tp', 'act')}), 4) AS recall_samples,
 round({dice}, 4) AS f1_samples, round({dice}, 4) AS avg_dice, round(avg({div('tp', '(pred + act - tp)')}), 4) AS avg_code_overlap, round(avg(pred), 4) AS avg_predicted_codes, round(avg(act), 4) AS avg_actual_codes
 FROM (SELECT {b}i.id, CAST(coalesce(sum(a * p), 0) AS DOUBLE) AS tp, CAST(coalesce(sum(p), 0) AS DOUBLE) AS pred, CAST(coalesce(sum(a), 0) AS DOUBLE) AS act FROM {ids} i LEFT JOIN {pairs} USING {using} GROUP BY {b}i.id) {f'GROUP BY {by}' if by else ''}"""


PICKED = """grid AS (SELECT unnest([0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS threshold),
 ranked AS (SELECT threshold, id_agenda AS id, codigo, prob, row_number() OVER (PARTITION BY threshold, id_agenda ORDER BY prob DESC, codigo) AS place, sum(CASE WHEN prob >= threshold THEN 1 ELSE 0 END) OVER (PARTITION BY threshold, id_agenda) AS hits FROM code_scores, grid),
 picked AS (SELECT threshold, id, codigo FROM ranked WHERE prob >= threshold OR (hits < 1 AND place <= 1))"""
SWEEP = f"""{TRUTH}, {PICKED}, pr AS (SELECT coalesce(g.threshold, k.threshold) AS threshold, coalesce(g.id, k.id) AS id, coalesce(g.codigo, k.codigo) AS codigo, CASE WHEN g.id IS NULL THEN 0 ELSE 1 END AS a, CASE WHEN k.id IS NULL THEN 0 ELSE 1 END AS p
 FROM (SELECT * FROM truth, grid) g FULL JOIN picked k ON k.threshold = g.threshold AND k.id = g.id AND k.codigo = g.codigo),
 ids AS (SELECT DISTINCT id_agenda AS id, threshold FROM code_scores, grid)"""


def at(spark, sf_dir, threshold=0.4, min_labels=1):
    return E.min_labels_topup(scores(spark, sf_dir), F.lit(threshold), min_labels).where("selected").select("id", "codigo")


@query(f"""WITH r AS (SELECT id_agenda AS id, codigo, prob, row_number() OVER (PARTITION BY id_agenda ORDER BY prob DESC, codigo) AS place, sum(CASE WHEN prob >= 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY id_agenda) AS hits FROM code_scores)
 SELECT id, codigo FROM r WHERE prob >= 0.9 OR (hits < 2 AND place <= 2)""", "code_scores")  # fmt: skip
def min_labels_topup(spark, sf_dir):
    return at(spark, sf_dir, 0.9, 2)


@query("""WITH r AS (SELECT id_agenda AS id, codigo, prob, row_number() OVER (PARTITION BY id_agenda ORDER BY prob DESC, codigo) AS place, sum(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY id_agenda) AS hits FROM code_scores)
 SELECT id, CAST(place AS INT) AS place, codigo, round(prob, 4) AS score, prob >= 0.5 OR (hits < 1 AND place <= 1) AS selected FROM r WHERE place <= 15""", "code_scores")  # fmt: skip
def code_ranking(spark, sf_dir):
    return E.code_ranking(scores(spark, sf_dir), 0.5)


@query(f"WITH {TRUTH}, {PICKED}, k AS (SELECT id, codigo FROM picked WHERE threshold = 0.4) SELECT coalesce(t.id, k.id) AS id, coalesce(t.codigo, k.codigo) AS codigo, CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS is_actual, CASE WHEN k.id IS NULL THEN 0 ELSE 1 END AS is_predicted FROM truth t FULL JOIN k ON k.id = t.id AND k.codigo = t.codigo", "code_scores")
def actual_vs_predicted(spark, sf_dir):
    return E.actual_vs_predicted(truth(spark, sf_dir), at(spark, sf_dir), E.label_universe(scores(spark, sf_dir)))


@query("SELECT codigo, CAST(row_number() OVER (ORDER BY codigo) - 1 AS INT) AS idx FROM (SELECT DISTINCT codigo FROM code_scores)", "code_scores")
def label_universe(spark, sf_dir):
    return E.label_universe(scores(spark, sf_dir))


@query(f"WITH {TRUTH}, u AS (SELECT codigo, CAST(row_number() OVER (ORDER BY codigo) - 1 AS INT) AS idx FROM (SELECT DISTINCT codigo FROM code_scores)) SELECT id, codigo, idx FROM truth JOIN u USING (codigo)", "code_scores")
def binarize_labels(spark, sf_dir):
    return E.binarize_labels(truth(spark, sf_dir), E.label_universe(scores(spark, sf_dir)))


@query(f"WITH {SWEEP}, one AS (SELECT id, codigo, a, p FROM pr WHERE threshold = 0.4), oneid AS (SELECT id FROM ids WHERE threshold = 0.4) {metrics_sql('one', 'oneid')}", "code_scores")
def multilabel_metrics(spark, sf_dir):
    pairs = E.actual_vs_predicted(truth(spark, sf_dir), at(spark, sf_dir))
    return E.multilabel_metrics(pairs, scores(spark, sf_dir).select("id").distinct())


@query(f"WITH {SWEEP} {metrics_sql('pr', 'ids', 'threshold')}", "code_scores")
def threshold_sweep(spark, sf_dir):
    return E.threshold_sweep(scores(spark, sf_dir), truth(spark, sf_dir))


@query(f"WITH {SWEEP}, m AS ({metrics_sql('pr', 'ids', 'threshold')}) SELECT * FROM m ORDER BY avg_dice DESC, f1_micro DESC, avg_dice DESC, threshold LIMIT 1", "code_scores")
def select_best(spark, sf_dir):
    return E.select_best(E.threshold_sweep(scores(spark, sf_dir), truth(spark, sf_dir)), "avg_dice", "threshold")


@query(f"""WITH {TRUTH}, {PICKED}, t AS (SELECT id, list(codigo) AS a FROM truth GROUP BY id), k AS (SELECT id, list(codigo) AS p FROM picked WHERE threshold = 0.4 GROUP BY id)
 SELECT id, round(len(list_intersect(a, p)) * 1.0 / len(list_distinct(a || p)), 4) AS overlap FROM t JOIN k USING (id)""", "code_scores")  # fmt: skip
def code_set_overlap(spark, sf_dir):
    return listed(spark, sf_dir).select("id", F.round(E.code_set_overlap(F.col("actual"), F.col("predicted")), 4).alias("overlap"))


def listed(spark, sf_dir):
    a = truth(spark, sf_dir).groupBy("id").agg(F.collect_set("codigo").alias("actual"))
    return a.join(at(spark, sf_dir).groupBy("id").agg(F.collect_set("codigo").alias("predicted")), "id")


@query(f"""WITH {TRUTH}, {PICKED}, k AS (SELECT id, codigo FROM picked WHERE threshold = 0.4), b AS (SELECT id FROM truth INTERSECT SELECT id FROM k)
 SELECT id, 'missing' AS kind, codigo FROM truth t WHERE id IN (FROM b) AND NOT EXISTS (SELECT 1 FROM k WHERE k.id = t.id AND k.codigo = t.codigo)
 UNION ALL SELECT id, 'extra', codigo FROM k WHERE id IN (FROM b) AND NOT EXISTS (SELECT 1 FROM truth t WHERE k.id = t.id AND k.codigo = t.codigo)""", "code_scores")  # fmt: skip
def code_set_diff(spark, sf_dir):
    missing, extra = E.code_set_diff(F.col("actual"), F.col("predicted"))
    both = listed(spark, sf_dir).select("id", missing.alias("missing"), extra.alias("extra"))
    return both.select("id", F.lit("missing").alias("kind"), F.explode("missing").alias("codigo")).union(both.select("id", F.lit("extra"), F.explode("extra")))


@query(f"""WITH {TRUTH}, {PICKED}, t AS (SELECT id, list_sort(list(codigo)) AS a FROM truth GROUP BY id), k AS (SELECT id, list_sort(list(codigo)) AS p FROM picked WHERE threshold = 0.4 GROUP BY id)
 SELECT id AS idx, array_to_string(list_filter(a, lambda x: NOT list_contains(p, x)), ',') AS missing, array_to_string(list_filter(p, lambda x: NOT list_contains(a, x)), ',') AS extra FROM t JOIN k USING (id) WHERE a <> p ORDER BY id LIMIT 10""", "code_scores")  # fmt: skip
def error_sample(spark, sf_dir):
    out = E.error_sample(listed(spark, sf_dir).withColumnRenamed("id", "idx"))
    return out.select("idx", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


SPLIT = """h AS (SELECT id_agenda, md5(concat(CAST(id_agenda AS VARCHAR), ':42')) AS h FROM historiaclinica), r AS (SELECT *, row_number() OVER (ORDER BY h) AS r, count(*) OVER () AS n FROM h),
 s AS (SELECT id_agenda, CASE WHEN r <= ceil(round(ceil(round(0.3 * n, 6)) * 0.5, 6)) THEN 'test' WHEN r <= ceil(round(0.3 * n, 6)) THEN 'validation' ELSE 'train' END AS part FROM r)"""


def split(spark, sf_dir):
    return E.split_rows(table(spark, sf_dir, "historiaclinica").select("id_agenda"), F.col("id_agenda"))


@query(f"WITH {SPLIT} SELECT * FROM s", "historiaclinica")
def split_rows(spark, sf_dir):
    return split(spark, sf_dir)


@query(f"WITH {SPLIT} SELECT count(*) FILTER (part = 'train') AS train_size, count(*) FILTER (part = 'validation') AS validation_size, count(*) FILTER (part = 'test') AS test_size, round(count(*) FILTER (part = 'train') / count(*), 4) AS train_fraction, round(count(*) FILTER (part = 'validation') / count(*), 4) AS validation_fraction, round(count(*) FILTER (part = 'test') / count(*), 4) AS test_fraction FROM s", "historiaclinica")
def split_summary(spark, sf_dir):
    return E.split_summary(split(spark, sf_dir))


CLASSED = f"{TIMES}, m AS ({_majority('times', 'tiempo_norm')}), yy AS (SELECT t.tiempo_norm AS y_true, m.value AS y_pred FROM times t JOIN m USING (codigo_norm))"


def classed(spark, sf_dir):
    rows = H.time_training_set(table(spark, sf_dir, "audit_detail"))
    return rows.join(H.majority_by_code(rows, "tiempo_norm"), "codigo_norm").select(F.col("tiempo_norm").alias("y_true"), F.col("value").alias("y_pred"))


@query(f"""WITH {CLASSED}, c AS (SELECT clase, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(pred) AS DOUBLE) AS pred, sum(support) AS support FROM (SELECT y_true AS clase, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS tp, 0 AS pred, 1 AS support FROM yy UNION ALL SELECT y_pred, 0, 1, 0 FROM yy) GROUP BY clase),
 per AS (SELECT clase, CASE WHEN pred = 0 THEN 0 ELSE tp / pred END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, CASE WHEN pred + support = 0 THEN 0 ELSE 2 * tp / (pred + support) END AS f1, CAST(support AS BIGINT) AS support, tp FROM c)
 SELECT clase, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM per
 UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT) FROM per
 UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM per
 UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 4), round(sum(tp) / sum(support), 4), round(sum(tp) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM per""", "audit_detail")  # fmt: skip
def class_report(spark, sf_dir):
    return E.class_report(classed(spark, sf_dir))


@query(f"WITH {CLASSED}, c AS (SELECT y_true AS c FROM yy UNION SELECT y_pred FROM yy) SELECT a.c AS y_true, b.c AS y_pred, (SELECT count(*) FROM yy WHERE y_true = a.c AND y_pred = b.c) AS n FROM c a, c b", "audit_detail")
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(classed(spark, sf_dir))


@query(f"WITH {CLASSED} SELECT round(avg(abs(CAST(y_true AS DOUBLE) - CAST(y_pred AS DOUBLE))), 4) AS mae_hours FROM yy", "audit_detail")
def mae_hours(spark, sf_dir):
    return E.mae_hours(classed(spark, sf_dir))


@query("""SELECT id, max_by(codigo, struct_pack(p := round(prob, 2), i := -CAST(codigo AS INT))) AS clase FROM (SELECT id_agenda AS id, codigo, prob FROM code_scores) GROUP BY id""", "code_scores")
def argmax_decode(spark, sf_dir):
    from procaudit.operators.tfidf import argmax_decode as decode

    return decode(scores(spark, sf_dir).select("id", F.col("codigo").alias("clase"), F.round("prob", 2).alias("logit"), F.col("codigo").cast("int").alias("idx")))


PREDICTED = f"{FEES}, {TIMES}, fm AS ({_majority('fees', 'porcentaje_norm')}), tm AS ({_majority('times', 'tiempo_norm')}), {PICKED}, rk AS (SELECT k.id, k.codigo, row_number() OVER (PARTITION BY k.id ORDER BY round(prob, 4) DESC, k.codigo) AS place FROM picked k JOIN code_scores c ON c.id_agenda = k.id AND c.codigo = k.codigo WHERE threshold = 0.5)"


def placed(spark, sf_dir):
    from procaudit.operators.models import multilabel_predict, ordered_codes

    return ordered_codes(multilabel_predict(scores(spark, sf_dir), 0.5)).withColumn("codigo_norm", V.normalize_code(F.col("codigo")))


@query(f"WITH {PICKED} SELECT k.id, k.codigo, round(prob, 4) AS score FROM picked k JOIN code_scores c ON c.id_agenda = k.id AND c.codigo = k.codigo WHERE threshold = 0.5", "code_scores")
def multilabel_predict(spark, sf_dir):
    return placed(spark, sf_dir).select("id", "codigo", "score")


@query(f"WITH {PREDICTED} SELECT id, string_agg(codigo || '(' || coalesce(fm.value, '100') || ')', ',' ORDER BY place) AS honorario FROM rk LEFT JOIN fm ON fm.codigo_norm = rk.codigo GROUP BY id", "audit_detail", "code_scores")
def apply_fees(spark, sf_dir):
    from procaudit.operators.models import apply_values, fees_per_request

    by_code = H.majority_by_code(H.fee_training_set(table(spark, sf_dir, "audit_detail")), "porcentaje_norm")
    return fees_per_request(apply_values(placed(spark, sf_dir), by_code, None, "100"), scores(spark, sf_dir).select("id").distinct()).select("id", "honorario")


@query(f"WITH {PREDICTED}, v AS (SELECT id, max(CAST(coalesce(tm.value, '0') AS DOUBLE)) AS m FROM rk LEFT JOIN tm ON tm.codigo_norm = rk.codigo GROUP BY id) SELECT id, {R.two_places('m')} AS tiempo_anestesia FROM v", "audit_detail", "code_scores")
def apply_times(spark, sf_dir):
    from procaudit.operators.models import apply_values, times_per_request

    by_code = H.majority_by_code(H.time_training_set(table(spark, sf_dir, "audit_detail")), "tiempo_norm")
    return times_per_request(apply_values(placed(spark, sf_dir), by_code, None, "0"), scores(spark, sf_dir).select("id").distinct())
