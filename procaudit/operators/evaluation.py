"""Reproducible splits, and multi-label and per-class metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = (0.2, 0.3, 0.4, 0.5)
METRICS = ("exact_code_group_accuracy", "precision_micro", "recall_micro", "f1_micro", "precision_samples", "recall_samples", "f1_samples", "avg_dice", "avg_code_overlap", "avg_predicted_codes", "avg_actual_codes")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def split_rows(rows: DataFrame, key: Column, validation: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """``rows`` with ``part`` of exact sizes: holdout ceil((v + t) n), of it ceil(holdout t / (v + t)) test rows.

    Rows are ranked by md5 of key and seed: within buckets of its first two hex digits, then shifted by the sizes
    of the buckets before, so no task sorts all rows. Keys are to be distinct.
    """
    if validation <= 0 or test <= 0 or validation + test >= 1:
        raise ValueError("validation and test sizes must be positive and below 1 together")
    hashed = rows.withColumn("_h", F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))).withColumn("_b", F.substring("_h", 1, 2))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 256 rows
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h"))).join(F.broadcast(offsets), "_b").withColumn("_r", F.col("_r") + F.col("_before"))
    hold = F.ceil(F.round((validation + test) * F.col("_total"), 6))
    tests = F.ceil(F.round(hold * (test / (validation + test)), 6))
    part = F.when(F.col("_r") <= tests, "test").when(F.col("_r") <= hold, "validation").otherwise("train")
    return ranked.withColumn("part", part).drop("_h", "_b", "_r", "_before", "_total")


def split_rows_fast(rows: DataFrame, key: Column, validation: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """``rows`` with ``part`` by thresholds on the hash: no shuffle, sizes only nearly exact."""
    share = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("part", F.when(share < test, "test").when(share < test + validation, "validation").otherwise("train"))


def split_summary(parts: DataFrame) -> DataFrame:
    n = F.count("*")
    sizes = [F.count_if(F.col("part") == p).alias(f"{p}_size") for p in ("train", "validation", "test")]
    return parts.agg(*sizes, n.alias("n")).select("train_size", "validation_size", "test_size", *[F.round(F.col(f"{p}_size") / F.col("n"), 4).alias(f"{p}_fraction") for p in ("train", "validation", "test")])


def label_universe(labels: DataFrame, code: str = "codigo") -> DataFrame:
    """(codigo, idx): the distinct codes in order. They number thousands at most, one list."""
    codes = labels.select(code).distinct().agg(F.array_sort(F.collect_list(code)).alias("codes"))
    return codes.select(F.posexplode("codes").alias("idx", code)).select(code, "idx")


def binarize_labels(labels: DataFrame, universe: DataFrame) -> DataFrame:
    return labels.join(universe, "codigo").select("id", "codigo", "idx").distinct()


def actual_vs_predicted(actual: DataFrame, predicted: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """(id, codigo, is_actual, is_predicted); predicted codes outside the universe are dropped first."""
    if universe is not None:
        predicted = predicted.join(universe.select("codigo"), "codigo", "left_semi").select("id", "codigo")
    a = actual.select("id", "codigo").distinct().withColumn("is_actual", F.lit(1))
    p = predicted.select("id", "codigo").distinct().withColumn("is_predicted", F.lit(1))
    return a.join(p, ["id", "codigo"], "full_outer").na.fill(0, ["is_actual", "is_predicted"])


def multilabel_metrics(pairs: DataFrame, ids: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The 11 figures over all of ``ids`` (with the columns ``by``), each to 4 places; x / 0 is 0."""
    keys = [*by, "id"]
    counts = pairs.groupBy(*keys).agg(F.sum(F.col("is_actual") * F.col("is_predicted")).alias("tp"), F.sum("is_predicted").alias("pred"), F.sum("is_actual").alias("act"))
    return counted_figures(ids.select(*keys).join(counts, keys, "left").na.fill(0, ["tp", "pred", "act"]), by)


def counted_figures(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The same from each id's numbers of right, predicted and actual codes (tp, pred, act)."""
    tp, pred, act = F.col("tp"), F.col("pred"), F.col("act")
    p, r = ratio(F.sum(tp), F.sum(pred)), ratio(F.sum(tp), F.sum(act))
    dice = F.avg(ratio(2 * tp, pred + act))
    figures = {
        "exact_code_group_accuracy": F.avg(((tp == pred) & (tp == act)).cast("double")), "precision_micro": p, "recall_micro": r, "f1_micro": ratio(2 * p * r, p + r),
        "precision_samples": F.avg(ratio(tp, pred)), "recall_samples": F.avg(ratio(tp, act)), "f1_samples": dice, "avg_dice": dice,
        "avg_code_overlap": F.avg(ratio(tp, pred + act - tp)), "avg_predicted_codes": F.avg(pred), "avg_actual_codes": F.avg(act),
    }
    return rows.groupBy(*by).agg(*[F.round(v, 4).alias(k) for k, v in figures.items()])


def min_labels_topup(scores: DataFrame, threshold: Column, min_labels: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``scores`` (id, codigo, prob) with ``selected``: prob >= threshold, and where an id has fewer than
    ``min_labels`` of them its best ``min_labels``, ties by code."""
    w = Window.partitionBy(*by, "id")
    hit = (F.col("prob") >= threshold).cast("int")
    out = scores.withColumns({"_hits": F.sum(hit).over(w), "_place": F.row_number().over(w.orderBy(F.desc("prob"), "codigo")), "_hit": hit})
    return out.withColumn("selected", (F.col("_hit") == 1) | ((F.col("_hits") < min_labels) & (F.col("_place") <= min_labels))).drop("_hits", "_place", "_hit")


def code_ranking(scores: DataFrame, threshold: float, min_labels: int = 1, n: int = 15) -> DataFrame:
    """(id, place, codigo, score, selected): the ``n`` most probable codes."""
    w = Window.partitionBy("id").orderBy(F.desc("prob"), "codigo")
    out = min_labels_topup(scores, F.lit(threshold), min_labels).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return out.select("id", "place", "codigo", F.round("prob", 4).alias("score"), "selected")


def threshold_sweep(scores: DataFrame, actual: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, min_labels: int = 1) -> DataFrame:
    """``multilabel_metrics`` at each threshold. Scores that no threshold and no top-up can select go first."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("prob"), "codigo"))
    useful = scores.withColumn("_p", place).where((F.col("prob") >= min(thresholds)) | (F.col("_p") <= min_labels)).drop("_p")
    grid = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    picked = min_labels_topup(useful.select("*", grid), F.col("threshold"), min_labels, ("threshold",)).where("selected").select("threshold", "id", "codigo")
    truth = actual.select("id", "codigo").distinct().select("*", grid).withColumn("is_actual", F.lit(1))
    pairs = truth.join(picked.withColumn("is_predicted", F.lit(1)), ["threshold", "id", "codigo"], "full_outer").na.fill(0, ["is_actual", "is_predicted"])
    ids = scores.select("id").union(actual.select("id")).distinct().select("*", grid)
    return multilabel_metrics(pairs, ids, ("threshold",))


def select_best(results: DataFrame, metric: str, order: str) -> DataFrame:
    """The row of largest (metric, f1_micro, avg_dice), of equal ones the first by ``order``; figures compare as
    rounded. The grid is a handful of rows."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return results.orderBy(F.desc(metric), F.desc("f1_micro"), F.desc("avg_dice"), order).limit(1)


def class_counts(rows: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(clase, tp, pred, support) over the true and predicted classes, or over ``classes``."""
    t = rows.select(F.col("y_true").alias("clase"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("tp"), F.lit(0).alias("pred"), F.lit(1).alias("support"))
    p = rows.select(F.col("y_pred").alias("clase"), F.lit(0).alias("tp"), F.lit(1).alias("pred"), F.lit(0).alias("support"))
    out = t.union(p).groupBy("clase").agg(F.sum("tp").alias("tp"), F.sum("pred").alias("pred"), F.sum("support").alias("support"))
    return out if classes is None else classes.select("clase").join(out, "clase", "left").na.fill(0)


def class_report(rows: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(clase, precision, recall, f1, support) per class, and rows for accuracy, macro and weighted averages."""
    c = class_counts(rows, classes)
    tp, pred, n = F.col("tp"), F.col("pred"), F.col("support")
    per = c.select("clase", ratio(tp, pred).alias("precision"), ratio(tp, n).alias("recall"), ratio(2 * tp, pred + n).alias("f1"), "support", "tp")
    total = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("clase"), *[F.avg(k).alias(k) for k in ("precision", "recall", "f1")], total.alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("clase"), *[ratio(F.sum(F.col(k) * n), total).alias(k) for k in ("precision", "recall", "f1")], total.alias("support"))
    accuracy = per.agg(F.lit("accuracy").alias("clase"), *[ratio(F.sum("tp"), total).alias(k) for k in ("precision", "recall", "f1")], total.alias("support"))
    out = per.drop("tp").union(macro).union(weighted).union(accuracy)
    return out.select("clase", *[F.round(k, 4).alias(k) for k in ("precision", "recall", "f1")], "support")


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """(y_true, y_pred, n) for every pair of the classes that occur, 0 where none; classes are a handful."""
    classes = rows.select(F.col("y_true").alias("c")).union(rows.select("y_pred")).distinct()
    grid = classes.select(F.col("c").alias("y_true")).crossJoin(F.broadcast(classes.select(F.col("c").alias("y_pred"))))
    return grid.join(rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n")), ["y_true", "y_pred"], "left").na.fill(0, ["n"])


def mae_hours(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.avg(F.abs(F.col("y_true").cast("double") - F.col("y_pred").cast("double"))), 4).alias("mae_hours"))


def nn_metrics(rows: DataFrame, least: int = 20) -> DataFrame:
    """Ordered exact match, mean overlap, mean and least similarity of (actual, predicted, score) with code lists;
    all null under ``least`` rows."""
    union = F.size(F.array_union("actual", "predicted"))
    shared = ratio(F.size(F.array_intersect("actual", "predicted")), union)
    enough = F.count("*") >= least
    figures = {"exact_code_group_accuracy": F.avg((F.col("actual") == F.col("predicted")).cast("double")), "avg_code_overlap": F.avg(shared), "avg_similarity": F.avg("score"), "min_similarity": F.min("score")}
    return rows.agg(F.count("*").alias("size"), *[F.when(enough, F.round(v, 4)).alias(k) for k, v in figures.items()])


def code_set_overlap(actual: Column, predicted: Column) -> Column:
    return ratio(F.size(F.array_intersect(actual, predicted)), F.size(F.array_union(actual, predicted)))


def code_set_diff(actual: Column, predicted: Column) -> tuple[Column, Column]:
    """(missing, extra), sorted."""
    return F.array_sort(F.array_except(actual, predicted)), F.array_sort(F.array_except(predicted, actual))


def template_coverage(cases: DataFrame, accepted: DataFrame) -> DataFrame:
    """Cases with a match, their share, and matches a case."""
    per = cases.select("q_id").join(accepted.groupBy("q_id").agg(F.count("*").alias("m")), "q_id", "left").na.fill(0, ["m"])
    return per.agg(F.count_if(F.col("m") > 0).alias("cases_with_template_match"), F.round(F.avg((F.col("m") > 0).cast("double")), 4).alias("coverage"), F.round(F.avg("m"), 4).alias("avg_templates_per_case"))


def compare_systems(actual: DataFrame, systems: dict[str, DataFrame], ids: DataFrame, universe: DataFrame) -> DataFrame:
    parts = [multilabel_metrics(actual_vs_predicted(actual, p, universe).withColumn("system", F.lit(n)), ids.select("id", F.lit(n).alias("system")), ("system",)) for n, p in systems.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def error_sample(rows: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows (idx, actual, predicted) whose code sets differ, with what is missing and extra."""
    missing, extra = code_set_diff(F.col("actual"), F.col("predicted"))
    wrong = rows.select("idx", "actual", "predicted", missing.alias("missing"), extra.alias("extra")).where((F.size("missing") > 0) | (F.size("extra") > 0))
    return wrong.orderBy("idx").limit(n)
