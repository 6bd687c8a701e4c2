"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Features: densities of a lexicon learned from the training labels (words and word beginnings, strong and weak),
hits near second-person words, capitals, punctuation and obfuscation rates. The trees and the calibration are
Spark ML models; texts are read once for scoring, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procaudit.llm.common import crc_bucket
from procaudit.llm.tokens import BYTE_CLASS, CAPITAL, DIGIT, OTHER, SIGN, SMALL, counted, pieces, split_words, sums, word_bytes

#: Documented bounds of the labelled samples that the lexicon and the trees are fitted on, chosen by hash of the id.
LEXICON_DOCUMENTS, TREE_DOCUMENTS = 12_000, 30_000
LEXICON_UNITS = 400
PREFIXES = (4, 5, 6, 7)
HELD_OUT = 5
CALIBRATION_BINS = 500
NEAR = 5
#: Second-person words of the four languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro".split())
#: Signs written in place of letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
N_FEATURES = 13


def units_of(word: str) -> tuple[str, ...]:
    """A word as it counts for the lexicon: itself, and its beginnings."""
    w = "".join(c for c in word.lower() if c.isalpha())
    if not w:
        return ()
    return (w, *(f"{w[:n]}*" for n in PREFIXES if len(w) > n))


def _lexicon_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, toxic, clean): documents of a batch that hold each unit."""
    for batch in pieces(batches, 0):
        offsets, codes, words = split_words(batch.column(0))
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        index: dict[str, int] = {}
        lists = [[index.setdefault(u, len(index)) for u in units_of(w)] for w in words.to_pylist()]
        lengths = np.array([len(x) for x in lists], np.int64)
        flat = np.array([u for x in lists for u in x], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.zeros((2, len(index)), np.int64)
        for i, label in enumerate(toxic):
            mine = np.unique(codes[offsets[i] : offsets[i + 1]])
            if len(mine):
                counts[label][np.unique(np.concatenate([flat[starts[c] : starts[c + 1]] for c in mine]))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(index), pa.string()), pa.array(counts[1], pa.int64()), pa.array(counts[0], pa.int64())], names=["unit", "toxic", "clean"])


def learn_lexicon(labelled: DataFrame, units: int = LEXICON_UNITS) -> dict[str, int]:
    """unit -> 2 (strong) or 1 (weak), from (text, toxic) rows: the units whose share of toxic documents exceeds
    their share of clean ones most surely; at most ``units`` of them."""
    n = labelled.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.when(F.col("toxic") == 0, 1)).alias("c")).first()
    if not n["t"] or not n["c"]:
        return {}
    counts = labelled.mapInArrow(_lexicon_counts, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    ratio = ((F.col("t") + 0.5) / (n["t"] + 1.0)) / ((F.col("c") + 0.5) / (n["c"] + 1.0))
    sure = F.log(ratio) / F.sqrt(1.0 / (F.col("t") + 0.5) + 1.0 / (F.col("c") + 0.5))
    found = counts.where(F.col("t") >= 3).select("unit", ratio.alias("ratio"), sure.alias("sure")).where((F.col("ratio") >= 4) & (F.col("sure") >= 3))
    best = found.orderBy(F.desc("sure"), "unit").limit(units).collect()
    return {r["unit"]: 2 if r["ratio"] >= 25 else 1 for r in best}


NOT_LETTERS = r"[^\p{L}]+"
ALNUM = np.isin(BYTE_CLASS, (CAPITAL, SMALL, DIGIT, OTHER))


def describe(words: pa.Array, lexicon: dict[str, int]) -> np.ndarray:
    """Rows of distinct words: strong, weak, hidden lexicon hit, obfuscated, second person, capitals, all capitals,
    signs, exclamation and question marks, bytes, digits."""
    data, at = word_bytes(words)
    kinds = BYTE_CLASS[data]
    count = {k: counted(kinds == k, at) for k in (CAPITAL, SMALL, DIGIT, SIGN, OTHER)}
    letters = pc.replace_substring_regex(pc.utf8_lower(words), NOT_LETTERS, "")
    length = pc.utf8_length(letters).to_numpy()

    def among(of: pa.Array, units: list[str]) -> np.ndarray:
        return pc.is_in(of, value_set=pa.array(units, of.type)).to_numpy(zero_copy_only=False)

    tiers = []
    for tier in (2, 1):
        hit = among(letters, [u for u in lexicon if lexicon[u] == tier and not u.endswith("*")])
        for n in PREFIXES:
            hit |= (length > n) & among(pc.utf8_slice_codeunits(letters, 0, n), [u[:-1] for u in lexicon if lexicon[u] == tier and u.endswith("*") and len(u) == n + 1])
        tiers.append(hit)
    core = pc.utf8_trim(words, characters=".,;:!?\"'()[]")
    odd = ~pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False) & (length > 0) & (pc.utf8_length(core).to_numpy() > 0)
    hidden = np.zeros(len(words), bool)
    for i in np.flatnonzero(odd & ~tiers[0]):
        plain = core[i].as_py().translate(LEET)
        odd[i] = plain.isalpha()
        hidden[i] = odd[i] and max((lexicon.get(u, 0) for u in units_of(plain)), default=0) == 2
    marks = counted((data == 33) | (data == 63), at)
    capital = (count[CAPITAL] > 1) & (count[SMALL] + count[OTHER] == 0)
    rows = [tiers[0], tiers[1] & ~tiers[0], hidden, odd, among(letters, sorted(SECOND_PERSON)), count[CAPITAL], capital, counted(~ALNUM[data], at), marks, np.diff(at), count[DIGIT]]
    return np.stack(rows, axis=1).astype(np.float64)


def features(texts: pa.Array, lexicon: dict[str, int]) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers a text; all zeros for a text without words."""
    offsets, codes, words = split_words(texts)
    about = describe(words, lexicon) if len(words) else np.zeros((0, 11))
    n = np.maximum(np.diff(offsets), 1).astype(np.float64)
    total = np.stack([sums(about[codes, j], offsets) for j in range(11)], axis=1) if len(words) else np.zeros((len(texts), 11))
    chars = np.maximum(total[:, 9], 1)
    near = np.zeros(len(texts))
    hits = np.flatnonzero(about[codes, 0] + about[codes, 2] > 0) if len(words) else []
    if len(hits):
        person = np.concatenate([[0], np.cumsum(about[codes, 4])])
        owner = np.searchsorted(offsets, hits, "right") - 1
        low, high = np.maximum(hits - NEAR, offsets[owner]), np.minimum(hits + NEAR + 1, offsets[owner + 1])
        near = np.bincount(owner, person[high] - person[low] > 0, len(texts))
    strong, weak, hidden = total[:, 0], total[:, 1], total[:, 2]
    return np.stack([strong / n, np.log1p(strong), weak / n, np.log1p(weak), hidden / n, near, total[:, 3] / n, total[:, 5] / chars, total[:, 6] / n, total[:, 7] / chars, total[:, 8] / chars, total[:, 10] / chars, np.log1p(np.diff(offsets))], axis=1)


def _extractor(lexicon: dict[str, int]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = features(batch.column(batch.num_columns - 1), lexicon)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * N_FEATURES, pa.int32()), pa.array(rows.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "f"])

    return extract


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", lexicon_documents: int = LEXICON_DOCUMENTS, tree_documents: int = TREE_DOCUMENTS, trees: int = 20, depth: int = 4) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Labels of ids with ``crc32(id as text) mod 5 = 0`` are never learned from; those with remainder 4 calibrate,
    the others make the lexicon and the trees. Both samples are bounded by parameters and chosen by hash of the id.
    The score is the isotonic calibration of the trees' probability.
    Defined cases: null and empty texts are scored like any text, all their features 0; very long texts are scored
    whole, in a piece of their own; equal features give equal scores; rows without a label are
    only scored; several labels of an id count as their largest; null labels and ids are not learned from; without
    labels of both classes every score is the toxic share of the labels, 0.0 if there are none; repeated rows are
    scored each; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    bucket = crc_bucket(F.col("_id"), HELD_OUT)
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull()).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(bucket != 0)
    count = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, toxic = count["n"], count["t"]
    held = (bucket == 0).alias("held_out")

    def constant() -> DataFrame:
        base = F.lit(toxic / n if n else 0.0)
        return rows.select(F.col("_id").alias(doc_id), held, base.alias("score"), (base >= 0.5).cast("int").alias("predicted"))

    if not 0 < toxic < n:
        return constant()

    def sampled(df: DataFrame, bound: int) -> DataFrame:
        return df if n <= bound else df.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1e6 * bound / n))

    learned = rows.join(F.broadcast(sampled(known, tree_documents)), "_id")  # about tree_documents ids: the texts stay where they are
    lexicon = learn_lexicon(sampled(learned.where(bucket != 4), lexicon_documents).select("_text", "toxic"))
    extract = _extractor(lexicon)
    vectors = learned.select("_id", "toxic", "_text").mapInArrow(extract, "_id long, toxic int, f array<double>").select("_id", F.col("toxic").cast("double").alias("toxic"), array_to_vector("f").alias("features")).persist()
    if len(vectors.where(bucket != 4).select("toxic").distinct().collect()) < 2:  # at most two rows
        return constant()
    model = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=64, seed=7).fit(vectors.where(bucket != 4))
    raw = vector_to_array("probability")[1]
    bins = model.transform(vectors.where(bucket == 4)).select(F.round(raw * CALIBRATION_BINS).alias("b"), "toxic").groupBy("b").agg(F.avg("toxic").alias("label"), F.count("*").cast("double").alias("weight"))
    bins = bins.select((F.col("b") / CALIBRATION_BINS).alias("raw"), "label", "weight")
    calibrated = None
    if not bins.isEmpty():
        calibrated = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="score").fit(bins.coalesce(1))
    vectors.unpersist()
    scored = rows.mapInArrow(extract, "_id long, f array<double>").select("_id", array_to_vector("f").alias("features"))
    scored = model.transform(scored).select("_id", raw.alias("raw"))
    scored = calibrated.transform(scored) if calibrated else scored.withColumn("score", F.col("raw"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select(F.col("_id").alias(doc_id), held, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
