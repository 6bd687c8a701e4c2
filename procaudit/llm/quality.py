"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every whole text. Expectation-maximisation over the counts of all
vote patterns (a table bounded by the number of patterns, whatever the corpus) estimates each labeller's rates and
each pattern's posterior. The posteriors label a bounded sample on which a linear scorer over hashed word shapes is
fitted; that scorer judges every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procaudit.llm.tokens import BYTE_CLASS, CAPITAL, DIGIT, counted, mixed, pieces, shape_hashes, split_words, sums, word_bytes

#: Documented bound of the sample that the linear scorer is fitted on, chosen by hash of id and text.
SCORER_DOCUMENTS = 20_000
BUCKETS = 512
THRESHOLD = 0.5
#: Prior rate of bad votes on good texts, and its weight as a share of the corpus.
FALSE_ALARM, BELIEF = 0.001, 0.02
STATISTICS = 9
#: Frequent words of the four languages of the corpus.
FREQUENT = frozenset("the of and to in is that it for on with as by at this are be was from or a an der die das und in zu den mit von sich ein eine ist nicht des auf im le la les de des et un une que qui dans en du au pour par sur il elle ou el los las y del se su con una es al lo para".split())
#: (statistic, bad below, bad above, good from, good to): a labeller votes bad outside the first pair, good inside
#: the second, and not at all in between.
LABELLERS = (
    (0, -1.0, 0.30, 0.0, 0.08),  # capitals a character
    (1, -1.0, 0.05, 0.0, 0.01),  # symbols a character
    (2, -1.0, 0.02, 0.0, 0.004),  # exclamation marks a character
    (3, -1.0, 0.20, 0.0, 0.03),  # words equal to the one before
    (4, 0.25, 2.0, 0.40, 1.0),  # distinct words a word, over the first 2,000 of each run of words
    (5, -1.0, 0.60, 0.0, 0.0),  # repeated lines a line
    (6, 2.2, 14.0, 3.0, 9.5),  # characters a word
    (7, 0.02, 2.0, 0.08, 0.9),  # frequent words a word
    (8, -1.0, 0.30, 0.0, 0.05),  # digits a character
)


SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"*$%&#|@~^<>{}=+_\\", np.uint8))


def describe(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(figures, shapes) of distinct words: capitals, symbols, exclamation marks, characters, whether frequent,
    digits; and the hash of the word's shape."""
    data, at = word_bytes(words)
    kinds = BYTE_CLASS[data]
    bare = pc.utf8_trim(pc.ascii_lower(words), characters=".,;:!?\"'()")
    frequent = pc.is_in(bare, value_set=pa.array(sorted(FREQUENT), bare.type)).to_numpy(zero_copy_only=False)
    figures = [counted(kinds == CAPITAL, at), counted(SYMBOLS[data], at), counted(data == 33, at), pc.utf8_length(words).to_numpy(), frequent, counted(kinds == DIGIT, at)]
    return np.stack(figures, axis=1).astype(np.float64), shape_hashes(data, at)


def examine(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, offsets, first, second): the labellers' statistics of each text, and the hash buckets of each
    word's shape and of its pair with the word before."""
    offsets, codes, words = split_words(texts)
    n_words = np.diff(offsets)
    n = np.maximum(n_words, 1).astype(np.float64)
    if len(words):
        figures, hashes = describe(words)
        cols, shapes = [sums(figures[codes, j], offsets) for j in range(6)], hashes[codes]
    else:
        cols, shapes = [np.zeros(len(texts))] * 6, np.zeros(0, np.uint64)
    chars = np.maximum(cols[3], 1)
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    starts = offsets[:-1][n_words > 0]
    same[starts] = False
    # distinct words within stretches of 2,000, so that long texts are judged like short ones
    owner = np.repeat(np.arange(len(texts)), n_words)
    within = (np.arange(len(codes)) - offsets[:-1][owner]) // 2000
    stretch = np.cumsum(np.append(0, (within[1:] != within[:-1]) | (owner[1:] != owner[:-1]))) if len(codes) else within
    key = np.sort(stretch * max(len(words), 1) + codes)
    new = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    owner_of = owner[np.searchsorted(stretch, new // max(len(words), 1))] if len(key) else new
    distinct = np.bincount(owner_of, minlength=len(texts))
    lines = [t.split("\n") if t else [""] for t in texts.to_pylist()]
    repeated = np.array([1 - len(set(x)) / len(x) for x in lines])
    statistics = np.stack([cols[0] / chars, cols[1] / chars, cols[2] / chars, sums(same, offsets) / n, distinct / n, repeated, cols[3] / n, cols[4] / n, cols[5] / chars], axis=1)
    before = np.concatenate([[np.uint64(0)], shapes[:-1]]) if len(shapes) else shapes
    before[starts] = np.uint64(1)
    pairs = mixed(mixed(before, shapes), same.astype(np.uint64))
    first = (mixed(shapes, np.uint64(17)) % np.uint64(BUCKETS)).astype(np.int64)
    return statistics, offsets, first, BUCKETS + (pairs % np.uint64(BUCKETS)).astype(np.int64)


def votes(statistics: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """2 good, 0 bad, 1 none, a column a labeller; texts of fewer than 20 words get no votes but on characters and lines."""
    out = np.ones((len(statistics), len(LABELLERS)), np.int64)
    for j, (s, low, high, good_from, good_to) in enumerate(LABELLERS):
        x = statistics[:, s]
        out[(x >= good_from) & (x <= good_to), j] = 2
        out[(x < low) | (x > high), j] = 0
        if s in (3, 4, 6, 7):
            out[n_words < 20, j] = 1
    return out


def _vote_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    power = 3 ** np.arange(len(LABELLERS))
    for batch in pieces(batches):
        statistics, offsets, _, _ = examine(batch.column(0))
        kinds, counts = np.unique(votes(statistics, np.diff(offsets)) @ power, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(counts, pa.int64())], names=["pattern", "n"])


def _log_fit(seen: np.ndarray, rates: np.ndarray, priors: np.ndarray) -> np.ndarray:
    """log P(class, votes), a row a text, a column a class; a labeller that does not vote says nothing."""
    labeller = np.arange(len(LABELLERS))
    return np.stack([np.log(p) + np.where(seen == 1, 0.0, np.log(r[labeller, seen])).sum(1) for r, p in zip(rates, priors, strict=True)], axis=1)


def _shares(fit: np.ndarray) -> np.ndarray:
    x = np.exp(fit - fit.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates, priors, good) by expectation-maximisation: rates[class, labeller, vote], and each pattern's posterior
    of being good. Class 0 is good; each labeller has a class of its own kind of bad text, since a text with one
    fault mostly looks good to the labellers of the others. Starts from one bad vote making a text bad."""
    seen = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    share = np.concatenate([np.where((seen == 0).any(1), 0.0, 1.0)[:, None], (seen == 0) / np.maximum((seen == 0).sum(1), 1)[:, None]], axis=1)
    n, classes = counts.sum(), 1 + len(LABELLERS)
    rates = np.empty((classes, len(LABELLERS), 3))
    priors = np.empty(classes)
    for _ in range(rounds):
        weight = counts[:, None] * share
        for c in range(classes):
            bad, well = weight[:, c] @ (seen == 0), weight[:, c] @ (seen == 2)
            blame, praise = (BELIEF * n * FALSE_ALARM, BELIEF * n * (1 - FALSE_ALARM)) if c == 0 else (0.1, 0.1)  # labellers seldom blame a good text
            rates[c, :, 0] = (bad + blame) / (bad + well + blame + praise)
            rates[c, :, 1], rates[c, :, 2] = 1.0, 1 - rates[c, :, 0]
        priors = (weight.sum(axis=0) + 0.1) / (n + 0.1 * classes)
        new = _shares(_log_fit(seen, rates, priors))
        done = np.abs(new - share).max() < 1e-9
        share = new
        if done:
            break
    return rates, priors, share[:, 0]


def posterior(seen: np.ndarray, rates: np.ndarray, priors: np.ndarray) -> np.ndarray:
    return _shares(_log_fit(seen, rates, priors))[:, 0] if len(seen) else np.zeros(0)


def _sample_rows(rates: np.ndarray, priors: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            statistics, offsets, first, second = examine(batch.column(0))
            n_words = np.diff(offsets)
            p = posterior(votes(statistics, n_words), rates, priors)
            dense = np.zeros((len(p), 2 * BUCKETS))
            owner = np.repeat(np.arange(len(p)), n_words)
            np.add.at(dense, (owner, first), 1.0)
            np.add.at(dense, (owner, second), 1.0)
            dense /= np.maximum(n_words, 1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * 2 * BUCKETS, pa.int32()), pa.array(dense.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.float64()), lists], names=["p", "f"])

    return rows


def _scorer(weights: np.ndarray, intercept: float, rates: np.ndarray, priors: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            statistics, offsets, first, second = examine(batch.column(batch.num_columns - 1))
            n_words = np.diff(offsets)
            linear = sums(weights[first] + weights[second], offsets) / np.maximum(n_words, 1) + intercept
            p = posterior(votes(statistics, n_words), rates, priors)
            scores = 1 / (1 + np.exp(-np.clip(linear, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "posterior", "score"])

    return score


def score_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scorer_documents: int = SCORER_DOCUMENTS) -> DataFrame:
    """(doc_id, text_key, posterior, score, keep) for each row of ``docs``: the weak labels' posterior of being
    good, the linear scorer's probability, and whether the scorer's is at least ``THRESHOLD``.

    Defined cases: very long texts are judged whole; null and empty texts have no words, so only the labellers on characters and lines vote and the
    scorer gives its intercept; repeated rows are scored each, alike; other columns are not read; where all
    posteriors fall on one side, the scorer is constant at that side; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).cast("string").alias("_text"))
    seen = rows.select("_text").mapInArrow(_vote_codes, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # at most 3 ** labellers rows
    out = "_id long, _key long, posterior double, score double"
    if not seen:
        weights, intercept, rates, priors = np.zeros(2 * BUCKETS), 0.0, np.full((1, len(LABELLERS), 3), 1 / 3), np.ones(1)
    else:
        counts = np.array([r["n"] for r in seen], np.float64)
        rates, priors, good = estimate(np.array([r["pattern"] for r in seen]), counts)
        n = int(counts.sum())
        sample = rows if n <= scorer_documents else rows.where(F.pmod(F.xxhash64("_id", "_key"), F.lit(1_000_000)) < int(1e6 * scorer_documents / n))
        if (good >= 0.5).all() or (good < 0.5).all():
            weights, intercept = np.zeros(2 * BUCKETS), 5.0 if good[0] >= 0.5 else -5.0
        else:
            labelled = sample.select("_text").mapInArrow(_sample_rows(rates, priors), "p double, f array<double>")
            labelled = labelled.select((F.col("p") >= 0.5).cast("double").alias("label"), F.abs(2 * F.col("p") - 1).alias("sure"), array_to_vector("f").alias("features"))
            model = LogisticRegression(weightCol="sure", regParam=1e-3, maxIter=100, standardization=True).fit(labelled)
            weights, intercept = model.coefficients.toArray(), float(model.intercept)
    scored = rows.mapInArrow(_scorer(weights, intercept, rates, priors), out)
    return scored.select(F.col("_id").alias(doc_id), F.col("_key").alias("text_key"), "posterior", "score", (F.col("score") >= THRESHOLD).alias("keep"))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that ``score_quality`` rejects, columns unchanged."""
    bad = score_quality(docs, doc_id, text, **options).where(~F.col("keep")).select(F.col(doc_id).alias("bad_id"), "text_key").distinct()
    d, b = docs.alias("d"), bad.alias("b")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("b.bad_id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("b.text_key"))
    return d.join(b, same, "left_anti")
