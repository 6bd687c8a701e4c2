"""Character n-gram features of whole texts, for the models. Grams come from words, and a batch of texts has far fewer
different words than words, so each word is cut into its grams once a batch; what leaves a task is counts by gram, or one
sparse vector a text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

LOW, HIGH = 3, 5
#: Texts whose grams are held at once.
PIECE_ROWS = 512
COUNTED = "gram string, df long, total long"


def word_grams(token: str) -> list[str]:
    """The grams of one lower-case token: accents dropped in compatibility form, one space on both sides."""
    if token.isascii():
        words = [token]
    else:
        words = re.split("[ \t\n\x0b\f\r]+", "".join(c for c in unicodedata.normalize("NFKD", token) if unicodedata.category(c) != "Mn"))
    padded = [f" {w} " for w in words if w]
    return [p[i : i + n] for p in padded for n in range(LOW, HIGH + 1) for i in range(len(p) - n + 1)]


def sparse_counts(texts: pa.Array, number: Callable[[str], int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of some lower-case texts, by row and gram; ``number`` names grams, None drops one."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = parts.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    lists = [[k for k in map(number, word_grams(w)) if k is not None] if w else [] for w in names]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.array([k for x in lists for k in x], np.int64)
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    pair, n = np.unique(row * max(len(names), 1) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, word = np.divmod(pair, max(len(names), 1))
    each = sizes[word]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[word], each)
    width = int(flat.max(initial=0)) + 1
    key, place = np.unique(np.repeat(row, each) * width + flat[at], return_inverse=True)
    count = np.bincount(place, np.repeat(n, each), len(key))
    return key // width, key % width, count


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(a, PIECE_ROWS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        seen: dict[str, int] = {}
        row, gram, count = sparse_counts(piece.column(1), lambda g: seen.setdefault(g, len(seen)))
        copies = piece.column(0).to_numpy()[row]
        df, total = (np.bincount(gram, w, len(seen)).astype(np.int64) for w in (copies, copies * count))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(df), pa.array(total)], names=["gram", "df", "total"])


def gram_table(texts: DataFrame, min_df: int = 2, max_features: int = 250_000) -> DataFrame:
    """(gram, df, total, idf) of (copies, text) rows, a text counting ``copies`` times: grams in ``min_df`` texts or more,
    the ``max_features`` most frequent over the corpus, of equally frequent ones the first in order; smoothed idf."""
    n = texts.agg(F.sum("copies")).first()[0] or 0
    counts = texts.select(F.col("copies").cast("long"), F.lower("text").alias("text")).mapInArrow(_count, COUNTED)
    grams = counts.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where(F.col("df") >= min_df)
    kept = grams.orderBy(F.desc("total"), "gram").limit(max_features)
    return kept.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        found = [list({g for w in (t or "").split() for g in word_grams(w)}) for t in piece.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.list_(pa.string()))], names=["key", "grams"])


def pair_vocabulary(pairs: DataFrame, heads: DataFrame, rests: DataFrame, n: int, min_df: int = 2, max_features: int = 250_000) -> DataFrame:
    """``fit_vocabulary`` of ``n`` texts given as pairs (head_id, rest_id, copies) of heads (head_id, text, copies) and rests
    (rest_id, text, copies). A gram that is in both parts of a text counts once in ``df``."""
    each = lambda df: df.select(F.col("copies").cast("long"), F.lower("text").alias("text")).mapInArrow(_count, COUNTED)
    grams = each(heads).union(each(rests)).groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    sets = lambda df, key: df.select(F.col(key).alias("key"), F.lower("text").alias("text")).mapInArrow(_sets, "key long, grams array<string>").select(F.col("key").alias(key), F.explode("grams").alias("gram"))
    of_rest = sets(rests, "rest_id")
    of_head = sets(heads, "head_id").join(of_rest.select("gram").distinct(), "gram", "left_semi").groupBy("head_id").agg(F.collect_list("gram").alias("grams"))
    met = pairs.join(of_head, "head_id").select("rest_id", "copies", F.explode("grams").alias("gram")).groupBy("rest_id", "gram").agg(F.sum("copies").alias("twice"))
    twice = met.join(of_rest, ["rest_id", "gram"], "left_semi").groupBy("gram").agg(F.sum("twice").alias("twice"))
    exact = grams.join(twice, "gram", "left").select("gram", (F.col("df") - F.coalesce("twice", F.lit(0))).alias("df"), "total").where(F.col("df") >= min_df)
    kept = exact.orderBy(F.desc("total"), "gram").limit(max_features).withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
    return kept.withColumn("idx", F.row_number().over(Window.orderBy("gram")) - 1).select("gram", "idx", "idf")  # max_features rows at most


def fit_vocabulary(texts: DataFrame, min_df: int = 2, max_features: int = 250_000) -> DataFrame:
    """(gram, idx, idf) of the same: the grams numbered in order."""
    numbered = gram_table(texts, min_df, max_features).withColumn("idx", F.row_number().over(Window.orderBy("gram")) - 1)  # max_features rows at most
    return numbered.select("gram", "idx", "idf")


class Featurizer:
    """TF-IDF vectors of length 1 over a vocabulary (gram, idx, idf), which is bounded and collected once."""

    def __init__(self, vocabulary: DataFrame):
        rows = vocabulary.orderBy("idx").collect()
        self.width, self.spark = len(rows), vocabulary.sparkSession
        self.known = self.spark.sparkContext.broadcast(({r["gram"]: r["idx"] for r in rows}, np.array([r["idf"] for r in rows], np.float64)))

    def _vectors(self, emit: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], unit: bool = True):
        known = self.known

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, idf = known.value
            for piece in _pieces(batches):
                row, gram, count = sparse_counts(piece.column(piece.num_columns - 1), numbers.get)
                weight = count * idf[gram] if len(gram) else count
                norm = np.sqrt(np.bincount(row, weight * weight, piece.num_rows))
                yield emit(piece, np.searchsorted(row, np.arange(piece.num_rows + 1)), gram.astype(np.int32), weight / norm[row] if unit else weight)

        return run

    def packed(self, rows: DataFrame, text: str = "text", unit: bool = True) -> DataFrame:
        """``rows`` with (idx, weights) in place of ``text``: the little-endian bytes of 32-bit numbers. Vectors that are not
        ``unit`` ones keep their lengths, so those of parts of a text can be added."""
        kept = [c for c in rows.columns if c != text]

        def emit(piece, ends, gram, weight):
            weight = weight.astype(np.float32)
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([*piece.columns[:-1], cut(gram), cut(weight)], names=[*kept, "idx", "weights"])

        schema = rows.select(kept).schema.add("idx", "binary").add("weights", "binary")
        return rows.select(*kept, F.lower(text).alias(text)).mapInArrow(self._vectors(emit, unit), schema)

    def lists(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with (grams, weights) in place of ``text``: lists of numbers, weights in double precision."""
        kept = [c for c in rows.columns if c != text]

        def emit(piece, ends, gram, weight):
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (gram.astype(np.int64), weight.astype(np.float64))]
            return pa.RecordBatch.from_arrays([*piece.columns[:-1], *lists], names=[*kept, "grams", "weights"])

        schema = rows.select(kept).schema.add("grams", ArrayType(LongType())).add("weights", ArrayType(DoubleType()))
        return rows.select(*kept, F.lower(text).alias(text)).mapInArrow(self._vectors(emit), schema)

    def vectors(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with a sparse ML vector ``features`` in place of ``text``."""
        kept, width = [c for c in rows.columns if c != text], self.width

        def emit(piece, ends, gram, weight):
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (gram, weight)]
            n = piece.num_rows
            struct = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)), *lists], names=["type", "size", "indices", "values"])
            return pa.RecordBatch.from_arrays([*piece.columns[:-1], struct], names=[*kept, "features"])

        schema = rows.select(kept).schema.add("features", VectorUDT())
        return rows.select(*kept, F.lower(text).alias(text)).mapInArrow(self._vectors(emit), schema)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """As many partitions as shuffles have: making grams outweighs the bytes by which small inputs are merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

