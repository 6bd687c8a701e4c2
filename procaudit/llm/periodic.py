"""Periodic runs of words: stretches that repeat with a period, however long the period.

Periods are searched octave by octave. For each octave a document is cut into tiles as long as ``TILE_BLOCKS`` of its
smallest period, which overlap by a few periods. A tile has a boundary every smallest period; a run is so long that it
covers a whole stretch between two boundaries. At each boundary the words from there on are compared with those one
period later, for all periods of the octave at once, and where a whole stretch agrees, Z-values to both sides tell how
far the agreement goes. Tiles are solved independently, all those of one octave together; what they find are fragments,
which are shuffled by document and period and stitched to whole runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procaudit.llm.common import BLANKS, saved
from procaudit.llm.tokens import pieces, split_words

#: A run has at least so many words, and at least so many times its period.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Boundaries of a tile, and words between two boundaries in the first octave, whose periods start at 1.
TILE_BLOCKS, FIRST_BLOCK = 64, 8
FRAGMENT = "doc long, text_id long, period long, low long, high long"
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Stream:
    """Word codes of several documents, one after the other with a mark of its own behind each, and sums of powers
    that give the hash of any stretch."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes
        self.words = np.empty(len(codes) + len(sizes), np.int64)
        at = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
        self.words[at] = codes
        self.words[self.ends] = -1 - np.arange(len(sizes))
        n = len(self.words)
        x = self.words.astype(np.uint64) * _ODD
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        power = np.full(n + 1, 6364136223846793005, np.uint64)
        power[0] = 1
        back = np.full(n + 1, pow(6364136223846793005, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * np.cumprod(power)[:n], dtype=np.uint64)])
        self.back = np.cumprod(back)

    def hashes(self, size: int) -> np.ndarray:
        """Of every stretch of ``size`` words, by its first place."""
        return (self.total[size:] - self.total[:-size]) * self.back[: len(self.total) - size]

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``size`` words at ``a`` and at ``b`` have one hash, ``a`` before ``b``."""
        left, right = self.total[a + size] - self.total[a], self.total[b + size] - self.total[b]
        return left * self.back[a] == right * self.back[b]


def _reach(stream: _Stream, place: np.ndarray, period: np.ndarray, most: int, step: int) -> np.ndarray:
    """Z-values: how many words from each ``place`` on (``step`` 1) or before it (-1) equal those one period later,
    ``most`` at most, by halving."""
    done = np.zeros(len(place), np.int64)
    n = len(stream.words)
    size = 1 << (most.bit_length() - 1)
    while size:
        a = place + done if step > 0 else place - done - size
        inside = (a >= 0) & (a + period + size <= n) & (done + size <= most)
        safe = np.where(inside, a, 0)
        shift = np.where(inside, period, 0)
        done += size * (inside & stream.equal(safe, safe + shift, np.where(inside, size, 0)))
        size >>= 1
    return done


def _candidates(stream: _Stream, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundary, period) wherever the ``block`` words at a boundary equal those one period of the octave later."""
    h = stream.hashes(block)
    rows = -(-len(h) // block)
    table = np.zeros((rows + 1) * block, np.uint64)
    table[: len(h)] = h
    table = table.reshape(-1, block)
    row, col = np.nonzero(table[1:] == table[:-1, :1])
    place, period = row * block, col + block
    if block == FIRST_BLOCK:  # the first octave has the shorter periods too
        row, col = np.nonzero(table[:-1, 1:] == table[:-1, :1])
        place, period = np.concatenate([place, row * block]), np.concatenate([period, col + 1])
    real = place + period < len(h)
    return place[real], period[real]


def _repeats_within(stretch: np.ndarray, period: int) -> bool:
    """Whether a stretch of at least one ``period`` has a period that divides it: then the whole run has."""
    rest, prime = period, 2
    while rest > 1:
        prime = prime if prime * prime <= rest else rest
        if rest % prime:
            prime += 1
            continue
        shorter = period // prime
        if np.array_equal(stretch[:-shorter], stretch[shorter:]):
            return True
        while rest % prime == 0:
            rest //= prime
    return False


def _octave(stream: _Stream, block: int) -> Iterator[tuple[int, int, int, int]]:
    """(document, period, low, high) of the fragments of one octave: from low to high each word equals the one a period
    later. Fragments of one document and period in different tiles overlap where they belong together."""
    place, period = _candidates(stream, block)
    doc = np.searchsorted(stream.starts, place, "right") - 1
    fits = (stream.ends - stream.starts)[doc] >= MIN_PERIODS * period
    place, period, doc = place[fits], period[fits], doc[fits]
    if not len(place):
        return
    order = np.lexsort((period, place))
    place, period, doc = place[order], period[order], doc[order]
    left, right = _reach(stream, place, period, block, -1), _reach(stream, place + block, period, block, 1)
    low, high = place - left, place + block + right
    # two periods over one stretch as long as both together are multiples of a shorter one, or the second of the first
    shared = np.minimum(high[1:] + period[1:], high[:-1] + period[:-1]) - np.maximum(low[1:], low[:-1])
    both = (place[1:] == place[:-1]) & (shared >= period[1:] + period[:-1])
    own = ~(np.append(both & (period[1:] % period[:-1] > 0), False) | np.append(False, both))
    place, period, doc, left, right, low, high = (x[own] for x in (place, period, doc, left, right, low, high))
    if not len(place):
        return
    tile = (place - stream.starts[doc]) // (TILE_BLOCKS * block)
    order = np.lexsort((low, tile, period))
    new = np.ones(len(order), bool)
    new[1:] = (tile[order][1:] != tile[order][:-1]) | (period[order][1:] != period[order][:-1]) | (low[order][1:] > high[order][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    first, last = order[first], order[last]
    for a, b in zip(first, last, strict=True):
        q, lo, hi, start = int(period[a]), int(low[a]), int(high[b]), int(stream.starts[doc[a]])
        if left[a] < block and right[b] < block and hi - lo + q < max(MIN_WORDS, MIN_PERIODS * q):
            continue  # it ends on both sides inside the tile, and is no run
        if _repeats_within(stream.words[lo : hi + q], q):
            continue
        same = stream.words[lo:hi] == stream.words[lo + q : hi + q]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
        for x, y in edges.reshape(-1, 2):  # one stretch, unless hashes of unlike words were equal
            yield int(doc[a]), q, lo + int(x) - start, lo + int(y) - start


def fragments_of(codes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The fragments of all octaves of some documents, given as word codes."""
    longest = int(np.diff(offsets).max(initial=0))
    if longest < MIN_WORDS:
        return []
    stream, found, block = _Stream(codes, offsets), [], FIRST_BLOCK
    while block == FIRST_BLOCK or MIN_PERIODS * block <= longest:
        found += _octave(stream, block)
        block *= 2
    return found


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        offsets, codes, _ = split_words(piece.column(2))
        found = np.array(fragments_of(codes, offsets), np.int64).reshape(-1, 4)
        rows = pa.array(found[:, 0])
        yield pa.RecordBatch.from_arrays([piece.column(0).take(rows), piece.column(1).take(rows), *[pa.array(found[:, i]) for i in (1, 2, 3)]], names=["doc", "text_id", "period", "low", "high"])


def stitched(intervals: DataFrame, *keys: str) -> DataFrame:
    """(keys, low, high) of the intervals put together where they overlap or touch."""
    order = Window.partitionBy(*keys).orderBy("low")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(F.col("low") <= before, 0).otherwise(1)).withColumn("part", F.sum("new").over(order))
    return marked.groupBy(*keys, "part").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("part")


def split_column(text: Column) -> Column:
    """The words of a text as an array."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_id, runs, gone) of the documents that have runs: ``runs`` holds (start, period, length) by start and
    period, ``gone`` the (start, length) of what repeats an earlier period of a run, in maximal stretches.

    ``doc`` is the id (the smallest long for null) and ``text_id`` the 64-bit hash of the text, so rows of one id and
    one text share their row, and those of one id and different texts do not.
    """
    rows = docs.select(_doc(F.col(doc_id)).alias("doc"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text"))
    fragments = saved(rows.mapInArrow(_fragments, FRAGMENT).distinct(), "run-fragments")
    whole = stitched(fragments, "doc", "text_id", "period").select("doc", "text_id", "period", F.col("low").alias("start"), (F.col("high") - F.col("low") + F.col("period")).alias("length"))
    whole = whole.where(F.col("length") >= F.greatest(F.lit(MIN_WORDS), MIN_PERIODS * F.col("period")))
    # one stretch with several periods: the smallest is the run's
    runs = saved(whole.groupBy("doc", "text_id", "start", "length").agg(F.min("period").alias("period")), "runs")
    listed = runs.groupBy("doc", "text_id").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    repeats = stitched(runs.select("doc", "text_id", (F.col("start") + F.col("period")).alias("low"), (F.col("start") + F.col("length")).alias("high")), "doc", "text_id")
    gone = repeats.groupBy("doc", "text_id").agg(F.array_sort(F.collect_list(F.struct(F.col("low").cast("int").alias("start"), (F.col("high") - F.col("low")).cast("int").alias("length")))).alias("gone"))
    return listed.join(gone, ["doc", "text_id"])


def _doc(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def collapse_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs``: its runs, by start and period, and its words without
    those that a run contains after its first period, with one space between each two.

    Words are runs of anything but space and U+0009 to U+000D. A run is a stretch of ``MIN_WORDS`` words and
    ``MIN_PERIODS`` of its smallest period or more that no neighbouring word extends with that period. Places are
    word numbers from 0. Stretches are compared by 64-bit hashes, and what is found is then compared word by word.

    Defined cases: null, empty and blank texts have no words, no runs and an empty collapsed text; a very long text is
    searched whole, in a piece of its own; of runs that start together the one with the smaller period comes first;
    repeated rows each get the result; a null id stays null; an empty table gives no rows; other columns are not read.
    """
    from procaudit.llm.line_dedup import keep_runs

    found = find_runs(docs, doc_id, text).select(F.col("doc").alias("f_doc"), F.col("text_id").alias("f_text"), "runs", "gone")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), _doc(F.col(doc_id)).alias("doc"), F.xxhash64(text).alias("text_id"))
    # sorted and merged at every size: a text moves once, and the plan is that of a large table
    met = rows.join(found.hint("merge"), (F.col("doc") == F.col("f_doc")) & (F.col("text_id") == F.col("f_text")), "left")

    def collapsed(words: Column) -> Column:
        kept = F.transform(keep_runs(F.col("gone"), F.size(words)), lambda r: F.slice(words, r["start"], r["length"]))
        return F.struct(F.size(words).cast("long").alias("n"), F.array_join(F.when(F.col("gone").isNull(), words).otherwise(F.flatten(kept)), " ").alias("text"))

    out = F.get(F.transform(F.array(split_column(F.col("body"))), collapsed), F.lit(0))
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    met = met.select(F.col("id").alias(doc_id), F.coalesce("runs", none).alias("runs"), out.alias("_out"))
    return met.select(doc_id, F.col("_out.n").alias("n_words"), "runs", F.col("_out.text").alias("collapsed"))
