"""Document fingerprints by SpotSigs.

Words that make up a thousandth of the corpus or more are anchors. Behind each anchor of a text, the content words that
follow form a chain; anchor and chain are a signature, and the set of a text's signatures is its fingerprint. What a page
has beside its prose, menus and lists without common words, leaves hardly a trace in it. Sets are compared by Jaccard:
only those of the same or a neighbouring partition of lengths can be alike, and a pair is given up as soon as what is
left of both sets cannot make it so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procaudit.llm.tokens import mixed, pieces, split_words, word_hashes

#: A word of this share of all words is an anchor; there are a thousand at most.
ANCHOR_SHARE = 0.001
#: Content words of a chain, and steps from one to the next among the content words that follow.
CHAIN, DISTANCE = 3, 1
#: Two fingerprints less alike than this count as not alike at all.
FLOOR = 0.1
#: Letters and digits, in lower case; every other ASCII byte parts words.
_PLAIN = np.array([b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or 48 <= b < 58 or b > 127 else 32 for b in range(256)], np.uint8)


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, words) of each text's runs of letters, digits and non-ASCII characters, in lower case."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    _, offsets, data = texts.buffers()
    plain = _PLAIN[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint8)
    return split_words(pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(plain), offset=texts.offset))


def _frequent(least: float):
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, n, total) of the words with the share ``least`` of a piece's ``total`` words, and the total alone."""
        for piece in pieces(batches):
            _, codes, words = plain_words(piece.column(0))
            counts = np.bincount(codes, minlength=len(words))
            often = np.flatnonzero(counts >= least * len(codes)) if len(codes) else np.zeros(0, np.int64)
            named = pa.concat_arrays([words.cast(pa.string()).take(pa.array(often)), pa.array([None], pa.string())])
            yield pa.RecordBatch.from_arrays([named, pa.array(np.append(counts[often], 0).astype(np.int64)), pa.array(np.full(len(often) + 1, len(codes), np.int64))], names=["word", "n", "total"])

    return frequent


def _counted(names: list[str]):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.large_string())
        for piece in pieces(batches):
            _, codes, words = plain_words(piece.column(0))
            counts = np.bincount(codes, minlength=len(words))
            at = pc.index_in(known, value_set=words).to_numpy(zero_copy_only=False)
            there = np.flatnonzero(~np.isnan(at.astype(float)))
            yield pa.RecordBatch.from_arrays([known.take(pa.array(there)).cast(pa.string()), pa.array(counts[at[there].astype(np.int64)].astype(np.int64))], names=["word", "n"])

    return counted


def common_words(docs: DataFrame, text: str = "text", share: float = ANCHOR_SHARE) -> list[str]:
    """The words that make up ``share`` of all words of ``docs`` or more, in order; 1 / share at most.

    Pieces of the corpus report the words with a quarter of that share. Of a word that a piece does not report it holds
    less than that, so only words whose reports come near the share can have it: 4 / (3 * share) of them at most, which
    are then counted everywhere.
    """
    texts = docs.select(text)
    reports = texts.mapInArrow(_frequent(share / 4), "word string, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("seen"))
    reports = reports.withColumn("all", F.max(F.when(F.col("word").isNull(), F.col("seen"))).over(_whole()))
    near = reports.where(F.col("word").isNotNull() & (F.col("n") + share / 4 * (F.col("all") - F.col("seen")) >= share * F.col("all"))).select("word", "all").collect()
    if not near:
        return []
    counts = texts.mapInArrow(_counted(sorted(r["word"] for r in near)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sorted(r["word"] for r in counts.where(F.col("n") >= share * near[0]["all"]).collect())


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy()


def signature_sets(texts: pa.Array, anchors: list[str], chain: int = CHAIN, distance: int = DISTANCE) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of each text.

    The beginning of a text is an anchor too, so a text with words has a signature; one of anchors alone has the chain
    of its first words. A chain that the text ends is the shorter for it; an anchor that nothing follows has none.
    """
    offsets, codes, words = plain_words(texts)
    n = len(offsets) - 1
    if not len(codes):
        return [np.zeros(0, np.uint32)] * n
    hashed = word_hashes(words)
    marks = pc.is_in(words, value_set=pa.array(anchors, words.type)).to_numpy(zero_copy_only=False) if anchors else np.zeros(len(words), bool)
    h, anchor = hashed[codes], marks[codes]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    some = np.bincount(doc[~anchor], minlength=n) > 0
    content = np.flatnonzero(~anchor | ~some[doc])  # without any content word, all words stand for it
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    spots = np.flatnonzero(anchor & some[doc])
    owner = np.concatenate([doc[spots], doc[starts]])
    value = np.concatenate([h[spots], np.zeros(len(starts), np.uint64)])
    first = np.concatenate([np.searchsorted(content, spots), np.searchsorted(content, starts)])
    held = np.zeros(len(owner), bool)
    for k in range(chain):
        at = first + k * distance
        word = content[np.minimum(at, len(content) - 1)]
        inside = (at < len(content)) & (doc[word] == owner)
        value = np.where(inside, mixed(value, h[word]), value)
        held |= inside
    key = np.unique((owner[held].astype(np.uint64) << np.uint64(32)) | (value[held] >> np.uint64(32)))
    ends = np.searchsorted(key >> np.uint64(32), np.arange(n + 1))
    return [key[a:b].astype(np.uint32) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def length_partition(sizes: np.ndarray, floor: float) -> np.ndarray:
    """Partitions of set lengths: sets of partitions that are no neighbours are less alike than ``floor``; 0 is for
    empty sets."""
    return np.where(sizes > 0, 2 + np.floor(np.log(np.maximum(sizes, 1)) / -np.log(floor) + 1e-9), 0).astype(np.int64)


def pruned_jaccard(left: list[np.ndarray], right: list[np.ndarray], floor: float = FLOOR, steps: int = 8) -> np.ndarray:
    """The Jaccard likeness of each pair of sorted sets, 0 where it is under ``floor``; two empty sets are equal.

    Pairs of neighbouring partitions of lengths are compared partition by partition, an eighth of the range of
    signatures at a time; those that cannot come up to ``floor`` any more leave.
    """
    a, b = (np.array([len(s) for s in side], np.int64) for side in (left, right))
    out = ((a == 0) & (b == 0)).astype(np.float64)
    pa_, pb = length_partition(a, floor), length_partition(b, floor)
    near = np.flatnonzero((a > 0) & (b > 0) & (abs(pa_ - pb) <= 1) & (np.minimum(a, b) >= floor * np.maximum(a, b)))
    edges = np.array([(k << 32) // steps for k in range(1, steps)], np.uint64)
    for part in np.unique(np.maximum(pa_, pb)[near]):
        live = near[np.maximum(pa_, pb)[near] == part]
        cuts = [np.array([np.concatenate([[0], np.searchsorted(side[i], edges), [len(side[i])]]) for i in live]) for side in (left, right)]
        need = np.ceil(floor * (a + b)[live] / (1 + floor) - 1e-9)
        common = np.zeros(len(live), np.int64)
        open_ = np.arange(len(live))
        for k in range(steps):
            rows = []
            for side, cut in zip((left, right), cuts, strict=True):
                sizes = cut[open_, k + 1] - cut[open_, k]
                values = np.concatenate([side[live[i]][cut[i, k] : cut[i, k + 1]] for i in open_] + [np.zeros(0, np.uint32)])
                rows.append((np.repeat(open_, sizes).astype(np.uint64) << np.uint64(32)) | values)
            both = np.sort(np.concatenate(rows))
            common += np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(live))
            rest = np.minimum(*(side[open_, -1] - side[open_, k + 1] for side in cuts))
            open_ = open_[common[open_] + rest >= need[open_]]
        done = live[open_]
        out[done] = common[open_] / (a[done] + b[done] - common[open_])
    return np.where(out >= floor, out, 0.0)


def _hex(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([s.astype(">u4").tobytes().hex() for s in sets], pa.string())


def _compared(keep: int, anchors: list[str], others: int):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, keep):
            mine = signature_sets(piece.column(keep), anchors)
            columns, names = [*piece.columns[:keep], _hex(mine)], [*piece.schema.names[:keep], "fingerprint"]
            for k in range(others):
                theirs = signature_sets(piece.column(keep + 1 + k), anchors)
                columns += [_hex(theirs), pa.array(pruned_jaccard(mine, theirs))]
                names += [f"f{k}", f"near{k}"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return compared


def fingerprints(rows: DataFrame, anchors: list[str], text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``fingerprint`` in place of ``text``, the signatures as hexadecimal numbers of eight digits in
    order, and in place of each of the texts ``others`` its own fingerprint and ``near_<name>``, its likeness to
    ``text``. Equal texts have equal fingerprints.

    Defined cases: null, empty and wordless texts have the empty fingerprint, alike with each other and nothing else;
    a very long text is taken whole; repeated rows are rows like others; an empty table gives no rows; other columns
    come back as they were, so long as none is called ``fingerprint`` or as the new ones.
    """
    kept = [c for c in rows.columns if c not in (text, *others)]
    names = ["fingerprint", *[x for o in others for x in (f"{o}_fingerprint", f"near_{o}")]]
    schema = rows.select([F.col(f"`{c}`") for c in kept]).schema
    schema = schema.add("fingerprint", "string")
    for k in range(len(others)):
        schema = schema.add(f"f{k}", "string").add(f"near{k}", "double")
    out = rows.select([F.col(f"`{c}`") for c in (*kept, text, *others)]).mapInArrow(_compared(len(kept), anchors, len(others)), schema)
    return out.toDF(*kept, *names)


def _parts_of(key: Column, edges: list[int]) -> Column:
    """How many of the sorted ``edges`` are ``key`` or less: by a coarse list, then within one stretch of them."""
    step = max(int(len(edges) ** 0.5), 1)
    coarse, every = F.array(*map(F.lit, edges[step - 1 :: step])), F.array(*map(F.lit, edges))
    below = F.size(F.filter(coarse, lambda e: e <= key)) * step
    return below + F.size(F.filter(F.slice(every, below + 1, step), lambda e: e <= key))


def _following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, border, doc, text), each part's in order and its border last, to (doc, text, next)."""
    held: pa.RecordBatch | None = None
    for piece in pieces(batches):
        rows = pa.Table.from_batches([piece] if held is None else [held, piece]).combine_chunks()
        border = rows["border"].to_numpy()[:-1]
        at = pa.array(np.flatnonzero(~border))
        held = rows.slice(rows.num_rows - 1).to_batches()[0]
        text = rows["text"].combine_chunks()
        out = [rows["doc"].combine_chunks().take(at), text.take(at), text.take(pc.add(at, 1))]
        yield pa.RecordBatch.from_arrays(out, names=["doc", "text", "next"])


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text, next): each row with the text of the row that follows by falling id, the last with that of the first.

    Rows are dealt to ranges of ids; a range ends with a copy of the first row of the next one, so each row moves once
    and meets the one that follows. A null id ranks last; of one id the rows come by the hash of their text; null texts
    stay null; a row alone follows itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("key"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [(k + 1) / parts for k in range(parts - 1)] or [0.5]
    edges = sorted(set(rows.agg(F.percentile_approx("key", shares, max(10_000, 10 * parts))).first()[0] or []))
    rows = rows.withColumn("part", _parts_of(F.col("key"), edges)) if edges else rows.withColumn("part", F.lit(0))
    tops = rows.groupBy("part").agg(F.max(F.struct("key", "text_id")).alias("top")).orderBy("part").collect()  # a row a part
    borders = [(tops[k]["part"], *tops[k - 1]["top"]) for k in range(len(tops))]
    near = spark.createDataFrame(borders, "part int, key long, text_id long")
    ahead = F.broadcast(near.withColumnsRenamed({"part": "before", "key": "k", "text_id": "t"}))
    first = rows.join(ahead, (F.col("key") == F.col("k")) & (F.col("text_id") == F.col("t"))).groupBy("before").agg(F.any_value("text").alias("text"))
    ends = first.select(F.col("before").alias("part"), F.lit(True).alias("border"), F.lit(None).cast("long").alias("doc"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("text_id"), "text")
    every = rows.select("part", F.lit(False).alias("border"), "doc", "key", "text_id", "text").unionByName(ends)
    ordered = every.repartition("part").sortWithinPartitions("part", "border", F.desc("key"), F.desc("text_id"))
    return ordered.select("part", "border", "doc", "text").mapInArrow(_following, "doc long, text string, next string")
