"""N-gram Jaccard join by vertical partitioning.

Texts that are equal byte for byte share one vertex. All n-grams have one global order, from the rarest in the corpus
to the most frequent, and each vertex's set is cut where that order is cut into fragments. Linked vertices have a
common n-gram in the first fragment of both (their prefixes), so the postings of the prefixes name the candidates;
the places of the common n-gram and 512-bit parity sketches of the whole sets bound a pair's overlap from above, and
what passes both bounds is counted: a partial overlap per pair and fragment, each in a key of its own, summed per pair.

Postings of one n-gram never expand into all their pairs at once. Each round takes from every part of a posting list
at most two partners a vertex, verifies them and contracts what is linked; lists longer than a part meet again by one
head a group. The last round looks only at lists with pairs that no round took, and there only between groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procaudit.llm.chunks import local_chunks, plan_sizes, shard_bounds, unpacked
from procaudit.llm.common import saved
from procaudit.llm.graph import components
from procaudit.llm.tokens import mixed, split_words, word_hashes

N, PERCENT = 4, 85
#: Vertices of a posting list that are compared at once.
CELL = 512
SKETCH_WORDS = 8
#: Codes of n-gram counts below this are the counts themselves; beyond it six codes make a doubling.
EXACT_CODES = 64
#: Where the global order is cut, as (count code, eighth of the hash range): n-grams of one vertex only come before the
#: first cut and overlap with nothing, so they are in no fragment.
CUTS = ((2, 0), (2, 2), (2, 4), (2, 6), (3, 0), (3, 4), (4, 0), (5, 0), (7, 0), (10, 0), (16, 0), (32, 0), (EXACT_CODES, 0), (EXACT_CODES + 18, 0))
POSTING = "v long, n long, sketch binary, token long, code int, place int, before long"


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text of fewer words counts as one n-gram of them all."""
    offsets, codes, words = split_words(texts, lower=True)
    h = word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64)
    grams = h
    for k in range(1, n):
        grams = mixed(grams[: len(h) - k], h[k:]) if len(h) > k else grams[:0]
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = mixed(np.array([whole]), np.array([x]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def count_codes(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes that keep their order: exact below ``EXACT_CODES``, then in steps of a sixth of a doubling."""
    above = EXACT_CODES + np.floor(6 * np.log2(np.maximum(counts, EXACT_CODES) / EXACT_CODES))
    return np.where(counts < EXACT_CODES, counts, np.minimum(above, 255)).astype(np.uint8)


def _buckets(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct 32-bit buckets, place of each n-gram among them, vertices of this chunk in each)."""
    every = np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(32)
    return np.unique(every, return_inverse=True, return_counts=True)


def _packed(sorted_keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as 16-bit steps; a step of 65535 stands for itself and goes on."""
    steps = np.diff(sorted_keys.astype(np.int64), prepend=0)
    full = steps // 65535
    out = np.full(len(steps) + full.sum(), 65535, np.uint16)
    out[np.cumsum(full + 1) - 1] = steps - full * 65535
    return out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16).astype(np.int64)
    return np.cumsum(steps)[steps != 65535]


def _squeezed(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def _opened(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _chunk_sets(data: bytes, n: int) -> tuple[pa.Table, list[np.ndarray]]:
    table = unpacked(pa.array([data], pa.binary()))
    return table, shingle_sets(table["text"].combine_chunks(), n)


ASK = "chunk long, shard long, keys binary, counts binary"


def _request(n: int, shards: int):
    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, _, counts = _buckets(_chunk_sets(data, n)[1])
                bounds = shard_bounds(keys, shards, 32)
                rows = [(chunk, s, _packed(keys[a:b]), _squeezed(counts[a:b].astype(np.uint32))) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "shard", "keys", "counts"])

    return request


def _answer(table: pa.Table) -> pa.Table:
    """The code of the corpus count of each key asked for."""
    asked = [_unpacked(x).astype(np.uint32) for x in table["keys"].to_pylist()]
    counts = np.concatenate([_opened(x, np.uint32) for x in table["counts"].to_pylist()])
    _, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = count_codes(np.bincount(place, counts))[place]
    ends = np.cumsum([len(x) for x in asked])
    return pa.table({"chunk": table["chunk"], "shard": table["shard"], "codes": pa.array([_squeezed(x) for x in np.split(total, ends[:-1])], pa.binary())})


def sketch(grams: np.ndarray) -> np.ndarray:
    """How many of the set's hashes fall to each of 512 places, as parities: two sets differ in at least as many
    n-grams as their sketches differ in bits."""
    places = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=64 * SKETCH_WORDS).astype(np.uint8) & 1, bitorder="little")


_EDGES = np.array([(code << 56) | (eighth << 53) for code, eighth in CUTS], np.uint64)
SETS = "v long, doc long, k1 long, k2 long, n long, sketch binary, prefix array<struct<token: long, code: int, place: int, before: long>>, fragments array<struct<f: int, grams: binary>>"


def _finish(n: int, percent: int):
    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        docs, sets = _chunk_sets(table["data"][0].as_py(), n)
        _, place, _ = _buckets(sets)
        order = np.argsort(answers["shard"].to_numpy())
        data = answers["codes"].to_pylist()
        codes = np.concatenate([_opened(data[i], np.uint8) for i in order] + [np.zeros(0, np.uint8)])[place]
        prefixes, sketches, pieces, counts, at = [], [], [], [], 0
        for s in sets:
            code = codes[at : at + len(s)]
            at += len(s)
            most = len(s) - -(-percent * len(s) // 100) + 1
            ranked = (code.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
            by = np.argsort(ranked, kind="stable")  # equal only for hashes with equal beginnings, and s is sorted
            first = by[:most][code[by[:most]] > 1] if len(s) else by
            prefixes.append((s[first].view(np.int64), code[first], np.flatnonzero(code[by[:most]] > 1) if len(s) else by))
            if not len(first):
                sketches.append(None)
                counts.append(0)
                continue
            sketches.append(sketch(s).tobytes())
            fragment = np.searchsorted(_EDGES, ranked, "right") - 1
            mine = np.unique(fragment[fragment >= 0])
            pieces += [(int(f), s[fragment == f].tobytes()) for f in mine]
            counts.append(len(mine))
        lengths = np.array([len(p[0]) for p in prefixes], np.int64)
        tokens, code, places = (np.concatenate([p[i] for p in prefixes] + [np.zeros(0, np.int64)]) for i in range(3))
        before = np.concatenate([[0], tokens[:-1]]) if len(tokens) else tokens
        starts = np.cumsum(lengths) - lengths
        before[starts[lengths > 0]] = 0
        postings = pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(code, pa.int32()), pa.array(places, pa.int32()), pa.array(before, pa.int64())], names=["token", "code", "place", "before"])
        cut = pa.StructArray.from_arrays([pa.array([f for f, _ in pieces], pa.int32()), pa.array([g for _, g in pieces], pa.binary())], names=["f", "grams"])
        lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
        return pa.table({
            "v": pa.array((table["chunk"][0].as_py() << 22) + np.arange(len(sets)), pa.int64()), "doc": docs["doc"], "k1": docs["k1"], "k2": docs["k2"], "n": pa.array([len(s) for s in sets], pa.int64()),
            "sketch": pa.array(sketches, pa.binary()), "prefix": lists(lengths, postings), "fragments": lists(counts, cut),
        })

    return finish


def least_overlap(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with 100 * overlap >= percent * union."""
    return -(-percent * (na + nb) // (100 + percent))


def survivors(cols: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, slack) of the pairs of places that the bounds leave.

    A pair is judged where its first common n-gram is: with the same n-gram before in both prefixes this is not the
    first. After the first, at most as many are common as either set has from there on.
    """
    na, nb = cols["n"][left], cols["n"][right]
    need = least_overlap(na, nb, percent)
    keep = (cols["label"][left] != cols["label"][right]) & ((cols["before"][left] == 0) | (cols["before"][left] != cols["before"][right]))
    keep &= np.minimum(na - cols["place"][left], nb - cols["place"][right]) >= need
    left, right, need, total = left[keep], right[keep], need[keep], (na + nb)[keep]
    differ = np.bitwise_count(cols["sketch"][left] ^ cols["sketch"][right]).sum(axis=1, dtype=np.int64) if len(left) else np.zeros(0, np.int64)
    bound = (total - differ) // 2
    keep = bound >= need
    return left[keep], right[keep], bound[keep] / np.maximum(need[keep], 1)


FOUND = "a long, b long, na long, slack double"


def _compare(percent: int, last: bool):
    """Parts of posting lists, sorted by (token, cell, n, v), to candidate pairs (a, b), a before b in (n, v).

    Not ``last``: of each vertex the most promising and the nearest in size of the vertices before it in its part, and
    (token, null) for a part with further candidates. ``last``: every candidate; ``side`` 0 and 1 are two parts of one
    list that meet, side 2 is a part that meets itself.
    """

    def judge(cols: dict[str, np.ndarray], sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for size in np.unique(sizes[sizes > 1]):
            mine = starts[sizes == size]
            i, j = np.triu_indices(size, 1)
            step = max(1, (1 << 16) // len(i))
            for g in range(0, len(mine), step):
                left, right = (mine[g : g + step, None] + i).ravel(), (mine[g : g + step, None] + j).ravel()
                found = []
                for h in range(0, len(left), 1 << 16):
                    x, y = left[h : h + (1 << 16)], right[h : h + (1 << 16)]
                    if last:
                        meet = (cols["side"][x] == 2) | (cols["side"][x] != cols["side"][y])
                        x, y = x[meet], y[meet]
                    found.append(survivors(cols, x, y, percent))
                yield tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def picked(cols: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in the pairs of each right vertex's best and nearest left one; the lists with more than that."""
        chosen = []
        for by in (-slack, -left):
            order = np.lexsort((left, by, right))
            new = np.ones(len(order), bool)
            new[1:] = right[order][1:] != right[order][:-1]
            chosen.append(order[new])
        chosen = np.unique(np.concatenate(chosen))
        rest = np.ones(len(left), bool)
        rest[chosen] = False
        return chosen, np.unique(cols["token"][left[rest]])

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {k: table[k].to_numpy() for k in ("token", "cell", "side", "v", "n", "place", "before", "label")}
        cols["sketch"] = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(cols["token"]) != 0) | (np.diff(cols["cell"]) != 0)]))
        for left, right, slack in judge(cols, np.diff(np.append(new, table.num_rows)), new):
            open_lists = np.zeros(0, np.int64)
            if not last and len(left):
                chosen, open_lists = picked(cols, left, right, slack)
                left, right, slack = left[chosen], right[chosen], slack[chosen]
            if len(left):
                a, b = cols["v"][left], cols["v"][right]
                order = np.lexsort((b, a))
                one = order[np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))]
                yield pa.RecordBatch.from_arrays([pa.array(a[one]), pa.array(b[one]), pa.array(cols["n"][left[one]]), pa.array(slack[one], pa.float64())], names=["a", "b", "na", "slack"])
            if len(open_lists):
                yield pa.RecordBatch.from_arrays([pa.array(open_lists, pa.int64()), *[pa.nulls(len(open_lists), t) for t in (pa.int64(), pa.int64(), pa.float64())]], names=["a", "b", "na", "slack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not table.num_rows:
                continue
            t, c = (table[k].to_numpy() for k in ("token", "cell"))
            end = np.flatnonzero((t != t[-1]) | (c != c[-1]))
            cut = end[-1] + 1 if len(end) else 0
            if cut:
                yield from emit(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield from emit(rest)

    return run


def compared(parts: DataFrame, percent: int, last: bool) -> DataFrame:
    columns = ["token", "cell", "side", "n", "v", "place", "before", "label", "sketch"]
    return parts.select(columns).repartition("token", "cell").sortWithinPartitions("token", "cell", "n", "v").mapInArrow(_compare(percent, last), FOUND)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many n-grams of one fragment a pair shares."""
    for batch in batches:
        common = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(y, x)
            common.append(int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64())], names=["a", "b", "common"])


def links_among(pairs: DataFrame, sizes: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link: partial overlaps are counted by (pair, fragment) and summed per pair."""
    left, right = (fragments.select(F.col("v").alias(x), "f", F.col("grams").alias(f"g{x}")) for x in ("a", "b"))
    partial = pairs.join(left, "a").join(right, ["b", "f"]).select("a", "b", "ga", "gb").mapInArrow(_partial, "a long, b long, common long")
    total = partial.groupBy("a", "b").agg(F.sum("common").alias("common")).where("common > 0")
    for x in ("a", "b"):
        total = total.join(sizes.select(F.col("v").alias(x), F.col("n").alias(f"n{x}")), x)
    return total.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def list_parts(code: Column) -> Column:
    """Into how many parts a posting list is dealt, from the code of its n-gram's count, which it cannot outgrow."""
    most = F.when(code < EXACT_CODES, code).otherwise(F.lit(EXACT_CODES) * F.pow(F.lit(2.0), (code + 1 - EXACT_CODES) / 6.0))
    return F.ceil(most / CELL).cast("long")


def _dealt(rows: DataFrame, parts: Column) -> DataFrame:
    return rows.withColumn("cell", F.pmod(F.xxhash64("v"), parts)).withColumn("side", F.lit(2))


def _relabelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("v"))
    return rows.join(labels.select(F.col("node").alias("v"), "label"), "v", "left").withColumn("label", F.coalesce("label", "v"))


def last_cells(lists: DataFrame) -> DataFrame:
    """Postings of open lists dealt to cells in which only different groups meet: a list's largest group is cut into
    parts that meet the others' parts, never each other."""
    groups = lists.groupBy("token", "label").agg(F.count("*").alias("m"))
    large = groups.groupBy("token").agg(F.sum("m").alias("all"), F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
    kept = lists.join(large, "token").withColumn("main", F.col("label") == F.col("top.label"))
    kept = kept.withColumn("km", F.ceil(F.col("top.m") / CELL).cast("long")).withColumn("ko", F.ceil((F.col("all") - F.col("top.m")) / CELL).cast("long"))
    kept = kept.withColumn("part", F.pmod(F.xxhash64("v"), F.when(F.col("main"), F.col("km")).otherwise(F.col("ko"))))
    # cells (i, j), i and j parts of the others with i <= j, and (i, ko + j), j a part of the largest group
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("ko") + F.col("km") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j"), F.when(j == F.col("part"), 2).when(j < F.col("part"), 1).otherwise(0).alias("side")))
    mains = F.transform(F.sequence(F.lit(0).cast("long"), F.col("ko") - 1), lambda i: F.struct(i.alias("i"), (F.col("ko") + F.col("part")).alias("j"), F.lit(1).alias("side")))
    cells = kept.withColumn("c", F.explode(F.when(F.col("main"), mains).otherwise(others)))
    return cells.withColumn("cell", F.col("c.i") * (F.col("ko") + F.col("km")) + F.col("c.j")).withColumn("side", F.col("c.side"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``labels`` with the groups that ``links`` join put together."""
    if labels is not None:
        for x in ("a", "b"):
            links = links.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left").withColumn(x, F.coalesce(f"l{x}", x)).select("a", "b")
    joined = components(links)
    if labels is None:
        return joined
    moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    return saved(moved.unionByName(joined.join(labels, "node", "left_anti")), "ngram-groups")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; a set holds the distinct ``n``-word shingles, of
    a shorter text all its words as one. Two documents link when ``100 * intersection >= percent * union``; no link
    is lost, and ``component_id`` is the smallest id that links reach. Shingles are compared by 64-bit hashes.

    Defined cases: null, empty and blank texts have empty sets and link with nothing; a very long text is compared
    whole, in a chunk of its own; rows of one id are one vertex with all their links; a null id takes no part and has
    a null component; ties need no rule; other columns are not read, whatever their names; an empty table gives no
    rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.select("doc", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    _, shards = plan_sizes(rows, "text")
    # equal texts become one vertex before they move
    unique = keyed.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.first("text").alias("text"))
    chunks = saved(local_chunks(unique.select("doc", "k1", "k2", "text")), "ngram-chunks")
    answers = chunks.mapInArrow(_request(n, shards), ASK).groupBy("shard").applyInArrow(_answer, "chunk long, shard long, codes binary")
    base = saved(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_finish(n, percent), SETS), "ngram-sets")
    sizes, known = base.select("v", "n"), base.where(F.col("doc").isNotNull() & (F.size("prefix") > 0))
    fragments = known.select("v", F.explode("fragments").alias("x")).select("v", "x.f", "x.grams")
    postings = known.select("v", "n", "sketch", F.explode("prefix").alias("p")).select("v", "n", "sketch", "p.*")

    # rows of one id are one vertex: its texts are linked
    ids = keyed.where(F.col("doc").isNotNull())
    several = ids.groupBy("doc").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).where("x <> y").select("doc")
    theirs = ids.select("doc", "k1", "k2").join(several, "doc").join(base.where("n > 0").select("k1", "k2", "v"), ["k1", "k2"]).select("doc", "v").distinct()
    same_id = theirs.join(theirs.groupBy("doc").agg(F.min("v").alias("a")), "doc").select("a", F.col("v").alias("b")).where("a <> b")

    found = saved(compared(_dealt(_relabelled(postings, None), list_parts(F.col("code"))), percent, False), "ngram-pairs")
    pairs = found.where(F.col("b").isNotNull())
    # of a vertex's partners over all its lists, two
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("slack", "na", "a")).alias("best"), F.max_by("a", F.struct("na", "a")).alias("near"))
    picked = best.select(F.explode(F.array_distinct(F.array("best", "near"))).alias("a"), "b")
    labels = _merged(None, links_among(picked, sizes, fragments, percent).unionByName(same_id))
    # lists in several parts, or with candidates beyond those found
    wanted = found.where(F.col("b").isNull()).select(F.col("a").alias("token")).unionByName(postings.where(list_parts(F.col("code")) > 1).select("token")).distinct()
    rest = saved(postings.join(wanted, "token", "left_semi"), "ngram-open")
    for _ in range(6):  # a round leaves one head a group, so lists of up to CELL ** 7 vertices come down to a part
        heads = _relabelled(rest, labels).groupBy("token", "label").agg(F.min_by(F.struct("v", "n", "sketch", "code", "place", "before"), "v").alias("h")).select("token", "label", "h.*")
        long = heads.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > CELL)
        if long.isEmpty():
            break
        heads = heads.join(long, "token")
        met = compared(_dealt(heads, F.ceil(F.col("m") / CELL).cast("long")), percent, False).where(F.col("b").isNotNull()).select("a", "b").distinct()
        links = saved(links_among(met, sizes, fragments, percent), "ngram-links")
        if links.isEmpty():
            break
        labels = _merged(labels, links)
    final = compared(last_cells(_relabelled(rest, labels)), percent, True).select("a", "b")
    for x in ("a", "b"):  # and what the first round found but did not take
        pairs = pairs.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left")
    final = final.unionByName(pairs.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")).distinct()
    labels = _merged(labels, links_among(final, sizes, fragments, percent))

    own = labels.join(base.select(F.col("v").alias("node"), "doc"), "node")
    own = own.join(own.groupBy("label").agg(F.min("doc").alias("group")), "label").select(F.col("node").alias("v"), "group")
    owned = keyed.select("doc", "k1", "k2").join(base.select("k1", "k2", "v", "n", F.col("doc").alias("least")), ["k1", "k2"])
    placed = owned.join(own, "v", "left")
    component = F.when(F.col("doc").isNotNull(), F.when(F.col("n") == 0, F.col("doc")).otherwise(F.coalesce("group", "least")))
    return placed.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
