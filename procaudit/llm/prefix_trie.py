"""Prefix trie of conversations as a burst trie.

Equal sequences of turns become one first. All of them start in one container under the root. A container with more
turns than one task should hold bursts: its head goes down to where its members part, and the next turn of each names
the head of the container that it goes to. What is left is dealt to shards by head, sorted, and swept into nodes with a
stack. Sums over subtrees come back up from the containers, one round of bursts after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procaudit.llm.common import BLANKS, saved

#: Turns below its head that a container of several sequences may hold.
CONTAINER_TURNS = 50_000
#: Ids of conversations that end at one node are put together by so many at most.
END_BITS = 16


def count_words(text: Column) -> Column:
    """Runs of anything but space and U+0009 to U+000D."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "[ \\t-\\r]+"))).cast("long")


def turn_sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, ids, words): of each conversation the 128-bit hashes of its turns (role and text) in order, and the words
    of each. Texts do not move.

    Turns are in order of ``turn``, null first, those of one number by their hash; a null role or text is empty; rows
    without a ``conv_id`` take no part; repeated rows are turns of their own. One task holds the hashes of one
    conversation's turns. An empty table gives no rows; other columns are not read.
    """
    r, x = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    name = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, x).cast("binary")))
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.struct(F.col(turn).alias("turn"), name.alias("id"), count_words(x).alias("words")).alias("t"))
    ordered = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def _chained(start: Column, ids: Column) -> Column:
    """The hash of a node from that of one above it and the turns between."""
    return F.aggregate(ids, start, lambda a, x: F.unhex(F.md5(F.concat(a, x))))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of id lists, sorted by (key, part), to the SHA-256 of each key's list; only the digest's state is held."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def ends_of(keyed: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the conversations (conv) of each sequence, their ids ascending and joined by commas."""
    parts = keyed.groupBy("key", F.shiftright("conv", END_BITS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return parts.repartition("key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(_ends, "key binary, ends_sha256 string")


NODE = "round int, parent binary, top boolean, conv long, depth int, parent_conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, key binary"


def swept_nodes(rows: list[dict]) -> list[tuple]:
    """The nodes at and below the head of one container, whose sequences come in order. A node is on the stack while
    the sequences go through it."""
    depth, path, before = rows[0]["depth"], [], None
    nodes: list[list] = []  # depth, parent, smallest member, members, children, leaves, saved tokens, key, words
    for r in rows:
        ids, common = r["ids"], depth - 1
        if before is not None:
            common = depth
            while common < min(len(ids), len(before)) and ids[common] == before[common]:
                common += 1
        del path[common - depth + 1 :]
        for d in range(common + 1, len(ids) + 1):
            nodes.append([d, path[-1] if path else -1, r["least"], 0, 0, 0, 0, None, r["words"][d - 1] if d else 0])
            path.append(len(nodes) - 1)
        last = nodes[path[-1]]
        last[2], last[3], last[7] = min(last[2], r["least"]), last[3] + r["n"], r["key"]
        before = ids
    for node in reversed(nodes):  # children come after their parents
        node[5] += not node[4]
        node[6] += (node[3] - 1) * node[8]
        if node[1] >= 0:
            up = nodes[node[1]]
            up[2], up[3], up[4], up[5], up[6] = min(up[2], node[2]), up[3] + node[3], up[4] + 1, up[5] + node[5], up[6] + node[6]
    head = rows[0]
    return [(head["round"], head["parent"], up < 0, least, d, head["parent_conv"] if up < 0 else nodes[up][2], n, children, leaves, tokens, key) for d, up, least, n, children, leaves, tokens, key, _ in nodes]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in NODE.split(", ")]
    container: list[dict] = []
    found: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        for row in batch.to_pylist():
            if container and container[0]["head"] != row["head"]:
                found += swept_nodes(container)
                container = []
                if len(found) > 10_000:
                    yield batch_of(found)
                    found = []
            container.append(row)
    yield batch_of(found + (swept_nodes(container) if container else []))


def _level(low: Column, high: Column) -> Column:
    """How many turns the first and the last of some sorted sequences have in common; all between have them too."""
    same = F.zip_with(low, high, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return (F.array_position(same, F.lit(False)) - 1).cast("int")


def burst_heads(cur: DataFrame, container_turns: int) -> DataFrame:
    """(head, level, conv, n_convs) of the containers that are too large: the depth that their heads go down to, and
    the smallest and the number of the conversations below."""
    sizes = cur.groupBy("head").agg(
        F.count("*").alias("m"), F.sum(F.size("ids") - F.col("depth") + 1).alias("turns"), F.min("ids").alias("low"), F.max("ids").alias("high"), F.min("least").alias("conv"), F.sum("n").alias("n_convs"),
    )
    return sizes.where((F.col("m") > 1) & (F.col("turns") > container_turns)).select("head", _level(F.col("low"), F.col("high")).alias("level"), "conv", "n_convs")


def trie_nodes(sequences: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row a node of the
    trie of ``sequences`` (conv, ids, words; each conv once, ids and words of one length, perhaps empty).

    ``conv_id`` is the smallest conversation through the node, with ``depth`` its name; the root has depth 0 and no
    parent. ``n_leaves`` and ``saved_tokens`` (members but one, times the words of the node's own turn) are sums over
    the node and all below it; ``ends_sha256`` is of the ids that end at the node, ascending, joined by commas.

    Defined cases: sequences that are equal are one path, however many; a sequence without turns ends at the root;
    long sequences are taken whole; without sequences there is no node, not even a root.
    """
    keyed = saved(sequences.withColumn("key", _chained(F.lit(b""), F.col("ids"))), "trie-sequences")
    unique = keyed.groupBy("key").agg(F.min("conv").alias("least"), F.count("*").alias("n"), F.any_value("ids").alias("ids"), F.any_value("words").alias("words"))
    root = {"round": F.lit(0), "head": F.lit(b""), "depth": F.lit(0), "parent": F.lit(None).cast("binary"), "parent_conv": F.lit(None).cast("long")}
    cur = saved(unique.withColumns(root), "trie-containers")
    bursts, ready = [], []
    while True:
        large = saved(burst_heads(cur, container_turns), "trie-large")
        if large.isEmpty():
            ready.append(cur)
            break
        ready.append(cur.join(large.select("head"), "head", "left_anti"))
        inside = cur.join(large, "head")
        own = ["round", "head", "depth", "parent", "parent_conv", "level", "conv", "n_convs"]
        steps = F.slice(F.concat(F.array(F.lit(0).cast("long")), "words"), F.col("depth") + 1, F.col("level") - F.col("depth") + 1)
        bursts.append(saved(inside.groupBy(own).agg(F.any_value(steps).alias("steps"), F.max(F.when(F.size("ids") == F.col("level"), F.col("key"))).alias("key")), "trie-bursts"))
        deeper = inside.where(F.size("ids") > F.col("level")).select(
            (F.col("round") + 1).alias("round"), _chained(F.col("head"), F.slice("ids", F.col("depth") + 1, F.col("level") + 1 - F.col("depth"))).alias("head"), (F.col("level") + 1).alias("depth"),
            F.col("head").alias("parent"), F.col("conv").alias("parent_conv"), "key", "least", "n", "ids", "words",
        )
        cur = saved(deeper, "trie-containers")

    columns = ["round", "parent", "parent_conv", "head", "depth", "ids", "words", "least", "n", "key"]
    containers = ready[0].select(columns)
    for r in ready[1:]:
        containers = containers.unionByName(r.select(columns))
    swept = saved(containers.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(_sweep, NODE), "trie-swept")
    names = [c.split()[0] for c in NODE.split(", ")]
    nodes, upper = swept.select(names), None
    for k in range(len(bursts) - 1, -1, -1):
        below = swept.where(F.col("top") & (F.col("round") == k + 1))
        below = below.select(names) if upper is None else below.select(names).unionByName(upper.where("top").select(names))
        sums = below.groupBy(F.col("parent").alias("head")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        steps = bursts[k].join(sums, "head").select("*", F.posexplode("steps").alias("step", "tokens"))
        after = Window.partitionBy("head").orderBy(F.desc("step"))
        top, last = F.col("step") == 0, F.col("depth") + F.col("step") == F.col("level")
        upper = saved(
            steps.withColumn("saved_tokens", F.col("below") + (F.col("n_convs") - 1) * F.sum("tokens").over(after)).select(
                "round", "parent", top.alias("top"), "conv", (F.col("depth") + F.col("step")).alias("depth"), F.when(top, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv"), "n_convs",
                F.when(last, F.col("children")).otherwise(1).alias("n_children"), "n_leaves", "saved_tokens", F.when(last, F.col("key")).alias("key"),
            ),
            "trie-upper",
        )
        nodes = nodes.unionByName(upper.select(names))
    return nodes.join(ends_of(keyed.select("key", "conv")), "key", "left").select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
