"""The prefix trie against a plain trie of Python dictionaries, with containers of every size."""

import collections
import hashlib
import random

import pytest

SCHEMA = "conv_id long, turn int, role string, text string, key string, head string"


def turn_rows(seed: int):
    """Conversations with shared beginnings, a deep chain, many copies, nulls, ties in turn, repeats and an id of null."""
    rng = random.Random(seed)
    out = []
    for c in range(60):
        turns = [(rng.choice(["user", None, ""]), rng.choice(["a", "b c", "b  c\n", "", None, "long " * 2000])) for _ in range(rng.randint(1, 6))]
        if c % 3 == 0:
            turns = [("user", "hello there"), ("assistant", "hi")] * 6 + turns[: c % 4]
        if c % 5 == 0:
            turns = [("user", "hello there"), ("assistant", "hi")]
        for i, (role, text) in enumerate(turns):
            out.append((c * 7 - 20, None if i == 0 and c % 2 else i, role, text))
    out += [(500, 1, "u", "x"), (500, 1, "u", "x"), (500, 1, "u", "w"), (None, 1, "u", "x")]
    return [(*r, "k", "h") for r in out]


def name(role, text):
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()


def sequences(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, name(role, text), len((text or "").split())))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}


def plain_trie(seqs):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, ts in seqs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    out = {}
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * q[-1][1] for q in below if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out[min(cs), len(p)] = (min(members[p[:-1]]) if p else None, len(cs), kids[p], sum(not kids[q] for q in below), saved, digest)
    return out


@pytest.mark.parametrize("seed, container", [(1, 50_000), (1, 5), (2, 0), (3, 40)])
def test_trie_is_that_of_plain_python(spark, seed, container):
    from procaudit.llm.prefix_trie import trie_nodes, turn_sequences

    rows = turn_rows(seed)
    random.Random(seed).shuffle(rows)
    seqs = turn_sequences(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], *list(r)[3:]) for r in trie_nodes(seqs, container).collect()}
    assert got == plain_trie(sequences(rows))


def test_turnless_sequences_and_empty_tables(spark):
    from procaudit.llm.prefix_trie import trie_nodes, turn_sequences

    kind = "conv long, ids array<binary>, words array<long>"
    rows = [tuple(r) for r in trie_nodes(spark.createDataFrame([(3, [], []), (10, [], [])], kind)).collect()]
    assert rows == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,10").hexdigest())]
    assert trie_nodes(turn_sequences(spark.createDataFrame([], SCHEMA))).count() == 0


def test_ends_of_one_node_come_in_parts(spark, monkeypatch):
    from procaudit.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "END_BITS", 2)
    ids = [9, 100, -3, 7, 8, 12, 11]
    got = prefix_trie.ends_of(spark.createDataFrame([(bytearray(b"k"), c) for c in ids] + [(bytearray(b"j"), 1)], "key binary, conv long")).collect()
    assert {bytes(r["key"]): r["ends_sha256"] for r in got} == {b"k": hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), b"j": hashlib.sha256(b"1").hexdigest()}


def test_query_rebuilds_conversations(spark, tmp_path):
    import zlib

    from procaudit.llm.queries import op12_prefix_trie

    rows = turn_rows(4)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    own = sequences(rows)
    rebuilt = {}
    for c, ts in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + ts[h:]
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], *list(r)[3:]) for r in op12_prefix_trie(spark, str(tmp_path)).collect()}
    assert got == plain_trie(rebuilt)
