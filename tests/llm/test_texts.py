"""The operators on texts against plain Python, over the cases that each docstring defines."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, blanks, a long text and an extra column."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéÉ") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(40))
    line = " Shared line " + " ".join(word() for _ in range(12))
    out = []
    for i in range(n):
        text = " ".join(rng.choice([word(), word().upper(), word() + "."]) for _ in range(rng.randint(0, 90)))
        if i % 5 == 0:
            text += " " + passage
        if i % 4 == 0:
            text = line.upper() * (i % 8 == 0) + line * (i % 8 != 0) + "\n" + text + "\n" + line + "\t"
        if i % 7 == 0 and out:
            old = rng.choice([t for _, t in out if t is not None]).split(" ")
            if old:
                old[rng.randrange(len(old))] = word()
            text = " ".join(old)
        if i % 9 == 0 and out:
            text = rng.choice([t for _, t in out if t is not None])
        out.append((i, text))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one two"), (n + 4, "ab" * 4000 + " " + passage * 30)]
    return out


SCHEMA = "doc_id long, text string, n int, label string, count string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs():
    return corpus()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(spark, docs):
    from procaudit.llm.line_dedup import dedup_lines

    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    held = collections.defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(d)
    expected = {}
    for d, t in docs:
        xs = (t or "").split("\n")
        kept = [x for x in xs if not (len(held.get(key(x), ())) >= 5 and max(held[key(x)]) != d)]
        expected[d] = (len(xs), len(xs) - len(kept), None if t is None else "\n".join(kept))
    out = dedup_lines(frame(spark, docs))
    assert out.columns == ["doc_id", "text", "n", "label", "count", "n_lines", "n_dropped", "keep"]
    rows = out.collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in rows} == expected
    assert any(r["n_dropped"] for r in rows)
    for r in rows:
        assert sum(k["length"] for k in r["keep"]) == r["n_lines"] - r["n_dropped"]
    assert dedup_lines(empty(spark)).count() == 0
    repeated = dedup_lines(frame(spark, [*docs, docs[4], (None, docs[4][1])])).where("doc_id = 4 or doc_id is null").collect()
    assert len(repeated) == 3 and all(r["n_dropped"] == expected[4][1] for r in repeated)


def windows_of(items, size=10):
    out = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        n = min(size, len(w))
        for s in range(len(w) - n + 1) if n else ():
            out[tuple(w[s : s + n])].add(str(i))
    return out


def test_decontamination(spark, docs):
    from procaudit.llm.decontaminate import decontaminate, find_contamination

    items = [(1, " ".join(docs[5][1].split()[:25])), (2, "one TWO"), (3, docs[0][1]), (4, None), (5, "..."), (10, docs[5][1]), (11, "zz yy xx"), (12, "Shared line")]
    wins = windows_of(items)
    expected = {}
    for d, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        expected[d] = (len(w), len(hit), sorted(found))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = find_contamination(frame(spark, docs), bench).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in out} == expected
    kept = {r["doc_id"] for r in decontaminate(frame(spark, docs), bench).collect()}
    assert kept == {d for d, x in expected.items() if not x[1]}
    assert find_contamination(empty(spark), bench).count() == 0
    assert find_contamination(frame(spark, docs), bench.limit(0)).where("contaminated").count() == 0


def near(docs, n, percent):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    ids, changed = sorted(sets), True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


@pytest.mark.parametrize("n, percent", [(4, 85), (2, 60)])
def test_ngram_join(spark, docs, n, percent, monkeypatch):
    from procaudit.llm import chunks, ngram_join

    monkeypatch.setattr(chunks, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(chunks, "SHARD_BYTES", 30_000)
    monkeypatch.setattr(ngram_join, "CELL", 4)
    expected = near(docs, n, percent)
    got = ngram_join.near_duplicates(frame(spark, docs), n=n, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert any(d != c for d, (_, c) in expected.items())


def test_ngram_join_cases(spark):
    from procaudit.llm.ngram_join import near_duplicates

    text = " ".join(f"w{i}" for i in range(30))
    rows = [(3, text), (2, text.upper()), (2, text.upper()), (None, text), (5, None), (6, " "), (7, "a b"), (8, "A  b")]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(3, 27, 2), (2, 27, 2), (2, 27, 2), (None, 27, None), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7)], key=str)
    assert near_duplicates(empty(spark)).count() == 0


def test_suffix_array_and_prefixes():
    from procaudit.llm.suffix_array import permuted_prefixes, suffix_array

    rng = np.random.default_rng(2)
    for _ in range(150):
        n, k = int(rng.integers(1, 70)), int(rng.integers(1, 5))
        t = rng.integers(0, k, n)
        order = suffix_array(t, k)
        assert order.tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
        shared = permuted_prefixes(t, order)
        for a, b in zip(order[:-1], order[1:], strict=True):
            same = 0
            while max(a, b) + same < n and t[a + same] == t[b + same]:
                same += 1
            assert shared[b] == same
    for n, k in ((5000, 2), (4000, 5), (3000, 40)):  # buckets in batches, and strings of names below them
        t = rng.integers(0, k, n)
        t[n // 2 : n // 2 + 900] = t[:900]
        assert suffix_array(t, k).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_remove_repeats(spark, docs, monkeypatch):
    from procaudit.llm import chunks, repeats

    monkeypatch.setattr(chunks, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(chunks, "SHARD_BYTES", 30_000)
    seen, expected = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                hit[i : i + 100] = True
            seen.add(b[i : i + 100])
        kept = np.frombuffer(b, np.uint8)[~hit].tobytes()
        expected[d] = (len(b), int(hit.sum()), hashlib.sha256(kept).hexdigest(), kept)
    got = repeats.remove_repeats(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_bytes"], sum(s["length"] for s in r["spans"]), r["kept_sha256"], bytes(r["kept"])) for r in got} == expected
    assert sum(x[1] for x in expected.values()) > 1000
    assert repeats.remove_repeats(empty(spark)).count() == 0
    twice = repeats.remove_repeats(frame(spark, [(1, "q" * 250 + "r" * 120), (1, "q" * 250 + "r" * 120), (None, None)])).collect()
    assert sorted(sum(s["length"] for s in r["spans"]) for r in twice) == [0, 368, 370]  # of the first row all but the first of its runs' strings


def first_strings(docs):
    """Bytes to remove of each document, by every 100-byte string of the documents before and of its own start."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = t.encode()
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                hit[i : i + 100] = True
            seen.add(b[i : i + 100])
        out[d] = np.frombuffer(b, np.uint8)[~hit].tobytes()
    return out


def test_long_text_between_short_ones(spark, monkeypatch):
    from procaudit.llm import repeats

    monkeypatch.setattr(repeats, "BLOCK", 1000)
    monkeypatch.setattr(repeats, "LONG", 8000, raising=False)
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, edge = some(300), some(60)
    long = some(4000) + passage + some(7000) + passage[:150] + some(500)
    docs = [(1, some(200) + edge), (2, some(240)), (3, edge + long), (4, some(90) + passage), (5, edge + long[:60] + some(80)), (6, some(300)), (7, long[3900:9000])]
    texts = repeats.Texts(pa_messages(docs))
    assert all(b == a + 1 or sum(texts.lengths[a:b]) <= 1000 for a, b in texts._blocks())
    ends = texts.starts + texts.lengths
    assert (texts.first >= texts.starts[texts.owner]).all() and (texts.last + 100 <= ends[texts.owner]).all()
    got = repeats.remove_repeats(frame(spark, docs)).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == first_strings(docs)


def pa_messages(docs):
    """A chunk of ``docs`` as the operator packs it."""
    import pyarrow as pa

    batch = pa.record_batch({"doc": [d for d, _ in docs], "id": [d for d, _ in docs], "tie": [0] * len(docs), "text": [t for _, t in docs]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return pa.array([sink.getvalue().to_pybytes()], pa.binary())


def test_long_text_in_parts():
    from procaudit.llm import repeats

    rng = np.random.default_rng(4)
    x = rng.integers(97, 123, 30_000).astype(np.uint8)
    one = repeats._segments_of(x, np.array([0]), np.array([len(x)]))
    assert one[2][-1] == len(x) - 100 and (one[1][1:] == one[2][:-1] + 1).all() and one[1][0] == 0


def kneser_ney(texts, order):
    """(probability of a token after a context of order - 1 tokens, training counts of tokens), by the textbook."""
    grams = {k: collections.Counter() for k in range(1, order + 1)}
    for w in texts:
        padded = [0] * (order - 1) + w
        for i in range(order - 1, len(padded)):
            grams[order][tuple(padded[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):  # continuation counts
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    seen = collections.Counter(x for w in texts for x in w)

    def cuts(counts):
        have = [sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)]
        if not have[0] or not have[1]:
            return [0, 0.75, 0.75, 0.75]
        y = have[0] / (have[0] + 2 * have[1])
        raw = [i + 1 - (i + 2) * y * have[i + 1] / have[i] if have[i] else 1.5 for i in range(3)]
        return [0, *[min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)]]

    d = {k: cuts(g) for k, g in grams.items()}
    after = {k: collections.defaultdict(list) for k in grams}
    for k, g in grams.items():
        for x, c in g.items():
            after[k][x[:-1]].append(c)

    def p(context, w):
        low = 1 / (len(seen) + 1)
        for k in range(1, order + 1):
            c, mine = context[len(context) - k + 1 :], after[k][context[len(context) - k + 1 :]]
            if mine:
                low = max(grams[k][(*c, w)] - d[k][min(grams[k][(*c, w)], 3)], 0) / sum(mine) + sum(d[k][min(x, 3)] for x in mine) / sum(mine) * low
        return low

    return p, seen


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm(spark, docs, monkeypatch, order):
    from procaudit.llm import chunks, kneser_ney as lm

    monkeypatch.setattr(chunks, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(chunks, "SHARD_BYTES", 30_000)
    toks = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in toks}
    p, seen = kneser_ney([w for d, w in toks.items() if not held[d]], order)
    total, size = sum(seen.values()), len(seen)
    rows = lm.score_documents(frame(spark, docs), order=order).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = toks[r["doc_id"]]
        padded = [0] * (order - 1) + w
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(seen[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((seen[x] + 0.1) / (total + 0.1 * (size + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(tuple(padded[i : i + order - 1]), x)) for i, x in enumerate(w)), rel_tol=1e-9)
    # one context's probabilities over all known words and one unknown add up to 1
    start = (0,) * (order - 1)
    assert math.isclose(sum(p(start, w) for w in seen) + p(start, "never seen"), 1.0, rel_tol=1e-9)


def test_lm_cases(spark):
    from procaudit.llm import kneser_ney as lm

    assert lm.score_documents(empty(spark)).count() == 0
    alone = lm.score_documents(frame(spark, [(None, None), (None, "a b")])).collect()
    assert sorted((r["held_out"], r["n_tokens"], r["train_tokens"]) for r in alone) == [(True, 1, 0), (True, 3, 0)]


def test_lm_keys_and_counts(tmp_path):
    from procaudit.llm import kneser_ney as lm

    keys = np.unique(np.concatenate([np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2), np.array([0, 5, (1 << 64) - 1], np.uint64)]))
    assert (lm.unpacked_keys(lm.packed_keys(keys)) == keys).all()
    for most in (3, 70_000, (1 << 33) + 1, (1 << 62) + 3):
        assert lm.widened(lm.narrow(np.array([[1, most], [0, 2]])), 2).tolist() == [[1, most], [0, 2]]
    lm.store_array(keys, f"file://{tmp_path}/a/keys.npy")
    mapped = lm.map_array(f"file://{tmp_path}/a/keys.npy")
    assert isinstance(mapped, np.memmap) and (mapped == keys).all()
    values = np.array([[1, 254, 255, 256, 0], [1 << 40, 0, 7, 255, (1 << 62) + 1]])
    lm.store_values(values, f"file://{tmp_path}/a/shard")
    places = np.array([4, 0, 3, 2, 2, 1])
    assert (lm.mapped_values(f"file://{tmp_path}/a/shard")(places) == values[:, places]).all()


def plain_power(tokens, budget, target, limit):
    """The power by itself, with the weights: bisection over plain sums."""
    shares = [t / sum(tokens) for t in tokens]

    def weights(p):
        w = [s**p for s in shares]
        return [x / sum(w) for x in w]

    even = lambda p: -sum(w * math.log(w) for w in weights(p)) >= target * math.log(len(tokens)) - 1e-12
    over = lambda p: max(budget * w / t for w, t in zip(weights(p), tokens, strict=True)) > limit

    def bisect(holds):
        low, high = 0.0, 1.0
        for _ in range(60):
            low, high = ((low + high) / 2, high) if holds((low + high) / 2) else (low, (low + high) / 2)
        return low

    p = 1.0 if even(1.0) else bisect(even)
    if over(p):
        p = 1.0 if over(1.0) else bisect(over)
    return p, weights(p)


def plain_mixture(spark, rows, block_tokens, budget, target, limit, seed=11):
    """(row, epoch, block, rank) of what the mixture takes, by running sums over the permutations; Spark gives the hashes."""
    df = spark.createDataFrame([(i, d, t, s) for i, (d, t, s) in enumerate(rows)], "row int, d long, t string, s string").withColumn("k", F.xxhash64("t"))
    keys = {r["row"]: (r["d"], r["k"], r["h"]) for r in df.select("row", "d", "k", F.xxhash64(F.lit(seed), "d", "k").alias("h")).collect()}
    size = [len((t or "").split()) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=str)
    tokens = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    tokens = {s: t for s, t in tokens.items() if t}
    _, weights = plain_power(list(tokens.values()), budget or sum(tokens.values()), target, limit)
    quota = {s: (budget or sum(tokens.values())) * w for s, w in zip(tokens, weights, strict=True)}
    epochs = {s: max(math.ceil(quota[s] / t - 1e-9), 1) for s, t in tokens.items()}
    most = max(epochs.values())
    blocks = max(-(-t // block_tokens) for t in tokens.values())
    turns = {(r["e"], r["b"]): r["h"] for r in spark.range(blocks).selectExpr("id as b").crossJoin(spark.range(1, most + 1).selectExpr("cast(id as int) as e")).select("e", "b", F.xxhash64(F.lit(seed), "e", "b").alias("h")).collect()}
    order = {(r["e"], r["row"]): r["h"] for r in df.crossJoin(spark.range(1, most + 1).selectExpr("cast(id as int) as e")).select("e", "row", F.xxhash64(F.lit(seed), "e", "d", "k").alias("h")).collect()}
    taken = []
    for s, t in tokens.items():
        mine = collections.defaultdict(list)
        for i, r in enumerate(rows):
            if r[2] == s:
                mine[keys[i][2] % -(-t // block_tokens)].append(i)
        done = 0
        for e in range(1, epochs[s] + 1):
            for rank, b in enumerate(sorted(mine, key=lambda b: (turns[e, b], b)), 1):
                for i in sorted(mine[b], key=lambda i: (order[e, i], *keys[i][:2])):
                    if done < quota[s]:
                        taken.append((rows[i][0], s, size[i], e, b, rank))
                    done += size[i]
    return sorted(taken, key=str)


@pytest.mark.parametrize("budget, target, limit, block", [(None, 0.9, 99.0, 200), (9000, 0.98, 4.0, 300), (20_000, 0.999, 3.0, 1 << 20), (40, 0.5, 99.0, 50)])
def test_mixing_takes_what_plain_sums_take(spark, budget, target, limit, block):
    """Nulls, blanks, a very long text, repeated rows and a source that holds most rows."""
    from procaudit.llm.mixing import mix_sources

    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), s) for i, s in enumerate(["a"] * 300 + ["b"] * 60 + ["c"] * 20 + [None] * 10)]
    rows += [(900, None, "a"), (901, "", "b"), (902, "v " * 5000, "c"), (903, "only blanks: none", "d"), (904, " ", "e"), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, epoch int, weight string").repartition(3)
    out = mix_sources(df, budget=budget, block_tokens=block, target_entropy=target, max_epochs=limit).collect()
    got = sorted(((r["doc_id"], r["source"], r["n_tokens"], r["epoch"], r["block"], r["block_rank"]) for r in out), key=str)
    assert got == plain_mixture(spark, rows, block, budget, target, limit)
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    tokens = {s: t for s, t in tokens.items() if t}
    power, weights = plain_power(list(tokens.values()), budget or sum(tokens.values()), target, limit)
    assert all(math.isclose(r["power"], power, abs_tol=1e-9) for r in out)
    assert all(math.isclose(r["weight"], dict(zip(tokens, weights, strict=True))[r["source"]], rel_tol=1e-6) for r in out)


def test_mixing_of_no_tokens_and_of_many_sources(spark):
    from procaudit.llm.mixing import mix_sources

    kind = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], kind)).count() == 0
    assert mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], kind)).count() == 0
    one = mix_sources(spark.createDataFrame([(1, "a b", "s")], kind)).collect()
    assert [(r["doc_id"], r["epoch"], r["weight"]) for r in one] == [(1, 1, 1.0)]
    hosts = spark.range(150_000).select("id", F.expr("if(id % 3 = 0, 'a b c', 'a')").alias("text"), F.concat(F.lit("host"), F.col("id").cast("string")).alias("source")).withColumnRenamed("id", "doc_id")
    out = mix_sources(hosts, max_epochs=1e9).agg(F.count_distinct("source").alias("n"), F.min("power").alias("power"), F.sum(F.when(F.col("epoch") == 1, F.col("weight"))).alias("w")).first()
    assert out["n"] == 150_000 and out["power"] == 1.0 and math.isclose(out["w"], 1.0, rel_tol=1e-9)


def test_pieces_keep_every_row():
    import pyarrow as pa

    from procaudit.llm import tokens

    batch = pa.RecordBatch.from_pydict({"i": list(range(9)), "t": ["x" * n for n in (0, 5, 5_000_000, 1, 1, 4_000_000, 300, 9_000_000, 2)]})
    parts = list(tokens.pieces([batch]))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(9)) and len(parts) > 2
    offsets, codes, words = tokens.split_words(pa.array([" a b\ta ", None, "", "B\x0bb\xa0c"]), lower=True)
    assert offsets.tolist() == [0, 3, 3, 3, 5] and [words[c].as_py() for c in codes] == ["a", "b", "a", "b", "b\xa0c"]
