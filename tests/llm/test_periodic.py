"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, runs int, gone string, period long"


def plain_runs(words):
    n, seen = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                seen.setdefault((i, j - i + q), q)  # periods rise, so the first is the smallest
            i = max(j, i + 1)
    return sorted((s, q, length) for (s, length), q in seen.items())


def plain_collapse(words, runs):
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed):
    rng = random.Random(seed)
    word = lambda k=6: rng.choice("abcdefghijkl"[:k])
    out = []
    for _ in range(40):
        words = [word(rng.choice([1, 2, 3, 12])) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            unit = [word(rng.choice([2, 12])) for _ in range(rng.randint(1, 40))]
            words += unit * rng.randint(2, 6) + unit[: rng.randint(0, len(unit))] + [word(12) for _ in range(rng.randint(0, 3))]
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    out += [" ".join(fib[-1]), " ".join("ab" * 300), "x " * 700, " ".join(("a" * 50 + "b") * 9), " ".join(f"{bin(i).count('1') % 2}" for i in range(512)), "é É " * 20]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_are_those_of_a_plain_search(spark, seed, monkeypatch):
    from procaudit.llm import periodic

    monkeypatch.setattr(periodic, "TILE_BLOCKS", [64, 2][seed - 1])
    rows = list(enumerate([*texts(seed), None, "", " \v ", "one two"]))
    expected = {}
    for d, t in rows:
        words = (t or "").split()
        runs = plain_runs(words)
        expected[d] = (len(words), runs, plain_collapse(words, runs))
    df = spark.createDataFrame([(d, t, 1, "g", 2) for d, t in rows], SCHEMA).repartition(3)
    found = periodic.collapse_runs(df)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert {r["doc_id"]: (r["n_words"], [(x["start"], x["period"], x["length"]) for x in r["runs"]], r["collapsed"]) for r in found.collect()} == expected
    assert sum(len(e[1]) for e in expected.values()) > 60


def test_found_stretches_are_checked_word_by_word():
    from procaudit.llm import periodic

    class Blind(periodic._Stream):
        def equal(self, a, b, size):
            return np.ones(len(a), bool)

    words = np.array([ord(c) for c in "xy" + "abcdefghij" * 4 + "zw" * 10 + "q"], np.int64)
    for doc, q, low, high in periodic._octave(Blind(words, np.array([0, len(words)])), 8):
        assert (words[low:high] == words[low + q : high + q]).all()


def test_tiles_of_one_long_document_meet(spark):
    from procaudit.llm.periodic import collapse_runs

    rng = random.Random(5)
    unit = [f"w{rng.randrange(50)}" for _ in range(3000)]
    words = [f"v{i}" for i in range(1000)] + unit * 4 + unit[:17] + ["z"] * 30000 + ["end"]
    runs = [(1000, 3000, 12017), (13017, 1, 30000)]
    row = collapse_runs(spark.createDataFrame([(1, " ".join(words), 1, "g", 2)], SCHEMA)).first()
    assert [tuple(r) for r in row["runs"]] == runs
    assert row["collapsed"] == plain_collapse(words, runs)


def test_defined_cases(spark):
    from procaudit.llm.periodic import collapse_runs

    assert collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a " * 30, 1, "g", 2), (7, "a " * 30, 1, "g", 2), (7, "a " * 30, 1, "g", 2), (7, "b c d", 1, "g", 2)]
    got = sorted((r["doc_id"] is not None, r["collapsed"], len(r["runs"])) for r in collapse_runs(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, "a", 1), (True, "a", 1), (True, "a", 1), (True, "b c d", 0)]


def test_query_plants_and_digests(spark, tmp_path):
    from procaudit.llm.queries import op11_periodic_runs

    rows = list(enumerate([*texts(6), *texts(7), *texts(8), None, ""]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = {}
    for d, t in rows:
        words = (t or "").split()
        n, h = len(words), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = (None,) * 4
        if runs:
            s, q, length = min(runs, key=lambda r: (-r[2] / r[1], r[0], r[1]))
            best = (s, length, q, 1000 * length // q)
        expected[d] = (len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, q, length in runs)), sha(plain_collapse(words, runs)))
    assert {r["doc_id"]: tuple(r)[1:] for r in op11_periodic_runs(spark, str(tmp_path)).collect()} == expected
