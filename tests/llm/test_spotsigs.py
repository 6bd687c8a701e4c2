"""Fingerprints against plain Python: anchors, chains, likeness, the order of documents and the edited texts."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

SCHEMA = "doc_id long, text string, part int, border boolean, fingerprint string"
WORD = r"[a-z0-9\u0080-\U0010ffff]+"


def words_of(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed=1, n=50):
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(400)] + ["été", "Öl"]
    out = []
    for i in range(n):
        words = [rng.choice(["the", "The,", "of", "a"]) if rng.random() < 0.4 else rng.choice(rare) for _ in range(rng.randint(0, 120))]
        out.append((i * 3 - 30, " ".join(words)))
    out += [(900, None), (901, ""), (902, " ;-) \n"), (903, "the of the"), (904, "solo"), (905, "the " + "x y z " * 30000), (906, out[3][1]), (907, out[3][1])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, True, "f") for d, t in rows], SCHEMA).repartition(3)


def plain_chains(text, anchors, chain=3):
    """The signatures as tuples: the anchor ('' for the beginning) and its chain."""
    words = words_of(text)
    if not words:
        return set()
    if all(w in anchors for w in words):
        return {("", *words[:chain])}
    out = {("", *[w for w in words if w not in anchors][:chain])}
    for i, w in enumerate(words):
        after = [x for x in words[i + 1 :] if x not in anchors][:chain] if w in anchors else []
        if after:
            out.add((w, *after))
    return out


def plain_jaccard(a, b, floor=0.1):
    j = 1.0 if not a and not b else len(a & b) / len(a | b)
    return j if j >= floor else 0.0


@pytest.mark.parametrize("share", [0.001, 0.02, 0.9])
def test_common_words_are_counted_over_the_whole_corpus(spark, share, monkeypatch):
    from procaudit.llm import spotsigs, tokens

    monkeypatch.setattr(tokens, "PIECE_BYTES", 2000)
    docs = corpus()
    counts = collections.Counter(w for _, t in docs for w in words_of(t))
    expected = sorted(w for w, n in counts.items() if n >= share * counts.total())
    assert spotsigs.common_words(frame(spark, docs), share=share) == expected


def test_signatures_and_likeness_are_those_of_plain_sets():
    from procaudit.llm.spotsigs import pruned_jaccard, signature_sets

    anchors = ["a", "of", "the"]
    texts = [t for _, t in corpus(2, 80)]
    sets, plain = signature_sets(pa.array(texts, pa.string()), anchors), [plain_chains(t, set(anchors)) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    rng = random.Random(3)
    pairs = [(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(600)] + [(i, i) for i in range(len(texts))]
    got = pruned_jaccard([sets[i] for i, _ in pairs], [sets[j] for _, j in pairs])
    assert got == pytest.approx([plain_jaccard(plain[i], plain[j]) for i, j in pairs])
    again = signature_sets(pa.array(["x", *texts], pa.string()).slice(1), anchors)
    assert all(np.array_equal(x, y) for x, y in zip(sets, again, strict=True))


def test_likeness_at_and_around_the_floor():
    from procaudit.llm.spotsigs import pruned_jaccard

    rng = np.random.default_rng(1)
    left, right = [], []
    for _ in range(400):
        n, m, both = rng.integers(0, 60), rng.integers(0, 60), rng.integers(0, 30)
        values = rng.choice(2**32, n + m + both, replace=False).astype(np.uint32)
        left.append(np.sort(values[: n + both]))
        right.append(np.sort(values[n:]))
    for floor in (0.1, 0.5, 0.8):
        assert pruned_jaccard(left, right, floor) == pytest.approx([plain_jaccard(set(a), set(b), floor) for a, b in zip(left, right, strict=True)])


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_rows_meet_the_next_by_falling_id(spark, partitions):
    from procaudit.llm.spotsigs import with_next

    docs = corpus()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["doc"]: (r["text"], r["next"]) for r in with_next(frame(spark, docs)).collect()}
        order = sorted(docs, key=lambda r: -r[0])
        assert got == {d: (t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order)}
        assert [tuple(r) for r in with_next(frame(spark, [(5, "x")])).collect()] == [(5, "x", "x")]
        many = with_next(frame(spark, [(5, "x")] * 3 + [(5, "y"), (None, "z"), (6, None)])).collect()
        assert collections.Counter(r["next"] for r in many) == collections.Counter(["x"] * 3 + ["y", "z", None])
        assert {(r["doc"], r["next"]) for r in many if r["text"] in ("z", None)} <= {(None, None), (6, "x"), (6, "y")}
        assert with_next(frame(spark, [])).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprints_keep_other_columns_and_equal_texts_agree(spark):
    from procaudit.llm.spotsigs import fingerprints

    docs = corpus()
    rows = frame(spark, [*docs, docs[3]]).drop("fingerprint")
    out = fingerprints(rows, ["the"])
    assert out.columns == ["doc_id", "part", "border", "fingerprint"]
    found = out.collect()
    assert len(found) == len(docs) + 1
    by = {r["doc_id"]: r["fingerprint"] for r in found}
    assert by[906] == by[907] == by[docs[3][0]] and len({by[d] for d, _ in docs[:50]}) > 40
    assert by[900] == by[901] == by[902] == "" and by[903] != "" and by[904] != ""


def test_query_against_plain_python(spark, tmp_path):
    from procaudit.llm.queries import op13_spotsigs

    docs = corpus(5)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = collections.Counter(w for _, t in docs for w in words_of(t))
    anchors = {w for w, n in counts.items() if n >= 0.001 * counts.total()}
    order = sorted(docs, key=lambda r: -r[0])
    expected = {}
    for i, (d, t) in enumerate(order):
        text, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        mine = plain_chains(text, anchors)
        near = [plain_jaccard(mine, plain_chains(x, anchors)) for x in (edited, after)]
        expected[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *(round(x, 9) for x in near))
    got = op13_spotsigs(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got} == expected
    assert all((r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1) for r in got)
