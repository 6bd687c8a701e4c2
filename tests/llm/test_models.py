"""Archives, search, and the trained classifiers."""

import hashlib
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F


def test_warc_round_trip(spark, tmp_path):
    from procaudit.llm import warc

    big, small = "<p>é" + "x" * 1200, "tiny"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, small), (4, "u\nv", small), (5, "u", None), (None, "u", big), (2, "http://a/2", big), (7, "u", "y" * 200_000)]
    rows += [(100 + i, f"http://b/{i}", f"<html><body>page {i} " + "text " * (i % 50) + "</body></html>") for i in range(200)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    path = str(tmp_path / "warc")
    got = warc.archive_pages(pages, path).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    for i, _, t in rows:
        for r in by[i]:
            refers = 2 if t == big and i != 2 else None
            assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len((t or "").encode()), sha(t), "revisit" if refers else "response", refers)
    payloads = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, path, with_payload=True).where("record_type = 'response'").collect()}
    assert all(payloads[i] == (t or "").encode() for i, _, t in rows if t != big)
    # every record is a frame of its own, the dictionary comes first
    archive = next((tmp_path / "warc").glob("part-*")).read_bytes()
    assert archive[:4] == (0x184D2A5D).to_bytes(4, "little")
    records = list(warc.iterate_records(archive))
    assert len(records) > 1 and archive.count(zstandard.FRAME_HEADER) >= len(records)
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_topk_is_exact(spark):
    from procaudit.llm.topk import exact_topk
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5).astype("float32")], 1) for i in range(120)]
    rows[7] = (7, rows[3][1], 1)
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0], 1), (202, [float("nan")] * 5, 1), (203, [float("inf")] * 5, 1), (None, [1.0] * 5, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(4)
    clean = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows[:120]]
    expected = set()
    for q, x in clean:
        if q % 10 == 0:
            best = sorted(((-int(x @ y), i) for i, y in clean if i != q))[:5]
            expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = {tuple(r) for r in exact_topk(df, F.col("vec_id") % 10 == 0, block_rows=16).collect()}
    assert got == expected
    assert exact_topk(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = exact_topk(df.where("vec_id in (0, 1)"), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(1, 1)]


def labelled(n=600):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        w = ["the", "of"] * 5 + [word() for _ in range(60)]
        rng.shuffle(w)
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["zzidiot", "zzmoron"])
        docs.append((i, " ".join(w).capitalize() + "."))
        if i % 2 == 0 or toxic:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    from procaudit.llm.toxicity import score_toxicity

    docs, labels = labelled()
    extra = [(9001, None), (9002, ""), (None, "zzidiot"), (3, docs[3][1])]
    df = spark.createDataFrame([(d, t, 0.5) for d, t in docs + extra], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = score_toxicity(df, lab, trees=5).collect()
    assert len(rows) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], int(r["doc_id"] % 6 == 0)) for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert np.mean([p == t for p, t in held]) > 0.95
    none = score_toxicity(df, lab.where("toxic = 0")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert score_toxicity(df.limit(0), lab).count() == 0


def test_quality_keeps_clean_texts(spark):
    from procaudit.llm.quality import keep_good, score_quality

    docs, _ = labelled()
    bad = [(1000 + i, t.upper().replace(" ", "!! ")) for i, (_, t) in enumerate(docs[:40])] + [(2000 + i, "spam " * 80) for i in range(40)] + [(3000 + i, t.replace(" ", "### ")) for i, (_, t) in enumerate(docs[:40])]
    rows = docs + bad + [(4000, None), (4001, ""), (4002, "x"), (1, docs[1][1])]
    df = spark.createDataFrame([(d, t, True, "s") for d, t in rows], "doc_id long, text string, keep boolean, source string")
    got = {r["doc_id"]: r["keep"] for r in score_quality(df).collect()}
    assert np.mean([got[d] for d, _ in docs]) > 0.99 and np.mean([got[d] for d, _ in bad]) < 0.05
    kept = keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(got[d] for d, _ in rows)
    assert score_quality(df.limit(0)).count() == 0


def test_topk_of_large_components_and_repeated_queries(spark):
    """Exact beyond the products that 64 bits hold, an error where the result is beyond; of repeated queries the least."""
    from pyspark.errors import PythonException

    from procaudit.llm.topk import exact_topk

    kind = "vec_id long, embedding array<double>"
    top = lambda rows: [tuple(r) for r in exact_topk(spark.createDataFrame(rows, kind), F.col("vec_id") == 0, 2).orderBy("rank").collect()]
    x = 2.0**26
    assert top([(0, [x, x, 1.0]), (1, [x, -x, 3.0]), (2, [x, -x, 4.0])]) == [(0, 1, 2, 4 * 65536), (0, 2, 1, 3 * 65536)]
    for bad in (1e8, 1e30):
        with pytest.raises(PythonException):
            top([(0, [bad, bad]), (1, [bad, bad])])
    assert top([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 2.0]), (2, [5.0, 1.0])]) == [(0, 1, 1, 2 * 65536), (0, 2, 2, 65536)]
