"""The registered queries of the subpackage against SQL, and the pipeline stage by stage (sf0.001)."""

import os

import duckdb
import pytest

from procaudit.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data are not here")


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    order = [[c[0] for c in found.description].index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.count() > 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
    assert {"doc_id", "source", "epoch", "block"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_by_brute_force(spark):
    """Stages 2 to 4 against plain Python, with nulls, empty and repeated texts, ties and a table without rows."""
    import collections

    import corpus_pipeline as P
    from test_texts import LOWER, corpus, near

    rows = corpus(seed=3, n=40)
    df = spark.createDataFrame([(i, t, "en", ("a", None)[i % 2], len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    gone = lambda i, x: len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != i
    cut = {i: None if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in rows}
    lines = P.line_dedup(spark, df, SF)
    assert lines.columns == df.columns and {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()} == {i: (t, None if t is None else len(t)) for i, t in cut.items()}
    groups = near(list(cut.items()), P.SHINGLE_WORDS, P.SIMILAR_PERCENT)
    left = P.near_dedup(spark, lines, SF)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {i for i, (_, c) in groups.items() if c == i}
    clean = P.decontamination(spark, left, SF)
    assert clean.columns == df.columns and clean.count() == left.count()  # invented words meet no benchmark
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r["text"] or "").split()) > 12)
    leaked = spark.createDataFrame([(777, item, "en", "a", len(item))], df.schema)
    assert 777 not in {r["doc_id"] for r in P.decontamination(spark, left.unionByName(leaked), SF).collect()}
    for _, stage in P.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
