"""The queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procaudit.llm.common import scratch_path
    from procaudit.llm.warc import archive_pages

    out = archive_pages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procaudit.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procaudit.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procaudit.llm.repeats import remove_repeats

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procaudit.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procaudit.llm.decontaminate import find_contamination

    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procaudit.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procaudit.llm.topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procaudit.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procaudit.llm.kneser_ney import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procaudit.llm.periodic import collapse_runs, split_column

    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        """Words from place a on repeat those from a to a + p."""
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n == 0, "").otherwise(F.array_join(F.slice(F.concat(F.slice(words, 1, a), tail), 1, n), " "))

    text = F.when(h % 10 == 0, F.get(F.transform(F.array(split_column(F.col("text"))), planted), F.lit(0))).otherwise(F.col("text"))
    found = collapse_runs(docs.select("doc_id", text.alias("text")))

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,period:bigint,length:bigint>"), better)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procaudit.llm.common import saved
    from procaudit.llm.prefix_trie import trie_nodes, turn_sequences

    own = saved(turn_sequences(table(spark, sf_dir, "conversations")), "conversations")
    heads = own.where("conv % 20 = 0").select(F.col("conv").alias("base"), F.slice("ids", 1, 3).alias("h_ids"), F.slice("words", 1, 3).alias("h_words"))
    rows = own.join(heads, F.col("conv") - F.col("conv") % 20 == F.col("base"), "left").withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).cast("int"))

    def spliced(head: str, turns: str) -> Column:
        first = F.when(F.col(head).isNull() | (F.col("h") == 0), F.slice(turns, 1, 0)).otherwise(F.slice(head, 1, F.col("h")))
        return F.concat(first, F.slice(turns, F.col("h") + 1, F.size(turns))).alias(turns)

    return trie_nodes(rows.select("conv", spliced("h_ids", "ids"), spliced("h_words", "words")))


def op13_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procaudit.llm.spotsigs import common_words, fingerprints, with_next

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    anchors = common_words(docs)
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = with_next(docs).select(F.col("doc").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), "text", "next")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next", F.lit(1), cut)))
    out = fingerprints(rows.withColumn("edited_sha256", F.sha2("edited", 256)), anchors, "text", ("edited", "next"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_archives, op2_toxicity, op3_source_mixing, op4_suffix_dedup, op5_line_dedup, op6_decontamination, op7_ngram_join, op8_exact_topk, op9_quality, op10_lm_scoring, op11_periodic_runs, op12_prefix_trie, op13_spotsigs)}


BLANKS_SQL = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
LOWER_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "op1_warc_archives": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
 k AS (SELECT digest, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
 CASE WHEN page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (digest)""",
    "op5_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
 k AS (SELECT *, translate(trim(line, {BLANKS_SQL}), {LOWER_SQL}) AS key FROM l),
 hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
 m AS (SELECT k.*, hot.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER_SQL}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {LOWER_SQL}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
 g AS (SELECT item, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0),
 win AS (SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS gram FROM g),
 ns AS (SELECT DISTINCT n FROM win),
 p AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n),
 h AS (SELECT doc_id, s, n, item FROM (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS gram FROM p) JOIN win USING (n, gram)),
 c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM h) GROUP BY doc_id),
 i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op7_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER_SQL}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS gram FROM d WHERE len(w) > 0)),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
 l AS MATERIALIZED (SELECT a, b FROM o JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * common >= 85 * (p.n + q.n - common)),
 r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op8_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_prefix_trie": """
WITH own AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(strlen(role), ':', role, text))) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
 h AS (SELECT DISTINCT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
   lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h FROM own),
 t AS (SELECT h.c, 0 AS part, i, role, text FROM h JOIN own o ON o.c = h.c - h.c % 20 AND i <= h UNION ALL SELECT h.c, 1, i, role, text FROM h JOIN own o ON o.c = h.c AND i > h),
 d AS (SELECT c, row_number() OVER w AS depth, md5(concat(strlen(role), ':', role, text)) AS id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM t WINDOW w AS (PARTITION BY c ORDER BY part, i)),
 p AS MATERIALIZED (SELECT c, depth, string_agg(id, '') OVER (PARTITION BY c ORDER BY depth) AS path, words FROM d UNION ALL SELECT c, 0, '', 0 FROM h),
 n AS MATERIALIZED (SELECT depth, path, min(c) AS least, count(*) AS n FROM p GROUP BY ALL),
 k AS MATERIALIZED (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS kids FROM n WHERE depth > 0 GROUP BY ALL),
 m AS (SELECT p.*, least, kids, CASE WHEN c = least THEN 0 ELSE words END AS extra, depth = max(depth) OVER (PARTITION BY c) AS ends FROM p JOIN n USING (depth, path) LEFT JOIN k USING (path)),
 s AS (SELECT *, sum(extra) OVER (PARTITION BY c ORDER BY depth DESC) AS saved, max(CASE WHEN ends AND c = least AND kids IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY c) AS leaf FROM m),
 g AS (SELECT depth, path, any_value(least) AS least, count(*) AS n_convs, any_value(kids) AS kids, sum(leaf) AS leaves, sum(saved) AS saved, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS ids FROM s GROUP BY depth, path)
SELECT g.least AS conv_id, g.depth, u.least AS parent_conv_id, n_convs, coalesce(kids, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM g LEFT JOIN n u ON g.depth > 0 AND u.depth = g.depth - 1 AND u.path = left(g.path, 32 * (g.depth - 1))""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
