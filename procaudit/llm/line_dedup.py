"""Line de-duplication over the whole corpus, in DataFrame functions only.

Texts are split and hashed once. Line hashes are range-partitioned by hash and document, so a line of however many
documents lies in as many ranges as its occurrences fill, and sorted in each by hash, document and position. One pass
over a range takes the first occurrence in each document and knows each line's documents and the last of them; what the
ranges know of a line is put together, a row a line and range. What comes back for a document is a run-length-compressed
bitmap; texts are cut only where a caller asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procaudit.llm.common import BLANKS, ascii_lower, saved

MIN_KEY_CHARS = 40
MIN_DOCUMENTS = 5


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A null id ranks below every other; rows of one id and one text share their decisions."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("_doc"), F.xxhash64(text).alias("_text"), F.col(text).alias("_body"))


def keyed_lines(docs: DataFrame, doc_id: str, text: str, min_key_chars: int) -> DataFrame:
    """(_doc, _text, pos, h1, h2) of every line whose key is long enough; keys are compared by two 64-bit hashes."""
    key = F.col("_key")
    lines = _keyed(docs, doc_id, text).select("_doc", "_text", F.posexplode(lines_of(F.col("_body"))).alias("pos", "_line"))
    lines = lines.select("_doc", "_text", "pos", line_key(F.col("_line")).alias("_key")).where(F.length(key) >= min_key_chars)
    return lines.select("_doc", "_text", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_key_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(_doc, _text, pos): the 0-based lines to drop."""
    lines = saved(keyed_lines(docs, doc_id, text, min_key_chars), "line-hashes")
    ranges = lines.select("h1", "h2", "_doc", "pos").repartitionByRange("h1", "h2", "_doc").sortWithinPartitions("h1", "h2", "_doc", "pos")
    in_document = Window.partitionBy("h1", "h2", "_doc").orderBy("pos")
    first = ranges.withColumn("place", F.row_number().over(in_document)).where("place = 1")
    decided = first.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("_doc").alias("keeper")).where(F.col("n_docs") >= min_documents)
    decided = saved(decided, "line-keepers")  # a plain table on this side, so that Spark can split a line of many documents
    return lines.join(decided, ["h1", "h2"]).where(F.col("_doc") != F.col("keeper")).select("_doc", "_text", "pos")


def runs_of(places: Column) -> Column:
    """Maximal runs (start, length) of sorted distinct places."""
    starts = F.filter(places, lambda x, i: (i == 0) | (F.get(places, i - 1) != x - 1))
    ends = F.filter(places, lambda x, i: (i == F.size(places) - 1) | (F.get(places, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """(_doc, _text, n_dropped, gone) per document that loses lines: the zeros of its keep bitmap as runs."""
    places = F.array_sort(F.collect_set("pos"))
    found = dropped_lines(docs, doc_id, text, **limits).groupBy("_doc", "_text").agg(places.alias("places"))
    return found.select("_doc", "_text", F.size("places").alias("n_dropped"), runs_of(F.col("places")).alias("gone"))


def keep_runs(gone: Column, n_lines: Column) -> Column:
    """The ones of the bitmap: (1-based start, length) of each maximal run of kept lines."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform(gone, lambda r: r["start"]), F.array(n_lines))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct((s + 1).alias("start"), (e - s).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_key_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with ``text`` cut, and ``n_lines``, ``n_dropped`` and ``keep`` (the run-length bitmap) added.

    A key is a line without blanks at both ends, A-Z lower-cased. Keys of at least ``min_key_chars`` code points in
    at least ``min_documents`` documents keep only the lines in the largest ``doc_id`` that holds them.

    Defined cases: a null or empty text is one empty line and never loses it (a null text stays null); very long texts
    and lines are taken whole, and of one document's equal lines all go or all stay; repeated
    rows of one id are one document and lose the same lines; a null id is one document that ranks lowest; an empty
    table gives no rows; other columns, whatever their names, come back as they were, except that existing columns
    called ``n_lines``, ``n_dropped`` or ``keep`` are replaced.
    """
    bitmaps = keep_bitmaps(docs, doc_id, text, min_key_chars=min_key_chars, min_documents=min_documents)
    others = [F.col(f"d.`{c}`") for c in docs.columns if c not in (text, "n_lines", "n_dropped", "keep")]
    same = (F.coalesce(F.col(f"d.`{doc_id}`").cast("long"), F.lit(-(2**63))) == F.col("b._doc")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("b._text"))
    body, lines = F.col(f"d.`{text}`"), lines_of(F.col(f"d.`{text}`"))
    runs = keep_runs(F.col("b.gone"), F.size(lines))
    kept = F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"], r["length"]))), "\n")
    out = docs.alias("d").join(bitmaps.alias("b"), same, "left").select(
        *others,
        F.when(F.col("b.gone").isNull(), body).otherwise(kept).alias(text),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("b.n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(runs, F.array(F.struct(F.lit(1).alias("start"), F.size(lines).alias("length")))).alias("keep"),
    )
    return out.select(*[F.col(f"`{c}`") for c in [*docs.columns, *[c for c in ("n_lines", "n_dropped", "keep") if c not in docs.columns]]])
