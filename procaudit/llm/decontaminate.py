"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every run of ``WINDOW - K + 1`` consecutive k-gram hashes the least is a fingerprint, so two texts that share
``WINDOW`` words share one. The distinct fingerprints of each document meet the benchmark's in a join; an item of fewer
words than a window is met by the hash of its longest word instead. Texts with a meeting, each once however many
documents hold it, have the places of those hashes extended to whole windows and items, which are compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procaudit.llm.common import ascii_lower, saved

WINDOW = 10
K = 5
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, k: int) -> Column:
    """From the words' hashes that of the k words from each place on."""
    return F.transform(places(F.size(hashes) - k + 1), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def minima(grams: Column, span: int) -> Column:
    """The distinct least hashes of each ``span`` consecutive ones."""
    return F.array_distinct(F.transform(places(F.size(grams) - span + 1), lambda i: F.least(*[F.get(grams, i + j) for j in range(span)]) if span > 1 else F.get(grams, i)))


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, n, gram, words): every window of every item; an item of fewer words is one window."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = items.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    return starts.select("item", "n", F.slice("w", F.col("i"), F.col("n")).alias("words")).select("item", "n", F.array_join("words", " ").alias("gram"), "words").distinct()


TEXT_KEYS = ["k1", "k2"]


def text_keys(text: str) -> list[Column]:
    """Two 64-bit hashes: what is found depends on a row's text alone."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def candidate_windows(docs: DataFrame, windows: DataFrame, text: str, window: int, k: int) -> DataFrame:
    """(k1, k2, s, n, gram): the places of each distinct text that may hold a benchmark window, a superset of the
    hits: equal text decides later."""
    span = window - k + 1
    # arrays that a lambda looks into are columns of their own, or they would be made anew at every place
    prints = windows.where(F.col("n") == window).select(word_hashes(F.col("words")).alias("hw")).select(F.array_min(gram_hashes(F.col("hw"), k)).alias("h")).distinct()
    short = windows.where(F.col("n") < window)
    longest = F.array_max(F.transform("words", lambda w, i: F.struct(F.length(w).alias("chars"), F.xxhash64(w).alias("h"), i.alias("at"))))
    short = short.select("n", longest.alias("m")).select("n", F.col("m.h").alias("h"), F.col("m.at").alias("at")).distinct()
    some_short = not short.isEmpty()

    rows = docs.select(*text_keys(text), F.col(text).alias("body"))
    split = rows.select(*TEXT_KEYS, word_hashes(words_of(F.col("body"))).alias("hw"))
    met = split.select(*TEXT_KEYS, gram_hashes(F.col("hw"), k).alias("grams")).select(*TEXT_KEYS, F.explode(minima(F.col("grams"), span)).alias("h")).join(prints, "h").select(*TEXT_KEYS, "h", F.lit(window).alias("n"), F.lit(-1).alias("at"))
    if some_short:
        words = split.select(*TEXT_KEYS, F.explode(F.array_distinct("hw")).alias("h"))
        met = met.unionByName(words.join(short, "h").select(*TEXT_KEYS, "h", "n", "at"))
    met = met.groupBy(*TEXT_KEYS).agg(F.collect_set(F.struct("h", "n", "at")).alias("met"))
    texts = rows.groupBy(*TEXT_KEYS).agg(F.first("body").alias("body"))  # copies become one before they move
    tried = texts.join(met, TEXT_KEYS).select(*TEXT_KEYS, "met", words_of(F.col("body")).alias("w"))
    tried = tried.withColumn("hw", word_hashes(F.col("w"))).withColumn("h", gram_hashes(F.col("hw"), k))

    last = F.size("w") - window
    tried = tried.withColumn("known", F.transform(F.filter("met", lambda m: m["at"] < 0), lambda m: m["h"]))
    anchors = F.filter(places(F.size("h")), lambda i: F.array_contains("known", F.get("h", i)))
    reach = F.flatten(F.transform(anchors, lambda p: F.sequence(F.greatest(p - (window - k), F.lit(0)), F.least(p, last))))
    spots = F.transform(F.array_distinct(reach), lambda s: F.struct(s.alias("s"), F.lit(window).alias("n")))
    if some_short:
        around = lambda m: F.transform(F.filter(places(F.size("hw")), lambda i: F.get("hw", i) == m["h"]), lambda i: F.struct((i - m["at"]).alias("s"), m["n"].alias("n")))
        items = F.flatten(F.transform(F.filter("met", lambda m: m["at"] >= 0), around))
        spots = F.concat(F.when(last >= 0, spots).otherwise(F.array().cast("array<struct<s:int,n:int>>")), F.array_distinct(F.filter(items, lambda x: (x["s"] >= 0) & (x["s"] + x["n"] <= F.size("w")))))
    else:
        spots = F.when(last >= 0, spots)
    tried = tried.select(*TEXT_KEYS, "w", F.explode(spots).alias("x"))
    return tried.select(*TEXT_KEYS, "x.s", "x.n", F.array_join(F.slice("w", F.col("x.s") + 1, F.col("x.n")), " ").alias("gram"))


def covered(spans: Column) -> Column:
    """How many places the (start, length) spans, sorted by start, cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc, x):
        end = F.greatest(acc["end"], x["s"] + x["n"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], x["s"])).alias("n"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int, k: int) -> DataFrame:
    """(k1, k2, spans, items) of each distinct text that holds a benchmark window, written, so that a join with it can
    split what many rows of one text make."""
    windows = saved(benchmark_windows(benchmark, item_id, item_text, window), "benchmark-windows")
    by_gram = windows.groupBy("n", "gram").agg(F.collect_set("item").alias("held_by"))
    hits = candidate_windows(docs, windows, text, window, k).join(by_gram, ["n", "gram"])
    found = hits.groupBy(*TEXT_KEYS).agg(F.array_sort(F.collect_set(F.struct("s", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("held_by")))).alias("items"))
    return saved(found, "contaminated-texts")


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """A row per row of ``docs``: its id, ``n_words``, ``n_hit`` (words inside any occurrence of a benchmark window),
    ``n_items``, ``items`` (ids as text, sorted) and ``contaminated``.

    Defined cases: null and empty texts have no words; very long texts are searched whole; an item without words
    matches nothing, one of fewer than ``window`` words is one window; items that share a window all count, and rows
    of one item id are one item; a null item id counts as the empty id; repeated document rows are judged each for
    itself; ties need no rule; other columns are not read, whatever their names; an empty table gives no rows, an empty
    benchmark no hits.
    """
    found = contaminated_texts(docs, benchmark, text, item_id, item_text, window, k)
    n_words = F.size(words_of(F.col("body")))
    rows = docs.select(F.col(doc_id).alias("id"), *text_keys(text), F.col(text).alias("body")).select("id", *TEXT_KEYS, n_words.cast("long").alias("n_words")).join(found, TEXT_KEYS, "left")
    return rows.select(
        F.col("id").alias(doc_id), "n_words", F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("spans").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` without its contaminated rows, columns unchanged; see ``find_contamination`` for the defined cases."""
    bad = contaminated_texts(docs, benchmark, text, item_id, item_text, window, k).alias("b")
    d, keys = docs.alias("d"), text_keys(f"d.`{text}`")
    return d.join(bad, (keys[0] == F.col("b.k1")) & (keys[1] == F.col("b.k2")), "left_anti")
