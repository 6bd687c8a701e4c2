"""Mixing sources to target weights.

Weights are the sources' token shares to a power, normalised; the power is found by bisection so that the weights
reach a target entropy and no source repeats more often than allowed. Sources are a table, however many, and a step of
the bisection is one aggregate over it. A token budget is then realised per source
and epoch: documents are dealt to blocks by hash, blocks are taken in a pseudo-random order until the source's
budget is met, and only the block in which it is met is cut, by the order of its own documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procaudit.llm.common import saved
from procaudit.llm.tokens import pieces, split_words

#: Share of the largest possible entropy that the weights are to reach, and epochs of a source at most.
TARGET_ENTROPY, MAX_EPOCHS = 0.98, 4.0
BLOCK_TOKENS = 1 << 20
SEED = 11
#: Points that a step of the bisection tries at once, and steps: together the power is found to 2 ** -48.
GRID, STEPS = 64, 8
#: Blocks of an epoch are summed up to so many parts of its permutation before they are ranked in them.
PERMUTATION_BITS = 10


def weight_of(tokens: Column, total: float, power: Column | float) -> Column:
    """A source's weight before it is normalised."""
    return F.exp(F.lit(power) * F.log(tokens / total))


def measured(totals: DataFrame, total: float, budget: float, powers: list[float]) -> list[tuple[float, float, float]]:
    """(sum of weights, entropy, repeats of the source that repeats most) at each of ``powers``, in their order."""
    spark = totals.sparkSession
    grid = F.broadcast(spark.createDataFrame(list(enumerate(powers)), "k int, power double"))  # GRID rows
    w, share = weight_of(F.col("t"), total, F.col("power")), F.log(F.col("t") / total)
    sums = totals.crossJoin(grid).select("k", "t", w.alias("w"), share.alias("share")).groupBy("k").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("share")).alias("l"), F.max(F.col("w") / F.col("t")).alias("r")).collect()
    at = {r["k"]: r for r in sums}
    return [(at[k]["z"], math.log(at[k]["z"]) - p * at[k]["l"] / at[k]["z"], budget * at[k]["r"] / at[k]["z"]) for k, p in enumerate(powers)]


def fit_power(totals: DataFrame, budget: float, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS) -> tuple[float, float]:
    """(power, sum of weights) for sources (t): the largest power in 0..1 whose weights have ``target_entropy`` of
    log(sources), or, where that would repeat a source more than ``max_epochs`` times, the least power that does not; 1
    where no power keeps to the limit."""
    size = totals.agg(F.sum("t").alias("t"), F.count("*").alias("n")).first()
    total, wanted = float(size["t"]), target_entropy * math.log(size["n"])

    def grid(low: float, high: float) -> list[float]:
        return [low + (high - low) * k / GRID for k in range(GRID + 1)]

    whole = measured(totals, total, budget, grid(0.0, 1.0))

    def bisect(holds) -> tuple[float, float, float]:
        """The boundary of ``holds``, true at 0 and false at 1, with the sum of weights and the repeats there."""
        low, high, found = 0.0, 1.0, whole
        for step in range(STEPS):
            found = found if not step else measured(totals, total, budget, grid(low, high))
            k = next((k for k in range(1, GRID) if not holds(found[k])), GRID) - 1
            edges = grid(low, high)
            low, high = edges[k], edges[k + 1]
        return low, found[k][0], found[k][2]

    even = lambda m: m[1] >= wanted - 1e-12
    power, z, repeats = (1.0, whole[-1][0], whole[-1][2]) if even(whole[-1]) else bisect(even)
    if repeats > max_epochs:
        power, z, _ = (1.0, *whole[-1][::2]) if whole[-1][2] > max_epochs else bisect(lambda m: m[2] > max_epochs)
    return power, z


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        offsets, _, _ = split_words(batch.column(batch.num_columns - 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(offsets), pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, source, n_tokens, epoch, block, block_rank, weight, power): a row per document and epoch
    in which the mixture takes it; ``block_rank`` is the block's place in that epoch's permutation, and documents
    of a block follow in the order of ``xxhash64(seed, epoch, doc_id, text_key)``.

    ``budget`` defaults to all tokens of the input. A source stops with the document that meets its budget. Defined
    cases: a null source is a source of its own; a very long text is one document of one block; texts without words (null, empty) have no tokens and are taken in
    every epoch whose budget is not yet met before them; repeated rows are documents each, in one block; ties in a
    permutation go to the smaller block; other columns are not read; without tokens there are no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_key"), F.col(source).cast("string").alias("_source"), F.col(text).cast("string").alias("_text"))
    sized = rows.mapInArrow(_count, "_id long, _key long, _source string, n_tokens long")
    totals = saved(sized.groupBy("_source").agg(F.sum("n_tokens").alias("t")).where(F.col("t") > 0), "source-totals")
    total = totals.agg(F.sum("t")).first()[0]
    wanted = float(budget if budget is not None else total or 0)
    power, z = fit_power(totals, wanted, target_entropy, max_epochs) if total else (1.0, 1.0)
    weight = weight_of(F.col("t"), float(total or 1), power) / z
    plan = totals.select(F.col("_source").alias("s0"), "t", weight.alias("weight"), F.lit(power).alias("power"), (F.lit(wanted) * weight).alias("quota"), F.ceil(F.col("t") / block_tokens).alias("blocks"))
    plan = plan.withColumn("epochs", F.ceil(F.col("quota") / F.col("t") - 1e-9).cast("int")).drop("t")
    dealt = sized.join(plan, sized["_source"].eqNullSafe(F.col("s0"))).drop("s0")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "_id", "_key"), F.col("blocks")))

    epochs = F.explode(F.sequence(F.lit(1), F.greatest("epochs", F.lit(1)))).alias("epoch")
    blocks = dealt.groupBy("_source", "block", "epochs", "quota").agg(F.sum("n_tokens").alias("block_tokens")).select("_source", "block", "quota", "block_tokens", epochs)
    blocks = blocks.withColumn("turn", F.xxhash64(F.lit(seed), "epoch", "block")).withColumn("part", F.shiftright("turn", 64 - PERMUTATION_BITS))
    # running sums in two steps: over a source's parts of permutations, then over the blocks of a part
    parts = blocks.groupBy("_source", "epoch", "part").agg(F.sum("block_tokens").alias("tokens"), F.count("*").alias("n"))
    so_far = lambda x, *by: F.sum(x).over(Window.partitionBy(*by[:-1]).orderBy(*by[-1])) - F.col(x)
    parts = parts.select(F.col("_source").alias("s1"), F.col("epoch").alias("e1"), F.col("part").alias("p1"), so_far("tokens", "_source", ["epoch", "part"]).alias("tokens_before"), so_far("n", "_source", "epoch", ["part"]).alias("n_before"))
    placed = blocks.join(parts, F.col("_source").eqNullSafe(F.col("s1")) & (F.col("epoch") == F.col("e1")) & (F.col("part") == F.col("p1")))
    inside = Window.partitionBy("_source", "epoch", "part").orderBy("turn", "block")
    ranked = placed.select("*", (F.col("tokens_before") + F.sum("block_tokens").over(inside) - F.col("block_tokens")).alias("before"), (F.col("n_before") + F.row_number().over(inside)).cast("int").alias("block_rank"))
    taken = ranked.where(F.col("before") < F.col("quota")).select(F.col("_source").alias("s2"), F.col("block").alias("b2"), "epoch", "block_rank", "before", (F.col("before") + F.col("block_tokens") > F.col("quota")).alias("cut"))
    placed = dealt.join(taken, dealt["_source"].eqNullSafe(F.col("s2")) & (dealt["block"] == F.col("b2"))).drop("s2", "b2")
    inside = Window.partitionBy("_source", "epoch", "block").orderBy(F.xxhash64(F.lit(seed), "epoch", "_id", "_key"), "_id", "_key").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where("cut").withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where(F.col("at") < F.col("quota")).drop("at")
    kept = placed.where(~F.col("cut")).unionByName(cut)
    return kept.select(F.col("_id").alias(doc_id), F.col("_key").alias("text_key"), F.col("_source").alias(source), "n_tokens", "epoch", "block", "block_rank", "weight", "power")
