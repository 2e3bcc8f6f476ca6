"""Mixing sources to target weights by temperature.

Shares of source tokens are raised to an exponent and normalised. The exponent is bisected to the largest one (nearest to
the natural mix) that meets a target entropy and a limit of repetition. Each source then has a budget of tokens, which
passes over permutations of its blocks fill: whole passes, and of the last one the blocks and rows that still fit.

Each round of the search evaluates many exponents in one aggregate over the table of sources, as several steps of
bisection at once; only the chosen interval reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.llm.common import stored

ROUNDS, PARTS = 8, 32
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 2000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bisect_exponent(sources: DataFrame, total: float, budget: float, least_entropy: float | None, most_passes: float | None) -> tuple[float, float]:
    """(exponent, sum of powers) for sources with column share: the largest exponent from 0 to 1 that meets the targets.

    Entropy falls and the repetition of the smallest sources falls too as the exponent rises, so the entropy target is
    an upper bound of the exponent and the repetition limit a lower one; where both can't hold the limit wins.
    """

    def measured(exponents: list[float]) -> list[tuple[float, float, float]]:
        def power(e: float) -> Column:
            return F.exp(e * F.log("share"))

        sums = sources.agg(*[F.sum(power(e)).alias(f"z{i}") for i, e in enumerate(exponents)], *[F.sum(power(e) * e * F.log("share")).alias(f"u{i}") for i, e in enumerate(exponents)], *[F.max(power(e) / F.col("share")).alias(f"r{i}") for i, e in enumerate(exponents)]).first()
        out = []
        for i in range(len(exponents)):
            z, u, r = sums[f"z{i}"], sums[f"u{i}"], sums[f"r{i}"]
            # ln z - sum(p^e ln p^e) / z is the entropy; budget * weight / tokens the passes
            out.append((z, math.log(z) - u / z, r / z * budget / total))
        return out

    def largest(holds) -> float:
        """The largest exponent for which holds is true, if it is true below and false above."""
        low, high = 0.0, 1.0
        if holds(measured([1.0])[0]):
            return 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / PARTS for k in range(PARTS + 1)]
            fine = [holds(m) for m in measured(grid)]
            k = max((i for i, ok in enumerate(fine) if ok), default=0)
            low, high = grid[k], grid[min(k + 1, PARTS)]
            if low == high:
                break
        return low

    exponent = 1.0 if least_entropy is None else largest(lambda m: m[1] >= least_entropy)
    if most_passes is not None and measured([exponent])[0][2] > most_passes * (1 + 1e-12):
        exponent = _smallest(measured, lambda m: m[2] <= most_passes)
    return exponent, measured([exponent])[0][0]


def _smallest(measured, holds) -> float:
    low, high = 0.0, 1.0
    if not holds(measured([1.0])[0]):
        return 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / PARTS for k in range(PARTS + 1)]
        fine = [holds(m) for m in measured(grid)]
        k = min((i for i, ok in enumerate(fine) if ok), default=PARTS)
        low, high = grid[max(k - 1, 0)], grid[k]
        if low == high:
            break
    return high


def source_weights(rows: DataFrame, budget: float | None, entropy: float | None, most_passes: float | None) -> DataFrame:
    """(source, rows, tokens, weight, budget, passes) for rows (source, tokens); sources without tokens get no budget."""
    sources = stored(rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens")))
    total, n = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.when(F.col("tokens") > 0, 1))).first()
    spoken = sources.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    budget = float(total if budget is None else budget)
    exponent, z = 1.0, 1.0
    if n:
        least = None if entropy is None else entropy * math.log(n)
        exponent, z = bisect_exponent(spoken, float(total), budget, least, most_passes)
    weight = F.exp(exponent * F.log("share")) / F.lit(z)
    return stored(
        spoken.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * budget + 1e-6)).withColumn("passes", F.col("budget") / F.col("tokens"))
        .select("source", "rows", "tokens", "weight", "budget", "passes")
    )


def _keyed(df: DataFrame, id_col: str, source_col: str, seed: int) -> list[Column]:
    source = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("~"))
    return [source.alias("source"), F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)).alias("h")]


def _turn(seed: int) -> Column:
    """Where a block stands in the permutation of a pass."""
    return F.xxhash64("block", "epoch", F.lit(seed))


def _inner(seed: int) -> Column:
    """Where a row stands in its block in a pass; rows of one id stand together."""
    return F.xxhash64("h", "epoch", F.lit(seed))


class Mixture:
    """Weights, budgets and permutations for a table of documents.

    budget: tokens of the mix (all tokens of df if None). entropy: the least entropy of the weights, as a part of that of
    equal weights; most_passes: the most passes over any source. The exponent stays as near to 1 as these permit; if they
    exclude each other the repetition limit stands. A null source is a source. Rows without words use no budget, and a
    source of only such rows has no share and none of its rows is taken. Rows of one id and source are taken together.
    Every source keeps to its budget, and falls short of it by less than one id's rows.
    """

    def __init__(
        self, df: DataFrame, budget: float | None = None, entropy: float | None = 0.98, most_passes: float | None = 4.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_rows: int = BLOCK_ROWS, seed: int = 0,
    ):
        self.names, self.seed = (id_col, source_col, seed), seed
        tokens = word_count(F.col(f"`{text_col}`")).alias("tokens")
        self.rows = stored(df.select(F.col(f"`{id_col}`").alias("id"), tokens, *_keyed(df, *self.names)))
        self.weights = source_weights(self.rows, budget, entropy, most_passes)
        blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / block_rows)).cast("long").alias("n_blocks")
        last = F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("last")
        plan = self.weights.select("source", "budget", F.col("tokens").alias("all"), blocks, last)
        placed = self.rows.join(plan, "source").withColumn("block", F.pmod("h", "n_blocks"))
        sizes = placed.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
        steps = sizes.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("turn", _turn(seed))
        order = Window.partitionBy("source", "epoch").orderBy("turn", "block")
        self.steps = stored(steps.withColumn("start", F.col("epoch") * F.col("all") + F.sum("size").over(order) - F.col("size")))
        # of the last pass, the first block that doesn't fit whole, and the first row in it that doesn't fit
        broken = self.steps.where((F.col("epoch") == F.col("last")) & (F.col("start") + F.col("size") > F.col("budget")))
        broken = broken.groupBy("source").agg(F.min_by(F.struct("turn", "block", "epoch", "start"), F.struct("turn", "block")).alias("cut"))
        edge = placed.join(broken, "source").where(F.col("block") == F.col("cut.block")).withColumn("epoch", F.col("cut.epoch")).withColumn("inner", _inner(seed))
        peers = Window.partitionBy("source").orderBy("inner").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        edge = edge.withColumn("end", F.col("cut.start") + F.sum("tokens").over(peers)).where(F.col("end") > F.col("budget"))
        edge = edge.groupBy("source").agg(F.min("inner").alias("cut_inner"))
        self.plan = stored(plan.join(broken, "source").join(edge, "source").select("*", F.col("cut.turn").alias("cut_turn"), F.col("cut.block").alias("cut_block")).drop("cut"))

    def take(self, keyed: DataFrame) -> DataFrame:
        """Rows (source, h, ...) once for each pass that takes them, with epoch, block and budget: a filter of each row
        by the plan of its source, without moving rows."""
        rows = keyed.join(self.plan, "source").withColumn("block", F.pmod("h", "n_blocks"))
        rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("turn", _turn(self.seed))
        before = (F.col("turn") < F.col("cut_turn")) | ((F.col("turn") == F.col("cut_turn")) & (F.col("block") < F.col("cut_block")))
        within = (F.col("block") == F.col("cut_block")) & (_inner(self.seed) < F.col("cut_inner"))
        return rows.where((F.col("epoch") < F.col("last")) | before | within).drop("turn", "cut_turn", "cut_block", "cut_inner", "last", "n_blocks", "all")

    def documents(self, df: DataFrame) -> DataFrame:
        """The rows of df, with its columns, as often as the mix takes them."""
        packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_keyed(df, *self.names))
        return self.take(packed).select("row.*")

    def listed(self) -> DataFrame:
        """(id, source, tokens, epoch, position): position is the part of its source's budget that comes before the row,
        so rows in its order come from all sources in proportion to the weights."""
        starts = self.steps.select("source", "epoch", "block", "start")
        taken = self.take(self.rows).join(starts, ["source", "epoch", "block"])
        order = Window.partitionBy("source", "epoch", "block").orderBy(_inner(self.seed), "h", "tokens").rowsBetween(Window.unboundedPreceding, 0)
        before = F.col("start") + F.sum("tokens").over(order) - F.col("tokens")
        return taken.select("id", "source", "tokens", "epoch", (before / F.col("budget")).alias("position"))
