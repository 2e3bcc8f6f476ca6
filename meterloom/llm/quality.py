"""Quality rules: statistics of texts, and robust multivariate outliers among them.

Each document gets a vector of transformed statistics. For each language and source, however few its documents are, a
minimum-covariance-determinant estimate is sought by concentration steps from two starts (medians with median deviations,
and means with covariances): again and again take the mean and covariance of the documents nearest to the last estimate,
until no determinant changes, and keep the start with the lesser one. Estimates are drawn towards the medians of all
documents by as much as PRIOR_ROWS documents would, which fades as a cell grows. Documents far from the final estimate by
Mahalanobis distance are rejected. All of it is column expressions and grouped aggregates; a step moves only sums of small
vectors.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import stored

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW = 5
#: Words that a ratio is smoothed by, so that short texts are not outliers for their shortness.
PSEUDO_WORDS = 50
#: Noise of each statistic, added to its spread: texts of the same kind differ by as much for their length alone.
FLOORS = (0.3, 0.5, 0.6, 0.7)
#: Documents that the common spread and the common centre count for in the estimate of a cell.
PRIOR_ROWS, PRIOR_CENTRE = 20.0, 2.0
#: Concentration steps at most; log determinants that change by less have settled.
MOST_STEPS, SETTLED = 10, 1e-3
#: Parts that the rows of a cell are dealt to when they meet its estimates, so that a hot cell is no single task.
SALTS = 32


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more, from the hashes of all words."""
    n = F.size(hashes) - WINDOW + 1

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def repeated(s: Column) -> Column:
        same = lambda x, k: (k > 0) & (F.get(s, k - 1)["g"] == x["g"]) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(p, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_bound(_bound(pairs, repeated), covered))

    return F.when(n < 2, F.lit(0)).otherwise(_bound(_bound(hashes, windows), count)).cast("long")


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text, and n_lines."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    return (
        df.withColumn("_text", t)
        .withColumn("_words", F.transform(F.array_remove(F.split("_text", SPACE), ""), lambda w: F.xxhash64(w)))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate("_text", SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", _repeat_words(F.col("_words")))
        .drop("_text", "_words", "_lines")
    )


def chi2_quantile(z: float, k: int) -> float:
    """Chi-squared quantile with k degrees of freedom at the normal quantile z (Wilson and Hilferty)."""
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def _vector(rows: DataFrame) -> DataFrame:
    """Adds x0.. : length of words in standard units, and logarithms of smoothed shares."""
    n = F.col("n_words") + PSEUDO_WORDS
    share = lambda count, per: F.log1p(100 * count / per)
    return rows.withColumns({
        "x0": (F.col("word_chars") + PSEUDO_WORDS * F.col("mean_chars")) / n,
        "x1": share(F.col("n_symbols"), n),
        "x2": share(F.col("n_dup_lines"), F.col("n_lines") + 5),
        "x3": share(F.col("n_repeat_words"), n),
    })


def _meet(rows: DataFrame, cells: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with the row of their cell; each cell is dealt to SALTS parts by id."""
    salted = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", "word_chars"), F.lit(SALTS)).cast("int")).join(salted, ["cell", "salt"], how).drop("salt")


def _distance(rows: DataFrame, fit: DataFrame, how: str = "inner") -> DataFrame:
    """rows with d2, the squared Mahalanobis distance under the fit of their cell, for each start of it."""
    d = len(FLOORS)
    solved: list[Column] = []
    for i in range(d):
        left = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            left = left - F.col(f"l{i}{j}") * F.col(f"y{j}")
        solved.append(left / F.col(f"l{i}{i}"))
    out = _meet(rows, fit, how)
    for i in range(d):
        out = out.withColumn(f"y{i}", solved[i])
    return out.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(d)]))


def _settled_fit(cells: DataFrame, prior: dict[str, float]) -> DataFrame:
    """(cell, start, centre m.., lower factor l.. of the covariance, logdet) from count n, centre m.. and covariance s..
    of the nearest rows of each cell, drawn towards the prior."""
    d, n = len(FLOORS), F.col("n")
    for i in range(d):
        cells = cells.withColumn(f"m{i}", (n * F.col(f"m{i}") + PRIOR_CENTRE * prior[f"m{i}"]) / (n + PRIOR_CENTRE))
    for i in range(d):
        for j in range(i + 1):
            rest = n * F.coalesce(F.col(f"s{i}{j}"), F.lit(0.0)) / (n + PRIOR_ROWS)
            if i == j:
                rest = rest + PRIOR_ROWS * prior[f"v{i}"] / (n + PRIOR_ROWS) + FLOORS[i] ** 2
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            cells = cells.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = reduce(lambda a, b: a + b, [F.log(f"l{i}{i}") for i in range(d)])
    factors = [f"l{i}{j}" for i in range(d) for j in range(i + 1)]
    return cells.select("cell", "start", *[f"m{i}" for i in range(d)], *factors, (2 * logdet).alias("logdet"))


def _moments(nearest: DataFrame, *keys: str) -> DataFrame:
    d = len(FLOORS)
    means = [F.avg(f"x{i}").alias(f"m{i}") for i in range(d)]
    covs = [F.covar_pop(f"x{i}", f"x{j}").alias(f"s{i}{j}") for i in range(d) for j in range(i + 1)]
    return nearest.groupBy(*keys).agg(F.count("*").alias("n"), *means, *covs)


def _middles(rows: DataFrame, *keys: str) -> DataFrame:
    """Count, medians m.. and variances s.. (by median deviations, no covariances) of the vectors of each key."""
    d = range(len(FLOORS))
    middle = stored(rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile_approx(f"x{i}", 0.5, 10_000).alias(f"m{i}") for i in d]))
    met = _meet(rows, middle) if keys else rows.join(F.broadcast(middle))
    spread = met.groupBy(*keys).agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 10_000).alias(f"a{i}") for i in d])
    both = middle.join(spread, list(keys)) if keys else middle.join(F.broadcast(spread))
    variances = [(F.pow(1.4826 * F.col(f"a{i}"), 2) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i in d for j in range(i + 1)]
    return both.select(*keys, "n", *[f"m{i}" for i in d], *variances)


def robust_fit(sound: DataFrame, share: float) -> DataFrame:
    """The estimate of each cell of the vectors x.. of sound documents, from the share of them that are nearest to it."""
    common = _middles(sound).first()
    if not common["n"]:
        prior = dict.fromkeys([f"{k}{i}" for k in "mv" for i in range(len(FLOORS))], 0.0)
    else:
        prior = {f"m{i}": common[f"m{i}"] for i in range(len(FLOORS))} | {f"v{i}": common[f"s{i}{i}"] for i in range(len(FLOORS))}
    starts = _middles(sound, "cell").withColumn("start", F.lit(0)).unionByName(_moments(sound, "cell").withColumn("start", F.lit(1)))
    fit = stored(_settled_fit(starts, prior))
    for step in range(MOST_STEPS):
        near = _distance(sound, fit)
        radius = stored(near.groupBy("cell", "start").agg(F.percentile_approx("d2", share, 10_000).alias("radius")))
        nearest = _distance(sound, fit.join(radius, ["cell", "start"])).where(F.col("d2") <= F.col("radius"))
        new = stored(_settled_fit(_moments(nearest, "cell", "start"), prior))
        change = new.join(fit.select("cell", "start", F.col("logdet").alias("before")), ["cell", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        fit = new
        # the first step leaves the starts, whose determinants are of another kind
        if step and (change is None or change < SETTLED):
            break
    best = F.min_by(F.struct(*[c for c in fit.columns if c != "cell"]), F.struct(F.round("logdet", 9), "start"))
    return stored(fit.groupBy("cell").agg(best.alias("fit")).select("cell", "fit.*"))


def outliers(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"),
    share: float = 0.75, z: float = 5.0, min_words: int = 10, max_repeat: int = 20,
) -> DataFrame:
    """One row for each row of df: id, the statistics, base_failed, distance and kept.

    base_failed: fewer than min_words words, or over max_repeat in 100 of them repeated. Other documents are rejected
    when their squared distance exceeds the chi-squared quantile at z standard deviations, after scaling distances down
    where their median is above that of chi-squared. Cells are the values of group_cols (null is a value), of any size. A
    null or empty text has no words and fails; very long texts are taken whole; repeated rows are each judged, and equal
    distances judged alike; an empty table gives an empty result; further columns are ignored, whatever their names.
    """
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("~"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.concat_ws("\x00", *map(value, group_cols)).alias("cell"))
    stats = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words".split()
    rows = statistics(rows).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    rows = stored(rows.select("id", *stats, "base_failed", "cell"))
    mean = stored(rows.where(~F.col("base_failed")).groupBy("cell").agg((F.sum("word_chars") / F.sum("n_words")).alias("mean_chars")))
    rows = stored(_vector(_meet(rows, mean, "left").na.fill(0.0, ["mean_chars"])).select("id", *stats, "base_failed", "cell", *[f"x{i}" for i in range(len(FLOORS))]))
    sound = rows.where(~F.col("base_failed"))
    fit = robust_fit(sound, share)
    scale = stored(_distance(sound, fit).groupBy("cell").agg(F.percentile_approx("d2", 0.5, 10_000).alias("middle")))
    typical = chi2_quantile(0.0, len(FLOORS))
    judged = _distance(rows, fit.join(scale, "cell"), "left").withColumn("d2", F.col("d2") * typical / F.greatest("middle", F.lit(typical)))
    # only cells without any sound document have no estimate, and none of theirs is kept
    near = F.coalesce(F.col("d2") <= chi2_quantile(z, len(FLOORS)), F.lit(False))
    return judged.select(F.col("id").alias(id_col), *stats, "base_failed", F.sqrt("d2").alias("distance"), (~F.col("base_failed") & near).alias("kept"))
