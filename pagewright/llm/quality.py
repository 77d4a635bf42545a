"""Operator 1: robust multivariate outliers by minimum-covariance-determinant estimates, in DataFrame functions only.

The statistic vectors of each (language, source) are summed up in cells of a fine grid, so the search for the subset
of least determinant reads the cells and not the documents. From several starts (medians, the classical estimate,
small random draws) concentration steps refit centre and covariance to the innermost HALF until no determinant falls
any more; the lowest one wins and is reweighted once. Estimates of small groups are drawn towards that of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, stage_table

WINDOW = 8
SYMBOLS = "#*$%&|<>"
D = 4  # features: log word length, symbols a word, log duplicate lines, root of the repeated share
#: Added to the standard deviations (as squares): most texts have no symbol, duplicate or repeat at all, and without
#: these a single one would lie infinitely far out.
FLOORS = (0.05, 0.03, 0.3, 0.1)
#: Cells of the grid to a unit of each feature; a cell carries its exact sums.
GRID = (256, 512, 16, 256)
HALF = 0.75
REWEIGHT = 0.975
DRAWS = 4  # random starts, of D + 1 points each
FALL = 1e-3  # a determinant that falls by less has converged
PRIOR = 100.0  # rows that the estimate of all rows counts for in each group
TAIL = 1e-4
ALL = "*"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _apart(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of docs in one struct beside the text, so that no name of theirs meets one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(text, F.lit("")).alias("text"))


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc struct of all columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of whole texts (null: none).

    All inside the row, without a shuffle. Eight-word windows are compared by 64-bit hashes of their words' hashes;
    only texts that have an equal pair sort their windows.
    """
    df = _apart(docs, F.col("text"))
    text, spaced = F.col("text"), r"[\x20\x09-\x0D]+"
    bare = F.btrim(text, F.lit(WS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    df = df.withColumn("hw", F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, spaced), lambda w: F.xxhash64(w))))
    df = df.withColumn("n_words", F.size("hw").cast("long"))
    df = df.withColumn("word_chars", F.char_length(F.translate(text, WS, "")).cast("long"))
    df = df.withColumn("n_symbols", (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"))
    df = df.withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    starts = F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get("hw", i + k) for k in range(WINDOW)]))
    df = df.withColumn("w", F.when(F.col("n_words") > WINDOW, windows))
    twice = F.size(F.array_distinct("w")) < F.size("w")
    df = df.withColumn("sorted", F.when(twice, F.array_sort(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get("sorted", k)["h"]
    same = F.transform(F.sequence(F.lit(0), F.size("sorted") - 1), lambda k: F.when((at(k) == at(k - 1)) | (at(k) == at(k + 1)), F.get("sorted", k)["i"]))
    df = df.withColumn("at", F.when(F.col("sorted").isNotNull(), F.array_sort(F.filter(same, lambda x: x.isNotNull()))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    cover = F.aggregate("at", none, lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["last"])).cast("long").alias("n"), s.alias("last")))
    df = df.withColumn("n_repeat_words", F.coalesce(cover["n"], F.lit(0)).cast("long"))
    return df.select("doc", *BASE)


def chi2_quantile(p: float, dof: int) -> float:
    """Of an even number of degrees of freedom, by bisection of the closed form."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - tail(mid) < p else (low, mid)
    return low


def consistency(half: float, dof: int) -> float:
    """Factor that makes the covariance of the innermost `half` of normal data that of all of it."""
    x = chi2_quantile(half, dof)
    return half / (1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range((dof + 2) // 2)))


PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
SUMS = [f"a{i}" for i in range(D)] + [f"b{i}{j}" for i, j in PAIRS]
MEANS, COVS = [f"m{i}" for i in range(D)], [f"c{i}{j}" for i, j in PAIRS]


def _eliminated() -> tuple[dict, list[Column]]:
    """The unrolled LDL' elimination of the covariance columns."""
    low: dict = {}
    diag: list[Column] = []
    for j in range(D):
        diag.append(F.col(f"c{j}{j}") - sum((low[j, k] * low[j, k] * diag[k] for k in range(j)), F.lit(0.0)))
        for i in range(j + 1, D):
            low[i, j] = (F.col(f"c{i}{j}") - sum((low[i, k] * low[j, k] * diag[k] for k in range(j)), F.lit(0.0))) / diag[j]
    return low, diag


def determinant() -> Column:
    out: Column = F.lit(1.0)
    for x in _eliminated()[1]:
        out = out * x
    return out


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. under c00.."""
    low, diag = _eliminated()
    z: list[Column] = []
    total: Column = F.lit(0.0)
    for i in range(D):
        z.append(F.col(f"x{i}") - F.col(f"m{i}") - sum((low[i, k] * z[k] for k in range(i)), F.lit(0.0)))
        total = total + z[i] * z[i] / diag[i]
    return total


def _estimated(scale: float) -> list[Column]:
    """m0.., c00.. of the weight k and the sums."""
    mean = [F.col(f"a{i}") / F.col("k") for i in range(D)]
    cov = lambda i, j: scale * (F.col(f"b{i}{j}") / F.col("k") - mean[i] * mean[j]) + (FLOORS[i] ** 2 if i == j else 0.0)
    return [*[mean[i].alias(f"m{i}") for i in range(D)], *[cov(i, j).alias(f"c{i}{j}") for i, j in PAIRS]]


def _total(weight: Column | None = None) -> list[Column]:
    return [F.sum(F.col(c) if weight is None else F.col(c) * weight).alias(c) for c in ("k", *SUMS)]


def _quantile(cells: DataFrame, value: str, step: float, out: str) -> DataFrame:
    """Median of each (grp, f), from a histogram: exact to `step`, combined before the shuffle."""
    bins = cells.groupBy("grp", "f", F.floor(F.col(value) / step).alias("bin")).agg(F.sum("k").alias("k"))
    w = Window.partitionBy("grp", "f")
    hit = bins.withColumn("run", F.sum("k").over(w.orderBy("bin"))).withColumn("all", F.sum("k").over(w)).where(F.col("run") >= 0.5 * F.col("all"))
    return hit.groupBy("grp", "f").agg(((F.min("bin") + 0.5) * step).alias(out))


def statistic_cells(rows: DataFrame) -> DataFrame:
    """(grp, k, sums, x0..) of rows(grp, x0..): the sums of each grid cell of a group, and of all rows as group ALL."""
    key = [F.floor(F.col(f"x{i}") * GRID[i]).alias(f"g{i}") for i in range(D)]
    first = [F.count(F.lit(1)).cast("double").alias("k"), *[F.sum(f"x{i}").alias(f"a{i}") for i in range(D)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"b{i}{j}") for i, j in PAIRS]]
    own = stage_table(rows.groupBy("grp", *key).agg(*first), "cells")
    every = own.groupBy(*[f"g{i}" for i in range(D)]).agg(*_total()).withColumn("grp", F.lit(ALL))
    both = own.unionByName(every)
    return stage_table(both.select("grp", "k", *SUMS, *[(F.col(f"a{i}") / F.col("k")).alias(f"x{i}") for i in range(D)]), "cells")


def _starts(cells: DataFrame) -> DataFrame:
    """(grp, start, m0.., c00..): medians and median deviations, the classical estimate, and DRAWS draws of D + 1 points."""
    tall = cells.select("grp", "k", F.posexplode(F.array(*[f"x{i}" for i in range(D)])).alias("f", "x"))
    med = stage_table(_quantile(tall, "x", 1 / 128, "med"), "medians")
    dev = tall.join(med, ["grp", "f"]).withColumn("dev", F.abs(F.col("x") - F.col("med")))
    mad = _quantile(dev, "dev", 1 / 256, "mad").join(med, ["grp", "f"])
    pick = lambda c, i: F.max(F.when(F.col("f") == i, F.col(c)))
    spread = lambda i, j: F.pow(1.4826 * pick("mad", i), 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0)
    robust = mad.groupBy("grp").agg(*[pick("med", i).alias(f"m{i}") for i in range(D)], *[spread(i, j).alias(f"c{i}{j}") for i, j in PAIRS])
    classical = cells.groupBy("grp").agg(*_total()).select("grp", *_estimated(1.0))
    # The least exponential waiting time draws a cell by its weight; D + 1 hash classes give as many points.
    drawn = []
    for r in range(DRAWS):
        h = F.xxhash64(F.lit(r), "k", *[f"x{i}" for i in range(D)])
        wait = -F.log((F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)) / F.col("k")
        drawn += [F.min(F.when(F.pmod(h, F.lit(D + 1)) == j, F.struct(wait.alias("wait"), F.lit(r).alias("r"), *[f"x{i}" for i in range(D)]))) for j in range(D + 1)]
    points = cells.groupBy("grp").agg(*[x.alias(f"p{n}") for n, x in enumerate(drawn)]).select("grp", F.explode(F.array(*[f"p{n}" for n in range(len(drawn))])).alias("p")).where("p is not null").select("grp", "p.*")
    sums = points.groupBy("grp", "r").agg(F.count(F.lit(1)).cast("double").alias("k"), *[F.sum(f"x{i}").alias(f"a{i}") for i in range(D)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"b{i}{j}") for i, j in PAIRS])
    out = robust.select("grp", F.lit(-2).alias("start"), *MEANS, *COVS).unionByName(classical.select("grp", F.lit(-1).alias("start"), *MEANS, *COVS))
    return out.unionByName(sums.select("grp", F.col("r").alias("start"), *_estimated(1.0)))


def _step(cells: DataFrame, est: DataFrame) -> DataFrame:
    """One concentration step of each (grp, start): refits to the innermost HALF of the group's rows. Cells are ranked
    by bins of their distance, and the last bin counts by the share of it that is wanted."""
    near = cells.join(est.select("grp", "start", *MEANS, *COVS), "grp").withColumn("bin", F.floor(F.log(distance() + 1e-6) * 32))
    bins = near.groupBy("grp", "start", "bin").agg(*_total())
    w = Window.partitionBy("grp", "start")
    wanted = HALF * F.sum("k").over(w)
    before = F.coalesce(F.sum("k").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("wanted") - F.col("before")) / F.col("k")))
    inner = bins.withColumn("wanted", wanted).withColumn("before", before).withColumn("share", share).where("share > 0")
    return inner.groupBy("grp", "start").agg(*_total(F.col("share"))).select("grp", "start", *_estimated(consistency(HALF, D))).withColumn("det", determinant())


def mcd_estimates(rows: DataFrame) -> DataFrame:
    """(grp, n, m0.., c00..) of each group of rows(grp, x0..) and of all rows as ALL, without regard to group size."""
    cells = statistic_cells(rows)
    est = _starts(cells).withColumn("det", F.lit(math.inf)).withColumn("falls", F.lit(True))
    est = stage_table(est, "mcd")
    while not (going := est.where("falls")).isEmpty():
        new = _step(cells, going).select("grp", "start", F.struct("det", *MEANS, *COVS).alias("new"))
        both = est.join(new, ["grp", "start"], "left")
        falls = F.coalesce(F.col("new.det") < F.col("det") * (1 - FALL), F.lit(False))
        now = lambda c: F.when(falls, F.col("new")[c]).otherwise(F.col(c)).alias(c)  # noqa: B023, E731
        est = stage_table(both.select("grp", "start", *[now(c) for c in ("det", *MEANS, *COVS)], falls.alias("falls")), "mcd")
    best = est.groupBy("grp").agg(F.min(F.struct("det", "start", *MEANS, *COVS)).alias("best")).select("grp", "best.*")
    near = cells.join(stage_table(best, "mcd").select("grp", *MEANS, *COVS), "grp")
    inside = F.when(distance() <= chi2_quantile(REWEIGHT, D), 1.0).otherwise(0.0)
    sums = near.withColumn("inside", inside).groupBy("grp").agg(F.sum("k").alias("n"), *_total(F.col("inside")))
    return stage_table(sums.where("k > 0").select("grp", "n", *_estimated(consistency(REWEIGHT, D))), "mcd")


def _shrunk(est: DataFrame) -> DataFrame:
    """Each group's estimate, in which that of all rows counts for PRIOR rows: (n own + PRIOR all) / (n + PRIOR), and
    the covariance also holds the distance between the two centres."""
    every = est.where(F.col("grp") == ALL).select(F.struct(*MEANS, *COVS).alias("every"))
    both = est.where(F.col("grp") != ALL).join(F.broadcast(every))  # one row
    share = F.col("n") / (F.col("n") + PRIOR)
    apart = lambda i: F.col(f"m{i}") - F.col("every")[f"m{i}"]
    mean = [(share * F.col(c) + (1 - share) * F.col("every")[c]).alias(c) for c in MEANS]
    cov = [(share * F.col(f"c{i}{j}") + (1 - share) * F.col("every")[f"c{i}{j}"] + share * (1 - share) * apart(i) * apart(j)).alias(f"c{i}{j}") for i, j in PAIRS]
    return both.select("grp", *mean, *cov)


def robust_quality(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """Adds the base statistics, base_failed, mcd_distance and kept to documents(doc_id, text, lang, source), less the text.

    base_failed: under 20 words, or over 30 % of the words in repeated eight-word windows. The others give each
    (lang, source) a centre and covariance; a document is kept when its squared distance is at most the chi-square
    quantile of 1 - tail. Null lang or source is a group of its own. Null and empty texts have no words and fail; where
    every row fails, nothing is estimated. Repeated rows are judged each. Other columns of any name pass through, but
    for those named like the new ones, which are replaced.
    """
    new = {*BASE, "base_failed", "kept", "mcd_distance"}
    keep = [c for c in docs.columns if c not in new | {"text"}]
    n = F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col("doc")[c]), F.lit("-"))
    transformed = (F.log((F.col("word_chars") + 1) / n), F.col("n_symbols") / n, F.log1p(F.col("n_dup_lines").cast("double")), F.sqrt(F.col("n_repeat_words") / n))
    base = text_statistics(docs).select(F.struct(*[F.col("doc")[c].alias(c) for c in keep]).alias("doc"), *BASE, failed.alias("base_failed"), F.concat_ws("\x01", part("lang"), part("source")).alias("grp"), *[x.alias(f"x{i}") for i, x in enumerate(transformed)])
    base = stage_table(base, "quality")
    est = stage_table(_shrunk(mcd_estimates(base.where("not base_failed").select("grp", *[f"x{i}" for i in range(D)]))), "mcd")
    far = F.when(~F.col("base_failed"), distance())
    judged = base.join(est, "grp", "left").select("doc", *BASE, "base_failed", far.alias("mcd_distance"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("mcd_distance"), F.lit(0.0)) <= chi2_quantile(1 - tail, D))
    return judged.select(*[F.col("doc").getField(c).alias(c) for c in keep], *BASE, "base_failed", "mcd_distance", kept.alias("kept"))
