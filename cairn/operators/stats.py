"""Statistics over lines and functions: rank correlation, verdicts, intervals, corrections, ridge, resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.panel import average_rank, global_rank01
from cairn.plans.shared import written


def spearman(rows: DataFrame, a: str, b: str, *by: str, least: int = 2) -> DataFrame:
    """(by, n, rho): Pearson's correlation of average ranks; 0 where a side is constant or rows are too few."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if by:
        ranked = both.select(*by, average_rank(F.col(a), *by).alias("ra"), average_rank(F.col(b), *by).alias("rb"))
    else:  # the correlation is that of ranks on any scale
        both = written(rows.sparkSession, both.select(F.col(a).alias("_a"), F.col(b).alias("_b")), "pairs")
        ranked = global_rank01(global_rank01(both, "_a", "ra"), "_b", "rb").select("ra", "rb")
    sums = [F.count("*").alias("n"), F.sum("ra").alias("sa"), F.sum("rb").alias("sb"), F.sum(F.col("ra") * F.col("ra")).alias("saa"), F.sum(F.col("rb") * F.col("rb")).alias("sbb"), F.sum(F.col("ra") * F.col("rb")).alias("sab")]
    t = ranked.groupBy(*by).agg(*sums) if by else ranked.agg(*sums)
    n = F.col("n")
    tiny = 0.0 if by else 1e-12
    cov, va, vb = n * F.col("sab") - F.col("sa") * F.col("sb"), n * F.col("saa") - F.col("sa") ** 2, n * F.col("sbb") - F.col("sb") ** 2
    rho = F.when((n >= least) & (va > tiny) & (vb > tiny), F.try_divide(cov, F.sqrt(va) * F.sqrt(vb))).otherwise(0.0)
    return t.select(*by, "n", F.coalesce(rho, F.lit(0.0)).alias("rho"))


def verdict(rho: Column, null: Column, lines: Column, mutants: Column) -> Column:
    """Is the ranking borne out: enough data first, then clear of the null and of the floor, then at least above the null."""
    return F.when((lines < 20) | (mutants < 30), "insufficient data").when((rho - null >= 0.1) & (rho >= 0.3), "calibrated").when(rho > null, "marginal").otherwise("uncalibrated")


def gate_code(verdict: Column) -> Column:
    return F.when(verdict == "insufficient data", 2).when(verdict == "uncalibrated", 3).otherwise(0)


def fisher_interval(rho: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a correlation by Fisher's transform; null below five pairs or for a perfect one."""
    ok = (n >= 5) & (F.abs(rho) < 1)
    r, half = F.when(ok, rho), z / F.sqrt(F.greatest(n - 3, F.lit(1)))
    return F.tanh(F.atanh(r) - half), F.tanh(F.atanh(r) + half)


def auc(rows: DataFrame, score: str, positive: str, *by: str) -> DataFrame:
    """(by, pairs, auc): the share of (positive, negative) pairs in order, ties half, from the sum of ranks."""
    if by:
        r = rows.select(*by, F.col(positive).cast("int").alias("p"), average_rank(F.col(score), *by).alias("r"))
    else:  # ranks of all rows without gathering them
        both = written(rows.sparkSession, rows.select(F.col(positive).cast("int").alias("p"), F.col(score).alias("_s")), "pairs")
        n = both.count()
        r = global_rank01(both, "_s", "_r").select("p", (F.col("_r") * (n - 1) + 1).alias("r"))
    aggs = [F.sum("p").alias("np"), F.sum(1 - F.col("p")).alias("nn"), F.sum(F.when(F.col("p") == 1, F.col("r")).otherwise(0.0)).alias("sr")]
    t = r.groupBy(*by).agg(*aggs) if by else r.agg(*aggs)
    pairs = F.col("np") * F.col("nn")
    return t.where(pairs > 0).select(*by, pairs.alias("pairs"), ((F.col("sr") - F.col("np") * (F.col("np") + 1) / 2) / pairs).alias("auc"))


def holm(tests: DataFrame, p: str, order: str) -> DataFrame:
    """``tests`` with holm: p-values adjusted step-down; ``order`` breaks ties."""
    every = Window.partitionBy(F.lit(0))
    w = Window.partitionBy(F.lit(0)).orderBy(p, order)
    step = (F.count("*").over(every) - F.row_number().over(w) + 1) * F.col(p)
    rows = tests.withColumn("_step", step)
    return rows.withColumn("holm", F.least(F.lit(1.0), F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def resolution(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, distinct, spread): distinct values to six digits and the range."""
    return rows.groupBy(*by).agg(F.countDistinct(F.round(value, 6)).alias("distinct"), (F.max(value) - F.min(value)).alias("spread"))


def ordinal_rank(value: Column, tie: Column, *by: Column | str) -> Column:
    """Ranks in [0, 1] without ties: equals keep the order of ``tie``; alone it is 0."""
    w = Window.partitionBy(*by)
    return (F.row_number().over(w.orderBy(value, tie)) - 1) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))


def index_quantile(values: Column, q: float) -> Column:
    """The element number max(0, int(n q) - 1) of a sorted array."""
    return F.element_at(values, (F.greatest(F.floor(F.size(values) * q) - 1, F.lit(0)) + 1).cast("int"))


def corpus_percentile(values: Column, q: float) -> Column:
    """The element number int((n - 1) q) of a sorted array."""
    return F.element_at(values, (F.floor((F.size(values) - 1) * q) + 1).cast("int"))


SIZE_BUCKETS = ((10, "1-10"), (50, "11-50"), (200, "51-200"), (1000, "201-1000"))


def size_bucket(n: Column) -> Column:
    out = F.when(n <= SIZE_BUCKETS[0][0], SIZE_BUCKETS[0][1])
    for most, name in SIZE_BUCKETS[1:]:
        out = out.when(n <= most, name)
    return out.otherwise(">1000")


def kill_tally(outcomes: DataFrame, *by: str) -> DataFrame:
    """(by, killed, mutants): timeouts are kills, invalid mutants don't count."""
    valid = F.col("outcome") != "invalid"
    return outcomes.where(valid).groupBy(*by).agg(F.count_if(F.col("outcome").isin("killed", "timeout")).alias("killed"), F.count("*").alias("mutants"))


def pair_lines(tally: DataFrame, functions: DataFrame) -> DataFrame:
    """``tally`` (file, line, killed, mutants) with the narrowest function (file, fn, lo, hi) around each line, and
    the positional null: 1 at a function's first line, 0 at its last. Lines in no function go."""
    f = functions.select("file", "fn", "lo", "hi")
    inside = tally.join(f, "file").where(F.col("line").between(F.col("lo"), F.col("hi")))
    best = inside.groupBy(*tally.columns).agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("width"), "fn", "lo")).alias("o"))
    null = F.when(F.col("o.width") == 0, 1.0).otherwise(1.0 - (F.col("line") - F.col("o.lo")) / F.greatest(F.col("o.width"), F.lit(1)))
    return best.select(*tally.columns, F.col("o.fn").alias("fn"), (F.col("killed") / F.col("mutants")).alias("kill_rate"), null.alias("null_score"))


def disagreements(rows: DataFrame, a: str, b: str, key: str, *by: str, k: int = 8) -> DataFrame:
    """The ``k`` rows whose ordinal ranks by the two columns within their group lie farthest apart."""
    ra, rb = ordinal_rank(F.col(a), F.col(key), *by), ordinal_rank(F.col(b), F.col(key), *by)
    far = rows.select(*by, key, (ra - rb).alias("distance"))
    return far.orderBy(F.desc(F.abs("distance")), F.desc("distance"), *map(F.desc, by), F.desc(key)).limit(k)


def lead_feature(rows: DataFrame, terms: dict[str, Column], *by: str, least: float = 0.005) -> DataFrame:
    """``rows`` with lead: the term that exceeds its own group's mean by the most, null where none does by ``least``."""
    if by:
        w = Window.partitionBy(*by)
        means = {n: F.avg(t).over(w) for n, t in terms.items()}
    else:  # one row of means
        one = rows.agg(*(F.avg(t).alias(n) for n, t in terms.items())).first()
        means = {n: F.lit(one[n]) for n in terms}
    best = F.array_max(F.array(*[F.struct((t - means[n]).alias("d"), F.lit(n).alias("n")) for n, t in terms.items()]))
    return rows.withColumn("lead", F.when(best["d"] > least, best["n"]))


def gram(rows: DataFrame, features: list[Column], target: Column, *by: str) -> DataFrame:
    """(by, n, i, j, product): sums of products of the features and, last, the target. One pass, k squared numbers."""
    xs = [*features, target]
    names = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    sums = [F.sum(xs[i] * xs[j]).alias(f"g_{i}_{j}") for i, j in names]
    t = rows.groupBy(*by).agg(F.count("*").alias("n"), *sums) if by else rows.agg(F.count("*").alias("n"), *sums)
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g_{i}_{j}").alias("product")) for i, j in names]))
    return t.select(*by, "n", stacked.alias("s")).select(*by, "n", "s.*")


def _matrices(grams: DataFrame, by: str | None) -> dict[object, tuple[int, np.ndarray]]:
    """Gram matrices by group: k squared numbers a group, of a bounded number of groups (projects)."""
    out: dict[object, tuple[int, np.ndarray]] = {}
    rows = grams.collect()
    k = max((r["j"] for r in rows), default=0) + 1
    for r in rows:
        key = r[by] if by else None
        n, m = out.setdefault(key, (r["n"], np.zeros((k, k))))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["product"]
    return out


def ridge(n: int, g: np.ndarray, lam: float) -> np.ndarray:
    """Weights without intercept of penalty ``lam`` times the number of rows, from a Gram matrix whose last column is the target."""
    k = len(g) - 1
    return np.linalg.solve(g[:k, :k] + lam * n * np.eye(k), g[:k, k])


def ridge_weights(grams: DataFrame, lam: float) -> DataFrame:
    """(feature, weight) of all rows."""
    n, g = _matrices(grams, None)[None]
    return grams.sparkSession.createDataFrame([(i, float(w)) for i, w in enumerate(ridge(n, g, lam))], "feature int, weight double")


LAMBDAS = (3e-2, 1e-1, 3e-1, 1e0, 3e0)


def leave_one_out(rows: DataFrame, features: list[str], target: str, by: str, lams: tuple[float, ...] = LAMBDAS) -> DataFrame:
    """(by, lam, rho): of each group, the rank correlation of its target with weights fitted on the others.

    The penalty is the one whose weights, with one more group left out, order that group best on average.
    Fits need Gram matrices only, and a fold's is the total less the groups left out; the predictions
    for all folds and penalties are one join of the rows with a table of a weight vector for each.
    """
    spark = rows.sparkSession
    ms = _matrices(gram(rows, [F.col(f).cast("double") for f in features], F.col(target).cast("double"), by), by)
    total = sum(n for n, _ in ms.values()), sum(g for _, g in ms.values())
    fits = []
    for outer, (n, g) in ms.items():
        for held, (m, h) in ms.items():
            left = (total[0] - n, total[1] - g) if held == outer else (total[0] - n - m, total[1] - g - h)
            if left[0] > 0:
                fits += [(outer, held, lam, ridge(*left, lam).tolist()) for lam in lams]
    kind = rows.schema[by].dataType.simpleString()
    weights = spark.createDataFrame(fits, f"_outer {kind}, _held {kind}, lam double, w array<double>")
    x = rows.join(weights, F.col(by) == F.col("_held"))
    guess = sum((F.col(f) * F.col("w")[i] for i, f in enumerate(features)), F.lit(0.0))
    rho = spearman(x.withColumn("_guess", guess), "_guess", target, "_outer", "_held", "lam", least=3)
    inner = rho.where("_outer <> _held").groupBy("_outer", "lam").agg(F.avg("rho").alias("m"))
    best = inner.groupBy("_outer").agg(F.max_by("lam", F.struct("m", -F.col("lam"))).alias("lam"))
    return rho.where("_outer = _held").join(best, ["_outer", "lam"]).select(F.col("_outer").alias(by), "lam", "rho")


def adopted(results: DataFrame, old: str, new: str) -> DataFrame:
    """(groups, better, mean_old, mean_new, adopt): a refit is adopted if more than half of the groups and the mean gain."""
    t = results.agg(F.count("*").alias("groups"), F.count_if(F.col(new) > F.col(old)).alias("better"), F.avg(old).alias("mean_old"), F.avg(new).alias("mean_new"))
    return t.withColumn("adopt", (2 * F.col("better") > F.col("groups")) & (F.col("mean_new") > F.col("mean_old")))


def poisson_steps(most: int = 10) -> list[float]:
    """The chances that a Poisson(1) variable is at most 0, 1, ..."""
    out, p, c = [], float(np.exp(-1.0)), 0.0
    for k in range(most):
        c += p
        out.append(c)
        p /= k + 1
    return out


def either(p: Column) -> Column:
    """The chance that any of a group's independent events happens: one less the product of their complements."""
    return -F.expm1(F.sum(F.log1p(-p)))


def bootstrap(clusters: DataFrame, value: str, weight: str, key: str, draws: int = 4000, seed: int = 1) -> DataFrame:
    """(mean, low, high, p): the weighted mean over clusters and its percentile interval.

    Each cluster is drawn a Poisson(1) number of times in each replicate, from a hash of its key, so that replicates
    are sums of one pass and no sample is gathered. p: twice the smaller share of replicates beyond 0, 1/draws at least.
    """
    b = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    digits = F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), F.col("b").cast("string"), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(digits, 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)
    times = sum((F.when(u > c, 1).otherwise(0) for c in poisson_steps()), F.lit(0))
    reps = clusters.withColumn("b", b).withColumn("t", times).groupBy("b").agg(F.try_divide(F.sum(F.col(value) * F.col(weight) * F.col("t")), F.sum(F.col(weight) * F.col("t"))).alias("m")).where("m is not null")
    q = reps.agg(F.sort_array(F.collect_list("m")).alias("m"))
    point = clusters.agg(weighted_mean(F.col(value), F.col(weight)).alias("mean"))
    n = F.size("m")
    low, high = F.element_at("m", (F.floor((n - 1) * 0.025) + 1).cast("int")), F.element_at("m", (F.floor((n - 1) * 0.975) + 1).cast("int"))
    below = F.size(F.filter("m", lambda x: x <= 0)) / n
    tail = F.greatest(F.least(F.lit(1.0), 2 * F.least(below, 1 - below)), F.lit(1.0 / draws))
    return point.crossJoin(q).select("mean", low.alias("low"), high.alias("high"), tail.alias("p"))  # one row by one row


def paired_bootstrap(clusters: DataFrame, new: str, old: str, weight: str, key: str, draws: int = 4000, seed: int = 1) -> DataFrame:
    """(mean, low, high, p) of the gain of ``new`` over ``old``, both of the same clusters in each replicate."""
    gains = clusters.select(key, weight, (F.col(new) - F.col(old)).alias("_gain"))
    return bootstrap(gains, "_gain", weight, key, draws, seed)


def leverage(mutants: DataFrame, *by: str) -> DataFrame:
    """(by, leverage, leverage_no_delete, mutants, kinds) from (divergence, kind): means with and without deletions."""
    other = F.when(F.col("kind") != "delete", F.col("divergence"))
    return mutants.groupBy(*by).agg(F.avg("divergence").alias("leverage"), F.avg(other).alias("leverage_no_delete"), F.count("*").alias("mutants"), F.sort_array(F.collect_set("kind")).alias("kinds"))


def scorer_pivot(rows: DataFrame, scorers: list[str], *by: str) -> DataFrame:
    """A column a scorer, the largest score of each line."""
    return rows.groupBy(*by).pivot("scorer", scorers).agg(F.max("score"))


def within_budget(sites: DataFrame, budget: int, *order: str) -> DataFrame:
    """The first ``budget`` sites in order: the budget is a feature, handed on from file to file."""
    return sites.orderBy(*order).limit(budget)


def pooled_rho(by_function: DataFrame, least: int = 5) -> DataFrame:
    """(functions, rho): the mean of Fisher's z over functions with ``least`` pairs, weighted by pairs less three."""
    z = F.atanh(F.least(F.greatest(F.col("rho"), F.lit(-0.999999)), F.lit(0.999999)))
    kept = by_function.where(F.col("n") >= least)
    return kept.agg(F.count("*").alias("functions"), F.tanh(weighted_mean(z, (F.col("n") - 3).cast("double"))).alias("rho"))


def pooled_auc(by_function: DataFrame) -> DataFrame:
    """(functions, auc): the mean over functions, weighted by their pairs."""
    return by_function.agg(F.count("*").alias("functions"), weighted_mean(F.col("auc"), F.col("pairs").cast("double")).alias("auc"))


#: What counts as low and as high, for a reader's labels and for measured leverage.
SEPARATION = {"labels": (3.0, 7.0), "leverage": (0.15, 0.60)}


def separation(rows: DataFrame, truth: str, score: str, kind: str, *by: str) -> DataFrame:
    """(by, pairs, auc) of high against low lines; those between don't count."""
    low, high = SEPARATION[kind]
    ends = rows.where((F.col(truth) <= low) | (F.col(truth) >= high)).withColumn("_high", F.col(truth) >= high)
    return auc(ends, score, "_high", *by)


def row_leave_one_out(rows: DataFrame, features: list[str], target: str, key: str, lams: tuple[float, ...] = LAMBDAS) -> DataFrame:
    """(lam, rho): for a single group, the rank correlation of predictions that each leave out their own row.

    With the weights w of all rows, A the penalised Gram matrix and x a row, the prediction without it is
    (x w - h y) / (1 - h), h = x A^-1 x, but for the penalty, which counts one row less: A is taken with n - 1.
    """
    n, g = _matrices(gram(rows, [F.col(f).cast("double") for f in features], F.col(target).cast("double")), None)[None]
    k = len(features)
    out = None
    for lam in lams:
        inverse = np.linalg.inv(g[:k, :k] + lam * max(n - 1, 1) * np.eye(k))
        w = inverse @ g[:k, k]
        guess = sum((F.col(f) * float(v) for f, v in zip(features, w)), F.lit(0.0))
        h = sum((F.col(a) * F.col(b) * float(inverse[i, j]) for i, a in enumerate(features) for j, b in enumerate(features)), F.lit(0.0))
        left = rows.withColumn("_guess", (guess - h * F.col(target)) / (1 - h))
        r = spearman(left, "_guess", target, least=3).select(F.lit(float(lam)).alias("lam"), "rho")
        out = r if out is None else out.unionByName(r)
    return out


def flatness(rows: DataFrame, value: str, *by: str, least: int = 3) -> DataFrame:
    """(functions, flat, flat_share): of groups with ``least`` values, those whose values are all equal to six digits."""
    t = rows.groupBy(*by).agg(F.count(value).alias("n"), F.countDistinct(F.round(value, 6)).alias("d")).where(F.col("n") >= least)
    return t.agg(F.count("*").alias("functions"), F.count_if(F.col("d") == 1).alias("flat")).withColumn("flat_share", F.col("flat") / F.greatest(F.col("functions"), F.lit(1)))


def fingerprint(rows: DataFrame) -> DataFrame:
    """(n, hash): the same for the same rows in any order; two runs are compared by it."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)")).alias("hash"))


def divergence(a_status: str, a: str, b_status: str, b: str) -> Column:
    """0 for equal observables, 1 where a run failed otherwise; else 1 less the similarity of their texts."""
    same = F.col(a_status).eqNullSafe(F.col(b_status)) & F.col(a).eqNullSafe(F.col(b))
    failed = (F.coalesce(F.col(a_status), F.lit("")) != "ok") | (F.coalesce(F.col(b_status), F.lit("")) != "ok")
    return F.when(same, 0.0).when(failed, 1.0).otherwise(F.pandas_udf(_unlike, "double")(F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))))


def _unlike(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([1.0 - SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])
