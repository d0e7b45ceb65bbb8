"""Agreement and retrieval metrics of rankings, as columns over two aligned arrays of ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.text import let


def aligned(pred: DataFrame, truth: DataFrame, keys: list[str], item: str, pred_rank: str, true_rank: str) -> DataFrame:
    """``keys, p, t``: the ranks of the items that both have, as arrays in order of the item."""
    both = pred.select(*keys, item, F.col(pred_rank).cast("double").alias("__p")).join(truth.select(*[k for k in keys if k in truth.columns], item, F.col(true_rank).cast("double").alias("__t")), [*[k for k in keys if k in truth.columns], item])
    rows = F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), "__p", "__t")))
    return both.groupBy(*keys).agg(rows.alias("r")).select(*keys, F.transform("r", lambda x: x["__p"]).alias("p"), F.transform("r", lambda x: x["__t"]).alias("t"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _mean(a: Column) -> Column:
    return F.try_divide(_sum(a), F.size(a).cast("double"))


def _square_gap(p: Column, t: Column) -> Column:
    return F.zip_with(p, t, lambda a, b: (a - b) * (a - b))


def average_ranks(a: Column) -> Column:
    """Ranks from 1 with ties averaged."""
    return F.transform(a, lambda x: F.size(F.filter(a, lambda y: y < x)) + (F.size(F.filter(a, lambda y: y == x)) + 1) / 2)


def spearman(p: Column, t: Column) -> Column:
    """Pearson's correlation of the average ranks; null where one side is constant."""
    def centred(a: Column) -> Column:
        return let(_mean(a), lambda m: F.transform(a, lambda x: x - m))

    def moments(r: Column) -> Column:
        return F.struct(_sum(F.zip_with(r["a"], r["b"], lambda x, y: x * y)).alias("ab"), _sum(F.transform(r["a"], lambda x: x * x)).alias("aa"), _sum(F.transform(r["b"], lambda x: x * x)).alias("bb"))

    ranks = F.struct(let(average_ranks(p), centred).alias("a"), let(average_ranks(t), centred).alias("b"))
    return let(let(ranks, moments), lambda m: F.when((m["aa"] > 1e-12) & (m["bb"] > 1e-12), m["ab"] / F.sqrt(m["aa"] * m["bb"])))


def spearman_p(rho: Column) -> Column:
    """Two-sided p-value for five items: Student's t with 3 degrees of freedom in closed form."""
    t = F.abs(rho) * F.sqrt(F.lit(3.0) / F.greatest(F.lit(1e-12), 1 - rho * rho)) / F.sqrt(F.lit(3.0))
    return F.greatest(F.lit(0.0), 1 - (2 / F.pi()) * (t / (1 + t * t) + F.atan(t)))


def alpha(p: Column, t: Column) -> Column:
    """Krippendorff's alpha with self-pairs counted: 1 less the mean squared gap over four pooled variances, on the
    values' indexes among the distinct values; 1 without variance."""
    def indexes(pool: Column) -> Column:
        return F.struct(*[F.transform(x, lambda v: F.array_position(pool, v).cast("double")).alias(n) for x, n in ((p, "p"), (t, "t"))])

    def variance(both: Column) -> Column:
        return let(_mean(both), lambda m: _mean(F.transform(both, lambda x: (x - m) * (x - m))))

    def of(i: Column) -> Column:
        return let(let(F.concat(i["p"], i["t"]), variance), lambda var: F.when(var == 0, 1.0).otherwise(1 - _mean(_square_gap(i["p"], i["t"])) / (4 * var)))

    return let(let(F.array_sort(F.array_distinct(F.concat(p, t))), indexes), of)


def kappa(p: Column, t: Column, weights: str | None = "quadratic") -> Column:
    """Cohen's kappa with quadratic, linear or no weights; 1 if chance leaves no gap."""

    def gap(a: Column, b: Column) -> Column:
        d = a - b
        return d * d if weights == "quadratic" else F.abs(d) if weights == "linear" else (d != 0).cast("double")

    seen = _mean(F.zip_with(p, t, gap))
    chance = _mean(F.flatten(F.transform(p, lambda a: F.transform(t, lambda b: gap(a, b)))))
    return F.when(chance == 0, 1.0).otherwise(1 - seen / chance)


def top_k_equal(p: Column, t: Column, k: int) -> Column:
    """Whether the k best items are the same: every item is within k on both sides or on neither."""
    return F.forall(F.zip_with(p, t, lambda a, b: (a <= k) == (b <= k)), lambda x: x)


def ndcg(p: Column, t: Column, k: int = 5) -> Column:
    """Gains ``2^(k + 1 - true rank) - 1`` at discount ``log2(predicted rank + 1)``, over the best order's."""
    gain = lambda r: F.pow(F.lit(2.0), F.lit(k + 1.0) - r) - 1
    got = _sum(F.zip_with(p, t, lambda a, b: F.when(a <= k, gain(b) / F.log2(a + 1)).otherwise(0.0)))
    best = _sum(F.transform(t, lambda b: F.when(b <= k, gain(b) / F.log2(b + 1)).otherwise(0.0)))
    return F.try_divide(got, best)


def reciprocal_rank(p: Column, t: Column) -> Column:
    """1 over the predicted rank of the truly best item; 0 if none is best."""
    return F.aggregate(F.zip_with(p, t, lambda a, b: F.when(b == 1, 1 / a).otherwise(0.0)), F.lit(0.0), lambda s, x: F.greatest(s, x))


def pairwise(p: Column, t: Column) -> Column:
    """Share of item pairs in the same order on both sides; ties count as not before."""
    idx = F.sequence(F.lit(1), F.size(p))
    flags = F.flatten(F.transform(idx, lambda i: F.transform(F.filter(idx, lambda j: j > i), lambda j: ((F.element_at(p, i) < F.element_at(p, j)) == (F.element_at(t, i) < F.element_at(t, j))).cast("double"))))
    return F.when(F.size(p) > 1, _mean(flags))


def evaluate(lists: DataFrame, by: list[str]) -> DataFrame:
    """Means of all metrics over the rows ``p, t`` of each ``by``; undefined correlations do not count."""
    p, t = F.col("p"), F.col("t")
    m = lists.select(*by, alpha(p, t).alias("alpha"), spearman(p, t).alias("rho"), kappa(p, t).alias("kappa"), top_k_equal(p, t, 1).cast("double").alias("acc1"), top_k_equal(p, t, 3).cast("double").alias("acc3"), ndcg(p, t).alias("ndcg"), reciprocal_rank(p, t).alias("rr"), pairwise(p, t).alias("pw"))
    return m.groupBy(*by).agg(F.avg("alpha").alias("alpha"), F.avg("rho").alias("rho"), F.avg("kappa").alias("kappa"), F.avg("acc1").alias("accuracy_1"), F.avg("acc3").alias("accuracy_3"), F.avg("ndcg").alias("ndcg_5"), F.avg("rr").alias("mrr"), F.avg("pw").alias("pairwise"), F.count("*").alias("n"))
