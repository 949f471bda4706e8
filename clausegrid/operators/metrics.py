"""Ranking metrics, intervals, paired tests, agreement, distributions and samples."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausegrid.config import Z_95

DECIMALS = 9


def rounded(x: Column) -> Column:
    return F.round(x, DECIMALS)


def ranking_metrics(ranks: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """n, s1, s5, s10, mrr10, ndcg10 of gold ranks (0: not found), one relevant item a query."""
    r = F.col(rank)
    within = lambda k: r.between(1, k)
    return ranks.groupBy(*by).agg(
        F.count("*").alias("n"),
        *(rounded(F.avg(within(k).cast("double"))).alias(f"s{k}") for k in (1, 5, 10)),
        rounded(F.avg(F.when(within(10), 1 / r).otherwise(0.0))).alias("mrr10"),
        rounded(F.avg(F.when(within(10), 1 / F.log2(r + 1)).otherwise(0.0))).alias("ndcg10"),
    )


def wilson(successes: Column, n: Column, clamp: bool = False) -> tuple[Column, Column]:
    """The 95 % score interval of a share; null for no trials."""
    n = F.when(n > 0, n)
    p, z2 = successes / n, Z_95 * Z_95
    middle, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z_95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low, high = middle - half, middle + half
    return (rounded(F.greatest(low, F.lit(0.0))), rounded(F.least(high, F.lit(1.0)))) if clamp else (rounded(low), rounded(high))


#: ln(k!) less Stirling's formula, for k from 1 to 15.
_STIRLING = [math.lgamma(k + 1) - ((k + 0.5) * math.log(k) - k + 0.5 * math.log(2 * math.pi)) for k in range(1, 16)]


def _with(f: Callable[..., Column], **values: Column) -> Column:
    """f of values that are computed once, however often f names them."""
    return F.element_at(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), lambda s: f(*(s[k] for k in values))), 1)


def _stirling(n: Column) -> Column:
    """ln(n!) less Stirling's formula, for whole n of 1 or more: no difference of large logarithms is ever taken."""
    far = lambda i, i2: i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188))))
    near = F.element_at(F.array(*map(F.lit, _STIRLING)), F.greatest(F.least(n, F.lit(15.0)), F.lit(1.0)).cast("int"))
    return F.when(n < 16, near).otherwise(_with(far, i=1 / n, i2=1 / (n * n)))


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, to full precision where the two are close."""

    def close(x, d, v, v2):
        series = F.lit(1 / 19)
        for k in range(8, 0, -1):
            series = F.lit(1 / (2 * k + 1)) + v2 * series
        return d * v + 2 * x * v * v2 * series

    def either(x, mean):
        d, v = x - mean, (x - mean) / (x + mean)
        return F.when(F.abs(d) < 0.1 * (x + mean), _with(close, x=x, d=d, v=v, v2=v * v)).otherwise(x * F.log(x / mean) - d)

    return _with(either, x=x, mean=mean)


def log_binomial(x: Column, n: Column, p: Column, q: Column) -> Column:
    """ln of the binomial probability of x of n, for p + q = 1, both above 0."""

    def value(x, n, p, q):
        far = F.transform(F.array(n, x, n - x), _stirling)
        off = F.transform(F.array(F.struct(x.alias("x"), (n * p).alias("mean")), F.struct((n - x).alias("x"), (n * q).alias("mean"))), lambda s: _deviance(s["x"], s["mean"]))
        inner = _with(lambda far, off: far[0] - far[1] - far[2] - off[0] - off[1], far=far, off=off) + 0.5 * F.log(n / (2 * math.pi * x * (n - x)))
        return F.when(n <= 0, 0.0).when(x <= 0, n * F.log(q)).when(x >= n, n * F.log(p)).otherwise(inner)

    return _with(value, x=x, n=n, p=p, q=q)


def _falling(first: Column, ratio: Callable[[Column], Column], terms: Column) -> Column:
    """first * (1 + ratio(0) + ratio(0) ratio(1) + ...), with so many ratios."""
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a, k):
        t = a["t"] * ratio(k.cast("double"))
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    steps = F.when(terms > 0, F.sequence(F.lit(0), F.greatest(terms - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return first * F.aggregate(steps, start, step)["s"]


def _reach(n: Column, left: Column) -> Column:
    """Terms of a tail that count in double precision: beyond 10 roots of n of them, the rest is below 1e-80 of it."""
    return F.least(left, F.ceil(10 * F.sqrt(n)) + 50).cast("int")


def mcnemar_exact(left_only: Column, right_only: Column) -> Column:
    """Two-sided exact p of a paired table; 1 without discordant pairs.

    The tail is summed from its largest term, whose logarithm is exact for any counts; the terms are at most in proportion to the root of the counts.
    """
    n, m = (left_only + right_only).cast("double"), F.least(left_only, right_only).cast("double")
    half = F.lit(0.5)
    total = _falling(F.exp(log_binomial(m, n, half, half)), lambda k: (m - k) / (n - m + 1 + k), _reach(n, m))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def _side(edge: Column, middle: Column, counts: Column) -> Column:
    return F.struct(F.when(counts, middle).otherwise(edge["at"]).alias("at"), F.when(counts, edge["out"]).otherwise(middle).alias("out"))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact p of a 2x2 table: tables no likelier than the given one, with a tolerance of 1e-15.

    Probabilities rise up to the mode and fall after it, so the tables that count are two tails. Where each begins is found by halving; it is summed from there
    outwards, with terms at most in proportion to the root of the counts.
    """
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))

    def value(a, rows, cols, n, low, high, mode):
        p, q = rows / n, (n - rows) / n

        def prob(places: Column) -> Column:
            """The probabilities of some tables."""
            parts = lambda x: F.array(F.struct(x.alias("x"), cols.alias("n"), F.lit(1.0).alias("sign")), F.struct((rows - x).alias("x"), (n - cols).alias("n"), F.lit(1.0).alias("sign")), F.struct(rows.alias("x"), n.alias("n"), F.lit(-1.0).alias("sign")))
            return F.transform(places, lambda x: F.exp(F.aggregate(F.transform(parts(x), lambda s: s["sign"] * log_binomial(s["x"], s["n"], p, q)), F.lit(0.0), lambda t, y: t + y)))

        def tails(known):
            most = known[0] * (1 + 1e-12) + 1e-15

            def halved(s):
                """Both edges: at, a table that counts (or one outside), and out, one that does not, come together."""
                middle = F.transform(s, lambda e: e["at"] + F.signum(e["out"] - e["at"]) * F.floor(F.abs(e["out"] - e["at"]) / 2))
                judged = lambda middle, there: F.zip_with(s, F.arrays_zip(middle.alias("m"), there.alias("p")), lambda e, x: _side(e, x["m"], (x["m"] == e["at"]) | (x["p"] <= most)))
                return _with(lambda middle: _with(judged, middle=middle, there=prob(middle)), middle=middle)

            side = lambda at: F.struct(at.alias("at"), mode.alias("out"))
            edges = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.array(side(low - 1), side(high + 1)), lambda s, _: halved(s))

            def sums(left, right, first):
                below = _falling(first[0], lambda k: (left - k) * (n - cols - rows + left - k) / ((cols - left + k + 1) * (rows - left + k + 1)), _reach(n, left - low))
                above = _falling(first[1], lambda k: (cols - right - k) * (rows - right - k) / ((right + k + 1) * (n - cols - rows + right + k + 1)), _reach(n, high - right))
                return F.when(left >= low, below).otherwise(0.0) + F.when(right <= high, above).otherwise(0.0)

            ends = F.transform(edges, lambda e: e["at"])
            return F.when(known[1] <= most, 1.0).otherwise(F.least(F.lit(1.0), _with(lambda ends: _with(sums, left=ends[0], right=ends[1], first=prob(ends)), ends=ends)))

        one = (rows == 0) | (rows == n) | (cols == 0) | (cols == n)
        return F.when(one, 1.0).otherwise(_with(tails, known=prob(F.array(a, mode))))

    def bounds(a, rows, cols, n):
        low, high = F.greatest(F.lit(0.0), rows + cols - n), F.least(rows, cols)
        mode = F.least(high, F.greatest(low, F.floor((rows + 1) * (cols + 1) / (n + 2)).cast("double")))
        return _with(value, a=a, rows=rows, cols=cols, n=n, low=low, high=high, mode=mode)

    return _with(bounds, a=a, rows=a + b, cols=a + c, n=a + b + c + d)


def paired_table(rows: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:
    """Counts of left only, right only, both and neither, for two pass flags of the same items."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    return rows.groupBy(*by).agg(F.count_if(x & ~y).alias("left_only"), F.count_if(~x & y).alias("right_only"), F.count_if(x & y).alias("both"), F.count_if(~x & ~y).alias("neither"))


def paired_deltas(rows: DataFrame, before: str, after: str, by: list[str]) -> DataFrame:
    d = F.col(after) - F.col(before)
    return rows.groupBy(*by).agg(F.count_if(d > 0).alias("improved"), F.count_if(d == 0).alias("tied"), F.count_if(d < 0).alias("worsened"), rounded(F.avg(d)).alias("mean_delta"))


def kappa(rows: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:
    """n, observed, expected and Cohen's kappa of two raters; with certain agreement 1 if they agree, else NaN."""
    pairs = rows.groupBy(*by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    left = pairs.groupBy(*by, "x").agg(F.sum("c").alias("l")).withColumnRenamed("x", "v")
    right = pairs.groupBy(*by, "y").agg(F.sum("c").alias("r")).withColumnRenamed("y", "v")
    both = left.join(right, [*by, "v"], "full").fillna(0, ["l", "r"]).groupBy(*by).agg(F.sum(F.col("l") * F.col("r")).alias("lr"))
    seen = pairs.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    out = seen.join(both, by) if by else seen.join(F.broadcast(both), how="cross")
    po, pe = F.col("same") / F.col("n"), F.col("lr") / (F.col("n") * F.col("n"))
    value = F.when(pe < 1, (po - pe) / F.when(pe < 1, 1 - pe)).otherwise(F.when(po == 1, 1.0).otherwise(float("nan")))
    return out.select(*by, "n", rounded(po).alias("observed"), rounded(pe).alias("expected"), rounded(value).alias("kappa"))


def distribution(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, min, mean, median, p95 and max; percentiles are exact and interpolated."""
    v = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.count(v).alias("n"), rounded(F.min(v)).alias("min"), F.round(F.avg(v), 6).alias("mean"), rounded(F.percentile(v, F.lit(0.5))).alias("p50"), rounded(F.percentile(v, F.lit(0.95))).alias("p95"), rounded(F.max(v)).alias("max"))


def seeded_sample(rows: DataFrame, seed: str, purpose: str, stratum: str, key: str, n: int) -> DataFrame:
    """n rows of each stratum in the order of a seeded SHA-256."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.lit(purpose), F.col(stratum), F.col(key).cast("string")), 256)
    return rows.withColumn("__o", order).withColumn("__r", F.row_number().over(W.partitionBy(stratum).orderBy("__o", key))).where(F.col("__r") <= n).drop("__o", "__r")


def blinded(sample: DataFrame, seed: str, key: str) -> DataFrame:
    """Adds a display position and id to a sample, in the order of a seeded SHA-256."""
    from clausegrid.operators.relational import positions

    order = F.sha2(F.concat_ws("|", F.lit(seed), F.lit("display"), F.col(key).cast("string")), 256)
    return positions(sample, [order.asc(), F.col(key).asc()]).withColumn("blind_id", F.concat(F.lit("IR-"), F.lpad(F.col("position").cast("string"), 3, "0")))


#: How often a row is drawn, for a uniform 32-bit number: as many times as it has passed of these, which are 2^32 times the distribution of a Poisson number of mean 1.
POISSON = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def bootstrap(rows: DataFrame, delta: str, by: list[str], key: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """n, mean, low, high: the 95 % percentile interval of a mean difference, by group.

    In each draw a row counts a Poisson number of times, which an MD5 of seed, key and draw gives (four draws a hash): no generator has a state, so the interval depends on
    the rows alone and not on how they are partitioned. What leaves a task are sums by group and draw. key: tells rows of a group apart; rows that repeat it
    are drawn together.
    """
    known = rows.where(F.col(delta).isNotNull()).select(*by, F.col(key).cast("string").alias("_k"), F.col(delta).cast("double").alias("_d"))
    each = known.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // 4) - 1))))
    each = each.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "_k", F.col("_block").cast("string"))))
    number = lambda j: F.conv(F.substring("_h", 1 + 8 * j, 8), 16, 10).cast("long")
    times = lambda j: sum(((number(j) >= F.lit(t)).cast("int") for t in POISSON), F.lit(0))
    each = each.withColumns({f"_w{j}": times(j) for j in range(4)})
    sums = each.groupBy(*by, "_block").agg(*(F.sum(f"_w{j}").alias(f"_n{j}") for j in range(4)), *(F.sum(F.col(f"_w{j}") * F.col("_d")).alias(f"_s{j}") for j in range(4)))
    drawn = sums.select(*by, F.explode(F.array(*(F.struct((F.col("_block") * 4 + j).alias("draw"), (F.col(f"_s{j}") / F.nullif(F.col(f"_n{j}"), F.lit(0))).alias("mean")) for j in range(4)))).alias("x"))
    ends = drawn.where((F.col("x.draw") < draws) & F.col("x.mean").isNotNull()).groupBy(*by).agg(*(F.percentile("x.mean", F.lit(at)).alias(name) for name, at in (("low", 0.025), ("high", 0.975))))
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_d").alias("mean")).join(ends, by, "left")


def gate_counterfactuals(rows: DataFrame, by: list[str], base: str, changed: str) -> DataFrame:
    """What a gate that keeps the base order prevents and blocks: rows right only before the change, and only after it."""
    x, y = F.col(base).cast("boolean"), F.col(changed).cast("boolean")
    return rows.groupBy(*by).agg(F.count_if(x & ~y).alias("prevented_error"), F.count_if(~x & y).alias("blocked_correction"))


def retest_summary(rows: DataFrame, by: list[str], first: Column, second: Column) -> DataFrame:
    """n, exact repeats and mean Jaccard similarity of two sets of ids; two empty sets agree."""
    both, either = F.size(F.array_intersect(first, second)), F.size(F.array_union(first, second))
    same = (F.size(F.array_except(first, second)) == 0) & (F.size(F.array_except(second, first)) == 0)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(same).alias("exact"), rounded(F.avg(F.when(either == 0, 1.0).otherwise(both / F.when(either > 0, either)))).alias("mean_jaccard"))


def realization_loss(rows: DataFrame, by: list[str], possible: str, realized: str) -> DataFrame:
    """Of the rows that were possible: n, those not realized, and their share."""
    g = rows.where(F.col(possible).cast("boolean")).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col(realized).cast("boolean")).alias("lost"))
    return g.withColumn("loss", rounded(F.col("lost") / F.col("n")))


def detection_rates(rows: DataFrame, by: list[str], found: str, true: str, missing: float = -1.0) -> DataFrame:
    """Sensitivity, specificity and precision of a detection; `missing` where a share has no rows."""
    x, y = F.col(found).cast("boolean"), F.col(true).cast("boolean")
    share = lambda c, b: rounded(F.coalesce(F.count_if(c & b) / F.nullif(F.count_if(b), F.lit(0)), F.lit(missing)))
    return rows.groupBy(*by).agg(share(x, y).alias("sensitivity"), share(~x, ~y).alias("specificity"), share(y, x).alias("precision"))


def window_opportunity(gold: DataFrame, window: DataFrame, by: str, marker: Column) -> DataFrame:
    """What an evidence window makes possible, by group: mean share of a query's gold ids in it, and its marked rows.

    gold: by, q, id; window: by, q, id and what marker reads. Queries without a window have none of their ids.
    """
    hits = gold.select(by, "q", "id").distinct().join(window.select("q", "id").distinct().withColumn("in", F.lit(1)), ["q", "id"], "left")
    recall = hits.groupBy(by, "q").agg((F.count("in") / F.count("*")).alias("r")).groupBy(by).agg(rounded(F.avg("r")).alias("recall"))
    marked = window.groupBy(by).agg(F.count_if(marker).alias("markers"))
    return recall.join(marked, by, "full").select(by, F.coalesce("recall", F.lit(0.0)).alias("recall"), F.coalesce("markers", F.lit(0)).alias("markers"))


def reproduction_rate(rows: DataFrame, by: list[str], recorded: str, again: str) -> DataFrame:
    """The share of rows whose recorded result comes out again."""
    return rows.groupBy(*by).agg(rounded(F.avg(F.col(recorded).eqNullSafe(F.col(again)).cast("double"))).alias("rate"))


def origin_summary(rows: DataFrame, origin: str, id_: str) -> DataFrame:
    """Occurrences and distinct ids of each origin."""
    return rows.groupBy(origin).agg(F.count("*").alias("occurrences"), F.countDistinct(id_).alias("uniques"))


def decomposition(rows: DataFrame, by: list[str], covered: str, strict: str) -> DataFrame:
    """Rows whose evidence covers the gold, and those of them that also pass strictly."""
    x, y = F.col(covered).cast("boolean"), F.col(strict).cast("boolean")
    return rows.groupBy(*by).agg(F.count_if(x).alias("covered"), F.count_if(x & y).alias("strict"))


def missing_bounds(rows: DataFrame, by: list[str], passed: str) -> DataFrame:
    """Passes if every row without a judgment (null) failed, and if each passed."""
    x = F.col(passed).cast("boolean")
    return rows.groupBy(*by).agg(F.count_if(F.coalesce(x, F.lit(False))).alias("lower"), F.count_if(F.coalesce(x, F.lit(True))).alias("upper"))


def hash_order_sample(rows: DataFrame, purpose: str, key: str, n: int) -> DataFrame:
    """The n keys that come first in the order of a SHA-256 of purpose and key: key, h."""
    return rows.select(key, F.sha2(F.concat_ws("|", F.lit(purpose), F.col(key).cast("string")), 256).alias("h")).orderBy("h", key).limit(n)


def paired_outputs(left: DataFrame, right: DataFrame, key: str, by: str, passed: str = "passed") -> DataFrame:
    """Two systems' outputs for the same items, by group: n, left_only, right_only, unmatched. A repeated key is an error."""
    from clausegrid.sources.scans import unique

    a = unique(left, key).select(key, F.col(by).alias("_a"), F.col(passed).cast("boolean").alias("_l"))
    b = unique(right, key).select(key, F.col(by).alias("_b"), F.col(passed).cast("boolean").alias("_r"))
    both = a.join(b, key, "full").withColumn(by, F.coalesce("_a", "_b"))
    return both.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("_l") & ~F.col("_r")).alias("left_only"), F.count_if(~F.col("_l") & F.col("_r")).alias("right_only"), F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("unmatched"))


#: Statuses that a summary counts; others count as other.
STATUSES = ("OK", "PARAMS_REQUIRED", "NO_EVIDENCE", "ERROR")


def paired_summary(left: DataFrame, right: DataFrame, key: str, by: str, passed: str = "passed", status: str = "status", subset: str = "parameters") -> DataFrame:
    """Two systems' outputs for the same items, by group, over all items and over those with parameters (part): n, the paired table, unmatched items, exact McNemar p, and how
    often each side has each status.

    left and right: key, by, passed, status, subset (a flag of the item). A repeated key is an error; an item that one side lacks is unmatched and in no cell of the table.
    """
    from clausegrid.sources.scans import unique

    def side(rows, mark):
        return unique(rows, key).select(key, F.col(by).alias(f"{mark}_by"), F.col(passed).cast("boolean").alias(mark), F.upper(F.trim(status)).alias(f"{mark}_status"), F.col(subset).alias(f"{mark}_subset"))

    both = side(left, "l").join(side(right, "r"), key, "full").withColumn(by, F.coalesce("l_by", "r_by"))
    parts = F.filter(F.array(F.lit("all"), F.when(F.coalesce("l_subset", "r_subset"), "parameters")), lambda x: x.isNotNull())
    rows = both.withColumn("part", F.explode(parts))
    l, r = F.col("l"), F.col("r")
    known = F.concat_ws("", *(F.lit(f"|{s}|") for s in STATUSES))
    counts = [F.count_if(F.col(f"{m}_status") == s).alias(f"{name}_{s.lower()}") for m, name in (("l", "left"), ("r", "right")) for s in STATUSES]
    others = [F.count_if(~F.contains(known, F.concat(F.lit("|"), F.col(f"{m}_status"), F.lit("|")))).alias(f"{name}_other") for m, name in (("l", "left"), ("r", "right"))]
    table = rows.groupBy(by, "part").agg(F.count("*").alias("n"), F.count_if(l & r).alias("both"), F.count_if(l & ~r).alias("left_only"), F.count_if(~l & r).alias("right_only"), F.count_if(~l & ~r).alias("neither"), F.count_if(l.isNull() | r.isNull()).alias("unmatched"), *counts, *others)
    return table.withColumn("p", F.round(mcnemar_exact(F.col("left_only"), F.col("right_only")), 6))


def newcombe_paired(both: Column, left_only: Column, right_only: Column, neither: Column) -> tuple[Column, Column]:
    """The 95 % interval of a difference of paired shares, left less right: Newcombe's method 10 with its continuity correction; null for no rows."""
    a, b, c, d = (x.cast("double") for x in (both, left_only, right_only, neither))
    n = a + b + c + d
    (l1, u1), (l2, u2) = wilson(a + b, n), wilson(a + c, n)
    p1, p2 = (a + b) / F.when(n > 0, n), (a + c) / F.when(n > 0, n)
    margins, cross = (a + b) * (c + d) * (a + c) * (b + d), a * d - b * c
    corrected = F.when(cross > n / 2, cross - n / 2).when(cross >= 0, 0.0).otherwise(cross)
    phi = F.when(margins > 0, corrected / F.sqrt(F.when(margins > 0, margins))).otherwise(0.0)
    root = lambda x, y: F.sqrt(F.greatest(x * x - 2 * phi * x * y + y * y, F.lit(0.0)))
    return rounded(p1 - p2 - root(p1 - l1, u2 - p2)), rounded(p1 - p2 + root(u1 - p1, p2 - l2))


def holm(rows: DataFrame, by: list[str], p: str, key: str, out: str = "adjusted") -> DataFrame:
    """Adds Holm's adjusted p to the tests of each group."""
    w = W.partitionBy(*by).orderBy(F.col(p), F.col(key))
    m, k = F.count("*").over(W.partitionBy(*by)), F.row_number().over(w)
    raw = rows.withColumn("_raw", F.least(F.lit(1.0), (m - k + 1) * F.col(p)))
    return raw.withColumn(out, rounded(F.max("_raw").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))).drop("_raw")


def set_metrics(got: Column, gold: Column) -> Column:
    """tp, fp, fn, precision, recall and f1 of two sets of strings; undefined shares are 0."""
    got, gold = F.array_distinct(F.filter(got, lambda x: x != "")), F.array_distinct(F.filter(gold, lambda x: x != ""))
    tp, fp, fn = F.size(F.array_intersect(got, gold)), F.size(F.array_except(got, gold)), F.size(F.array_except(gold, got))
    share = lambda a, b: F.when(a + b > 0, a / F.when(a + b > 0, a + b)).otherwise(0.0)
    p, r = share(tp, fp), share(tp, fn)
    f1 = F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0)
    return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(f1).alias("f1"))
