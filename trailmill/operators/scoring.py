"""Metrics of predictions, verdicts and rewards, and their inference over replicates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(rows: DataFrame, label: str, prediction: str, *by: str) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy. A null prediction is wrong: missed if the label is 1, else a false alarm."""
    y, p = F.col(label), F.col(prediction)
    c = rows.groupBy(*by).agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p.isNull() | (p == 1))).alias("fp"), F.count_if((y == 1) & (p.isNull() | (p == 0))).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if(p.isNull()).alias("invalid"))
    pr, re = _safe(F.col("tp"), F.col("tp") + F.col("fp")), _safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": F.round(pr, 9), "recall": F.round(re, 9), "f1": F.round(_safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9), "accuracy": F.round(_safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 9)})


def action_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 of predicted actions; rows without a true action are skipped. Rows are (action, predicted)."""
    real = rows.where(F.coalesce("action", F.lit("")) != "")
    classes = real.select(F.col("action").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("action").eqNullSafe(F.col("predicted"))).cast("int").alias("h")).unionAll(real.where("predicted IS NOT NULL").select("predicted", F.lit(0), F.lit(1), F.lit(0)))
    per = classes.groupBy("c").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    f1 = _safe(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    return per.withColumn("f1", f1).agg(F.sum("support").alias("n"), F.round(F.sum("hits") / F.sum("support"), 9).alias("accuracy"), F.round(F.avg("f1"), 9).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 9).alias("weighted_f1"))


def bucket_rates(rows: DataFrame, bucket: str, success: str) -> DataFrame:
    """Success rate by bucket; a missing bucket is <unknown>."""
    return rows.groupBy(F.coalesce(F.col(bucket), F.lit("<unknown>")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.col(success).cast("int")), 9).alias("rate"))


def mean_scores(rows: DataFrame) -> DataFrame:
    """Mean score per criterion of rows with a map of scores."""
    return rows.select(F.explode("scores").alias("criterion", "score")).groupBy("criterion").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("score").alias("n"))


def agreement(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Counts of verdicts that stayed, rose and fell."""
    b, a = F.col(before), F.col(after)
    return rows.agg(F.count("*").alias("n"), F.count_if(a == b).alias("same"), F.count_if(a > b).alias("gained"), F.count_if(a < b).alias("lost"))


def mean_and_deviation(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.count(value).alias("n"))


def backfill(tasks: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Tasks with their summary; tasks without one fail, summaries without a task stay."""
    return tasks.join(summaries, key, "full").withColumn("verdict", F.coalesce("verdict", F.lit("missing")))


def paired_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(n, mean_difference, unpaired) over equal keys; unpaired keys must be 0 for a sound comparison."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key, "full")
    paired = F.col("x").isNotNull() & F.col("y").isNotNull()
    return both.agg(F.count_if(paired).alias("n"), F.round(F.avg(F.col("x") - F.col("y")), 9).alias("mean_difference"), F.count_if(~paired).alias("unpaired"))


def token_f1(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """F1 of the multisets of words (letters, numbers and _) of two texts, case folded; two texts without words agree, one alone gives 0."""
    folded = lambda c: F.replace(F.replace(F.lower(F.col(c)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    words = lambda c, n: pairs.select(key, F.explode(F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w")).groupBy(key, "w").agg(F.count("*").alias(n))
    both = words(a, "x").join(words(b, "y"), [key, "w"], "full").na.fill(0, ["x", "y"])
    sums = both.groupBy(key).agg(F.sum(F.least("x", "y")).alias("c"), F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    return pairs.select(key).join(sums, key, "left").select(key, F.round(F.when(F.col("c").isNull(), 1.0).otherwise(2 * F.col("c") / (F.col("nx") + F.col("ny"))), 9).alias("f1"))


def similar_share(a: Column, b: Column) -> Column:
    """Length of the longest common substring over the mean length; 1 for two empty texts."""

    @F.pandas_udf("int")
    def longest(xs: pd.Series, ys: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x or "", y or "", False).find_longest_match().size for x, y in zip(xs, ys, strict=True)])

    n = F.length(a) + F.length(b)
    return F.when(n == 0, 1.0).otherwise(2 * longest(a, b) / n)


def target_reward(similarity: Column, valid: Column, exact: Column) -> Column:
    return 0.6 * similarity + 0.1 * valid.cast("int") + 0.3 * exact.cast("int")


def composite_reward(format_ok: Column, action_ok: Column, grounding: Column, similarity: Column, target: Column, has_target: Column, weights: tuple[float, float, float] = (0.05, 0.45, 0.5), inner: tuple[float, float] = (0.7, 0.3)) -> Column:
    """Base, reasoning and target terms over their weights, for answers of the right format and action; all others get 0.

    The reasoning term is the weighted mean of grounding and similarity. Without
    a true target its term is left out of both sums, so every action can reach 1.
    """
    base, reason, aim = weights
    reasoning = (inner[0] * grounding + inner[1] * similarity) / F.lit(inner[0] + inner[1])
    plain = base + reason * reasoning
    total = F.when(has_target, (plain + aim * target) / F.lit(base + reason + aim)).otherwise(plain / F.lit(base + reason))
    return F.when(format_ok & action_ok, total).otherwise(F.lit(0.0))


def holm(rows: DataFrame, p: str, *by: str) -> DataFrame:
    """Holm-adjusted p-values within a group."""
    order = Window.partitionBy(*by).orderBy(p, "name")
    n = F.count("*").over(Window.partitionBy(*by))
    raw = rows.withColumn("__h", F.col(p) * (n - F.row_number().over(order) + 1))
    return raw.withColumn("adjusted", F.least(F.lit(1.0), F.max("__h").over(order))).drop("__h")


def interval(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return replicates.agg(F.round(F.percentile("value", F.lit(a)), 6).alias("low"), F.round(F.percentile("value", F.lit(1 - a)), 6).alias("high"), F.count("value").alias("n"))


SERIES = 60  # terms of the series and levels of the fraction


def erfc(z: Column) -> Column:
    """The complementary error function of a number that is not negative, to about 11 digits: a series of positive terms up to 3, a continued fraction beyond."""
    z = z.cast("double")
    term = lambda acc, n: F.struct((acc["t"] * 2 * z * z / (2 * n + 1)).alias("t"), (acc["s"] + acc["t"] * 2 * z * z / (2 * n + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES)), F.struct(z.alias("t"), z.alias("s")), term, lambda acc: acc["s"])
    fraction = F.aggregate(F.sequence(F.lit(SERIES), F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, n: 1 + n / (2 * z * z) / acc)
    root = F.lit(math.sqrt(math.pi))
    bell = F.exp(-z * z)
    return F.when(z <= 3, 1 - 2 / root * bell * series).otherwise(bell / (z * root) / fraction)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution."""
    return erfc(F.abs(z) / math.sqrt(2))


def chi_square_tail(x: Column, dof: int) -> Column:
    """The share of a chi-square distribution of `dof` degrees of freedom above x."""
    half = x.cast("double") / 2
    if dof % 2 == 0:
        return F.exp(-half) * sum((F.pow(half, F.lit(j)) / math.factorial(j) for j in range(dof // 2)), F.lit(0.0))
    more = sum((F.pow(half, F.lit(j - 0.5)) / math.gamma(j + 0.5) for j in range(1, (dof + 1) // 2)), F.lit(0.0))
    return erfc(F.sqrt(half)) + F.exp(-half) * more


#: The outcomes that a selection is split over, in this order.
OUTCOMES = ("checkout", "cart_abandoned", "browse_only")


def outcome_quotas(available: dict[str, int], n: int, outcomes: tuple[str, ...] = OUTCOMES) -> dict[str, int]:
    """n split evenly, the remainder to the first outcomes; what an outcome lacks goes to those that have spare sessions, in order."""
    base, rest = divmod(n, len(outcomes))
    want = {o: base + (i < rest) for i, o in enumerate(outcomes)}
    quota = {o: min(w, available.get(o, 0)) for o, w in want.items()}
    missing = n - sum(quota.values())
    for o in outcomes:
        more = min(missing, available.get(o, 0) - quota[o])
        quota[o] += more
        missing -= more
    return quota


def select_sessions(candidates: DataFrame, n: int, least: int = 0, most: int = 1 << 30, outcomes: tuple[str, ...] = OUTCOMES, batch: int = 10_000) -> list[str]:
    """Ids of n sessions, split over the outcomes, that cover many products: greedily the one that adds most, ties to the smaller id.

    Candidates are (session_id, outcome, n_real, products); sessions with fewer
    than `least` or more than `most` real actions are left out. One choice over
    all outcomes; one whose quota is full is passed over. The driver holds `batch`
    candidates of greatest gain at a time. A gain only falls, so a choice that
    beats the last of them beats all others too; when none does, Spark names the
    next batch by the gains of that moment.
    """
    import heapq

    real = candidates.where(F.col("n_real").between(least, most) & F.col("outcome").isin(*outcomes))
    real = real.select(F.col("session_id").cast("string").alias("session_id"), "outcome", F.array_distinct("products").alias("products"))
    left = outcome_quotas({r["outcome"]: r["n"] for r in real.groupBy("outcome").agg(F.count("*").alias("n")).collect()}, n, outcomes)
    spark = candidates.sparkSession
    out: list[str] = []
    covered: set[str] = set()
    while any(left.values()):
        state = spark.createDataFrame([(sorted(covered), out)], "covered array<string>, taken array<string>")
        open_ = real.where(F.col("outcome").isin(*[o for o, k in left.items() if k])).crossJoin(F.broadcast(state)).where(~F.array_contains("taken", F.col("session_id")))  # one row
        gain = F.size(F.array_except("products", "covered"))
        rows = open_.select("session_id", "outcome", "products", gain.alias("gain")).orderBy(F.desc("gain"), "session_id").limit(batch).collect()
        heap = [(-r["gain"], r["session_id"], r["outcome"], frozenset(r["products"])) for r in rows]
        beyond = heap[-1][:2] if len(heap) == batch else None
        heapq.heapify(heap)
        while heap and any(left.values()):
            _, sid, outcome, products = heapq.heappop(heap)
            if not left[outcome]:
                continue
            now = (-len(products - covered), sid)
            if heap and now > heap[0][:2]:
                heapq.heappush(heap, (*now, outcome, products))
                continue
            if beyond is not None and now > beyond:
                break
            out.append(sid)
            covered |= products
            left[outcome] -= 1
    return out
