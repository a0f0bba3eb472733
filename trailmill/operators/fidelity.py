"""Real against synthetic sessions: frequencies, transitions, lengths, outcomes, distances.

Inputs are steps (session_id, ord, action); metrics of two sides take two frames.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sessionize import SEMANTIC_ACTIONS

#: Actions of a session that only browses.
BROWSING = ("detail", "explore-search", "explore-goto", "explore-back", "explore-stay", "terminate")
EPSILON = 1e-12


def domain(df: DataFrame) -> DataFrame:
    """(idx, action): the nine actions."""
    return df.sparkSession.createDataFrame(list(enumerate(SEMANTIC_ACTIONS)), "idx int, action string")


def lengths(steps: DataFrame, *by: str) -> DataFrame:
    return steps.groupBy(*by, "session_id").agg(F.count("*").alias("n"))


def descriptive(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """mean, population deviation, quartiles and count of a column."""
    return rows.groupBy(*by).agg(F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_pop(column), 6).alias("std"), *[F.percentile(column, F.lit(p / 100)).alias(f"p{p}") for p in (25, 50, 75)], F.count(column).alias("n"))


def action_frequencies(steps: DataFrame, *by: str) -> DataFrame:
    """Share of each of the nine actions among all steps, steps of other actions included; actions that don't occur have 0."""
    counts = steps.groupBy(*by, "action").agg(F.count("*").alias("c"))
    totals = counts.groupBy(*by).agg(F.sum("c").alias("total"))
    grid = totals.crossJoin(F.broadcast(domain(steps)))  # nine rows a group
    return grid.join(counts, [*by, "action"], "left").select(*by, "idx", "action", (F.coalesce("c", F.lit(0)) / F.col("total")).alias("freq"))


def transition_counts(steps: DataFrame, *by: str) -> DataFrame:
    """(i, j, c): how often action j follows action i, both of the nine."""
    following = steps.withColumn("next", F.lead("action").over(Window.partitionBy(*by, "session_id").orderBy("ord")))
    d = domain(steps)
    return following.join(F.broadcast(d.withColumnRenamed("idx", "i")), "action").join(F.broadcast(d.select(F.col("idx").alias("j"), F.col("action").alias("next"))), "next").groupBy(*by, "i", "j").agg(F.count("*").alias("c"))


def transition_matrix(steps: DataFrame, *by: str) -> DataFrame:
    """(i, j, p) of all 81 cells; rows without a transition are 0."""
    d = domain(steps)
    grid = steps.select(*by).distinct().crossJoin(F.broadcast(d.select(F.col("idx").alias("i")))).crossJoin(F.broadcast(d.select(F.col("idx").alias("j"))))
    rows = transition_counts(steps, *by).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*by, "i")))
    return grid.join(rows, [*by, "i", "j"], "left").select(*by, "i", "j", F.coalesce("p", F.lit(0.0)).alias("p"))


def jsd(pairs: DataFrame, p: Column, q: Column) -> DataFrame:
    """Jensen-Shannon divergence (natural logarithm) of two columns of shares over the rows of one domain."""
    whole = Window.partitionBy()
    eps = pairs.select((p + EPSILON).alias("p"), (q + EPSILON).alias("q"))
    unit = eps.select((F.col("p") / F.sum("p").over(whole)).alias("p"), (F.col("q") / F.sum("q").over(whole)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    return unit.agg(F.round(F.sum(0.5 * (F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m))), 9).alias("jsd"))


def action_jsd(real: DataFrame, synth: DataFrame) -> DataFrame:
    a = action_frequencies(real).select("idx", F.col("freq").alias("p"))
    b = action_frequencies(synth).select("idx", F.col("freq").alias("q"))
    return jsd(a.join(b, "idx"), F.col("p"), F.col("q"))


def length_jsd(real: DataFrame, synth: DataFrame) -> DataFrame:
    """JSD of session lengths over 0 to the longest; 1 if a side is empty."""
    h = lambda steps, c: lengths(steps).groupBy("n").agg(F.count("*").alias(c))
    both = h(real, "r").join(h(synth, "s"), "n", "full")
    bins = both.agg(F.max("n").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("n"))
    grid = bins.join(both, "n", "left").na.fill(0, ["r", "s"])
    whole = Window.partitionBy()
    shares = grid.select((F.col("r") / F.nullif(F.sum("r").over(whole), F.lit(0))).alias("p"), (F.col("s") / F.nullif(F.sum("s").over(whole), F.lit(0))).alias("q"))
    return jsd(shares, F.col("p"), F.col("q")).select(F.coalesce("jsd", F.lit(1.0)).alias("jsd"))


def session_flags(steps: DataFrame, *by: str) -> DataFrame:
    a = F.col("action")
    flags = steps.groupBy(*by, "session_id").agg(F.bool_or(a == "checkout").alias("has_checkout"), F.bool_or(a == "add").alias("has_add_to_cart"), F.bool_and(a.isin(*BROWSING)).alias("browse_only"))
    return flags.withColumn("abandoned", F.col("has_add_to_cart") & ~F.col("has_checkout"))


def outcome_rates(steps: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of the four flags."""
    names = ("has_checkout", "has_add_to_cart", "browse_only", "abandoned")
    short = ("checkout_rate", "add_rate", "browse_rate", "abandoned_rate")
    return session_flags(steps, *by).groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in names], *[F.round(F.count_if(c) / F.count("*"), 9).alias(s) for c, s in zip(names, short, strict=True)])


def primary_outcomes(steps: DataFrame) -> DataFrame:
    """(session_id, outcome): checkout before abandoned before browse_only."""
    return session_flags(steps).select("session_id", F.when(F.col("has_checkout"), "checkout").when(F.col("has_add_to_cart"), "abandoned").otherwise("browse_only").alias("outcome"))


def paired_outcomes(real: DataFrame, synth: DataFrame) -> DataFrame:
    a, b = (primary_outcomes(x).withColumnRenamed("outcome", n) for x, n in ((real, "real_outcome"), (synth, "synth_outcome")))
    return a.join(b, "session_id").withColumn("outcome_score", (F.col("real_outcome") == F.col("synth_outcome")).cast("int"))


def matched(steps: DataFrame, other: DataFrame) -> DataFrame:
    """Steps of the sessions that the other side has too."""
    return steps.join(other.select("session_id").distinct(), "session_id", "left_semi")


def without(steps: DataFrame, excluded: DataFrame) -> DataFrame:
    return steps.join(excluded.select("session_id").distinct(), "session_id", "left_anti")


def _word(steps: DataFrame, name: str) -> DataFrame:
    """(session_id, word, n): each action as one character, so that edit distance counts actions."""
    char = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, a in enumerate(SEMANTIC_ACTIONS) for x in (a, "abcdefghi"[i])]), F.col("action")), F.lit("O"))
    return steps.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", char.alias("c")))), lambda x: x["c"]), "").alias(name), F.count("*").alias(f"{name}_n"))


def edit_distances(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Levenshtein distance of the action sequences of paired sessions, also over the longer length."""
    both = _word(real, "a").join(_word(synth, "b"), "session_id")
    d = F.levenshtein("a", "b")
    return both.select("session_id", d.cast("long").alias("distance"), F.round(d / F.greatest("a_n", "b_n"), 9).alias("normalized"))


def matrix_distance(real: DataFrame, synth: DataFrame) -> DataFrame:
    """L1 and Frobenius norm of the difference of the transition matrices."""
    a = transition_matrix(real).select("i", "j", F.col("p"))
    b = transition_matrix(synth).select("i", "j", F.col("p").alias("q"))
    e = F.col("p") - F.col("q")
    return a.join(b, ["i", "j"]).agg(F.round(F.sum(F.abs(e)), 9).alias("l1"), F.round(F.sqrt(F.sum(e * e)), 9).alias("frobenius"))


def chi_square(real: DataFrame, synth: DataFrame) -> DataFrame:
    """(statistic, dof, p) of the outcomes of both sides: with one degree of freedom each difference is taken half nearer (at most to 0), with none p is 1."""
    from .scoring import chi_square_tail

    rows = primary_outcomes(real).withColumn("side", F.lit(0)).unionByName(primary_outcomes(synth).withColumn("side", F.lit(1)))
    c = rows.groupBy("outcome").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("s"))
    whole = Window.partitionBy()
    n, r, s = F.col("r") + F.col("s"), F.sum("r").over(whole), F.sum("s").over(whole)
    er, es = n * r / (r + s), n * s / (r + s)
    nearer = lambda e: F.when(F.count("*").over(whole) == 2, F.greatest(F.abs(e) - 0.5, F.lit(0.0))).otherwise(e)
    terms = c.select((F.pow(nearer(F.col("r") - er), F.lit(2)) / er + F.pow(nearer(F.col("s") - es), F.lit(2)) / es).alias("t"))  # a row an outcome
    found = terms.agg(F.sum("t").alias("statistic"), (F.count("*") - 1).cast("int").alias("dof"))
    p = F.when(F.col("dof") == 2, chi_square_tail(F.col("statistic"), 2)).when(F.col("dof") == 1, chi_square_tail(F.col("statistic"), 1)).when(F.col("dof") == 0, 1.0)
    return found.withColumn("p", p)


def two_proportions(real: DataFrame, synth: DataFrame, flag: str = "has_checkout") -> DataFrame:
    """(z, p) of the difference of a flag's rates, pooled; both null where no or every session has it."""
    from .scoring import normal_tail

    a = session_flags(real).agg(F.count("*").alias("n1"), F.count_if(flag).alias("x1"))
    b = session_flags(synth).agg(F.count("*").alias("n2"), F.count_if(flag).alias("x2"))
    pool = (F.col("x1") + F.col("x2")) / (F.col("n1") + F.col("n2"))
    return a.crossJoin(b).select(((F.col("x1") / F.col("n1") - F.col("x2") / F.col("n2")) / F.sqrt(F.nullif(pool * (1 - pool), F.lit(0.0)) * (1 / F.col("n1") + 1 / F.col("n2")))).alias("z")).withColumn("p", normal_tail(F.col("z")))  # one row each


def arrays(steps: DataFrame) -> DataFrame:
    """One row a session with its columns as arrays in order."""
    row = F.array_sort(F.collect_list(F.struct("ord", "action")))
    return steps.groupBy("session_id").agg(row.alias("r")).select("session_id", F.transform("r", lambda x: x["action"]).alias("actions"), F.transform("r", lambda x: x["ord"]).alias("ords"))


def valid_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions that are not empty and whose arrays have one length."""
    return sessions.where((F.size("actions") > 0) & (F.size("actions") == F.size("ords"))).withColumn("n", F.size("actions"))


def merge_scores(scores: dict[str, DataFrame]) -> DataFrame:
    """Per-session scores of several evaluators side by side, with the mean of those that are there."""
    joined = functools.reduce(lambda a, b: a.join(b, "session_id", "full"), scores.values())
    there = [F.col(n).isNotNull().cast("int") for n in scores]
    n = functools.reduce(lambda a, b: a + b, there)
    total = functools.reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in scores])
    return joined.withColumns({"mean": total / n, "n_scores": n})
