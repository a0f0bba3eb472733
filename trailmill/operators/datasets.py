"""Conversation and action datasets: windows, turns, samples, splits, statistics, checks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLEAN_ACTIONS = ("click", "type", "terminate")


def window_bounds(n: Column, size: int, stride: int) -> Column:
    """Starts of windows over n rows: every `stride`, and one anchored to the end; one start where n fits a window."""
    full = F.sequence(F.lit(0), n - size, F.lit(stride))
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(full, F.array(n - size))))


def sliding_windows(rows: DataFrame, key: str, order: str, size: int, stride: int) -> DataFrame:
    """(key, window, start, place, order): each row in all windows of its group that hold it; windows are named #w0, #w1 …"""
    w = Window.partitionBy(key)
    numbered = rows.withColumns({"__n": F.count("*").over(w).cast("int"), "__i": F.row_number().over(w.orderBy(order)) - 1})
    starts = numbered.select("*", F.posexplode(window_bounds(F.col("__n"), size, stride)).alias("__w", "__s"))
    inside = starts.where((F.col("__i") >= F.col("__s")) & (F.col("__i") < F.col("__s") + size))
    return inside.select(key, F.concat(F.col(key).cast("string"), F.lit("#w"), F.col("__w").cast("string")).alias("window"), F.col("__s").alias("start"), (F.col("__i") - F.col("__s")).alias("place"), order)


def turns(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row an assistant message: turn_idx from 0, how many messages come before it, and the latest user message (`ui`)."""
    w = Window.partitionBy(conv).orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = messages.withColumns({"n_before": F.row_number().over(w) - 1, "ui": F.last(F.when(F.col("role") == "user", F.col("text")), True).over(before)})
    answers = placed.where("role = 'assistant'")
    return answers.select(conv, (F.row_number().over(w) - 1).alias("turn_idx"), "n_before", "ui", F.col("text").alias("completion"))


def first_windows(records: DataFrame, id_column: str = "window") -> DataFrame:
    """Only records named #w0 if any record is a window, else all."""
    windowed = records.agg(F.bool_or(F.col(id_column).rlike(r"#w\d+$")).alias("__any"))
    return records.crossJoin(F.broadcast(windowed)).where(~F.coalesce("__any", F.lit(False)) | F.col(id_column).endswith("#w0")).drop("__any")  # one row


def base_session(id_column: Column) -> Column:
    return F.regexp_replace(id_column, r"#w\d+$", "")


def gate_by_score(rows: DataFrame, scores: DataFrame, threshold: float, key: str) -> DataFrame:
    """Rows whose mean verifier score (key, criterion, score) is not below the threshold; rows without one stay.

    The last bits of a sum of doubles depend on the order in which a run adds them, so means
    are compared at nine decimals: one that is the threshold is never below it.
    """
    low = scores.groupBy(key).agg(F.round(F.avg("score"), 9).alias("m")).where(F.col("m") < threshold)
    return rows.join(low.select(key), key, "left_anti")


def clean_actions(rows: DataFrame) -> DataFrame:
    return rows.where(F.lower("action").isin(*CLEAN_ACTIONS))


#: What marks an action as adding to the cart, in its target and in its description.
ADD_TARGETS = ("add_to_cart", "add_to_bag", "add_item")
ADD_PHRASES = ("add to cart", "add to bag", "add item")


def is_add_to_cart(target: Column, description: Column) -> Column:
    """Whether an action adds to the cart: a signal in its target or a phrase in its description, in any case."""
    t, d = (F.lower(F.coalesce(c.cast("string"), F.lit(""))) for c in (target, description))
    return reduce(or_, [t.contains(x) for x in ADD_TARGETS] + [d.contains(x) for x in ADD_PHRASES])


def truncate_before_add(rows: DataFrame, key: str, order: str, is_add: Column) -> DataFrame:
    """Rows before the first add of their group; groups that start with one go."""
    w = Window.partitionBy(key)
    return rows.withColumn("__f", F.min(F.when(is_add, F.col(order))).over(w)).where(F.col("__f").isNull() | (F.col(order) < F.col("__f"))).drop("__f")


def drop_runs_with(rows: DataFrame, key: str, bad: Column) -> DataFrame:
    """Rows of the groups that have no bad row."""
    return rows.join(rows.where(bad).select(key).distinct(), key, "left_anti")


def min_steps(rows: DataFrame, key: str, least: int) -> DataFrame:
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where(F.col("__n") >= least).drop("__n")


def join_users(actions: DataFrame, users: DataFrame, keys: list[str]) -> DataFrame:
    """Actions with their user's columns; actions without a user go."""
    return actions.join(users, keys)


def missing_keys(actions: DataFrame, users: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of actions without a user: empty where a strict join is allowed."""
    return actions.select(*keys).distinct().join(users, keys, "left_anti")


def referenced(images: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    return images.join(actions.select(*keys).distinct(), keys, "left_semi")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rows): rows of one table that the other lacks, counted as multisets; no row if both are equal."""
    left, right = a.exceptAll(b).withColumn("side", F.lit("left")), b.exceptAll(a).withColumn("side", F.lit("right"))
    return left.unionByName(right).groupBy("side").agg(F.count("*").alias("n"))


def hash_order(seed: int, *columns: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def hash_places(keys: DataFrame, seed: int, *columns: str, place: str = "place") -> DataFrame:
    """Keys numbered from 1 in hash order, without a task that sees all of them.

    Keys of one head of the hash (three hex digits) are numbered by themselves,
    after the totals of the heads before: 4,096 rows, whatever the table.
    """
    headed = keys.withColumn("__h", hash_order(seed, *columns)).withColumn("__head", F.substr("__h", F.lit(1), F.lit(3)))
    upto = Window.orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows
    before = headed.groupBy("__head").agg(F.count("*").alias("__n")).select("__head", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__head").orderBy("__h", *columns))
    return headed.join(F.broadcast(before), "__head").withColumn(place, inside + F.col("__before")).drop("__h", "__head", "__before")


def nested_sample(keys: DataFrame, group: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """k keys per group by hash order, so a smaller sample is part of a larger one."""
    w = Window.partitionBy(group).orderBy(hash_order(seed, key), key)
    return keys.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def cap_ratio(keys: DataFrame, flag: Column, ratio: float, seed: int = 42, key: str = "session") -> DataFrame:
    """All unflagged keys and so many flagged ones by hash order that they are at most `ratio` of the whole."""
    other = keys.where(~flag).count()
    cap = int(ratio * other / (1 - ratio))
    kept = hash_places(keys.where(flag), seed, key, place="__k").where(F.col("__k") <= cap).drop("__k")
    return keys.where(~flag).unionByName(kept)


def control_adds(rows: DataFrame, key: str, order: str, is_add: Column, ratio: float, target: int | None = None, least: int = 2, seed: int = 42) -> DataFrame:
    """Rows of all sessions without an add and of so many with one that they are at most `ratio` of the kept ones; up to `target` sessions in all are filled up with beginnings.

    Sessions with an add stand in hash order: the first ones stay, and of the next
    ones, where there are too few, what comes before their first add, if that is
    `least` rows or more. A ratio of 1 or more keeps all; ratio and target count
    sessions.
    """
    if ratio >= 1:
        return rows
    marked = rows.withColumn("__add", F.coalesce(is_add, F.lit(False)))
    keys = marked.groupBy(key).agg(F.bool_or("__add").alias("__has"), F.min(F.when(F.col("__add"), F.col(order))).alias("__at"))
    counts = keys.agg(F.count_if("__has").alias("adds"), F.count_if(~F.col("__has")).alias("others")).first()
    cap = int(ratio * counts["others"] / (1 - ratio)) if ratio > 0 else 0
    if counts["adds"] <= cap:
        return rows
    placed = hash_places(keys.where("__has"), seed, key, place="__k")
    whole = keys.where("NOT __has").select(key).unionByName(placed.where(F.col("__k") <= cap).select(key))
    out = rows.join(whole, key, "left_semi")
    missing = 0 if target is None else target - counts["others"] - cap
    if missing <= 0:
        return out
    cut = rows.join(placed.where(F.col("__k") > cap).select(key, "__at", "__k"), key).where(F.col(order) < F.col("__at"))
    long = cut.groupBy(key).agg(F.count("*").alias("__n"), F.min("__k").alias("__k")).where(F.col("__n") >= least)
    filled = long.orderBy("__k").limit(missing).select(key)
    return out.unionByName(cut.select(*rows.columns).join(filled, key, "left_semi"))


def split_groups(keys: DataFrame, share: float, seed: int = 42, key: str = "session") -> DataFrame:
    """Keys with `split`: round(share * n), one at least, by hash order are test; no key is in both."""
    n = keys.count()
    test = max(1, round(share * n)) if n else 0
    return hash_places(keys, seed, key, place="__k").withColumn("split", F.when(F.col("__k") <= test, "test").otherwise("train")).drop("__k")


def carve(keys: DataFrame, share: float, most: int | None = None, seed: int = 42, key: str = "session") -> DataFrame:
    """Keys with `split`: the whole part of share * n by hash order, one at least, is val, the rest train; of train at most `most`, the next ones in that order.

    The cap comes after the split, so val is the same whatever the cap; a cap above
    the number of train keys raises.
    """
    n = keys.count()
    val = max(1, int(share * n)) if n else 0
    if most is not None and most > n - val:
        raise ValueError(f"{most} sessions are asked for, {n - val} are there")
    placed = hash_places(keys, seed, key, place="__k").withColumn("split", F.when(F.col("__k") <= val, "val").otherwise("train"))
    return (placed if most is None else placed.where(F.col("__k") <= val + most)).drop("__k")


def leaks(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys in both parts: empty in a sound split."""
    return train.select(key).intersect(test.select(key))


def pool(runs: dict[str, DataFrame], id_column: str) -> DataFrame:
    """All runs under each other, ids prefixed with the run's tag."""
    out = None
    for tag, df in runs.items():
        tagged = df.withColumn(id_column, F.concat(F.lit(f"{tag}__"), F.col(id_column).cast("string")))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows with new ones in their place, by key."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return both.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__v")))).where("__k = 1").drop("__v", "__k")


def dataset_statistics(rows: DataFrame) -> DataFrame:
    """(store, split, n_actions, n_sessions, n_types): overall, per store and per split from one pass; null is all."""
    return rows.groupingSets([[], ["store"], ["split"]], "store", "split").agg(F.count("*").alias("n_actions"), F.countDistinct("session").alias("n_sessions"), F.countDistinct("action").alias("n_types"))


def distribution(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """n, mean, median, population deviation, extremes and quartiles, two decimals."""
    r = lambda c: F.round(c, 2)
    return rows.groupBy(*by).agg(F.count(column).alias("n"), r(F.avg(column)).alias("mean"), r(F.median(column)).alias("median"), r(F.stddev_pop(column)).alias("std"), r(F.min(column).cast("double")).alias("least"), r(F.percentile(column, F.lit(0.25))).alias("p25"), r(F.percentile(column, F.lit(0.75))).alias("p75"), r(F.max(column).cast("double")).alias("most"))


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n, percent): rows that have a field, neither null nor blank."""
    agg = rows.agg(F.count("*").alias("__n"), *[F.count_if(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull()).alias(c) for c in columns])
    return agg.unpivot(["__n"], columns, "field", "n").select("field", "n", F.round(100 * F.col("n") / F.col("__n"), 2).alias("percent"))


def merge_fields(sources: DataFrame) -> DataFrame:
    """(path, value, conflicts): of (path, value, source) the value of the last source, and how many sources said otherwise."""
    last = sources.groupBy("path").agg(F.max_by("value", "source").alias("value"), F.countDistinct("value").alias("__d"))
    return last.select("path", "value", (F.col("__d") - 1).alias("conflicts"))


def shared_ids(rows: DataFrame, method: str, key: str) -> DataFrame:
    """(key, shared): whether all methods have the key."""
    methods = rows.select(method).distinct().count()
    return rows.groupBy(key).agg((F.countDistinct(method) == methods).alias("shared"))
