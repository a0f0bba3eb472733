"""Item-sequence corpora: filtering, vocabularies, prefix examples, co-occurrence, priors.

Sequences are rows (session, pos, item); pos orders the items of a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import apart, before_range, cut, ranged, shares, sorted_places


def collapse_repeats(rows: DataFrame) -> DataFrame:
    """Rows whose item differs from the one before in the session."""
    w = Window.partitionBy("session").orderBy("pos")
    return rows.withColumn("__b", F.lag("item").over(w)).where(~F.col("item").eqNullSafe(F.col("__b"))).drop("__b")


def min_frequency(rows: DataFrame, least: int = 5) -> DataFrame:
    """One pass: sessions of one item go, then items seen under `least` times, then sessions left with one item."""
    by_session, by_item = Window.partitionBy("session"), Window.partitionBy("item")
    some = rows.withColumn("__n", F.count("*").over(by_session)).where("__n > 1")
    often = some.withColumn("__n", F.count("*").over(by_item)).where(F.col("__n") >= least)
    return often.withColumn("__n", F.count("*").over(by_session)).where("__n >= 2").drop("__n")


def renumber_positions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("session").orderBy("pos")))


def vocabulary(rows: DataFrame) -> DataFrame:
    """(item, id): ids from 1 in the order in which items are first seen, sessions ascending."""
    first = rows.groupBy("item").agg(F.min(F.struct("session", "pos")).alias("f"))
    return sorted_places(first, "f", place="id").select("item", "id")


def to_ids(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows with the ids of known items; unknown items go, and sessions left with one item."""
    known = rows.join(vocab, "item").select("session", "pos", F.col("id").alias("item"))
    return known.withColumn("__n", F.count("*").over(Window.partitionBy("session"))).where("__n > 1").drop("__n")


def prefixes(rows: DataFrame) -> DataFrame:
    """(session, length, prefix, label): every proper prefix of a session with the item that follows, longest first."""
    s = rows.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items")).where("size(items) > 1")
    ex = s.select("session", "items", F.explode(F.sequence(F.size("items") - 1, F.lit(1))).alias("length"))
    return ex.select("session", "length", F.slice("items", F.lit(1), F.col("length")).alias("prefix"), F.element_at("items", F.col("length") + 1).alias("label"))


def groups_of_prefixes(examples: DataFrame, order: str) -> DataFrame:
    """Examples with `grp`, from 1: a new group starts where the length does not shrink by one.

    Ranges of the order are numbered by themselves; a range's first row looks at
    the last length of the range before, and its groups follow those before it.
    The order must tell rows apart and hold no nulls.
    """
    rows = ranged(examples, order)
    inside = Window.partitionBy("__part").orderBy(order)
    ends = rows.groupBy("__part").agg(F.max_by(F.struct("length"), order).alias("__end"))
    ends = ends.select("__part", F.lag("__end").over(Window.orderBy("__part"))["length"].alias("__prior"))  # one row a range
    previous = F.when(F.row_number().over(inside) == 1, F.col("__prior")).otherwise(F.lag("length").over(inside))
    fresh = F.coalesce((F.col("length") != previous - 1).cast("int"), F.lit(1))
    flagged = rows.join(F.broadcast(ends), "__part").withColumn("__f", fresh)
    before = before_range(flagged.groupBy("__part").agg(F.sum("__f").alias("__n")), "__n")
    numbered = flagged.join(F.broadcast(before), "__part").withColumn("grp", F.sum("__f").over(inside) + F.col("__before"))
    return numbered.drop("__part", "__prior", "__f", "__before")


def counters(examples: DataFrame, rows: DataFrame) -> DataFrame:
    """(kind, key, n): items, labels and item-to-item transitions."""
    w = Window.partitionBy("session").orderBy("pos")
    items = rows.groupBy(F.col("item").cast("string").alias("key")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("item"))
    labels = examples.groupBy(F.col("label").cast("string").alias("key")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("label"))
    moves = rows.withColumn("__n", F.lead("item").over(w)).where("__n IS NOT NULL").groupBy(F.concat_ws(">", "item", "__n").alias("key")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("transition"))
    return items.unionByName(labels).unionByName(moves).select("kind", "key", "n")


def distribution_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tv, overlap) of two tables of (key, n): total variation and weighted overlap; empty sides give 1 and 0."""
    both = a.select("key", F.col("n").alias("x")).join(b.select("key", F.col("n").alias("y")), "key", "full").na.fill(0, ["x", "y"])
    whole = a.agg(F.sum("n").alias("__x")).crossJoin(b.agg(F.sum("n").alias("__y")))
    p = F.col("x") / F.nullif(F.col("__x"), F.lit(0))
    q = F.col("y") / F.nullif(F.col("__y"), F.lit(0))
    shares = both.crossJoin(F.broadcast(whole)).select(p.alias("p"), q.alias("q"))  # one row
    return shares.agg(F.round(F.coalesce(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, F.lit(1.0)), 9).alias("tv"), F.round(F.coalesce(F.sum(F.least("p", "q")) / F.sum(F.greatest("p", "q")), F.lit(0.0)), 9).alias("overlap"))


def alignment(real: DataFrame, synth: DataFrame, by: str = "store") -> DataFrame:
    """Per store: distinct items of both sides, shared ones, and the shares covered."""
    a = real.select(by, "item").distinct().withColumn("r", F.lit(1))
    b = synth.select(by, "item").distinct().withColumn("s", F.lit(1))
    both = a.join(b, [by, "item"], "full")
    out = both.groupBy(by).agg(F.count("r").alias("n_real"), F.count("s").alias("n_synth"), F.count_if(F.col("r").isNotNull() & F.col("s").isNotNull()).alias("n_both"))
    return out.withColumns({"covered_real": F.round(F.col("n_both") / F.nullif(F.col("n_real"), F.lit(0)), 9), "covered_synth": F.round(F.col("n_both") / F.nullif(F.col("n_synth"), F.lit(0)), 9)})


def popularity(rows: DataFrame, k: int) -> DataFrame:
    """(item, n, rank) of the k most frequent items, ties to the smaller item."""
    top = rows.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "item")))


def popularity_ties(rows: DataFrame, k: int) -> DataFrame:
    """(cutoff, sure, tied, open): the count at the cut-off, items above it, items at it, and how many of them fit."""
    counts = rows.groupBy("item").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "item").limit(k).agg(F.min("n").alias("cutoff"))
    return counts.crossJoin(F.broadcast(top)).groupBy("cutoff").agg(F.count_if(F.col("n") > F.col("cutoff")).alias("sure"), F.count_if(F.col("n") == F.col("cutoff")).alias("tied")).withColumn("open", F.lit(k) - F.col("sure"))  # one row


def score_ranking(labels: DataFrame, ranking: DataFrame, k: int) -> DataFrame:
    """HR@k and MRR@k of one ranking (item, rank) for labels (label)."""
    hit = labels.join(F.broadcast(ranking.where(F.col("rank") <= k).select(F.col("item").alias("label"), "rank")), "label", "left")
    return hit.agg(F.count("*").alias("n"), F.round(F.avg(F.col("rank").isNotNull().cast("int")), 9).alias("hr"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 9).alias("mrr"))


def popularity_range(train: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(hr_by_id, hr_min, hr_max, n_tied, n_slots): hit rate of the k most frequent items of `train` for the labels.

    Items tied at the cut-off compete for the last slots: by id, and the least
    and greatest rate that any choice of them gives. No label gives null rates.
    """
    ties = popularity_ties(train, k)
    hits = labels.groupBy(F.col("label").alias("item")).agg(F.count("*").alias("h"))
    items = train.groupBy("item").agg(F.count("*").alias("n")).join(F.broadcast(ties.select("cutoff", "tied", "open")), F.col("n") >= F.col("cutoff")).join(hits, "item", "left").na.fill(0, ["h"])  # one row of ties
    slots = F.least("open", "tied")
    tied = items.where("n = cutoff")
    place = lambda *order: F.row_number().over(Window.partitionBy("cutoff").orderBy(*order)) <= slots
    chosen = tied.select("h", *[place(*o).alias(c) for c, o in (("by_id", ["item"]), ("fewest", ["h", "item"]), ("most", [F.desc("h"), "item"]))])
    sums = chosen.agg(*[F.coalesce(F.sum(F.when(F.col(c), F.col("h"))), F.lit(0)).alias(c) for c in ("by_id", "fewest", "most")])
    sure = items.where("n > cutoff").agg(F.coalesce(F.sum("h"), F.lit(0)).alias("sure"))
    one = sums.crossJoin(sure).crossJoin(labels.agg(F.count("*").alias("n"))).crossJoin(ties.select(F.col("tied").alias("n_tied"), F.col("open").cast("long").alias("n_slots")))  # one row each
    rate = lambda c: F.round((F.col("sure") + F.col(c)) / F.nullif(F.col("n"), F.lit(0)), 9)
    return one.select(rate("by_id").alias("hr_by_id"), rate("fewest").alias("hr_min"), rate("most").alias("hr_max"), "n_tied", "n_slots")


def cooccurrence(rows: DataFrame, *by: str) -> DataFrame:
    """(i, j, n): over all pairs of positions of a session with different items, both directions.

    Sessions and pairs go into parts that grow with the rows, which are counted
    first; keep them (`cut`) if they are costly. Pairs are dealt out by `by`, both items
    if not given; what goes on by item gives "i".
    """
    parts = shares(rows)
    dealt = rows.select("session", "pos", "item").repartition(parts, "session")
    a = dealt.select("session", F.col("pos").alias("p"), F.col("item").alias("i"))
    b = dealt.select("session", F.col("pos").alias("q"), F.col("item").alias("j"))
    once = a.join(apart(b), "session").where("p <> q AND i < j").select("i", "j")
    ways = lambda df, *more: df.select(F.inline(F.array(F.struct("i", "j", *more), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), *more))))
    if by:
        return ways(once).repartition(parts, *by).groupBy("i", "j").agg(F.count("*").alias("n"))
    return ways(once.repartition(parts, "i", "j").groupBy("i", "j").agg(F.count("*").alias("n")), "n")


def adjacency(pairs: DataFrame) -> DataFrame:
    """Co-occurrence with weights that sum to 1 in a row."""
    return pairs.withColumn("w", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("i")), 9))


def top_neighbours(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k neighbours of highest count of each item, ties to the smaller one."""
    w = Window.partitionBy("i").orderBy(F.desc("n"), "j")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbour_flags(examples: DataFrame, neighbours: DataFrame, miss: int = -1) -> DataFrame:
    """Examples with `flag`: 1 if the label is a top neighbour of any prefix item, else `miss`."""
    items = examples.select("session", "length", "label", F.explode(F.array_distinct("prefix")).alias("i"))
    hit = items.join(neighbours.select("i", F.col("j").alias("label"), F.lit(1).alias("h")), ["i", "label"], "left")
    return hit.groupBy("session", "length", "label").agg(F.coalesce(F.max("h"), F.lit(miss)).alias("flag"))


def price_levels(catalog: DataFrame, levels: int = 99) -> DataFrame:
    """Catalog with `level`: 1 + the price's place between the extremes of its type, in `levels` steps; 1 where they are equal."""
    w = Window.partitionBy("product_type")
    lo, hi = F.min("price").over(w), F.max("price").over(w)
    return catalog.withColumn("level", F.when(hi > lo, ((F.col("price") - lo) / (hi - lo) * levels).cast("int") + 1).otherwise(1))


def first_seen_codes(rows: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code): codes from 1 in first-seen order."""
    return sorted_places(rows.groupBy(column).agg(F.min(order).alias("__f")), "__f", column, place="code").select(column, "code")


def negatives(items: DataFrame, pairs: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """k items per item that it never occurs with, by hash order: its candidates are a rotation of the vocabulary, so no item meets all others.

    Of the vocabulary in hash order, the items after an item's own place are
    tried; those that co-occur are skipped. Each item tries k more than tries of it
    would hit a neighbour, so k are found whenever so many exist. `items` are
    distinct, and so are the pairs.
    """
    headed = items.withColumn("__h", F.xxhash64("item", F.lit(seed))).withColumn("__head", F.shiftright("__h", 52))
    upto = Window.orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows
    before = headed.groupBy("__head").agg(F.count("*").alias("__n")).select("__head", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__head").orderBy("__h", "item"))
    placed = headed.join(F.broadcast(before), "__head").select("item", (inside + F.col("__before")).alias("p"))
    placed = cut(placed)
    n = placed.count()
    # What a try of an item would hit is told by the places of its neighbours, so only hits are kept and only k tries an item go on.
    met = pairs.select("i", "j").join(apart(placed.select(F.col("item").alias("i"), F.col("p").alias("__p"))), "i").withColumn("__most", F.count("*").over(Window.partitionBy("i")) + k)
    hits = met.join(apart(placed.select(F.col("item").alias("j"), F.col("p").alias("__q"))), "j").withColumn("step", F.pmod(F.col("__q") - F.col("__p"), F.lit(n))).where("step <= __most")
    hit = hits.groupBy(F.col("i").alias("item")).agg(F.collect_set("step").alias("__hit"))
    tried = placed.join(apart(hit), "item", "left").withColumn("__hit", F.coalesce("__hit", F.array().cast("array<bigint>")))
    last = F.least(F.lit(n - 1), F.size("__hit") + k).cast("long")
    free = F.slice(F.array_except(F.sequence(F.lit(1).cast("long"), last), "__hit"), 1, k)
    steps = tried.where(last > 0).select("item", "p", F.posexplode(free).alias("__r", "step"))
    wanted = steps.select("item", (F.col("__r") + 1).alias("rank"), ((F.col("p") + F.col("step") - 1) % n + 1).alias("q"))
    return wanted.join(apart(placed.select(F.col("item").alias("negative"), F.col("p").alias("q"))), "q").select("item", "negative", "rank")


def stay_runs(rows: DataFrame) -> DataFrame:
    """Runs of stays leave their first row; runs of searches leave the rows with a query, or their first row marked `Failure`.

    Rows are (session_id, ord, action, query); query is empty where none was typed.
    """
    w = Window.partitionBy("session_id").orderBy("ord")
    fresh = F.coalesce((F.col("action") != F.lag("action").over(w)).cast("int"), F.lit(1))
    runs = rows.withColumn("__f", fresh).withColumn("__i", F.sum("__f").over(w))
    run = Window.partitionBy("session_id", "__i")
    marked = runs.withColumns({"__typed": F.max((F.col("query") != "").cast("int")).over(run), "__k": F.row_number().over(run.orderBy("ord"))})
    stay, search = F.col("action") == "explore-stay", F.col("action") == "explore-search"
    keep = F.when(stay, F.col("__k") == 1).when(search & (F.col("__typed") == 1), F.col("query") != "").when(search, F.col("__k") == 1).otherwise(True)
    return marked.where(keep).withColumn("query", F.when(search & (F.col("__typed") == 0), "Failure").otherwise(F.col("query"))).drop("__f", "__i", "__typed", "__k")


def drop_search_clicks(rows: DataFrame, is_click) -> DataFrame:
    """Rows without the clicks that come directly before a search."""
    nxt = F.lead("action").over(Window.partitionBy("session_id").orderBy("ord"))
    return rows.withColumn("__n", nxt).where(~(is_click & F.coalesce(F.col("__n") == "explore-search", F.lit(False)))).drop("__n")
