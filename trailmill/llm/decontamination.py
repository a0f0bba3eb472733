"""Operator 12: text of benchmark items in documents, found by winnowing. SQL functions only.

Both sides are cut into grams of `GRAM` words. Of every window of grams that spans
10 words the least hash stays as a fingerprint (the first place, where it stands
twice), so any 10 words that two texts share leave the same gram at the same
place of both. Fingerprints of documents that are none of the benchmark's go in a
semi join; what is left is put beside the item's words and extended to both
sides, word by word. A run of 10 equal words is a hit, a hash never is. Items
of fewer words are windows by themselves, with grams and windows to their length;
they cost a pass over the hashes a length that occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared
from .words import word_list

WINDOW = 10
GRAM = 5
REACH = WINDOW - GRAM  # words that a window can have on either side of its gram
PLACE_BITS = 28  # a fingerprint is 36 bits of hash over the gram's place in its text
BROADCAST_HASHES = 2_000_000
BROADCAST_PLACES = 100_000
KEY = ["id_hash", "text_hash"]


def _keyed(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, text) and two hashes that stand for both; equal rows share them and have equal results."""
    i, t = F.col(f"`{id_column}`"), F.col(f"`{text}`")
    return df.select(i.alias("id"), t.alias("text"), F.xxhash64(i.isNull(), i).alias("id_hash"), F.xxhash64(t.isNull(), t).alias("text_hash"))


def _fingerprints(df: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """`keep` and one row a fingerprint of the texts' `words`: for windows of each of the given lengths in words."""
    hashed = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    size = lambda n: min(GRAM, n)
    place = F.lit((1 << PLACE_BITS) - 1).cast("long")

    def gram(k: int):
        at = lambda x, i: F.xxhash64(x, *[F.get("h", i + d) for d in range(1, k)]).bitwiseAND(F.bitwise_not(place)).bitwiseOR(i.cast("long"))
        return F.slice(F.transform("h", at), F.lit(1), F.greatest(F.size("h") - (k - 1), F.lit(0)))

    grams = hashed.select(*keep, *[gram(k).alias(f"g{k}") for k in sorted({size(n) for n in lengths})])

    def least(n: int) -> Column:
        k = size(n)
        if n == k:
            return F.col(f"g{k}")
        return F.transform(f"g{k}", lambda x, i: F.least(x, *[F.get(f"g{k}", i + d) for d in range(1, n - k + 1)]))

    marks = grams.select(*keep, F.array_distinct(reduce(F.concat, [least(n) for n in lengths])).alias("marks"))
    # Outer: explode() would add a filter on `marks` that the optimizer moves down, with all of its expression, to each word.
    exploded = marks.select(*keep, F.explode_outer("marks").alias("mark")).where("mark IS NOT NULL")
    return exploded.select(*keep, F.shiftright("mark", PLACE_BITS).alias("hash"), F.col("mark").bitwiseAND(place).cast("int").alias("at"))


def _around(words: str, at: str) -> Column:
    """The words from REACH before a place to WINDOW behind it, and how many of them are before."""
    begin = f"greatest({at} - {REACH}, 0)"
    return F.struct(F.expr(f"slice({words}, {begin} + 1, {at} - {begin} + {WINDOW})").alias("words"), F.expr(f"{at} - {begin}").alias("before"))


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) of every row of docs.

    A word is hit if it lies in an occurrence of WINDOW consecutive words of an
    item, or of all words of an item that has fewer. items are the sorted ids, as
    strings, of the items with an occurrence.

    Null and empty texts have no words, are not hit and hit nothing. Rows of docs
    that repeat get a result each. An item id that repeats is named once; an item
    without an id hits words but is not named. Rows with equal ids and different
    texts are told apart. Empty tables are fine on both sides. No other column is
    read.
    """
    keyed = _keyed(docs, id_column, text)
    terms = items.select(F.col(f"`{item_column}`").cast("string").alias("item"), word_list(F.col(f"`{text}`")).alias("words")).where("size(words) > 0")
    terms = terms.withColumn("need", F.least(F.size("words"), F.lit(WINDOW)))
    lengths = sorted(r["need"] for r in terms.select("need").distinct().collect())  # WINDOW numbers at most
    keep = ["item", "words", "need"]
    of_length = [_fingerprints(terms.where(F.col("need") == n), [n], keep) for n in lengths]
    counted = keyed.select("id", F.size(word_list(F.col("text"))).cast("long").alias("n_words"), *KEY)
    if not of_length:
        return counted.select(F.col("id").alias(id_column), "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    places = shared(reduce(DataFrame.unionAll, of_length).select("hash", "item", "need", _around("words", "at").alias("theirs")))
    hashes = places.select("hash").distinct()
    worded = keyed.select(*KEY, word_list(F.col("text")).alias("words"))
    if hashes.count() <= BROADCAST_HASHES:
        # The words stay beside the fingerprints up to the join, in one task; what goes on has its few words around.
        marks = _fingerprints(worded, lengths, [*KEY, "words"]).join(F.broadcast(hashes), "hash", "left_semi")
        ours = marks.select(*KEY, "hash", "at", _around("words", "at").alias("ours"))
    else:
        anchors = shared(_fingerprints(worded, lengths, KEY).join(hashes, "hash", "left_semi").distinct())
        touched = keyed.join(anchors.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY)
        ours = touched.select(*KEY, word_list(F.col("text")).alias("words")).join(anchors, KEY).select(*KEY, "hash", "at", _around("words", "at").alias("ours"))
    both = ours.join(F.broadcast(places) if places.count() <= BROADCAST_PLACES else places, "hash")
    same = lambda d: f"coalesce(get(ours.words, ours.before + {d}) = get(theirs.words, theirs.before + {d}), false)"
    ahead = F.expr("CASE " + " ".join(f"WHEN NOT {same(d)} THEN {d}" for d in range(WINDOW)) + f" ELSE {WINDOW} END")
    back = F.expr("CASE " + " ".join(f"WHEN NOT {same(-d)} THEN {d - 1}" for d in range(1, REACH + 1)) + f" ELSE {REACH} END")
    runs = both.select(*KEY, "item", "need", "at", ahead.alias("ahead"), back.alias("back")).where("ahead > 0 AND ahead + back >= need")
    runs = shared(runs.select(*KEY, "item", (F.col("at") - F.col("back")).alias("begin"), (F.col("at") + F.col("ahead")).alias("end")).distinct())

    before = Window.partitionBy(*KEY).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest(F.col("begin"), F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    hit = runs.select(*KEY, "begin", "end").distinct().select(*KEY, fresh.alias("fresh")).groupBy(*KEY).agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = runs.select(*KEY, "item").distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = hit.join(named, KEY)
    none = F.array().cast("array<string>")
    out = counted.join(found, KEY, "left").select(F.col("id").alias(id_column), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))
    return out.select(id_column, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))
