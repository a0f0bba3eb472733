"""Places and groups over ranges against plain loops."""

import random

from pyspark.sql import functions as F

from trailmill.operators.ordering import sorted_places
from trailmill.operators.sequences import groups_of_prefixes


def test_sorted_places_with_ties_nulls_and_a_hot_value(spark):
    rng = random.Random(3)
    rows = [(i, None if rng.random() < 0.4 else rng.choice([1.5, 2.0, 7.0]), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, price double, place string").repartition(7)
    got = {r.id: r.place for r in sorted_places(df.drop("place"), F.asc_nulls_last("price"), "id").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {r[0]: k for k, r in enumerate(want, 1)}
    down = {r.id: r.n for r in sorted_places(df, F.desc_nulls_first("price"), F.desc("id"), place="n").collect()}
    assert down == {k: len(rows) + 1 - n for k, n in got.items()}
    equal = spark.createDataFrame([(1,)] * 50, "id long")
    assert sorted(r.place for r in sorted_places(equal, "id").collect()) == list(range(1, 51))
    assert sorted_places(df.drop("place").limit(0), "id").collect() == []


def test_groups_of_prefixes_over_range_borders(spark):
    rng = random.Random(5)
    lengths = [x for _ in range(400) for x in range(rng.randint(1, 9), 0, -1)]
    lengths[10] = lengths[700] = None
    df = spark.createDataFrame(list(enumerate(lengths)), "o long, length int").repartition(5)
    want, group = {}, 0
    for i, n in enumerate(lengths):
        before = lengths[i - 1] if i else None
        group += before is None or n is None or n != before - 1
        want[i] = group
    assert {r.o: r.grp for r in groups_of_prefixes(df, "o").collect()} == want
    assert groups_of_prefixes(df.limit(0), "o").collect() == []
