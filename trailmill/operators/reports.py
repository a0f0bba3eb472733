"""Results in the shapes in which they are handed on: envelopes, tables, records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def envelope(metrics: dict[str, DataFrame]) -> DataFrame:
    """One row with one struct a one-row metric frame; `simple` of it keeps chosen fields."""
    out = None
    for name, df in metrics.items():
        one = df.select(F.struct(*df.columns).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def simple(env: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Chosen fields of an envelope under flat names."""
    return env.select(*[F.col(path).alias(name) for name, path in fields.items()])


def long_metrics(df: DataFrame, section: str) -> DataFrame:
    """(section, name, value) of a one-row frame of numbers."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
    return doubles.unpivot([], doubles.columns, "name", "value").select(F.lit(section).alias("section"), "name", "value")


def buyer_records(features: DataFrame, products: DataFrame, buyer: str = "client_id") -> DataFrame:
    """(buyer, record): a buyer's features and products as one JSON object."""
    p = products.groupBy(buyer).agg(F.array_sort(F.collect_list(F.struct("rank", "product_handle", "price"))).alias("browsed_products"))
    both = features.join(p, buyer, "left")
    return both.select(buyer, F.to_json(F.struct(*[c for c in both.columns if c != buyer])).alias("record"))


def count_features():
    """A function of JSON texts: how many leaves are true, plus the lengths of all lists, at any depth."""

    @F.pandas_udf("long")
    def count(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import json

        def walk(x) -> int:
            if isinstance(x, bool):
                return int(x)
            if isinstance(x, list):
                return len(x) + sum(walk(y) for y in x if isinstance(y, (dict, list)))
            return sum(map(walk, x.values())) if isinstance(x, dict) else 0

        def one(text) -> int:
            try:
                return walk(json.loads(text))
            except (TypeError, ValueError):
                return 0

        for v in values:
            yield v.map(one).astype("int64")

    return count


def typed_variants(raw: Column) -> Column:
    """Variants of a feed with numeric prices and an availability that is false where it is missing."""
    return F.transform(raw, lambda v: F.struct(v["id"].alias("id"), v["title"].alias("title"), v["price"].try_cast("double").alias("price"), F.coalesce(v["available"], F.lit(False)).alias("available")))
