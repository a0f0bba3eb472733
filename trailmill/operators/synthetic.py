"""Recorded steps of simulated shoppers as sessions of semantic actions, and the methods that their folders stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import product_slug
from .actions import classify_steps
from .sequences import stay_runs

#: Labels of a product's text, in order.
PRODUCT_LABELS = {"product_type": "Product Type", "product_title": "Product Title", "product_description": "Product Description", "product_handle": "Product Handle"}


def synthetic_sessions(steps: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(session_id, ord, action, product_category, product_text, timestamp, url, search_query) of recorded steps.

    steps is (session_id, timestamp, seq, synthetic_action: JSON, url,
    clicked_url); their order is by time as text, then seq. A broken action counts
    as an empty one. Recorded ends are left out and each session gets one of its
    own. Runs of stays keep their first step. Of a run of searches the steps with a
    typed query stay, or else the first one with the query "Failure". ord counts
    what is left, from 0. Sessions without an id are left out.
    """
    payload = F.from_json("synthetic_action", "action string, target string, description string, text string")
    w = Window.partitionBy("session_id").orderBy("timestamp", "seq")
    rows = steps.where("session_id IS NOT NULL").withColumn("__a", payload).withColumns({"ord": F.row_number().over(w), "type": F.lower(F.coalesce("__a.action", F.lit("")))})
    kept = rows.where("type <> 'terminate'").select("session_id", "ord", "type", "timestamp", "url", "clicked_url", F.col("__a.target").alias("target"), F.col("__a.description").alias("description"), F.trim(F.coalesce("__a.text", F.lit(""))).alias("__text"))
    named = classify_steps(kept).withColumn("query", F.when((F.col("semantic") == "explore-search") & (F.col("type") == "type"), F.col("__text")).otherwise(""))
    left = stay_runs(named.withColumnRenamed("semantic", "action"))
    slug = lambda c: product_slug(F.coalesce(F.col(c), F.lit("")))
    body = left.select("session_id", "ord", "action", F.coalesce(F.nullif(slug("clicked_url"), F.lit("")), slug("url")).alias("product_handle"), "timestamp", F.coalesce("clicked_url", F.lit("")).alias("url"), F.col("query").alias("search_query"))
    ends = rows.groupBy("session_id").agg((F.max("ord") + 1).alias("ord"), F.max(F.when(F.col("type") != "terminate", F.struct("ord", "timestamp"))).alias("__l"))
    last = ends.select("session_id", "ord", F.lit("terminate").alias("action"), F.lit("").alias("product_handle"), F.coalesce("__l.timestamp", F.lit("")).alias("timestamp"), F.lit("").alias("url"), F.lit("").alias("search_query"))
    out = body.unionByName(last)
    if catalog is not None:
        parts = [F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.trim(c))) for c, label in PRODUCT_LABELS.items() if c in catalog.columns]
        known = catalog.select("product_handle", F.coalesce("product_type", F.lit("")).alias("product_category"), F.concat_ws(", ", *parts).alias("product_text"))
        out = out.join(known, "product_handle", "left").na.fill("", ["product_category", "product_text"])
    else:
        out = out.withColumns({"product_category": F.lit(""), "product_text": F.lit("")})
    place = (F.row_number().over(Window.partitionBy("session_id").orderBy("ord")) - 1).alias("ord")
    return out.select("session_id", place, "action", "product_category", "product_text", "timestamp", "url", "search_query")


#: The middle of a run folder's name, and the method that it stands for.
METHOD_SLUGS = {"actsingle_fee0_per0_pla0_verno": "trajectory", "actsingle_fee0_per1_pla0_verno": "trajectory+persona", "actsingle_fee1_per1_pla1_verno": "Plan_Act_Reflect", "actsingle_fee1_per1_pla1_verpre": "Ours"}


def method_folders(folders: DataFrame, slugs: dict[str, str] = METHOD_SLUGS) -> DataFrame:
    """(method, path): the folder of each method, of result folders given by (path) relative to their root.

    persona/<name> is the method persona; traj_cond/<model>__<slug>__n<k> the one
    that the slug names, other slugs are passed over. Of several folders the first
    by name counts.
    """
    kind, name = F.split("path", "/")[0], F.split("path", "/")[1]
    slug = F.regexp_replace(F.regexp_extract(name, r"^.*?__(.*)$", 1), r"__n\d+$", "")
    known = F.create_map(*[F.lit(x) for pair in slugs.items() for x in pair])
    method = F.when(kind == "persona", "persona").when((kind == "traj_cond") & name.contains("__"), F.element_at(known, slug))
    two = folders.where(F.size(F.split("path", "/")) == 2)
    return two.select(method.alias("method"), "path").where("method IS NOT NULL").groupBy("method").agg(F.min("path").alias("path"))
