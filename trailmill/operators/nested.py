"""Nested documents as rows: one a node with its path, walked level by level in the JVM.

A document is a VARIANT (or JSON text). Objects of a VARIANT know no order of
keys, so the order of a walk is that of `order`, the fields of the schema, and by
name beyond it; arrays keep theirs. A level is one generator, so a walk is as many
steps as the deepest document has levels, whatever the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strict_json
from .ordering import cut

_PLACE = "array<struct<rank:int,pos:int,key:string>>"
_CONTAINERS = ("OBJECT", "ARRAY")


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID and so on."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def nodes(documents: DataFrame, key: str, document: str, order: tuple[str, ...] = ()) -> DataFrame:
    """(key, path, pattern, above, parent, place, kind, text) of every node below the root of each document, and of the root itself.

    path is like products[0].title, pattern the same with [] for any index, both ''
    for the root; parent and above are those of the node above; place sorts depth
    first. text is the value of a leaf, null for
    containers and JSON nulls. A text that is no JSON has one row of kind INVALID;
    a null document has none.
    """
    spark = documents.sparkSession
    kind = documents.schema[document].dataType.typeName()
    v = F.col(document) if kind == "variant" else strict_json(F.col(document).cast("string"))
    start = documents.where(F.col(document).isNotNull()).select(F.col(key).alias("key"), v.alias("v"))
    known = F.array(*map(F.lit, order)) if order else F.array().cast("array<string>")
    level = start.select("key", F.lit("").alias("path"), F.lit("").alias("pattern"), F.lit(None).cast("string").alias("above"), F.lit(None).cast("string").alias("parent"), F.array().cast(_PLACE).alias("place"), F.coalesce(_kind(F.col("v")), F.lit("INVALID")).alias("kind"), "v")
    out = None
    while True:
        level = cut(level)
        rows = level.select("key", "path", "pattern", "above", "parent", "place", "kind", F.when(~F.col("kind").isin(*_CONTAINERS, "VOID", "INVALID"), F.col("v").cast("string")).alias("text"))
        out = rows if out is None else out.unionAll(rows)
        inner = level.where(F.col("kind").isin(*_CONTAINERS))
        if inner.isEmpty():
            return out.withColumnRenamed("key", key)
        below = inner.withColumnRenamed("key", "__key").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        found = F.array_position(known, F.col("key"))
        step = F.struct(F.when(F.col("key").isNull(), 0).when(found > 0, found).otherwise(len(order) + 1).cast("int").alias("rank"), F.when(F.col("key").isNull(), F.col("pos")).otherwise(0).alias("pos"), F.coalesce("key", F.lit("")).alias("key"))
        name = lambda c, index: F.when(F.col("key").isNull(), F.concat(F.col(c), index)).when(F.col(c) == "", F.col("key")).otherwise(F.concat(F.col(c), F.lit("."), F.col("key")))
        level = below.select(
            F.col("__key").alias("key"),
            name("path", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).alias("path"),
            name("pattern", F.lit("[]")).alias("pattern"),
            F.col("pattern").alias("above"),
            F.col("path").alias("parent"),
            F.concat("place", F.array(step)).alias("place"),
            _kind(F.col("value")).alias("kind"),
            F.col("value").alias("v"),
        )


def leaves(walked: DataFrame) -> DataFrame:
    return walked.where(~F.col("kind").isin(*_CONTAINERS, "INVALID") & (F.col("path") != ""))


def first_leaks(walked: DataFrame, key: str, brands: list[str], allowed: list[str] = ()) -> DataFrame:
    """(key, path, token) of the first text of each document, depth first, that names a brand as a word, in any case; allowed words don't count."""
    from .tasks import literal

    words = "|".join(literal(b) for b in sorted(brands, key=len, reverse=True))
    tokens = F.regexp_extract_all("text", F.lit(rf"(?iuU)(?<!\w)({words})(?!\w)"), F.lit(1)) if brands else F.array().cast("array<string>")
    hits = F.filter(tokens, lambda t: ~F.lower(t).isin(*[a.lower() for a in allowed])) if allowed else tokens
    found = leaves(walked).where("kind = 'STRING'").withColumn("__hits", hits).where("size(__hits) > 0")
    return found.groupBy(key).agg(F.min_by(F.struct("path", F.col("__hits")[0].alias("token")), "place").alias("m")).select(key, "m.path", "m.token")


@dataclass(frozen=True)
class Field:
    """What may stand at a pattern: kinds (of `nodes`), whether it must be there, whether it may be null."""

    kinds: tuple[str, ...]
    required: bool = True
    nullable: bool = False


TEXT, WHOLE, NUMBER, FLAG = ("STRING",), ("BIGINT",), ("BIGINT", "DECIMAL", "DOUBLE"), ("BOOLEAN",)


def _above(pattern: str) -> str:
    return pattern[:-2] if pattern.endswith("[]") else pattern.rpartition(".")[0]


def schema_errors(walked: DataFrame, key: str, schema: dict[str, Field]) -> DataFrame:
    """(key, path, error) of all departures from a closed schema of patterns: not JSON, extra field, missing field, wrong kind. Below an extra field nothing more is said.

    The pattern '' is the root. Names with dots or brackets are not told apart from paths.
    """
    spark = walked.sparkSession
    rows = [(p, _above(p), list(f.kinds), f.required, f.nullable) for p, f in schema.items()]
    fields = spark.createDataFrame(rows, "pattern string, __above string, kinds array<string>, required boolean, nullable boolean")
    judged = walked.where("kind <> 'INVALID'").join(F.broadcast(fields.drop("__above")), "pattern", "left")  # a row a field
    invalid = walked.where("kind = 'INVALID'").select(key, "path", F.lit("not JSON").alias("error"))
    known = F.broadcast(fields.select(F.col("pattern").alias("above")))
    extra = judged.where("kinds IS NULL AND path <> ''").join(known, "above", "left_semi").select(key, "path", F.lit("extra field").alias("error"))
    right = F.array_contains("kinds", F.col("kind")) | (F.col("nullable") & (F.col("kind") == "VOID"))
    wrong = judged.where("kinds IS NOT NULL").where(~right).select(key, "path", F.concat(F.lit("expected "), F.array_join("kinds", " or "), F.lit(", got "), F.col("kind")).alias("error"))
    needed = fields.where("required AND pattern <> '' AND NOT endswith(pattern, '[]')").select(F.col("__above").alias("pattern"), F.element_at(F.split("pattern", r"\."), -1).alias("__name"))
    asked = walked.where("kind = 'OBJECT'").join(F.broadcast(needed), "pattern").select(key, F.concat_ws(".", F.nullif("path", F.lit("")), "__name").alias("path"))
    missing = asked.join(walked.select(key, "path"), [key, "path"], "left_anti").select(key, "path", F.lit("missing field").alias("error"))
    return invalid.unionAll(extra).unionAll(wrong).unionAll(missing)


def menu_entries(walked: DataFrame, key: str, items: str = "items") -> DataFrame:
    """(key, path, depth, place, title, url): recursive menus flat, depth first; depth 0 are entries of a top menu."""
    own = leaves(walked).where(F.col("pattern").rlike(rf"(^|\.){items}\[\]\.(title|url)$"))
    named = own.withColumn("__n", F.regexp_extract("path", r"([^.]+)$", 1))
    place = F.slice("place", F.lit(1), F.size("place") - 1)
    grouped = named.groupBy(key, F.col("parent").alias("path")).agg(F.min(place).alias("place"), F.max(F.when(F.col("__n") == "title", F.col("text"))).alias("title"), F.max(F.when(F.col("__n") == "url", F.col("text"))).alias("url"))
    depth = F.size(F.filter("place", lambda s: s["key"] == items)) - 1
    return grouped.select(key, "path", depth.alias("depth"), "place", "title", "url")
