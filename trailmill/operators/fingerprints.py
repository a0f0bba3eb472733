"""A fingerprint of a list of records that depends on their order and on nothing else."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import cut, sorted_places

CHUNK = 10_000


def json_text(value: Column) -> Column:
    """A text as a JSON string, escaping only what must be; null is null."""
    out = value
    for raw, safe in [("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
        out = F.replace(out, F.lit(raw), F.lit(safe))
    for code in range(32):
        if chr(code) not in "\b\f\n\r\t":
            out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def protocol_record(session: Column, source: Column, outcome: Column, actions: Column) -> Column:
    """What of a record can affect a run, as JSON with sorted keys and no blanks: actions that are not blank, outcome, session, source."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kept = F.transform(F.filter(F.coalesce(actions, F.array().cast("array<string>")), lambda a: F.coalesce(a != "", F.lit(False))), json_text)
    return F.concat(F.lit('{"actions":['), F.array_join(kept, ","), F.lit('],"outcome":'), json_text(outcome), F.lit(',"session_id":'), json_text(blank(session)), F.lit(',"source":'), json_text(blank(source)), F.lit("}"))


def list_fingerprint(records: DataFrame, text: str, *order: str, chunk: int = CHUNK, levels: int | None = None) -> DataFrame:
    """(n, fingerprint): SHA-256 of the JSON list of the record texts in the given order.

    A list of up to `chunk` records is hashed as it is. Of a longer one each run of
    `chunk` records is hashed as a list, then each run of `chunk` hashes as a list
    of JSON strings, and so on up to one; so no task ever holds more than one
    run. Rows that are equal in the whole order must have equal texts. An empty
    list is [].

    With `levels` the folding ends after so many. There is a row for each hash that
    is left then, none for an empty list, and a run of one hash stays that hash.
    """
    level = cut(sorted_places(records.select(F.col(text).alias("text"), *order), *order).select((F.col("place") - 1).alias("i"), "text"))
    n = level.count()
    left = n
    for done in count(1):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), ",")
        hashed = F.sha2(F.concat(F.lit("["), joined, F.lit("]")), 256)
        if levels is not None and done > 1:
            hashed = F.when(F.count("*") == 1, F.btrim(F.min("text"), F.lit('"'))).otherwise(hashed)
        level = level.groupBy(F.expr(f"i div {chunk}").alias("i")).agg(hashed.alias("h"))
        left = -(-left // chunk)
        if left <= 1 or done == levels:
            break
        level = cut(level.select("i", F.concat(F.lit('"'), "h", F.lit('"')).alias("text")))
    if levels is not None:
        return level.select(F.lit(n).cast("long").alias("n"), F.col("h").alias("fingerprint"))
    one = level.agg(F.max("h").alias("h"))
    return one.select(F.lit(n).cast("long").alias("n"), F.coalesce("h", F.sha2(F.lit("[]"), 256)).alias("fingerprint"))
