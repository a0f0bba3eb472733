"""Operator 11: how far the sources of each language differ in their terms, by sorted runs.

A map task counts the terms of a block of documents, so a term in a third of all
documents sends one row a source and block. The rows are summed by (lang, term,
source, document), dealt by (lang, term) and sorted by (lang, term, source,
document). One scan over a sorted partition finds runs: a run of (lang, term)
yields the document frequency and, if enough documents have it, the counts of its
sources. A row has a document of its own only where one very long text came in
pieces; then the run of that document counts once.

The second pass deals the kept terms again, in slices of about `SLICE_ROWS` rows
and, where a language has more than `BLOCK` sources, by pairs of blocks of them.
A slice is a matrix of terms by sources, absent terms at their source's least
value; it gives one partial sum a pair of sources. So a task holds one slice and
2 * BLOCK sources whatever the size of the input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, shared

SCALE = 1_000_000_000
SMOOTH = 5
LEAST_DOCS = 30
TOP_TERMS = 50
HELD_TERMS = 300_000  # (source, term) counts that a map task holds before it sends them on
PIECE_BYTES = 1 << 20  # texts are cut into words so much at a time
LONG_BYTES = 16 << 20  # longer texts are counted in pieces
SLICE_ROWS = 20_000
BLOCK = 256

#: Bytes of letters, A-Z made small, everything else of ASCII a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, document long, docs long, n long"
_KEPT = "lang string, source string, term string, n long, lang_n long, head int"


def _pieces(text: bytes, most: int) -> Iterator[list[bytes]]:
    """The terms of a text, about `most` bytes at a time."""
    text = text.translate(_LETTERS)
    at = 0
    while len(text) - at > most:
        to = text.find(b" ", at + most)
        if to < 0:
            break
        yield text[at:to].split(b" ")
        at = to
    yield text[at:].split(b" ")


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows(lang: str, source: str, document: int | None, counts: Counter, docs: Counter | None) -> Iterator[pa.RecordBatch]:
        counts.pop(b"", None)
        terms = list(counts)
        for at in range(0, len(terms), 50_000):
            some = terms[at : at + 50_000]
            k = len(some)
            yield pa.record_batch(
                [
                    pa.array([lang] * k, pa.string()),
                    pa.array([source] * k, pa.string()),
                    pa.array(some, pa.binary()).cast(pa.string()),
                    pa.array([document] * k, pa.int64()),
                    pa.array([docs[t] if docs else 0 for t in some], pa.int64()),
                    pa.array([counts[t] for t in some], pa.int64()),
                ],
                names=["lang", "source", "term", "document", "docs", "n"],
            )

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            yield from rows(lang, source, None, counts, docs)
        held.clear()

    size = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for i, (lang, source, document) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "row")), strict=True)):
            text = texts[i].as_py()
            if len(text) > LONG_BYTES:
                for words in _pieces(text, LONG_BYTES // 4):
                    yield from rows(lang, source, document, Counter(words), None)
                continue
            if (lang, source) not in held:
                held[lang, source] = Counter(), Counter()
            counts, docs = held[lang, source]
            before = len(docs)
            seen: set[bytes] = set()
            for words in _pieces(text, PIECE_BYTES):
                counts.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(docs) - before
            if size > HELD_TERMS:
                yield from flush()
                size = 0
    yield from flush()


def _starts(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Where the runs of equal values begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in columns:
        col = table.column(c).combine_chunks()
        if len(col) > 1:
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _runs(least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
            groups, runs = _starts(t, ("lang", "term", "source")), _starts(t, ("lang", "term"))
            document = t.column("document").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            docs = np.where(document, 1, t.column("docs").to_numpy())
            n = t.column("n").to_numpy()
            run_of = np.searchsorted(runs, groups, "right") - 1
            df, total = np.add.reduceat(docs, runs), np.add.reduceat(n, runs)
            keep = (df >= least)[run_of]
            at = groups[keep]
            if len(at):
                rows = t.take(pa.array(at))
                yield from pa.table(
                    [rows.column("lang"), rows.column("source"), rows.column("term"), np.add.reduceat(n, groups)[keep], total[run_of][keep], np.isin(at, runs).astype(np.int32)],
                    names=["lang", "source", "term", "n", "lang_n", "head"],
                ).to_batches()

        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if t.num_rows == 0:
                continue
            last = int(_starts(t, ("lang", "term"))[-1])
            if last:
                yield from whole(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield from whole(rest)

    return scan


def _pair_sums(table: pa.Table) -> pa.Table:
    """Partial sums of a slice: sum over its terms of the two sources' difference, for each ordered pair of sources."""
    first = {c: table.column(c)[0].as_py() for c in ("lang", "bi", "bj")}
    term = table.column("term").combine_chunks()
    base, side = term.is_null().to_numpy(zero_copy_only=False), table.column("side").to_numpy()
    at, p = table.column("at").to_numpy(), table.column("p").to_numpy()
    codes = term.dictionary_encode().indices.fill_null(0).to_numpy()
    n_terms = int(codes[~base].max()) + 1 if (~base).any() else 0

    def matrix(s: int) -> np.ndarray:
        own = base & (side == s)
        least = np.zeros(int(own.sum()), np.int64)
        least[at[own]] = p[own]
        out = np.tile(least, (n_terms, 1))
        rows = ~base & (side == s)
        out[codes[rows], at[rows]] = p[rows]
        return out

    a = matrix(0)
    same = first["bi"] == first["bj"]
    b = a if same else matrix(1)
    sums = np.zeros((a.shape[1], b.shape[1]), np.int64)
    for t in range(0, n_terms, 1_000):
        for i in range(a.shape[1]):
            sums[i] += np.abs(a[t : t + 1_000, i : i + 1] - b[t : t + 1_000]).sum(0)
    i, j = np.indices(sums.shape).reshape(2, -1)
    i, j, v = first["bi"] * BLOCK + i, first["bj"] * BLOCK + j, sums.ravel()
    i, j, v = (i[i != j], j[i != j], v[i != j]) if same else (np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([v, v]))
    return pa.table({"lang": pa.array([first["lang"]] * len(i), pa.string()), "i": i.astype(np.int64), "j": j.astype(np.int64), "value": v})


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)) in whole numbers that no count overflows; 0 without terms."""
    whole = "CAST({} AS DECIMAL(19,0))".format
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1L + ({SCALE}BD * ({whole(n)} + {SMOOTH})) div ({whole(total)} + {SMOOTH} * {whole(terms)}) ELSE 0L END")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, lang_n, head) of every source and kept term that occurs in it; head is 1 on one row of each (lang, term).

    Terms are runs of letters and of anything beyond ASCII, A-Z made small. A
    language keeps the terms that at least `least_docs` of its rows contain.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    narrow = importable(docs).select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    counts = narrow.mapInArrow(_block_counts, _COUNTS).groupBy("lang", "term", "source", "document").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    ordered = counts.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return ordered.mapInArrow(_runs(least_docs), _KEPT)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how the sources of each language differ.

    With p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)) of each kept term in a
    source and in the whole language (V kept terms, N their occurrences there):
    part `pair` has every other source of the language as item and the summed
    |p - p of the other| as value; part `term` has the `top` kept terms of the
    source with the largest p - p of the language, where that is positive. Ranks
    go by falling value, then by item in the order of UTF-8.

    Null lang, source and text are ''. Every row is a document, whatever its id,
    so repeated rows count each. Groups without terms are compared as well, with
    0 in languages that keep no term; a language with one source has no pairs. An
    empty table gives an empty one. Other columns are not read.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    kept = shared(kept_terms(docs, least_docs, text, lang, source))
    present = docs.select(empty(lang).alias("lang"), empty(source).alias("source")).distinct()
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("head").alias("terms"), F.count("*").alias("rows"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = shared(
        present.join(by_source, ["lang", "source"], "left")
        .join(by_lang, "lang", "left")
        .fillna(0, ["total", "lang_total", "terms", "rows"])
        .withColumns({"number": number.cast("long"), "sources": F.count("*").over(Window.partitionBy("lang"))})
        .withColumns({"block": F.expr(f"number div {BLOCK}"), "at": F.col("number") % BLOCK, "blocks": F.expr(f"(sources + {BLOCK - 1}) div {BLOCK}"), "slices": F.expr(f"1 + rows div {SLICE_ROWS}")})
    )
    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total", "terms"), "q": _share("lang_n", "lang_total", "terms")})

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    entries = shares.select("lang", "term", "block", "at", "p", F.expr("pmod(xxhash64(term), slices)").alias("slice"), other)
    bases = groups.withColumn("least", _share("0", "total", "terms")).select("lang", F.lit(None).cast("string").alias("term"), "block", "at", F.col("least").alias("p"), "slices", other)
    bases = bases.select("lang", "term", "block", "at", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "other")
    blocks = entries.unionByName(bases).select("lang", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "slice", "term", (F.col("block") > F.col("other")).cast("int").alias("side"), "at", "p")
    partial = blocks.groupBy("lang", "bi", "bj", "slice").applyInArrow(_pair_sums, "lang string, i long, j long, value long")
    sums = partial.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    name = lambda k, c: groups.select("lang", F.col("number").alias(k), F.col("source").alias(c))
    pairs = sums.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.unionByName(terms)
