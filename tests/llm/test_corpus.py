"""Operators 11 to 13 against plain versions, over whole small tables and odd ones."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from trailmill.llm import decontamination, divergence, queries, resampling

DATA = "/root/testdata/sf0.001"
if not os.path.isdir(DATA):
    pytest.skip("no test data", allow_module_level=True)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain_divergence(docs, least, top=50):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for d in docs:
        lang, source = d["lang"] or "", d["source"] or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(d["text"]))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = {}
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        share = {}
        for s in [None, *sources]:
            c = Counter({t: sum(counts[lang, x][t] for x in sources) for t in kept}) if s is None else counts[lang, s]
            n = sum(c[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(share[s][t] - share[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, share[s][t] - share[None][t]) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                for k, (item, value) in enumerate(ordered if part == "pair" else ordered[:top], 1):
                    out[lang, s, part, item] = (value, k)
    return out


def got_divergence(df):
    rows = df.collect()
    out = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_divergence(spark, monkeypatch):
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    want = plain_divergence(docs, 30)
    assert got_divergence(queries.op11_source_divergence(spark, DATA)) == want and len(want) > 100
    few = [d | {"source": f"s{k % 7}"} for k, d in enumerate(docs)]
    frame = spark.createDataFrame([(d["lang"], d["source"], d["text"]) for d in few], "lang string, source string, text string")
    assert got_divergence(divergence.source_divergence(frame, 2, 3)) == plain_divergence(few, 2, 3)


def test_divergence_of_long_texts_many_sources_and_odd_rows(spark, monkeypatch):
    """Texts in pieces, blocks of sources, slices, flushes: bounds made small here and in the workers, where the functions travel by value."""
    rows = [("en", f"s{k % 9}", f"alpha beta{k % 5} Gamma gamma éß-É {'long ' * (k % 3)}") for k in range(40)]
    rows += [(None, None, None), ("xx", "a", ""), ("xx", "b", "1 2 3"), ("en", "s1", "ALPHA " * 50 + "once"), ("en", "s1", "ALPHA " * 50 + "once"), ("one", None, "a b a")]
    docs = [dict(zip(("lang", "source", "text"), r, strict=True)) for r in rows]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, source string, text string, term string, n int, row int")
    for least in (1, 2, 30):
        assert got_divergence(divergence.source_divergence(frame, least)) == plain_divergence(docs, least)
    monkeypatch.setattr(divergence, "BLOCK", 4)
    monkeypatch.setattr(divergence, "SLICE_ROWS", 3)
    batches = [pa.record_batch([[r[0] or "" for r in rows], [r[1] or "" for r in rows], [r[2] or "" for r in rows], list(range(len(rows)))], names=["lang", "source", "text", "row"])]

    def summed():
        total, df = Counter(), Counter()
        for b in divergence._block_counts(iter(batches)):
            for r in b.to_pylist():
                total[r["lang"], r["source"], r["term"]] += r["n"]
                df[r["lang"], r["source"], r["term"], r["document"]] += r["docs"] if r["document"] is None else 0
        return total, df

    whole, df = summed()
    for name, value in (("PIECE_BYTES", 7), ("HELD_TERMS", 5)):
        monkeypatch.setattr(divergence, name, value)
        assert summed() == (whole, df)
    monkeypatch.setattr(divergence, "LONG_BYTES", 100)
    pieces, df = summed()
    assert pieces == whole and any(k[3] is not None for k in df)
    scan = [r for b in divergence._block_counts(iter(batches)) for r in b.to_pylist()]
    ordered = Counter()
    for r in scan:
        ordered[r["lang"], r["term"], r["source"], r["document"]] += r["n"]
    table = [(*k, sum(r["docs"] for r in scan if (r["lang"], r["term"], r["source"], r["document"]) == k), n) for k, n in sorted(ordered.items(), key=lambda x: (x[0][:3], x[0][3] is not None, x[0][3] or 0))]
    columns = list(zip(*table, strict=True))
    one = pa.record_batch([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64())], names=["lang", "term", "source", "document", "docs", "n"])
    for size in (1, 4, 1000):
        found = {(r["lang"], r["source"], r["term"]): r["n"] for b in divergence._runs(2)(iter([one.slice(k, size) for k in range(0, one.num_rows, size)])) for r in b.to_pylist()}
        assert found["en", "s1", "once"] == 2 and found["en", "s1", "alpha"] == whole["en", "s1", "alpha"] and ("one", "", "a") not in found


def plain_contamination(docs, items):
    windows = defaultdict(set)
    for x in items:
        w = words(x["text"])
        need = min(10, len(w))
        for i in range(len(w) - need + 1) if w else ():
            windows[tuple(w[i : i + need])].add(x["item_id"])
    out = []
    for d in docs:
        w, hit, named = words(d["text"]), set(), set()
        for need in {len(k) for k in windows}:
            for i in range(len(w) - need + 1):
                if (k := tuple(w[i : i + need])) in windows:
                    hit.update(range(i, i + need))
                    named |= windows[k]
        ids = sorted(str(i) for i in named if i is not None)
        out.append((d["doc_id"], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got_contamination(spark, data):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op12_decontamination(spark, data).collect()), key=repr)


def test_contamination(spark):
    docs, items = (pq.read_table(f"{DATA}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    want = plain_contamination(docs, items)
    assert got_contamination(spark, DATA) == want and any(r[5] for r in want)


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination_of_odd_tables(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_HASHES", -1)
        monkeypatch.setattr(decontamination, "BROADCAST_PLACES", -1)
    said = [f"w{k}" for k in range(30)]
    items = [(1, " ".join(said[:14])), (1, "one two three"), (2, "A"), (None, "null id words"), (3, None), (4, ""), (5, "x x x x x x x x x x x x"), (6, " ".join(said[5:16])), (70, "Ä ß É é 9"), (8, "one two three four five six seven")]
    texts = [None, "", "--", "a", "b A b", " ".join(said), " ".join(said[1:11]), " ".join(said[1:10]), " ".join(said[4:16]) + " gap " + " ".join(said[:10]).upper(), "x " * 9, "x " * 10, "x " * 200, "one two three one two", "null. ID words", "é ä ß É é 9 ä", "one two three four five six seven eight", "q " + "one,two-three four five six " * 3, "z " * 50_000 + " ".join(said[3:14])]
    docs = list(enumerate(texts)) + [(None, texts[5]), (5, texts[6]), (5, texts[5]), (5, texts[5])]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": [t for _, t in docs], "hash": ["x"] * len(docs), "words": [1] * len(docs), "items": [2] * len(docs)}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": [t for _, t in items], "item": [0] * len(items), "need": ["y"] * len(items)}), tmp_path / "benchmark.parquet")
    want = plain_contamination([{"doc_id": i, "text": t} for i, t in docs], [{"item_id": i, "text": t} for i, t in items])
    assert got_contamination(spark, str(tmp_path)) == want
    pq.write_table(pq.read_table(tmp_path / "benchmark.parquet").slice(0, 0), tmp_path / "benchmark.parquet")
    assert got_contamination(spark, str(tmp_path)) == plain_contamination([{"doc_id": i, "text": t} for i, t in docs], [])
    pq.write_table(pq.read_table(tmp_path / "documents.parquet").slice(0, 0), tmp_path / "documents.parquet")
    assert got_contamination(spark, str(tmp_path)) == []


def plain_sample(docs, items):
    def features(text):
        w = words(text)
        return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = Counter(), Counter()
    for d in docs:
        s.update(features(d["text"]))
    for x in items:
        t.update(features(x["text"]))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000) / ((s[b] + 1.0) * (all_t + 10_000))))
    rows = []
    for d in docs:
        f = features(d["text"])
        weight = sum(gain(b) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d['doc_id'] is None else d['doc_id']}".encode()).hexdigest()[:8], 16)
        rows.append([d["doc_id"], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(d["text"])) >= 20])
    can = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(can[: 25 * len(can) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got_sample(spark, data):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in queries.op13_importance_resampling(spark, data).collect()), key=repr)


def test_sample(spark):
    docs, items = (pq.read_table(f"{DATA}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    want = plain_sample(docs, items)
    assert got_sample(spark, DATA) == want and sum(r[4] is not None for r in want) > 20


def test_sample_of_odd_tables(spark, tmp_path):
    texts = [None, "", "..", "one", "ONE two", "é É ß " * 12, "tok " * 30_000, *[f"alpha {'beta ' * k}gamma {k}" for k in range(18, 40)]]
    docs = list(enumerate(texts)) + [(None, texts[-1]), (9, texts[-1]), (9, texts[-1])]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": [t for _, t in docs], "row": ["x"] * len(docs), "score": ["x"] * len(docs), "pos": [1] * len(docs)}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, None], pa.int64()), "text": ["alpha beta", None], "bucket": ["x", "y"]}), tmp_path / "benchmark.parquet")
    as_rows = lambda: [{"doc_id": i, "text": t} for i, t in docs]
    assert got_sample(spark, str(tmp_path)) == plain_sample(as_rows(), [{"text": "alpha beta"}, {"text": None}])
    pq.write_table(pq.read_table(tmp_path / "benchmark.parquet").slice(0, 0), tmp_path / "benchmark.parquet")
    assert got_sample(spark, str(tmp_path)) == plain_sample(as_rows(), [])
    pq.write_table(pq.read_table(tmp_path / "documents.parquet").slice(0, 0), tmp_path / "documents.parquet")
    assert got_sample(spark, str(tmp_path)) == []
    three = resampling.feature_buckets(spark.createDataFrame([(1, 5, "a b c"), (2, 6, "")], "row long, id long, text string"), 3, 97).collect()
    crc = lambda s: zlib.crc32(s.encode()) % 97
    assert sorted(map(tuple, three), key=repr) == sorted([(1, 5, crc("a"), crc("a b"), crc("a b c")), (1, 5, crc("b"), crc("b c"), None), (1, 5, crc("c"), None, None), (2, 6, None, None, None)], key=repr)
