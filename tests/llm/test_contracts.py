"""The registered queries themselves, over whole small tables, against the libraries and plain versions."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_documents import linked

from trailmill.llm import jaccard, queries

pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
if not os.path.isdir(DATA):
    pytest.skip("no test data", allow_module_level=True)


def rows(name, data=DATA):
    return pq.read_table(f"{data}/{name}.parquet").to_pylist()


def run(spark, name, data=DATA):
    return [r.asDict() for r in queries.queries()[name](spark, data).collect()]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Tables with null and repeated ids, null, empty and long texts, extra columns of clashing names."""
    r = random.Random(4)
    at = tmp_path_factory.mktemp("odd")
    texts = [None, "", " ", "a b", "same text of some words here now", "x" * 70_000, "tok " * 30_000, *[" ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=40)) for _ in range(40)]]
    ids = [None, *range(len(texts) - 3), 7, 7]
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "n_tokens": ["x"] * len(ids), "score": ["x"] * len(ids), "size": ["x"] * len(ids), "offset": ["x"] * len(ids), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()), "lang": ["en", None] * (len(ids) // 2) + ["en"] * (len(ids) % 2), "source": [None, "s", "t"] * (len(ids) // 3) + ["s"] * (len(ids) % 3)})
    pq.write_table(docs, at / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 1, None, 3], pa.int64()), "text": ["alpha beta", "tok", None, " "], "n_words": ["x"] * 4}), at / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([1, 1, None, 900, 2], pa.int64()), "quality": pa.array([1, 0, 1, None, 0], pa.int32())}), at / "labels.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([0, 0, None, 3, 4, 5, 100], pa.int64()), "embedding": pa.array([[1.0, 2.0], [1.0, 2.0], [1.0, 1.0], None, [], [float("nan"), 1.0], [0.5, 0.5]], pa.list_(pa.float32())), "score": ["x"] * 7}), at / "embeddings.parquet")
    pq.write_table(pa.table({"conv_id": pa.array([1, 1, None], pa.int64()), "turn": pa.array([0, 0, None], pa.int64()), "role": ["user", "user", None], "text": ["b\\", "a", None], "size": ["x"] * 3}), at / "conversations.parquet")
    return str(at)


def test_every_query_on_odd_and_on_empty_tables(spark, odd, tmp_path):
    docs = pq.read_table(f"{odd}/documents.parquet").num_rows
    for name in ("documents", "labels", "embeddings", "conversations", "benchmark"):
        pq.write_table(pq.read_table(f"{odd}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    for name in queries.queries():
        got, none = run(spark, name, odd), run(spark, name, str(tmp_path))
        if name.startswith(("op1_", "op2_", "op3_", "op5_", "op6_", "op9_", "op12_", "op13_")):
            assert len(got) == docs, name
        assert [r["conv_id"] for r in none] == [-7] if name.startswith("op7_") else none == [], name


def test_op1_and_op2(spark, odd):
    import sentencepiece
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE))
    piece = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_BPE))
    for data in (DATA, odd):
        want1, want2 = [], []
        for d in rows("documents", data):
            text = d["text"] or ""
            n = len(bpe.encode(text, add_special_tokens=False).ids)
            want1.append((d["doc_id"] or -1, len(text.encode()), n, n > 512))
            ids = piece.encode(text, add_bos=True, add_eos=True)
            want2.append((d["doc_id"] or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(piece.decode(ids).encode()).hexdigest()))
        assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in run(spark, "op1_token_counts", data)) == sorted(want1)
        assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op2_sentencepiece", data)) == sorted(want2)


def test_op3(spark):
    """Held-out rows by their CRC, and held-out accuracy on the given labels."""
    got = {r["doc_id"]: r for r in run(spark, "op3_quality", "/root/testdata/sf0.01")}
    labels = {d["doc_id"]: d["quality"] for d in rows("labels", "/root/testdata/sf0.01")}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [i for i in labels if i in got and got[i]["held_out"]]
    assert len(held) > 30 and sum(got[i]["predicted"] == labels[i] for i in held) >= 0.95 * len(held)


def test_op5(spark):
    want = linked([(d["doc_id"], d["text"]) for d in rows("documents")], jaccard.Likeness(4, 85, 100))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op5_ngram_jaccard")} == want


def test_op6(spark):
    got = {r["doc_id"]: r for r in run(spark, "op6_sharding")}
    total, at, slots = sum(r["size"] for r in got.values()), 0, {}
    for d in sorted(rows("documents"), key=lambda d: d["doc_id"]):
        text, r = (d["text"] or "").encode(), got[d["doc_id"]]
        shard = min(39, (2 * at + len(text) + 16) * 40 // (2 * total))
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"]) == (len(text) + 16, zlib.crc32(text), "bytes", shard, slots.get(shard, 0), None)
        slots[shard] = slots.get(shard, 0) + 1
        at += len(text) + 16


def test_op8(spark):
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE))
    got, docs, places = run(spark, "op8_packing"), {d["doc_id"]: d["text"] or "" for d in rows("documents")}, {}
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for i, own in pieces.items():
        ids = np.array([*bpe.encode(docs[i], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids) and (len(ids) > 1024 or len(own) == 1)
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) <= 1024
    assert len(places) <= 1.02 * -(-sum(r["length"] for r in got) // 1024) + 1


def test_op10(spark):
    table = [(d["vec_id"], np.array(d["embedding"], np.float32).astype(float)) for d in rows("embeddings") if d["embedding"]]
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table])
    got = {}
    for r in run(spark, "op10_nearest_neighbours"):
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hit = total = 0
    for q, own in got.items():
        score = x @ x[np.flatnonzero(ids == q)[0]]
        want = [int(ids[j]) for j in np.lexsort((ids, -score)) if ids[j] != q][:20]
        assert sorted(own) == list(range(1, len(want) + 1))
        assert all(abs(s - score[np.flatnonzero(ids == i)[0]]) < 1e-9 for i, s in own.values())
        hit, total = hit + len(set(want) & {i for i, _ in own.values()}), total + len(want)
    assert hit >= 0.9 * total


def test_pipeline_on_odd_tables(spark, odd, tmp_path):
    """All stages in a row on rows of any kind: every piece is of a row that was there, each row's pieces are whole; empty tables give an empty result."""
    import corpus_pipeline

    got = corpus_pipeline.run(spark, odd).collect()
    ids = [d["doc_id"] for d in rows("documents", odd)]
    assert {r["doc_id"] for r in got} <= set(ids) and all(1 <= r["length"] <= 1024 for r in got)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()]
    for name in ("documents", "labels"):
        pq.write_table(pq.read_table(f"{odd}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
