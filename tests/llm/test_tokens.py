"""Operators 1, 2 and 8 against the libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from trailmill.llm import byte_bpe, packing, pieces  # noqa: E402

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
BITS = ["'s", "'", "s", "l", "'ll", "'re", " ", "  ", "\n", "\t", " ", "　", "a", "th", "ing", "é", "ß", "1", "½", "!", "...", "<|endoftext|>", "<s>", "中", "\U0001d7d8", "‍", "\U0001f600", "́", "\x00", "\x85", "▁", "\r\n", "’s"]


def cases(n):
    random.seed(5)
    return ["".join(random.choices(BITS, k=random.randint(0, 14))) for _ in range(n)] + ["", " ", "\n", "x" * 30000 + " y", "ab " * 60000, "aaaaaaaaaaab" * 500]


def test_byte_bpe_ids_are_the_library_s():
    bpe = byte_bpe.loaded(BYTE)
    texts = cases(3000)
    want = [e.ids for e in bpe.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.ids(texts)] == want
    assert bpe.counts(texts).tolist() == [len(x) for x in want]


def test_whole_tokens_are_proved():
    bpe = byte_bpe.loaded(BYTE)
    known = bpe.text_strings()
    ids = bpe.proven.tolist()
    strings = [known[i] for i in ids]
    pick = random.Random(1).sample(range(len(strings)), 300)
    assert all(bpe.tokenizer.encode(strings[i], add_special_tokens=False).ids == [ids[i]] for i in pick if bpe.split(strings[i])[0][1] == (0, len(strings[i])))


def test_cache_limit_changes_nothing():
    bpe = byte_bpe.ByteBpe(BYTE)
    bpe.table.most = 10
    texts = cases(300)
    assert bpe.counts(texts).tolist() == bpe.counts(texts[::-1])[::-1].tolist() == byte_bpe.loaded(BYTE).counts(texts).tolist()


def test_token_counts_frame(spark):
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (None, None, 1), (3, "", 2)], "doc_id long, text string, n_tokens long").withColumn("n_bytes", F_len())
    rows = byte_bpe.token_counts(df, BYTE).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (1, 2), (1, 2), (3, 0)]
    assert byte_bpe.token_counts(df.limit(0), BYTE).count() == 0


def F_len():
    from pyspark.sql import functions as F

    return F.length("text")


def test_pieces_are_the_library_s():
    codec = pieces.loaded(PIECE)
    for text, ids in zip(cases(2000), codec.ids_of(cases(2000)), strict=True):
        assert ids.tolist() == codec.library.encode(text, add_bos=True, add_eos=True)
        assert codec.decode(ids) == codec.library.decode(ids.tolist())


def test_pieces_decode_any_ids():
    codec = pieces.loaded(PIECE)
    r = random.Random(2)
    for _ in range(500):
        ids = [r.randrange(len(codec.pieces)) if r.random() < 0.6 else r.choice(codec.bytes + [0, 1, 2, 259]) for _ in range(r.randint(0, 8))]
        assert codec.decode(ids) == codec.library.decode(ids)


def test_round_trip_frame(spark):
    df = spark.createDataFrame([(1, "héllo  wörld 中", "x"), (2, None, "y"), (2, None, "y")], "doc_id long, text string, ids_sha256 string")
    codec = pieces.loaded(PIECE)
    for r in pieces.round_trip(df, PIECE).collect():
        text = "héllo  wörld 中" if r.doc_id == 1 else ""
        ids = codec.library.encode(text, add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = pieces.decode(pieces.encode(df, PIECE), PIECE).where("doc_id = 1").first()
    assert back.text == "héllo  wörld 中"
    assert pieces.round_trip(df.limit(0), PIECE).count() == 0


def check_packing(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_packing(spark):
    r = random.Random(4)
    texts = [None, "", "a b c" * 3000, *["word " * r.randint(1, 400) for _ in range(150)], *["same text"] * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("offset", F_len())
    rows = packing.pack_documents(df, BYTE, 64).collect()
    n = check_packing(rows, 64)
    assert n <= -(-sum(x.length for x in rows) // 64) * 1.02 + 2
    tokenizer = byte_bpe.loaded(BYTE).tokenizer
    by = defaultdict(list)
    for x in rows:
        by[x.doc_id].append(x)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        start = 0
        for k, x in enumerate(sorted(by[i], key=lambda x: x.piece)):
            assert (x.piece, x.start) == (k, start) and (k == 0 or x.length == 64)
            assert x.ids_crc32 == zlib.crc32(np.array(ids[start : start + x.length], "<u4").tobytes())
            start += x.length
        assert start == len(ids) and (len(by[i]) == 1) == (len(ids) <= 64)
    assert packing.pack_documents(df.limit(0), BYTE, 64).count() == 0


def test_plan_uses_every_piece_once():
    r = random.Random(6)
    for _ in range(20):
        histogram = {r.randint(1, 50): r.randint(1, 300) for _ in range(r.randint(1, 20))}
        used = defaultdict(int)
        for own, n in packing.plan(histogram, 50):
            assert sum(own) <= 50
            for length in own:
                used[length] += n
        assert dict(used) == histogram


def test_patterns_fill_exactly():
    rows = packing.patterns(np.array([1, 2, 3, 5]), 6)
    assert {tuple(sorted(x for x in row if x)) for row in rows.tolist()} == {(1, 5), (3, 3), (1, 2, 3), (2, 2, 2)}


def test_texts_of_two_letters():
    """Pairs of texts whose polynomial hashes modulo a power of two agree, both orders in one batch."""
    from test_documents import thue_morse

    texts = [t for n in (512, 1024, 2048, 8192) for t in thue_morse(n, "q", "e")]
    for own in (texts, texts[::-1], [f"{t} x {t}" for t in texts]):
        assert byte_bpe.loaded(BYTE).counts(own).tolist() == [len(byte_bpe.loaded(BYTE).tokenizer.encode(t, add_special_tokens=False).ids) for t in own]
        codec = pieces.loaded(PIECE)
        assert [x.tolist() for x in codec.ids_of(own)] == [codec.library.encode(t, add_bos=True, add_eos=True) for t in own]


def test_pieces_are_cut_where_no_piece_joins_two_characters():
    codec = pieces.PieceCodec(PIECE)
    words, marks = [f"{a}{b}" for a in ("the", "tion", "ing", "qu", "zx") for b in ("er", "al", "oo", "k", "v")], "中文字语言模型数据处理"
    texts = [f"{w}{c}{w}" for w in words for c in marks] + ["aaaa" * 300, "中" * 300, " " * 50 + "a", "a\u2581b", "\u0000é😀e\u0301", ""]
    for text, ids in zip(texts, codec.ids_of(texts), strict=True):
        assert ids.tolist() == [codec.bos, *codec.library.encode(text), codec.eos], text
    assert len(codec.table.new) < 2 * len(words) + len(marks) + 20
