"""Operators 3, 5, 6, 7, 9 and the pipeline against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.llm import chat, components, hashing, jaccard, passages, quality, sharding

DOCS = "doc_id long, text string, n_removed long, component_id long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 7, 8) for i, t in texts], DOCS)


def corpus(seed, n, words=30):
    """Documents with copies, near copies, shared passages and junk."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = r.choices(vocab, k=40)
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.3:
            w = (out[r.randrange(len(out))][1] or "").split(" ")
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        elif kind < 0.4:
            w = r.choices(vocab, k=r.randint(0, 8)) + passage + r.choices(vocab, k=r.randint(0, 8))
        elif kind < 0.45:
            w = [r.choice(vocab)] * r.randint(1, 40)
        else:
            w = r.choices(vocab, k=r.randint(0, words * 2))
        out.append((i, r.choice([" ", " ", "\n", "\t "]).join(w)))
    out += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "A b"), (n + 4, "a B")]
    return out


def test_hashes_tell_words_and_windows():
    texts = [b"", b" ", b"a b a", b"\x0bA\x1cb", "é x y".encode(), b"z" * 3_000_000, b"p q " * 700_000]
    hashes, counts = hashing.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    names = {}
    for word, h in zip((w for t in texts for w in t.split()), hashes.tolist(), strict=True):
        assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
    value, text, place = hashing.windows(hashes, counts, 2)
    assert len(value) == sum(max(0, c - 1) for c in counts.tolist())
    assert value[0] != value[1] and place[:2].tolist() == [0, 1] and text[0] == 2


def removed(rows, width):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted(split, key=lambda x: x[0]):
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, w in split:
        off = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                off[k : k + width] = [True] * width
        out[i] = (len(w), sum(off), b" ".join(x for x, o in zip(w, off, strict=True) if not o).decode())
    return out


@pytest.mark.parametrize("seed, bits", [(1, 64), (2, 64), (3, 6), (4, 1)])
def test_passages(spark, seed, bits):
    """With few bits of the first hash nearly all windows collide there; what is removed stays the same."""
    rows = corpus(seed, 250)
    got = passages.remove_repeated_passages(frame(spark, rows).repartition(5), 13, bits=bits)
    assert got.columns[:2] == ["doc_id", "text"] and "component_id" in got.columns
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == removed(rows, 13)
    for r in got.where("n_removed > 0").collect():
        assert sum(s.words for s in r.removed_spans) == r.n_removed


def test_passages_without_or_with_equal_ids(spark):
    text = " ".join(f"v{i}" for i in range(20))
    rows = [(None, text), (5, text), (5, text), (5, text + " more"), (9, "x " + text)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in passages.remove_repeated_passages(frame(spark, rows)).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (5, 0), (9, 20)]
    assert passages.remove_repeated_passages(frame(spark, []), 13).count() == 0


def linked(rows, like):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        n = like.words
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and like.whole * n >= like.part * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed,like", [(1, jaccard.Likeness(4, 85, 100)), (2, jaccard.Likeness(2, 60, 100))])
def test_near_copies(spark, seed, like):
    rows = corpus(seed, 220)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_copies(frame(spark, rows).repartition(4), like).collect()}
    assert got == linked(rows, like)


def test_near_copies_of_one_text_in_one_large_group(spark):
    """A star of copies with many edits, most of them too far from each other: the second round decides."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = f"x{i}_{r.randrange(3)}"
        rows.append((i, " ".join(w)))
    like = jaccard.Likeness(2, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_copies(frame(spark, rows), like).collect()}
    assert got == linked(rows, like)


def test_near_copies_edge_rows(spark):
    rows = [(None, "a b c d e f"), (4, "A b c d e f"), (4, "A b c d e f"), (9, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.near_copies(frame(spark, rows)).collect())
    assert got == [(0, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9)]
    assert jaccard.near_copies(frame(spark, [])).count() == 0


def test_signatures_of_linked_sets_meet():
    """PartEnum's promise, on random sets at the threshold."""
    like = jaccard.Likeness(4, 85, 100)
    r = np.random.default_rng(3)
    for n in (3, 8, 20, 33, 100, 700):
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            b = a
            while True:
                c = np.unique(np.concatenate([np.delete(b, r.integers(len(b))) if r.random() < 0.5 and len(b) > 1 else b, r.integers(0, 2**63, 1).astype(np.uint64)]))
                common = len(np.intersect1d(a, c))
                if 100 * common < 85 * (len(a) + len(c) - common):
                    break
                b = c
            if len(np.intersect1d(a, b)) == len(a) == len(b):
                continue
            sig, of = jaccard.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), like)
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (n, len(a), len(b))


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (None, 3), *[(k, k + 1) for k in range(100, 180)], *[(300, k) for k in range(301, 360)]]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[5] == got[4] == 4 and 9 not in got
    assert {got[k] for k in range(100, 181)} == {100} and {got[k] for k in range(300, 360)} == {300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def tasks_of(spark, group, work):
    """The result of some work, and the number of tasks that Spark ran for it without merging shuffle partitions."""
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "20"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup(group, group)
        out = work()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = {i for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds}
    return out, sum(info.numCompletedTasks for i in stages if (info := tracker.getStageInfo(i)))


@pytest.mark.parametrize("most", [0, components.BROADCAST_LINKS])
def test_components_of_few_and_many_links(spark, monkeypatch, most):
    monkeypatch.setattr(components, "BROADCAST_LINKS", most)
    r = random.Random(5)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(1000, k) for k in range(1001, 1100)]
    links += links[:50]
    root = {k: k for pair in links for k in pair}
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {x.node: x.root for x in got} == {k: v for k, v in root.items() if any(k in (a, b) and a != b for a, b in links)} and len(got) == len({x.node for x in got})


def test_few_links_take_few_tasks(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 300, 3)] + [(k, k + 2) for k in range(0, 300, 3)], "a long, b long").coalesce(1)
    got, tasks = tasks_of(spark, "few links", lambda: components.components(links).count())
    assert got == 300 and tasks < 180, tasks


def test_shards(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randint(0, 50)) for i in range(500)] + [(7, "same")] * 200 + [(None, None), (600, "é" * 3000)]
    got = sharding.shards_by_bytes(frame(spark, rows), 10).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert len(got) == len(rows) and [g.shard for g in got if g.doc_id != 7] == sorted(g.shard for g in got if g.doc_id != 7)
    total = sum(g.size for g in got)
    for shard in {g.shard for g in got}:
        own = [g for g in got if g.shard == shard]
        assert sorted(g.slot for g in own) == list(range(len(own)))
        assert sum(g.size for g in own) <= total / 10 + max(g.size for g in own)
    for g in got:
        assert g.law == "bytes" and g.grown_shard is None
        if g.doc_id == 600:
            assert (g.size, g.text_crc32) == (6016, zlib.crc32(("é" * 3000).encode()))
    assert sharding.shards_by_bytes(frame(spark, []), 10).count() == 0


def test_chat(spark):
    odd = ["", "\\", "<|end|>", "\\<|turn|>\\\\", "</s>[INST] ok [/INST]", "a\nb", "<s>", "<\\|", "\U0001f600é"]
    rows = [(1, k, random.Random(k).choice(["user", "assistant", "sys<|says|>"]), t, "z") for k, t in enumerate(odd)] + [(2, 0, "user", None, "z"), (None, 1, None, "q", "z"), (3, 5, "assistant", "same", "z"), (3, 5, "assistant", "same", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df, content="text")
    for r in out.select("*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.masked_text().alias("loss")).collect():
        own = sorted([x for x in rows if x[0] == r.conv_id], key=lambda x: (x[1], x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.formatted.count("<|turn|>") == r.formatted.count("<|end|>") == r.n_turns == len(own)
        assert "[INST]" not in r.formatted and "</s>" not in r.formatted
    assert chat.format_conversations(df.limit(0), content="text").count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "u1", 100, 50, None, None), ("audio", None, "u2", None, None, 2.5, None), ("document", None, None, None, None, None, 3), ("video", None, "u4", None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<|turn|>user<|says|>see <\\|image|><|image|><|audio|><|document|><|end|><|turn|>assistant<|says|><|end|>"
    assert [(a.turn, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "u1", 8), (0, "audio", "u2", 63), (0, "document", None, 768)]
    assert r.expanded_tokens == 839 and [(s.start, s.length) for s in r.loss_spans] == [(len(r.formatted) - 7, 0)]


def test_quality(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["the", "house", "is", "green.", "and", "tall,", "we", "went", f"on{r.randrange(99)}"]) for _ in range(60))
    junk = [lambda: "SALE!! " * 40, lambda: "word " * 60, lambda: good().replace(" ", "*** ")]
    rows = [(i, good() if i % 3 else r.choice(junk)(), 0, 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(0, 0), (10**6, 1), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model.rules and len(model.rules) < 150
    scored = quality.with_score(docs.withColumn("held", quality.held_out(F.col("doc_id"))), model).where("held").collect()
    assert sum((s.score >= 0.3) == (s.doc_id % 3 > 0) for s in scored) >= 0.98 * len(scored)
    odd = quality.with_score(frame(spark, [(1, None), (2, ""), (3, "\n"), (4, "x" * 100000)]), model).collect()
    assert all(0 <= s.score <= 1 for s in odd)
    none = quality.train(docs, labels.limit(0))
    assert none.rules == () and quality.with_score(docs.limit(1), none).first().score == pytest.approx(0.5)


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C

    rows = corpus(3, 160, 40)
    junk = [(1000 + i, "BUY!! " * 50 + f"N{i}!!") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + junk], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i, t in rows if t and len(t) > 40] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = C.quality_stage(spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    kept = {r.doc_id: r.text for r in first.collect()}
    assert not set(kept) & {i for i, _ in junk}
    assert len(set(kept) & {i for i, t in rows if t and len(t) > 80}) > 100
    second = C.near_copy_stage(spark, first, str(tmp_path))
    want = {i for i, (_, c) in linked(list(kept.items()), C.NEAR).items() if i == c}
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == want
    third = C.passage_stage(spark, second, str(tmp_path))
    plain = removed([(i, kept[i]) for i in want], C.PASSAGE_WORDS)
    assert third.columns == docs.columns
    for r in third.collect():
        n, gone, text = plain[r.doc_id]
        assert r.text == (text if gone else kept[r.doc_id]) and (not gone or r.n_chars == len(text))
    last = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == want
    spans = {}
    for r in last:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) <= 1024


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null texts, one id with two texts, clashing column names, an empty table."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C

    text = " ".join(f"word{i}" for i in range(30))
    other = " ".join(f"else{i}" for i in range(30))
    rows = [(None, text), (1, text), (1, text), (2, text + " more"), (2, other), (3, None), (4, ""), (5, other), (5, other)]
    kind = "doc_id long, text string, n_chars long, component_id long, kept_text string, text_hash string"
    docs = spark.createDataFrame([(i, t, len(t or ""), 9, "x", "h") for i, t in rows], kind)
    got = C.near_copy_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == [(0, text), (1, text), (2, other), (3, ""), (4, "")]
    for name, stage in C.STAGES[1:]:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        assert stage(spark, docs, "").count() > 0, name


def thue_morse(n, a, b):
    s = [0]
    while len(s) < n:
        s += [1 - x for x in s]
    return "".join((a, b)[x] for x in s), "".join((b, a)[x] for x in s)


def test_texts_of_two_letters_are_told_apart(spark):
    """Pairs that a polynomial modulo a power of two takes for equal, as words and as windows."""
    words = [t for n in (512, 1024, 2048, 8192) for t in thue_morse(n, "q", "e")]
    hashes, _ = hashing.word_hashes([w.encode() for w in words])
    assert len(set(hashes.tolist())) == len(words)
    rows = [(i, f"{w} " + " ".join(f"v{k}" for k in range(14))) for i, w in enumerate(words)]
    rows += [(100 + i, " ".join(w)) for i, w in enumerate(thue_morse(2048, "q", "e"))]
    got = passages.remove_repeated_passages(frame(spark, rows), 13)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == removed(rows, 13)
    whole, _, _ = hashing.windows(*hashing.word_hashes([" ".join(w).encode() for w in thue_morse(1024, "q", "e")]), 1024)
    assert len(set(whole.tolist())) == 2


def test_no_group_of_unrelated_sets():
    r = np.random.default_rng(1)
    for like in (jaccard.Likeness(4, 85, 100), jaccard.Likeness(5, 80, 100)):
        for size in (4, 5, 6, 7, 8, 10, 14, 30):
            value = np.sort(r.integers(0, 2**64 - 1, (20_000, size), dtype=np.uint64), 1).ravel()
            sig, _ = jaccard.signatures(value, np.full(20_000, size), like)
            assert len(sig) <= 2 * size * 20_000 and np.unique(sig, return_counts=True)[1].max(initial=0) <= 3


def test_windows_of_blocks_of_texts(monkeypatch):
    texts = [b"", b"a b c d e", b"a b", b"X y  z a b c d e f", b"a b c d e" * 9, b""]
    for lower, short in ((False, False), (True, True)):
        whole = hashing.windows(*hashing.word_hashes(texts, lower), 3, short)
        for most in (1, 12, 1 << 20):
            monkeypatch.setattr(hashing, "CHUNK_BYTES", most)
            for a, b in zip(hashing.text_windows(texts, 3, lower, short), whole, strict=True):
                assert a.tolist() == b.tolist()
    assert [len(x) for x in hashing.text_windows([], 3)] == [0, 0, 0]


def test_lists_of_near_copies_stay_short():
    """1,500 near copies of one text that is not there itself: a node stands in few lists of a range, of the dozens of signatures that it shares."""
    import pyarrow as pa

    r = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(1_500):
        w = list(base)
        for _ in range(3):
            w[r.randrange(len(w))] = f"x{k}"
        texts.append(" ".join(w))
    like = jaccard.Likeness(5, 80, 100)
    sent = pa.Table.from_batches(list(jaccard._sign(iter([pa.record_batch([texts], names=["text"])]), like, 5)))
    for b in range(5):
        out = jaccard._propose(sent.filter(pa.compute.equal(sent.column("bucket"), b)).select(["data"]), like)
        lists = out.column("members").drop_null().to_pylist()
        heads = out.column("pivot").drop_null().to_pylist()
        assert len(heads) == len(set(heads)) and sum(map(len, lists)) <= 8 * 16 * len(texts)
