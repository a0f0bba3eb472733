"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontamination, divergence, impact, jaccard, neighbours, packing, passages, pieces, quality, resampling, sharding
from .common import table

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = byte_bpe.token_counts(docs, tokenizer_path(BYTE_BPE))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, tokenizer_path(PIECE_BPE))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x : floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_copies(docs, jaccard.Likeness(words=4, part=85, whole=100))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    out = chat.format_conversations(messages, content="text")
    read = out.select("conv_id", "n_turns", F.length("formatted").cast("long").alias("formatted_chars"), chat.parse_turns(F.col("formatted")).alias("turns"), chat.masked_text().alias("loss"))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP7_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), safe AS (
  SELECT *, length(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length('<|turn|><|says|><|end|>') AS size
  FROM said
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(length(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant')), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM safe GROUP BY conv_id
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(BYTE_BPE), capacity=1024, end_id=2)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.remove_repeated_passages(docs, width=13).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: One row a window; DuckDB has no cheaper way to say it.
OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM words WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i+12], ' ')) AS h, hash('b' || array_to_string(w[i:i+12], ' ')) AS g FROM places
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h, g) AS first FROM windows) WHERE doc_id > first
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM repeated, range(13) r(k)
), each_word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), marked AS (
  SELECT e.doc_id, e.word, e.i, g.i IS NOT NULL AS off FROM each_word e LEFT JOIN gone g USING (doc_id, i)
), summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (off) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT off) AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s USING (doc_id)
"""


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"), least_docs=30, top=50)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), occurrences AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), counts AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM occurrences GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 30
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), each_term AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS lang_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM each_term GROUP BY ALL
), shares AS (
  SELECT e.lang, e.source, e.term, e.n, 1 + 1000000000 * (e.n + 5) // (t.total + 5 * l.v) AS p, 1 + 1000000000 * (e.lang_n + 5) // (l.total + 5 * l.v) AS q
  FROM each_term e JOIN totals t USING (lang, source) JOIN langs l USING (lang)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), found AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(10, len(w)) AS need FROM items WHERE len(w) > 0
), item_places AS (
  SELECT item_id, need, w, unnest(range(1, len(w) - need + 2)) AS i FROM sized
), item_windows AS (
  SELECT DISTINCT item_id, need, array_to_string(w[i:i + need - 1], ' ') AS said FROM item_places
), doc_places AS (
  SELECT r, need, w, unnest(range(1, len(w) - need + 2)) AS i FROM docs, (SELECT DISTINCT need FROM sized) WHERE len(w) >= need
), hits AS (
  SELECT p.r, p.i, p.need, x.item_id FROM (SELECT r, i, need, array_to_string(w[i:i + need - 1], ' ') AS said FROM doc_places) p JOIN item_windows x USING (need, said)
), words AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, range(10) t(k) WHERE k < need GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), orders=2, buckets=10_000, least_words=20, percent=25, seed=7)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_quality": op3_quality,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_sharding": op6_sharding,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_packing": op8_packing,
        "op9_repeated_passages": op9_repeated_passages,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_source_divergence": op11_source_divergence,
        "op12_decontamination": op12_decontamination,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_top_k": OP4_SQL, "op7_chat_formatting": OP7_SQL, "op9_repeated_passages": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_decontamination": OP12_SQL}
