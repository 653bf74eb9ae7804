"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import alignment, bpe, chat, decontaminate, maxent, merkle, phrases, pieces, ranker, sharding, simhash, substring, token_store
from loam.llm.common import new_path, table

TOKENIZER, BYTE_TOKENIZER, PIECE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def substring_digests(docs: DataFrame) -> DataFrame:
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return substring.remove_repeats(docs, window=50).select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_token_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_store.read_digests(spark, path)


def _digests(c: bpe.TreeCoder, ids: bytes) -> tuple:
    decimal = " ".join(map(str, memoryview(ids).cast("I")))
    return len(ids) // 4, hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


CONTROL = "<|im_end|><|im_start|>assistant ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.read_digests(chat.format_conversations(turns.union(own)))


def merkle_digests(docs: DataFrame) -> DataFrame:
    rows = merkle.with_next(docs).withColumn("edited", merkle.edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_nodes", merkle.nodes(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        merkle.root(F.col("text")).alias("fingerprint"),
        merkle.root(F.col("edited")).alias("edited_fingerprint"),
        merkle.likeness(F.col("nodes"), F.col("edited_nodes")).alias("near_edited"),
        merkle.likeness(F.col("nodes"), F.col("next_nodes")).alias("near_next"),
    )


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_digests(table(spark, sf_dir, "documents"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def contamination_digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = decontaminate.contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ranker.train(docs, table(spark, sf_dir, "labels"))
    scored = ranker.score_documents(docs, model)
    return scored.select("doc_id", (~ranker.training_row(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= ranker.CUT).cast("int").alias("predicted"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, percent=50, top=2000)


def _piece_digests(c: pieces.PieceCoder, ids: np.ndarray) -> tuple:
    decimal = ",".join(map(c.decimal.__getitem__, ids.tolist()))
    return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()


def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_TOKENIZER), _piece_digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_store": op2_token_store,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_simhash": op4_simhash,
    "op5_chat_format": op5_chat_format,
    "op6_merkle_fingerprints": op6_merkle_fingerprints,
    "op7_feistel_shards": op7_feistel_shards,
    "op8_maxent_scores": op8_maxent_scores,
    "op9_winnowing": op9_winnowing,
    "op10_pairwise_quality": op10_pairwise_quality,
    "op11_token_alignment": op11_token_alignment,
    "op12_collocations": op12_collocations,
    "op13_piece_round_trip": op13_piece_round_trip,
}
_TREE = """sha256(array_to_string(list_transform(string_split({t}, chr(10) || chr(10)), lambda s:
    sha256(array_to_string(list_transform(string_split(s, chr(10)), lambda p: sha256(p)), ''))), ''))"""
_NODES = """list_distinct(list_concat(list_transform(regexp_extract_all({t}, '[^\\n]{{0,46}}?[esdnt] |[^\\n]{{1,48}}'), lambda x: 'l' || x),
    list_transform(string_split({t}, chr(10)), lambda x: 'p' || x), list_transform(string_split({t}, chr(10) || chr(10)), lambda x: 's' || x)))"""
_LIKE = "CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
        g AS (SELECT r, doc_id, p, array_to_string(list_slice(w, p, p + 49), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
        f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
        x AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS q FROM g JOIN f USING (g) WHERE first < doc_id),
        k AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS kept FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d) ANTI JOIN x USING (r, q) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN (SELECT r, count(*) AS n FROM x GROUP BY r) USING (r) LEFT JOIN k USING (r)""",
    "op5_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
            UNION ALL SELECT -1, n, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, role)),
        e AS (SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<|im_start|>' || er || chr(10) || et || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op6_merkle_fingerprints": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
        n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS other
              FROM d WINDOW w AS (ORDER BY doc_id DESC, text DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        e AS (SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(other, 1, length(text) // 2) AS edited FROM n),
        l AS (SELECT *, {_NODES.format(t="text")} AS la, {_NODES.format(t="edited")} AS lb, {_NODES.format(t="other")} AS lc FROM e)
        SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
               {_TREE.format(t="text")} AS fingerprint, {_TREE.format(t="edited")} AS edited_fingerprint,
               CAST({_LIKE.format(a="la", b="lb")} AS DOUBLE) AS near_edited, CAST({_LIKE.format(a="la", b="lc")} AS DOUBLE) AS near_next
        FROM l""",
    "op9_winnowing": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                   FROM documents WHERE doc_id IS NOT NULL),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
              FROM benchmark WHERE item_id IS NOT NULL),
        iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS g
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
        dw AS (SELECT r, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS g
               FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
        h AS (SELECT r, p, m, item_id FROM dw JOIN iw USING (m, g)),
        c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM h) GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)""".replace("\\\\", "\\"),
    "op12_collocations": r"""
        WITH p AS (SELECT r, lang, generate_subscripts(x, 1) AS j, unnest(x) AS piece
                   FROM (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS x FROM documents)),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, m, w[i:i + m - 1] AS g, count(*) AS f
              FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(m) WHERE len(w) >= m) GROUP BY ALL),
        n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
        c AS (SELECT lang, m, g, f AS a FROM g WHERE m > 1 AND f >= 10),
        k AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
              FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
              JOIN g x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN g y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
        b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        d AS (SELECT DISTINCT s.lang, s.g FROM c s JOIN (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS g FROM c WHERE m = 3) t
              ON s.lang = t.lang AND s.g = t.g WHERE 100 * t.a >= 50 * s.a)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
              FROM (SELECT *, array_to_string(g, ' ') AS phrase FROM b ANTI JOIN d USING (lang, g))) JOIN n USING (lang) WHERE rank <= 2000""",
}
