"""All queries over the service's own operators, with their SQL.

Tables stand in for the service's: documents for items, embeddings for vectors,
pages for web files, conversations for chat turns, events for feedback and usage,
customer and orders for users and jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import sanitize, table_functions, text
from loam.functions.scalars import rounded
from loam.operators import analytics, chunking, dedup, display, evaluation, jobs, retrieval, sections, structured, vector_index
from loam.operators.retrieval import RetrievalConfig
from loam.plans import ingest, models
from loam.sources import loaders, manifest, sinks, tables

CFG = RetrievalConfig()
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# retrieval: vectors of ids divisible by 20 are the questions, all vectors the corpus


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return e.select(F.col("vec_id").alias("query_id"), "embedding", F.concat_ws(" ", F.lit("what is vector number"), F.when(F.col("vec_id") % 40 == 0, "this one here").otherwise("")).alias("question"))


def _scored(spark: SparkSession, sf_dir: str, k: int = CFG.fanout) -> DataFrame:
    q = _questions(spark, sf_dir)
    found = retrieval.top_k(read(spark, sf_dir, "embeddings"), q, k)
    short = q.select("query_id", retrieval.is_short(F.col("question")).alias("short"))
    return found.withColumn("sim", retrieval.similarity(F.col("raw_score"))).join(short, "query_id")


_TOPK = """
    q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe, vec_id % 40 <> 0 AS not_forty FROM embeddings WHERE vec_id % 20 = 0),
    d AS (SELECT query_id, vec_id, label, not_forty, -list_dot_product(qe, CAST(embedding AS DOUBLE[])) AS raw_score FROM q, embeddings),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score, vec_id) AS rank FROM d QUALIFY rank <= 100),
    s AS (SELECT *, least(greatest((1 - raw_score) / 2, 0), 1) AS sim, FALSE AS short FROM t),
    p AS (SELECT query_id, count(*) AS candidates, max(sim) AS sim_max, min(sim) AS sim_min, min(raw_score) AS raw_min, max(raw_score) AS raw_max,
                 quantile_cont(sim, 0.9) AS p90, bool_or(short) AS short FROM s GROUP BY query_id),
    g AS (SELECT *, CASE WHEN short THEN least(1.0, greatest(0.5, p90 - 0.03) + 0.03) ELSE greatest(0.5, p90 - 0.03) END AS t_adapt,
                 CASE WHEN short THEN 0.2 ELSE 0.25 END AS threshold_low, CASE WHEN short THEN 0.45 ELSE 0.55 END AS threshold_high FROM p)"""


@query(f"WITH {_TOPK} SELECT query_id, vec_id, round(raw_score, 6) AS raw_score, rank FROM t WHERE rank <= 25")
def retrieval_topk(spark, sf_dir):
    found = retrieval.top_k(read(spark, sf_dir, "embeddings"), _questions(spark, sf_dir), CFG.top_k)
    return found.select("query_id", "vec_id", rounded(F.col("raw_score"), 6).alias("raw_score"), "rank")


@query(
    f"""WITH {_TOPK} SELECT query_id, candidates, round(sim_max, 6) AS sim_max, round(p90, 6) AS p90, short, round(t_adapt, 6) AS t_adapt,
        threshold_low, threshold_high, CASE WHEN sim_max >= threshold_high THEN 'rag' WHEN sim_max >= threshold_low THEN 'hybrid' ELSE 'fallback' END AS decision_mode FROM g"""
)
def retrieval_decision(spark, sf_dir):
    d = retrieval.decide(_scored(spark, sf_dir))
    return d.select("query_id", "candidates", *(F.round(c, 6).alias(c) for c in ("sim_max", "p90")), "short", F.round("t_adapt", 6).alias("t_adapt"), F.col("threshold_low").cast("double").alias("threshold_low"), F.col("threshold_high").cast("double").alias("threshold_high"), "decision_mode")


@query(
    f"""WITH {_TOPK}, a AS (SELECT s.query_id, vec_id, sim, t_adapt, row_number() OVER w AS pos, count(*) FILTER (sim >= t_adapt) OVER (PARTITION BY s.query_id) AS n
        FROM s JOIN g USING (query_id) WINDOW w AS (PARTITION BY s.query_id ORDER BY sim DESC, rank))
        SELECT query_id, vec_id, pos FROM a WHERE (n >= 6 AND sim >= t_adapt) OR (n < 6 AND pos <= 6)"""
)
def adaptive_filter(spark, sf_dir):
    scored = _scored(spark, sf_dir).persist()
    return retrieval.adaptive_filter(scored, retrieval.decide(scored)).select("query_id", "vec_id", "pos")


@query(
    """WITH v AS (SELECT a.vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) AS dot,
        sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2)))) AS l2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(least(greatest((1 + dot) / 2, 0), 1), 4) AS dot, round(least(greatest((dot + 1) / 2, 0), 1), 4) AS cosine,
           round(1 - least(greatest((1 - dot) / 2, 0), 1), 4) AS cosine_distance, round(1 / (1 + l2), 4) AS other FROM v"""
)
def similarity_modes(spark, sf_dir):
    """Likeness of each vector to the next, by every kind of score."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    d = lambda kind: retrieval.distance(F.col("embedding"), F.col("next"), kind)
    kinds = {
        "dot": (d("dot_product"), CFG),
        "cosine": (1 - d("cosine"), RetrievalConfig(distance="cosine")),
        "cosine_distance": (d("cosine"), RetrievalConfig(distance="cosine", score_kind="distance")),
        "other": (d("l2"), RetrievalConfig(distance="l2")),
    }
    return pairs.select("vec_id", *(F.round(retrieval.similarity(raw, c), 4).cast("double").alias(n) for n, (raw, c) in kinds.items()))


def _candidates(spark, sf_dir):
    """Filtered candidates with their chunk's text: document ids stand for vector ids."""
    scored = _scored(spark, sf_dir).persist()  # some rows a query, used by each step below
    decided = retrieval.decide(scored)
    kept = retrieval.adaptive_filter(scored, decided)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source", F.lit("text").alias("chunk_type"), F.lit("paragraph").alias("block_type"))
    rows = kept.join(docs, "vec_id").where(~retrieval.excluded(F.col("chunk_type"), F.col("block_type")))
    return rows.select("query_id", F.col("vec_id").alias("chunk_id"), F.col("source").alias("doc_id"), "source", "text", "sim", "raw_score", "pos"), decided


@query()
def mmr_select(spark, sf_dir):
    candidates, _ = _candidates(spark, sf_dir)
    return retrieval.select_and_pack(candidates)


@query()
def retrieval_pipeline(spark, sf_dir):
    """From question vectors to answer records, with a stand-in for the model."""
    candidates, decided = _candidates(spark, sf_dir)
    chosen = retrieval.select_and_pack(candidates).persist()
    gated = retrieval.gates(decided, chosen)
    used = chosen.join(candidates.select("query_id", "chunk_id", "source", "text", "sim"), ["query_id", "chunk_id"])
    questions = _questions(spark, sf_dir).select("query_id", "question")
    prompts = retrieval.prompts(used, questions, "Answer from the context.")
    replies = prompts.select("query_id", F.concat(F.lit("Answer of "), F.char_length("prompt"), F.lit(" characters")).alias("primary"), F.lit("No context was found.").alias("fallback"))
    return retrieval.answers(gated, questions, replies, used)


@query(
    """WITH c AS (SELECT label AS query_id, vec_id AS key, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
    r AS (SELECT query_id, key, sum(strlen(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running_bytes FROM c WHERE length(text) >= 50)
    SELECT query_id, key, CAST(running_bytes AS BIGINT) AS running_bytes FROM r WHERE running_bytes <= 20000"""
)
def legacy_pack(spark, sf_dir):
    w = Window.partitionBy("label").orderBy("vec_id")
    c = read(spark, sf_dir, "embeddings").join(read(spark, sf_dir, "documents"), F.col("doc_id") == F.col("vec_id"))
    c = c.select(F.col("label").alias("query_id"), F.col("vec_id").alias("key"), F.row_number().over(w).alias("rank"), "text")
    return retrieval.legacy_pack(c, 20_000, 50).select("query_id", "key", "running_bytes")


@query(
    f"""WITH {_TOPK}, v AS (SELECT query_id, label, count(*) AS n FROM t WHERE rank BETWEEN 2 AND 11 GROUP BY ALL)
    SELECT query_id, label AS voted, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1"""
)
def knn_label_vote(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    near = retrieval.top_k(e, _questions(spark, sf_dir), 11).where("rank > 1").join(e.select("vec_id", "label"), "vec_id")
    votes = near.groupBy("query_id", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"))
    return best.select("query_id", F.col("b.label").alias("voted"), (-F.col("b.m")).alias("votes"))


@query(
    f"""WITH {_TOPK}, f AS (SELECT q.query_id, min(t.rank) AS first_rank FROM q LEFT JOIN (SELECT t.query_id, t.rank FROM t JOIN embeddings e ON e.vec_id = t.query_id
        WHERE t.rank <= 10 AND t.label = e.label AND t.vec_id <> t.query_id) t USING (query_id) GROUP BY ALL)
    SELECT count(*) AS eligible, count(first_rank) AS hits, count(first_rank) / count(*) AS hit_rate, round(coalesce(sum(1 / first_rank), 0) / count(*), 6) AS mrr FROM f"""
)
def eval_hit_mrr(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    near = retrieval.top_k(e, _questions(spark, sf_dir), 10).select("query_id", "rank", "vec_id")
    # a query wants all other rows of its label; those among the ten found are all that count
    labelled = near.join(e.select("vec_id", F.col("label").alias("found_label")), "vec_id").join(q, "query_id")
    wanted = labelled.where("found_label = label and vec_id <> query_id").groupBy("query_id").agg(F.collect_list(F.col("vec_id").cast("string")).alias("found_ids"))
    others = e.groupBy("label").agg((F.count("*") - 1).alias("others"))
    golden = q.join(others, "label", "left").join(wanted, "query_id", "left")
    # a query whose wanted rows were not found stays eligible, by an id that no row has
    ids = F.when(F.col("others") > 0, F.coalesce("found_ids", F.array(F.lit("none found"))))
    golden = golden.select("query_id", ids.alias("expect_doc_ids"), F.lit(None).cast("array<string>").alias("expect_phrases"), F.lit(10).alias("top_k"))
    found = near.select("query_id", "rank", F.col("vec_id").alias("doc_id"), F.lit(None).cast("string").alias("chunk_id"), F.lit("").alias("text"))
    return evaluation.hit_rate_mrr(golden, found).select("eligible", "hits", "hit_rate", F.round("mrr", 6).alias("mrr"))


@query(
    """SELECT item_id AS query_id, bool_or(d.text IS NOT NULL) AS phrase_hit FROM benchmark b
    LEFT JOIN (SELECT DISTINCT lower(text) AS text FROM documents WHERE text IS NOT NULL) d ON contains(d.text, lower(b.text)) GROUP BY item_id"""
)
def eval_phrase_hit(spark, sf_dir):
    """Which benchmark texts, whole, any document holds."""
    phrases = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"))
    return evaluation.phrases_in(phrases, read(spark, sf_dir, "documents").select("text"))


# text, dedup, chunks

_HASH = "sha256(lower(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')))"


@query(f"SELECT min(doc_id) AS doc_id, {_HASH} AS hash_norm FROM documents WHERE text IS NOT NULL GROUP BY 2")
def hash_dedup(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.hash_norm(F.col("text")).alias("hash_norm"))
    return dedup.first_of_each(d, "hash_norm", ["doc_id"])


@query(
    f"""WITH h AS (SELECT doc_id, {_HASH} AS hash_norm FROM documents), b AS (SELECT * FROM h WHERE doc_id % 2 = 1)
    SELECT min(doc_id) AS doc_id, hash_norm FROM b WHERE hash_norm NOT IN (SELECT hash_norm FROM h WHERE doc_id % 2 = 0) GROUP BY hash_norm"""
)
def upsert_antijoin(spark, sf_dir):
    h = read(spark, sf_dir, "documents").select("doc_id", text.hash_norm(F.col("text")).alias("hash_norm"))
    return dedup.upsert(h.where("doc_id % 2 = 1"), h.where("doc_id % 2 = 0"), "hash_norm", ["doc_id"])


@query(
    f"""WITH h AS (SELECT doc_id, {_HASH} AS hash_norm FROM documents), b AS (SELECT * FROM h WHERE doc_id % 2 = 1),
    n AS (SELECT count(DISTINCT hash_norm) AS inserted FROM b WHERE hash_norm NOT IN (SELECT hash_norm FROM h WHERE doc_id % 2 = 0))
    SELECT inserted, (SELECT count(*) FROM b) - inserted AS skipped FROM n"""
)
def upsert_counts(spark, sf_dir):
    h = read(spark, sf_dir, "documents").select("doc_id", text.hash_norm(F.col("text")).alias("hash_norm"))
    return dedup.upsert_counts(h.where("doc_id % 2 = 1"), h.where("doc_id % 2 = 0"), "hash_norm", ["doc_id"])


@query(
    r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'))) AS cleaned
    FROM documents"""
)
def clean_lines(spark, sf_dir):
    t = text.normalize_lines(text.ligatures(text.strip_invisible(F.col("text"))))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("cleaned"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, count(*) AS total FROM l GROUP BY 1),
    r AS (SELECT doc_id, line, count(*) AS c FROM l WHERE line <> '' AND length(line) <= 60 GROUP BY ALL),
    x AS (SELECT doc_id, line FROM r JOIN n USING (doc_id) WHERE c >= 3 AND c > 0.05 * total)
    SELECT doc_id, total - coalesce(gone, 0) AS kept_lines FROM n LEFT JOIN (SELECT doc_id, count(*) AS gone FROM l SEMI JOIN x USING (doc_id, line) GROUP BY 1) USING (doc_id)"""
)
def repeated_lines(spark, sf_dir):
    kept = text.drop_repeated_lines(F.col("text"))
    d = read(spark, sf_dir, "documents").select("doc_id", kept.alias("kept"), F.col("text"))
    none = F.col("kept") == ""
    return d.where("text is not null").select("doc_id", F.when(none & (F.col("text") != ""), F.lit(0)).otherwise(F.size(F.split("kept", "\n", -1))).cast("long").alias("kept_lines"))


_WS = r"[ \t\x0B\x0C\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _stripped(c: str) -> str:
    return f"regexp_replace({c}, '^({_WS}|\\n)+|({_WS}|\\n)+$', '', 'g')"



@query(
    rf"""WITH a AS (SELECT doc_id, replace(replace(translate(nfc_normalize(coalesce(text, '')), chr(160) || chr(173) || chr(8203) || chr(8204) || chr(8205), ' '), chr(64257), 'fi'), chr(64258), 'fl') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '{_WS}+\n', chr(10), 'g'), '[ \t]+', ' ', 'g') AS t FROM a),
    c AS (SELECT doc_id, string_split({_stripped("t")}, chr(10)) AS l FROM b),
    r AS (SELECT doc_id, list(line) AS gone FROM (SELECT doc_id, line, count(*) AS n, any_value(total) AS total FROM (SELECT doc_id, unnest(l) AS line, len(l) AS total FROM c) WHERE line <> '' AND length(line) <= 60 GROUP BY doc_id, line)
          WHERE n >= 3 AND n > 0.05 * total GROUP BY doc_id),
    d AS (SELECT c.doc_id, regexp_replace(array_to_string(CASE WHEN gone IS NULL THEN l ELSE list_filter(l, lambda x: NOT list_contains(gone, x)) END, chr(10)), '([A-Za-z]{{2,}})-\n([a-z]{{2,}})', '\1\2' || chr(10), 'g') AS t FROM c LEFT JOIN r ON r.doc_id = c.doc_id),
    e AS (SELECT doc_id, list_filter(string_split(t, chr(10) || chr(10)), lambda x: length(regexp_replace(x, '[^\pL]', '', 'g')) >= 10 OR (length(trim(x)) BETWEEN 1 AND 60 AND
          (regexp_full_match({_stripped("x")}, '[A-Z0-9 ,.:;()\-/]+') OR regexp_full_match({_stripped("x")}, '[A-Z][a-z]+( [A-Z][a-z]+)*')))) AS k FROM d)
    SELECT doc_id, {_stripped("array_to_string(k, chr(10) || chr(10))")} AS text FROM e"""
)
def clean_text(spark, sf_dir):
    return text.with_clean_text(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, i, regexp_replace(substring(text, 1 + i * 1900, 2000), '^\\s+|\\s+$', '', 'g') AS chunk
          FROM d, LATERAL (SELECT unnest(range(0, 1 + CAST(greatest(0, ceil((n - 2000) / 1900.0)) AS BIGINT))) AS i))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk_seq, sha256(chunk) AS chunk_hash FROM w WHERE chunk <> ''""".replace("\\\\", "\\")
)
def chunk_char(spark, sf_dir):
    rows = chunking.chunk_rows(read(spark, sf_dir, "documents"), chunking.chunk_chars(F.col("text"), 2000, 100))
    return rows.select("doc_id", F.col("chunk_seq").cast("long").alias("chunk_seq"), F.sha2("text", 256).alias("chunk_hash"))


@query(ORACLE_SQL["chunk_char"])
def chunk_char_sql(spark, sf_dir):
    """The same chunks, asked for in SQL."""
    table_functions.register(spark)
    return spark.sql("SELECT d.doc_id, CAST(c.chunk_seq AS BIGINT) AS chunk_seq, sha2(c.text, 256) AS chunk_hash FROM {docs} d, LATERAL chunk_text(d.text, 2000, 100) c", docs=read(spark, sf_dir, "documents"))


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS item_idx, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
    d AS (SELECT *, length(text) AS n FROM l),
    w AS (SELECT doc_id, item_idx, i, regexp_replace(substring(text, 1 + i * 180, 200), '^\\s+|\\s+$', '', 'g') AS chunk
          FROM d, LATERAL (SELECT unnest(range(0, 1 + CAST(greatest(0, ceil((n - 200) / 180.0)) AS BIGINT))) AS i))
    SELECT doc_id, CAST(item_idx AS INTEGER) AS item_idx, row_number() OVER (PARTITION BY doc_id ORDER BY item_idx, i) AS chunk_seq, sha256(chunk) AS chunk_hash FROM w WHERE chunk <> ''""".replace("\\\\", "\\")
)
def chunk_lines_sql(spark, sf_dir):
    """Lines as items of their documents, numbered through in SQL."""
    table_functions.register(spark)
    items = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("item_idx", "text"))
    found = spark.sql("SELECT * FROM chunk_documents(TABLE({items}) PARTITION BY doc_id ORDER BY (item_idx), 200, 20)", items=items)
    return found.select("doc_id", "item_idx", F.col("chunk_seq").cast("long").alias("chunk_seq"), F.sha2("text", 256).alias("chunk_hash"))


@query(
    r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, i, list_slice(w, i * 90 + 1, i * 90 + 100) AS p FROM d, LATERAL (SELECT unnest(range(0, 1 + CAST(greatest(0, ceil((len(w) - 100) / 90.0)) AS BIGINT))) AS i))
    SELECT doc_id, i + 1 AS chunk_seq, len(p) AS n_tokens, sha256(array_to_string(p, ' ')) AS chunk_hash FROM c WHERE len(p) > 0"""
)
def chunk_tokens(spark, sf_dir):
    rows = chunking.chunk_rows(read(spark, sf_dir, "documents"), chunking.chunk_tokens(F.col("text"), 100, 0.1))
    return rows.select("doc_id", F.col("chunk_seq").cast("long").alias("chunk_seq"), F.size(F.split("text", " ")).cast("long").alias("n_tokens"), F.sha2("text", 256).alias("chunk_hash"))


@query("SELECT doc_id, CAST(round_even(length(text) / 4, 0) AS INT) AS estimated, CAST(ceil(length(text) / 4) AS INT) AS counted FROM documents")
def token_estimate(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", chunking.estimated_tokens(t).alias("estimated"), chunking.counted_tokens(t).alias("counted"))


@query(
    """SELECT count(*) AS items, count(*) FILTER (ceil(length(text) / 4) > 256) AS over_limit,
    CAST(sum(CASE WHEN ceil(length(text) / 4) > 256 THEN ceil(length(text) / 4) - 256 ELSE 0 END) AS BIGINT) AS excess_tokens FROM documents"""
)
def token_policy_counts(spark, sf_dir):
    return chunking.limit_counts(read(spark, sf_dir, "documents"), "text", 256)


@query(
    rf"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, list_filter(flatten(list_transform(string_split(regexp_replace({_stripped("text")}, '([.!?])(?:{_WS}|\n)+', '\1' || chr(1), 'g'), chr(1)),
          lambda x: CASE WHEN length(x) <= 1024 THEN [x] ELSE regexp_split_to_array(x, '(?:{_WS}|\n)+') END)), lambda x: x <> '') AS p FROM d WHERE n > 1024),
    f AS (SELECT doc_id, p, list_reduce(list_transform(p, lambda x: {{'h': length(x), 'c': [1]}}), lambda a, x: CASE WHEN a.h + 1 + x.h <= 1024
          THEN {{'h': a.h + 1 + x.h, 'c': list_append(a.c, a.c[-1])}} ELSE {{'h': x.h, 'c': list_append(a.c, a.c[-1] + 1)}} END) AS a FROM s WHERE len(p) > 0),
    u AS (SELECT doc_id, unnest(p) AS piece, unnest(a.c) AS chunk_seq, generate_subscripts(p, 1) AS k FROM f),
    g AS (SELECT doc_id, 1 AS chunk_seq, text FROM d WHERE n <= 1024 UNION ALL SELECT doc_id, chunk_seq, string_agg(piece, ' ' ORDER BY k) FROM u GROUP BY 1, 2)
    SELECT doc_id, chunk_seq, text, doc_id || '_chunk_' || chunk_seq AS chunk_id FROM g"""
)
def split_to_limit(spark, sf_dir):
    return chunking.chunk_rows(read(spark, sf_dir, "documents"), chunking.apply_limit(F.col("text"), 256, "split"))


@query(
    rf"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, i, {_stripped("substring(text, 1 + i * 1900, 2000)")} AS text FROM d, LATERAL (SELECT unnest(range(0, 1 + CAST(greatest(0, ceil((n - 2000) / 1900.0)) AS BIGINT))) AS i)),
    c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk_seq, text, string_split(text, chr(10))[1] AS first FROM w WHERE text <> ''),
    t AS (SELECT *, count(*) OVER p >= 2 AND min(first) OVER p = max(first) OVER p AS same FROM c WINDOW p AS (PARTITION BY doc_id))
    SELECT doc_id, CAST(chunk_seq AS INTEGER) AS chunk_seq, CASE WHEN same AND chunk_seq > 1 THEN {_stripped("substring(text, length(first) + 2)")} ELSE text END AS text,
           doc_id || '_chunk_' || chunk_seq AS chunk_id, CASE WHEN same THEN first END AS doc_title FROM t"""
)
def title_stripped_chunks(spark, sf_dir):
    return chunking.strip_title(chunking.chunk_rows(read(spark, sf_dir, "documents"), chunking.chunk_chars(F.col("text"), 2000, 100)))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '\b[a-zA-Z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS emails,
    len(regexp_extract_all(text, '\b\d{1,3}(?:\.\d{1,3}){3}\b')) AS ipv4_shaped FROM documents"""
)
def pii_counts(spark, sf_dir):
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", count(sanitize.DEFAULT_RULES[0].patterns[0][0]).alias("emails"), count(r"\b\d{1,3}(?:\.\d{1,3}){3}\b").alias("ipv4_shaped"))


@query()
def pii_redact(spark, sf_dir):
    done = sanitize.sanitize(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "sanitized", "redactions")


@query()
def sanitizer_audit(spark, sf_dir):
    done = sanitize.sanitize(read(spark, sf_dir, "documents").select("doc_id", "text"), mode="shadow")
    return sanitize.audit_rows(done, "default", "shadow")


@query("SELECT c_custkey, list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN (len(s) - i) % 2 = 0 THEN CAST(s[i] AS INT) ELSE CAST(s[i] AS INT) * 2 - 9 * (CAST(s[i] AS INT) > 4)::INT END)) % 10 = 0 AS valid FROM (SELECT c_custkey, CAST(100000 + c_custkey * 7919 AS VARCHAR) AS s FROM customer)")
def luhn_flags(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", sanitize.luhn_valid((100000 + F.col("c_custkey") * 7919).cast("string")).alias("valid"))


@query(
    r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{2,}')) AS s FROM documents),
    v AS (SELECT doc_id, list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN (len(s) - i) % 2 = 0 THEN CAST(s[i] AS INT) ELSE CAST(s[i] AS INT) * 2 - 9 * (CAST(s[i] AS INT) > 4)::INT END)) % 10 = 0 AS valid FROM r)
    SELECT doc_id, count(*) AS runs, count(*) FILTER (valid) AS valid FROM v GROUP BY doc_id"""
)
def luhn_runs(spark, sf_dir):
    """Runs of digits in all texts, and how many have a valid check digit."""
    runs = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{2,}"), F.lit(0))).alias("s"))
    return runs.groupBy("doc_id").agg(F.count("*").alias("runs"), F.count_if(sanitize.luhn_valid(F.col("s"))).alias("valid"))


@query(
    r"""SELECT doc_id, list_filter(list_transform(string_split(string_split(text, chr(10))[1], ','), lambda t: trim(t)), lambda t: t <> '') AS tags
    FROM documents WHERE text IS NOT NULL AND NOT starts_with(trim(text), '[')"""
)
def first_line_tags(spark, sf_dir):
    """The first line of each text, read as a list of tags."""
    d = read(spark, sf_dir, "documents").where("text is not null and not startswith(trim(text), '[')")
    return d.select("doc_id", sinks.parse_tags(F.split("text", "\n", 2)[0]).alias("tags"))


# sources


@query()
def html_sections(spark, sf_dir):
    raw = loaders.html_page_sections(read(spark, sf_dir, "pages"), "page_id", "html")
    return text.nonempty(raw, text.cleaned(F.col("text")))


@query(
    r"""SELECT page_id, regexp_extract(lower(url), '\.([^./]+)$', 1) AS extension, CASE WHEN contains(lower(left(html, 4096)), '<html') OR contains(lower(left(html, 4096)), '<!doctype html') THEN 'html' ELSE 'txt' END AS bucket FROM pages"""
)
def page_type_route(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    kind = manifest.content_bucket(manifest.sniffed_type(F.col("html").cast("binary"), F.col("url")))
    return p.select("page_id", F.regexp_extract(F.lower("url"), r"\.([^./]+)$", 1).alias("extension"), kind.alias("bucket"))


@query("SELECT event_id, list_sort(list_distinct(['all', event_type, 'k' || json_extract_string(props, '$.k')])) AS tags, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def tag_union(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select("event_id", F.array_sort(F.array_distinct(F.array(F.lit("all"), F.col("event_type"), F.concat(F.lit("k"), k)))).alias("tags"), k.cast("long").alias("k"))


# operational analytics


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00') AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 10")
def user_search(spark, sf_dir):
    users = read(spark, sf_dir, "customer").withColumnRenamed("c_name", "email").withColumnRenamed("c_mktsegment", "status")
    found = analytics.filter_users(users, "00", "BUILDING")
    return analytics.page(found, [F.desc("c_acctbal"), F.col("c_custkey")], 50, 10).select("c_custkey", F.col("email").alias("c_name"))


@query("SELECT count(*) AS total FROM customer WHERE contains(lower(c_name), '00') AND c_mktsegment = 'BUILDING'")
def user_total(spark, sf_dir):
    users = read(spark, sf_dir, "customer").withColumnRenamed("c_name", "email").withColumnRenamed("c_mktsegment", "status")
    return analytics.filter_users(users, "00", "BUILDING").agg(F.count("*").alias("total"))


def _feedback(spark, sf_dir):
    """Events as feedback: type as mode, whether the value is over 50 as rating."""
    meta = F.to_json(F.struct(F.concat(F.lit("Q "), F.col("event_id")).alias("question"), F.col("props").alias("answer_preview"), F.col("event_type").alias("mode"), F.lit("web").alias("client"), F.lit("2").alias("ui_version")))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.concat(F.lit("session-"), F.col("user_id") % 7).alias("session_id"), F.when(F.col("value") > 50, 1).otherwise(-1).alias("rating"), F.col("event_type").alias("category"), F.lit(" said ").alias("comment"), meta.alias("metadata_json"), F.col("ts").alias("created_at"))


@query(
    """SELECT count(*) FILTER (value > 50) AS likes, count(*) FILTER (value <= 50 OR value IS NULL) AS dislikes, 0 AS mode_rag, 0 AS mode_hybrid, 0 AS mode_fallback, 0 AS mode_none,
    count(*) FILTER (value > 50) * 100.0 / count(*) AS like_pct, count(*) FILTER (value <= 50 OR value IS NULL) * 100.0 / count(*) AS dislike_pct FROM events"""
)
def feedback_kpis(spark, sf_dir):
    return analytics.feedback_kpis(analytics.derive_feedback(_feedback(spark, sf_dir)))


@query("SELECT event_type AS mode, count(*) AS n, count(*) FILTER (value > 50) AS likes FROM events GROUP BY 1")
def feedback_by_mode(spark, sf_dir):
    d = analytics.derive_feedback(_feedback(spark, sf_dir))
    return d.groupBy("mode").agg(F.count("*").alias("n"), F.count_if(F.col("rating_label") == "like").alias("likes"))


@query(
    """SELECT event_id AS id, user_id, 'Q ' || event_id AS question, event_type AS mode, 'web@2' AS client_tag, CASE WHEN value > 50 THEN 'like' ELSE 'dislike' END AS rating_label,
    user_id || ' | session-' AS user_display, 'said' AS comment, lower('Q ' || event_id || ' said') AS search_blob FROM events"""
)
def feedback_derived(spark, sf_dir):
    return analytics.derive_feedback(_feedback(spark, sf_dir)).select("id", "user_id", "question", "mode", "client_tag", "rating_label", "user_display", "comment", "search_blob")


@query("SELECT event_id AS id FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5")
def feedback_page(spark, sf_dir):
    f = analytics.filter_feedback(_feedback(spark, sf_dir), user_id=7, since="2024-01-05", until="2024-01-25")
    return analytics.page(f, [F.desc("created_at"), F.desc("id")], 20, 5).select("id")


@query("SELECT event_id AS id FROM events WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 5000) ORDER BY ts DESC, event_id DESC LIMIT 20")
def feedback_keyset(spark, sf_dir):
    after = (F.lit("2024-01-20").cast("timestamp_ntz"), F.lit(5000))
    return analytics.keyset_page(_feedback(spark, sf_dir), "created_at", "id", after, 20).select("id")


@query(
    """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS interactions, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'purchase') AS fallbacks,
    count(*) FILTER (event_type = 'purchase') / count(*) AS fallback_rate FROM events GROUP BY 1"""
)
def usage_daily(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("mode", F.when(F.col("event_type") == "purchase", "fallback").otherwise("rag"))
    return analytics.usage_daily(e).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("SELECT event_type, user_id, count(*) AS n, round(sum(value), 4) AS total, CAST(grouping_id(event_type, user_id) AS BIGINT) AS level FROM events GROUP BY ROLLUP (event_type, user_id)")
def rollup_usage(spark, sf_dir):
    return analytics.usage_rollup(read(spark, sf_dir, "events"), "event_type", "user_id", "value").withColumn("total", F.round("total", 4))


@query("SELECT user_id AS session_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS events FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def session_upsert(spark, sf_dir):
    return analytics.sessions(read(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id"))


@query(
    """SELECT event_id, round(value - lag(value) OVER w, 6) AS change, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS running_mean
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def latency_trend(spark, sf_dir):
    t = analytics.latency_trend(read(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id")
    return t.select("event_id", *(rounded(F.col(c), 6).alias(c) for c in ("change", "running_mean")))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy(F.window(F.col("ts"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query()
def approx_distinct_users(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query("SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_partkey <= 20")
def conflict_jobs(spark, sf_dir):
    held = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("upload_ids"))
    jobs = read(spark, sf_dir, "orders").join(held, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "queued").otherwise("succeeded").alias("status"), "upload_ids")
    wanted = read(spark, sf_dir, "part").where("p_partkey <= 20").select(F.col("p_partkey").alias("upload_id"))
    return dedup.conflicting(jobs, wanted).select("o_orderkey").distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_uploads(spark, sf_dir):
    return dedup.missing_ids(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT n_name, count(*) AS users, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def users_by_group(spark, sf_dir):
    n = F.broadcast(read(spark, sf_dir, "nation"))  # a dimension of fixed size
    return read(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count("*").alias("users"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_orderdate) AS at FROM orders GROUP BY 1")
def registry_state(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("ts"), F.col("o_orderstatus").alias("status"))
    return dedup.latest_state(o, "o_custkey", "ts").select("o_custkey", "status", F.col("ts.o_orderdate").alias("at"))


_PLAIN = r"regexp_replace(lower(text), '[^\pL\pM\pN_\s]', ' ', 'g')"


@query(rf"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(trim({_PLAIN}), '\s+'), lambda t: regexp_full_match(t, '\pL+'))) <= 3 AS short FROM conversations WHERE role = 'user'")
def short_query_share(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", retrieval.is_short(F.col("text")).alias("short"))


@query(
    r"""SELECT conv_id, turn, CASE WHEN length(trim(text)) <= 64 AND upper(trim(text)) = 'NO_CONTEXT' THEN 'exact_token' WHEN regexp_matches(text, '(?i)\bcontext (does not|doesn''t) contain\b') THEN 'regex_phrases:0'
    WHEN regexp_matches(text, '(?i)\bno specific information\b') THEN 'regex_phrases:1' WHEN regexp_matches(text, '(?i)\bnot contain any information\b') THEN 'regex_phrases:2'
    WHEN regexp_matches(text, '(?i)\bdoes not mention\b') THEN 'regex_phrases:3' END AS rule FROM conversations WHERE role = 'assistant'"""
)
def no_context_rules(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", retrieval.no_context_rule(F.col("text")).alias("rule"))


@query(
    """WITH b AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderkey % 4 AS level, o_orderpriority FROM orders), t AS (SELECT * FROM b),
    l AS (SELECT doc_id, pos, max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level = 2 THEN pos END) OVER w AS p2, max(CASE WHEN level = 3 THEN pos END) OVER w AS p3
          FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT l.doc_id, CAST(l.pos AS INT) AS pos, concat_ws('>', CASE WHEN p1 IS NOT NULL THEN t1.o_orderpriority END, CASE WHEN coalesce(p2, 0) > coalesce(p1, 0) THEN t2.o_orderpriority END,
           CASE WHEN coalesce(p3, 0) > greatest(coalesce(p1, 0), coalesce(p2, 0)) THEN t3.o_orderpriority END) AS path
    FROM l LEFT JOIN t t1 ON t1.doc_id = l.doc_id AND t1.pos = p1 LEFT JOIN t t2 ON t2.doc_id = l.doc_id AND t2.pos = p2 LEFT JOIN t t3 ON t3.doc_id = l.doc_id AND t3.pos = p3"""
)
def heading_path(spark, sf_dir):
    """A customer's orders as blocks of headings of three levels and body."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    b = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.row_number().over(w).alias("pos"), F.nullif((F.col("o_orderkey") % 4).cast("int"), F.lit(0)).alias("level"), F.col("o_orderpriority").alias("title"))
    return chunking.heading_paths(b).select("doc_id", "pos", F.array_join("heading_path", ">").alias("path"))


@query(
    """WITH e AS (SELECT event_id, CAST(floor(value * value * value) AS BIGINT) AS n FROM events)
    SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.2f MB', n / 1048576.0) END AS size FROM e"""
)
def human_sizes(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").select("event_id", text.human_size(F.floor(v * v * v)).alias("size"))


@query("SELECT label, list(m ORDER BY i) AS embedding FROM (SELECT label, i, round(avg(embedding[i]), 5) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY 1")
def mean_pool(spark, sf_dir):
    e = dedup.mean_pool(read(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding")), ["label"])
    return e.select("label", F.transform("embedding", lambda x: rounded(x, 5)).alias("embedding"))


@query("SELECT event_type, list_sort(list(DISTINCT trim(t))) AS tags FROM (SELECT event_type, unnest(string_split('b, a,' || event_type, ',')) AS t FROM events) GROUP BY 1")
def parsed_tags(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", sinks.parse_tags(F.concat(F.lit("b, a,"), F.col("event_type"))).alias("tags")).distinct()
    return e.select("event_type", F.array_sort("tags").alias("tags"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
    n AS (SELECT doc_id, line || CASE WHEN length(line) % 7 = 0 THEN ' ..... ' || length(line) WHEN length(line) % 7 = 1 THEN chr(9) || (length(line) % 100) ELSE '' END AS line FROM l),
    f AS (SELECT doc_id, regexp_matches(line, '\.{3,}\s*\d+$') AS leader, regexp_matches(line, '\t+\s*\d+$') AS tab, regexp_matches(line, '^\s*\d+(\.\d+)*\s+.+\s+\d{1,4}$') AS numbered, length(line) AS n,
                 len(regexp_extract_all(line, '\b\d+(?:\.\d+)*\s*[A-Za-z][^0-9]{0,80}?\s*\d{1,4}\b')) AS entries FROM n)
    SELECT doc_id, count(*) AS lines, count(*) FILTER (leader) AS loose, count(*) FILTER (n >= 4 AND (leader OR tab OR numbered)) AS strict, CAST(sum(entries) AS BIGINT) AS entries FROM f GROUP BY doc_id""".replace("\\\\", "\\")
)
def toc_line_kinds(spark, sf_dir):
    """Lines of documents, some with a page number set after them as in a table of contents."""
    lines = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    n = F.char_length("line")
    marked = lines.withColumn("line", F.concat("line", F.when(n % 7 == 0, F.concat(F.lit(" ..... "), n)).when(n % 7 == 1, F.concat(F.lit("\t"), n % 100)).otherwise("")))
    c = F.col("line")
    return marked.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(text.is_toc_line(c)).alias("loose"), F.count_if(text.is_toc_strict(c)).alias("strict"), F.sum(text.toc_entries(c)).cast("long").alias("entries"))


@query(
    """WITH s AS (SELECT doc_id AS id, source AS path, CASE doc_id % 4 WHEN 0 THEN 'TEXT/Markdown' WHEN 1 THEN 'Html' WHEN 2 THEN 'other' END AS kind, lang FROM documents
        UNION ALL SELECT page_id, url || '/x.PDF', NULL, '' FROM pages),
    t AS (SELECT *, CASE kind WHEN 'TEXT/Markdown' THEN 'txt' WHEN 'Html' THEN 'html' ELSE CASE WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN lower(path) LIKE '%.html' OR lower(path) LIKE '%.htm' THEN 'html' ELSE 'txt' END END AS content_type FROM s)
    SELECT id, CASE WHEN path IS NULL OR content_type IN ('pdf', 'html') THEN NULL WHEN path LIKE '%://%' THEN path ELSE '/files/' || path END AS source, content_type, nullif(lang, '') AS lang,
           CASE WHEN path IS NULL THEN 'source is required' WHEN content_type = 'pdf' THEN 'page is required' WHEN content_type = 'html' THEN 'section_path is required' END AS error FROM t"""
)
def normalized_items(spark, sf_dir):
    """Documents and pages under odd content types; those whose type needs a field that they lack
    are errors."""
    k = F.col("doc_id") % 4
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.when(k == 0, "TEXT/Markdown").when(k == 1, "Html").when(k == 2, "other").alias("content_type"), "lang")
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat("url", F.lit("/x.PDF")).alias("source"), F.lit(None).cast("string").alias("content_type"), F.lit("").alias("lang"))
    good, bad = manifest.normalized(d.unionByName(p), "/files")
    fields = ["id", "source", "content_type", "lang"]
    return good.select(*fields, F.lit(None).cast("string").alias("error")).unionByName(bad.withColumn("source", F.lit(None).cast("string")).select(*fields, "error"))


# the index of vectors, beside the exact search


def _indexed(spark, sf_dir, k: int = 25, sample: int = 256):
    """The index over all rows, and as many probes as find 95 % of the exact rows of a bounded
    sample of the questions."""
    corpus, q = read(spark, sf_dir, "embeddings"), _questions(spark, sf_dir)
    index = vector_index.build(corpus)
    some = q.orderBy(F.xxhash64("query_id")).limit(sample)
    return index, q, vector_index.probes_needed(index, some, retrieval.top_k(corpus, some, k), 0.95)


@query()
def ivf_topk(spark, sf_dir):
    index, q, probes = _indexed(spark, sf_dir)
    return vector_index.search(index, q, 25, probes)


@query()
def ivf_recall(spark, sf_dir):
    index, q, probes = _indexed(spark, sf_dir)
    return vector_index.recall(vector_index.search(index, q, 25, probes), retrieval.top_k(read(spark, sf_dir, "embeddings"), q, 25))


# the ingest job


def _items(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("item_idx"), "text", F.lit("text/plain").alias("content_type"), "source")


@query()
def ingest_chunks(spark, sf_dir):
    return ingest.chunk_items(_items(spark, sf_dir))


@query()
def ingest_vectors(spark, sf_dir):
    return ingest.ingest(_items(spark, sf_dir))


@query()
def ingest_job(spark, sf_dir):
    return ingest.run_job(_mixed_items(spark, sf_dir), ROUTED).counters


@query()
def ingest_summary(spark, sf_dir):
    items = _items(spark, sf_dir)
    chunks = tables.written(ingest.chunk_items(items), "ingest-chunks")
    return ingest.summary(items, chunks, dedup.first_of_each(chunks, "hash_norm", ["doc_id", "chunk_seq"]))


DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
ROUTED = ingest.Profile(chunker="toc_section_docx", max_tokens=512)


def _mixed_items(spark, sf_dir):
    """Documents as text files, pages as web files, conversations as files of a word
    processor: their user turns are headings."""
    d = _items(spark, sf_dir).withColumn("doc_id", F.concat(F.lit("document-"), "doc_id"))
    p = read(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id").alias("doc_id"), F.lit(0).alias("item_idx"), loaders.html_text(F.col("html")).alias("text"), F.lit("text/html").alias("content_type"), F.col("url").alias("source"))
    asks = F.col("role") == "user"
    c = read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conversation-"), "conv_id").alias("doc_id"),
        F.col("turn").cast("int").alias("item_idx"),
        F.when(asks, F.concat(F.lit("Question number "), "turn", F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"),
        F.lit(DOCX).alias("content_type"),
        F.lit("conversations").alias("source"),
        F.when(asks, F.concat(F.lit("Question number "), "turn")).alias("section_heading"),
        F.when(asks, F.when(F.col("turn") <= 1, 1).otherwise(2)).alias("heading_level"),
    )
    return d.unionByName(p).unionByName(c, allowMissingColumns=True)


@query(
    f"""SELECT route, content_type, count(*) AS items, count(DISTINCT doc_id) AS docs FROM (
        SELECT 'char' AS route, 'text/plain' AS content_type, doc_id FROM documents WHERE coalesce(source, '') <> ''
        UNION ALL SELECT 'char', 'text/html', page_id FROM pages WHERE coalesce(url, '') <> ''
        UNION ALL SELECT 'toc_section_docx', '{DOCX}', conv_id FROM conversations) GROUP BY ALL"""
)
def ingest_routes(spark, sf_dir):
    good, _ = manifest.split_valid(_mixed_items(spark, sf_dir))
    return models.routed(good, ROUTED.chunker).groupBy("route", "content_type").agg(F.count("*").alias("items"), F.countDistinct("doc_id").alias("docs"))


@query()
def ingest_routed(spark, sf_dir):
    return ingest.chunk_items(_mixed_items(spark, sf_dir), ROUTED)


@query()
def chunks_by_type(spark, sf_dir):
    return ingest.chunks_by_type(ingest.chunk_items(_mixed_items(spark, sf_dir), ROUTED))


# scalar functions and small operators, each over a whole table


@query("SELECT event_id, CASE WHEN value > 60 THEN 1 WHEN value < 20 THEN -1 END AS sign FROM events")
def rating_signs(spark, sf_dir):
    r = F.when(F.col("value") > 80, "like").when(F.col("value") > 60, "+1").when(F.col("value") < 10, "negative").when(F.col("value") < 20, "-1").otherwise("all")
    return read(spark, sf_dir, "events").select("event_id", analytics.rating_sign(r).alias("sign"))


@query("SELECT c_custkey FROM customer WHERE lower(c_name) = 'customer#000000007' AND c_mktsegment NOT IN ('suspended', 'deleted')")
def login_lookup(spark, sf_dir):
    users = read(spark, sf_dir, "customer").withColumnRenamed("c_name", "email").withColumnRenamed("c_mktsegment", "status")
    return analytics.login(users, "CUSTOMER#000000007").select("c_custkey")


@query(
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'Low' WHEN value >= 60 THEN 'High' WHEN value >= 25 THEN 'Medium' ELSE 'Low' END AS label,
    round(CASE WHEN event_type = 'purchase' THEN 0.0 ELSE least(1.0, greatest(0.0, (value - 25) / 35)) END, 6) AS ratio FROM events"""
)
def confidence_labels(spark, sf_dir):
    c = retrieval.confidence(F.col("value"), F.lit(25.0), F.lit(60.0), F.when(F.col("event_type") == "purchase", "fallback").otherwise("hybrid"))
    return read(spark, sf_dir, "events").select("event_id", c["label"].alias("label"), F.round(c["ratio"], 6).alias("ratio"))


@query("SELECT event_id FROM events WHERE event_type NOT IN ('purchase', 'view') AND (value IS NULL OR value >= 25)")
def evidence_filter(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    explain = e.select(F.col("event_type").alias("query_id")).distinct().select("query_id", F.when(F.col("query_id") == "purchase", "fallback").otherwise("hybrid").alias("mode"), F.when(F.col("query_id") == "view", "min_chunks_gate").alias("gate_failed"), F.lit(99.0).alias("sim_max"), F.lit(25.0).alias("threshold_low"))
    return retrieval.evidence(e.select("event_id", F.col("event_type").alias("query_id"), F.col("value").alias("score")), explain).select("event_id")


@query("SELECT doc_id, left(sha256('salt' || source), 10) AS pseudonym FROM documents")
def pseudonyms(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.pseudonym(F.col("source"), "salt").alias("pseudonym"))


@query(
    """SELECT doc_id, substring(text, 1, 320) AS snippet, translate(substring(text, 1, 400), chr(10), ' ') AS preview,
    CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substring(text, 1, 77), '\\s+$', '') || '...' END AS short FROM documents""".replace("\\\\", "\\")
)
def snippets(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", display.snippet(t).alias("snippet"), display.preview(t).alias("preview"), text.truncated(t).alias("short"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN role END AS text, CASE turn % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'answer2' ELSE 'none' END AS field FROM conversations WHERE trim(text) <> ''")
def answer_selection(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("trim(text) <> ''")
    got = display.selected_answer(F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(" "), F.when(F.col("turn") % 3 == 1, F.col("role")), F.lit("\n"))
    return c.select("conv_id", "turn", got["text"].alias("text"), got["field"].alias("field"))


@query("SELECT event_id, event_type AS answer, CASE WHEN event_id % 3 < 2 THEN 'hybrid' END AS mode FROM events")
def response_shapes(spark, sf_dir):
    body = F.to_json(F.struct(F.col("event_type").alias("answer"), F.lit("hybrid").alias("mode")))
    raw = F.when(F.col("event_id") % 3 == 0, body).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(body.alias("response")))).otherwise(F.col("event_type"))
    r = display.coerced_response(raw)
    return read(spark, sf_dir, "events").select("event_id", r["answer"].alias("answer"), r["mode"].alias("mode"))


@query("SELECT event_id, ['a ', event_type, ' b'] AS \"values\", ['text', 'figure', 'text'] AS kinds FROM events")
def figure_split(spark, sf_dir):
    p = display.split_by_figures(F.concat(F.lit("a [FIGURE: "), F.col("event_type"), F.lit(" ] b")))
    return read(spark, sf_dir, "events").select("event_id", F.transform(p, lambda x: x["value"]).alias("values"), F.transform(p, lambda x: x["kind"]).alias("kinds"))


@query("SELECT event_id, 'keep' || chr(10) || event_type AS text FROM events")
def figure_labels(spark, sf_dir):
    t = F.concat(F.lit("keep\nSee images:\nimg1\n\n"), F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", display.without_figure_labels(t).alias("text"))


@query(
    """WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\\pL\\pM\\pN_\\s]', ' ', 'g')), '\\s+'), lambda w: regexp_full_match(w, '\\pL+'))) AS w FROM documents)
    SELECT a.doc_id, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS likeness
    FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""".replace("\\\\", "\\")
)
def token_jaccard(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(text.alphabetic_tokens(F.col("text"))).alias("w"))
    n = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return t.join(n, "doc_id").select("doc_id", F.round(text.jaccard(F.col("w"), F.col("v")), 6).cast("double").alias("likeness"))


@query("SELECT c_custkey, c_mktsegment AS status, CASE WHEN c_custkey % 10 = 0 THEN 'suspended' ELSE c_mktsegment END AS after FROM customer")
def soft_deleted_users(spark, sf_dir):
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"))
    gone = analytics.soft_delete(users, users.where("id % 10 = 0"))
    return users.join(gone.select("id", F.col("status").alias("after")), "id").select(F.col("id").alias("c_custkey"), "status", "after")


@query(
    """SELECT coalesce(a.c_custkey, 0) AS id, CASE WHEN a.c_custkey % 5 = 0 THEN 'X' ELSE a.c_name END AS name, a.c_nationkey AS nation FROM customer a
    UNION ALL SELECT c_custkey + 10000000, 'X', NULL FROM customer WHERE c_custkey % 7 = 0"""
)
def merged_users(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    changes = c.where("id % 5 = 0").select("id", F.lit("X").alias("name")).union(c.where("id % 7 = 0").select(F.col("id") + 10_000_000, F.lit("X")))
    return analytics.merge_users(c, changes)


@query(
    """SELECT l_orderkey AS doc_id, l_linenumber AS local_idx, count(*) AS n, max(p) AS parent FROM lineitem LEFT JOIN (SELECT l_orderkey AS k, l_linenumber AS pi, max(l_orderkey || '_' || l_linenumber) AS p FROM lineitem GROUP BY 1, 2)
    ON k = l_orderkey AND pi = l_linenumber - 1 GROUP BY 1, 2"""
)
def parent_links(spark, sf_dir):
    name = F.concat_ws("_", "l_orderkey", "l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("local_idx"), (F.col("l_linenumber") - 1).alias("parent_idx"), F.col("l_linenumber").alias("chunk_seq"), name.alias("chunk_id"))
    return dedup.parent_links(rows).groupBy("doc_id", "local_idx").agg(F.count("*").alias("n"), F.max("parent_chunk_id").alias("parent"))


@query(
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'download_failed' WHEN o_totalprice > 200000 THEN 'too_large' WHEN o_orderkey % 13 = 0 THEN 'duplicate'
        WHEN o_orderkey % 3 = 0 THEN 'type_not_allowed' END AS reason FROM orders) SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM o GROUP BY 1"""
)
def sync_reasons(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    entries = o.select((F.col("o_orderkey") % 11 != 0).alias("download_success"), F.concat(F.lit("/data/"), F.col("o_orderkey")).alias("path"), F.lit(True).alias("exists"), F.when(F.col("o_orderkey") % 3 == 0, ".pdf").otherwise(".txt").alias("extension"), F.col("o_totalprice").alias("size_bytes"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    seen = o.where("o_orderkey % 13 = 0").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    out = dedup.sync_rejections(entries, seen, "/data", ["text/plain"], 200_000)
    return out.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS job_id, list(o_orderpriority ORDER BY o_orderkey) AS tail FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3) GROUP BY 1")
def job_log_tail(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("line"))
    return jobs.log_tail(o, n=3)


@query("SELECT o_orderkey, o_custkey AS docs, o_orderkey % 100 AS chunks, 7 AS inserted, NULL::BIGINT AS skipped FROM orders")
def job_summaries(spark, sf_dir):
    line = F.concat(F.lit("done docs="), F.col("o_custkey"), F.lit(" chunks="), F.col("o_orderkey") % 100, F.lit(" inserted=7"))
    s = jobs.parsed_summary(line)
    return read(spark, sf_dir, "orders").select("o_orderkey", *(s[c].alias(c) for c in ("docs", "chunks", "inserted", "skipped")))


@query(
    """WITH p AS (SELECT o_custkey, (o_orderkey % 5) || '.' || (o_orderkey % 3) AS prefix, o_orderkey FROM orders), d AS (SELECT o_custkey, prefix, min(o_orderkey) AS k FROM p GROUP BY ALL)
    SELECT o_custkey, CASE WHEN count(*) > 1 THEN arg_min(prefix, k) || '-' || arg_max(prefix, k) ELSE min(prefix) END AS section_range FROM d GROUP BY 1"""
)
def section_ranges(spark, sf_dir):
    p = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.col("o_orderkey") % 5, F.lit("."), F.col("o_orderkey") % 3).alias("prefix"))
    return jobs.section_ranges(p, ["o_custkey"], "o_orderkey")


@query(
    """WITH l AS (SELECT source AS doc_id, doc_id AS page, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY 1),
    c AS (SELECT doc_id, line, count(DISTINCT page) AS k FROM (SELECT doc_id, page, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM l) WHERE line <> '' AND NOT regexp_matches(line, '^\\d+[.)]\\s') GROUP BY ALL)
    SELECT doc_id, line FROM c JOIN n USING (doc_id) WHERE pages >= 2 AND k / pages >= 0.02""".replace("\\\\", "\\")
)
def repeated_page_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("line"))
    return chunking.repeated_page_lines(d, 0.02)


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(source, '(?i)src1') OR regexp_matches(source, 'src10')")
def admin_filter(spark, sf_dir):
    return chunking.admin_sections(read(spark, sf_dir, "documents"), "source", ["SRC1"], ["src10"]).select("doc_id")


@query()
def structured_docx(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("item_idx"), "text")
    return structured.chunk_docx(d, 512)


@query()
def structured_pdf(spark, sf_dir):
    """Documents as files of pages of 1,500 characters."""
    pages = F.posexplode(chunking.chunk_chars(F.col("text"), 1500, 0)).alias("item_idx", "text")
    d = read(spark, sf_dir, "documents").select("doc_id", pages).select("doc_id", "item_idx", "text", (F.col("item_idx") + 1).alias("page"))
    return structured.chunk_pdf(d, 512)


def _outline_items(spark, sf_dir):
    """The lines of documents as items of a word processor; headings by line number, and
    none of level 1 in every fifth document."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("item_idx", "text"))
    n = F.col("item_idx") % 8
    level = F.when((n == 0) & (F.col("doc_id") % 5 != 0), 1).when(n == 2, 2).when(n == 5, (F.col("doc_id") % 3 + 2).cast("int")).when(n == 3, 3)
    return lines.withColumn("heading_level", level).withColumn("section_heading", F.when(level.isNotNull(), F.substring("text", 1, 60)))


_OUTLINE = r"""
    WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
    h AS (SELECT *, regexp_replace(line[1:60], '^\s+|\s+$', '', 'g') AS title,
                 CASE WHEN regexp_full_match(line[1:60], '\s*') THEN NULL WHEN i % 8 = 0 AND doc_id % 5 <> 0 THEN 1 WHEN i % 8 = 2 THEN 2 WHEN i % 8 = 5 THEN doc_id % 3 + 2 WHEN i % 8 = 3 THEN 3 END AS level FROM l),
    p AS (SELECT *, count(*) FILTER (level = 1) OVER (PARTITION BY doc_id ORDER BY i) AS proc, coalesce(bool_or(level = 1) OVER (PARTITION BY doc_id), FALSE) AS styled FROM h),
    s AS (SELECT *, proc > 0 AND level > 1 AND level <= coalesce(min(CASE WHEN level > 1 THEN level END) OVER (PARTITION BY doc_id, proc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 99) AS starts FROM p),
    n AS (SELECT *, CASE WHEN bool_or(starts) OVER (PARTITION BY doc_id, proc) THEN greatest(count(*) FILTER (starts) OVER (PARTITION BY doc_id, proc ORDER BY i), 1) ELSE 0 END AS sec,
                 min(title) FILTER (level = 1) OVER (PARTITION BY doc_id, proc) AS procedure_title FROM s),
    g AS (SELECT doc_id, proc, sec, any_value(styled) AS styled, any_value(procedure_title) AS procedure_title, min(title) FILTER (starts) AS own,
                 regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line <> '' AND NOT coalesce(starts, FALSE) AND level IS DISTINCT FROM 1), ''), '\s+$', '') AS body FROM n GROUP BY doc_id, proc, sec),
    t AS (SELECT *, coalesce(own, procedure_title) AS section_title, CASE WHEN own IS NULL THEN '' ELSE ' | ' || own END AS below,
                 nullif(regexp_extract(procedure_title, '^\s*(\d+)(?:\b|[.)-])', 1), '') AS procedure_number FROM g),
    x AS (SELECT *, CASE WHEN proc = 0 THEN regexp_replace(body, '^\s+', '') ELSE 'Procedure' || coalesce(' ' || procedure_number, '') || ': ' || section_title || chr(10) || 'Section: ' || section_title || chr(10)
                 || 'Path: ' || procedure_title || below || CASE WHEN body = '' THEN '' ELSE chr(10) || body END END AS text FROM t)
    SELECT doc_id, proc, CAST(sec AS BIGINT) AS sec, CASE WHEN styled THEN 'NUM_PREFIX_MAJOR' ELSE 'HEADING1' END AS strategy, procedure_title, procedure_number,
           CASE WHEN proc > 0 THEN section_title END AS section_title, procedure_title || below AS path, sha256(text) AS text_sha256
    FROM x WHERE len(list_filter(string_split(text, chr(10)), lambda v: NOT regexp_full_match(v, '\s*'))) > 1"""


@query(_OUTLINE)
def section_outline(spark, sf_dir):
    found = sections.outlined(_outline_items(spark, sf_dir))
    return found.select("doc_id", "proc", F.col("sec").cast("long").alias("sec"), "strategy", "procedure_title", "procedure_number", "section_title", F.array_join("heading_path", " | ").alias("path"), F.sha2("text", 256).alias("text_sha256"))


@query()
def section_chunks(spark, sf_dir):
    return sections.chunk_sections(_outline_items(spark, sf_dir), 512)


@query("SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g').replace('&nbsp;', ' ').replace('&lt;', '<').replace('&gt;', '>').replace('&quot;', chr(34)).replace('&#39;', chr(39)).replace('&amp;', '&'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))) AS visible FROM pages".replace("\\\\", "\\"))
def html_visible_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(loaders.html_text(F.col("html")), 256).alias("visible"))
