"""Registered queries of the subpackage and the SQL that repeats them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerweave.llm import (byte_bpe, centroids, decontaminate, filter_audit, labelled, language_model, line_dedup, near_dup, perplexity,
                             quality, token_counts, toxicity, vector_dup, warc)

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_sha256(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


_OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY k.doc_id
"""


@query("op1_line_dedup", _OP1_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", hex_sha256(F.col("text")).alias("kept_sha256"))


@query("op2_language_model")
def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = labelled.fold("doc_id", 7) == 2
    out = language_model.score_documents(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, s, iw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query("op3_benchmark_decontamination", _OP3_SQL)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), size=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.encode_texts(docs, keep_text=False, back=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), hex_sha256(F.col("ids_text")).alias("ids_sha256"),
                      F.sha2("ids_bytes", 256).alias("decoded_sha256"))


_OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), b32 AS (
  SELECT page_id, body, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::INTEGER >> (15 - 5 * (k % 4))) & 31), 1), '' ORDER BY k)
    FROM range(32) t(k)) AS digest FROM p
), best AS (SELECT digest, max(page_id) AS top FROM b32 GROUP BY digest)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b32 JOIN best USING (digest)
"""


@query("op5_warc", _OP5_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    records = warc.read_archives(spark, folder).filter(F.col("kind").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("long")
    return records.select(page(F.col("record_id")).alias("page_id"), F.col("payload_bytes"), F.col("payload_digest"),
                          F.col("kind").alias("record_type"), page(F.col("refers_to")).alias("refers_to"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = labelled.fold("doc_id", 5) == 0
    net = quality.learn(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.score_quality(docs, net, threshold=0.3).select("doc_id", held.alias("held_out"), "score", "predicted")


_OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT link.b, reach.c FROM reach JOIN link ON reach.a = link.a WHERE reach.c < link.b
), low AS (SELECT a, min(c) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, c = vec_id AS kept
FROM embeddings JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


@query("op7_embedding_near_dedup", _OP7_SQL)
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = labelled.fold("doc_id", 3) == 1
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held, threshold=0.7)
    return toxicity.score_toxicity(docs, machine, threshold=0.7).select("doc_id", held.alias("held_out"), "score", "predicted")


_OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pairs JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT link.b, reach.c FROM reach JOIN link ON reach.a = link.a WHERE reach.c < link.b
), low AS (SELECT a, min(c) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN low ON low.a = d.doc_id
"""


@query("op9_near_duplicates", _OP9_SQL)
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs, size=5, percent=75, permutations=64)


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs)


def _op11_sql(k: int, rounds: int, salt: int) -> str:
    """One nearest-centroid step per round; distances are sums of whole numbers below 2^53, hence exact as doubles."""
    steps = [f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) - 1 AS c, x FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) <= {k}
)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(v.x) AS x, min(CAST(list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, q.x)
    + list_inner_product(q.x, q.x) AS BIGINT) * 64 + c) AS best FROM v, c{r} q GROUP BY vec_id
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT c, list(m ORDER BY i) AS x FROM (
    SELECT best % 64 AS c, i, floor(sum(e) / count(*)) AS m FROM (SELECT best, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY ALL
  ) GROUP BY c
), c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m{r}.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} ON o.c = m{r}.c)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, CAST(best % 64 AS INTEGER) AS cluster, best // 64 AS distance,
       CAST(sum(best // 64) OVER (PARTITION BY best % 64) AS BIGINT) AS cluster_inertia, CAST(sum(best // 64) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(q.x, lambda e: CAST(e AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} q ON best % 64 = q.c
"""


@query("op11_centroid_clustering", _op11_sql(40, 5, 2))
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, salt="2")


@query("op12_quality_rules")
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perplexity.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), low=10.0, high=5.0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity",
                      "lower", "upper")


_OP13_SQL = r"""
WITH w AS (
  SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), f AS (
  SELECT part, doc_id, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > first, false) AS INTEGER) AS fails FROM w
), g AS (
  SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL
), p AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM range(5) a(i), range(5) b(i), range(5) c(i), range(5) d(i), range(5) e(i)
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT list_reduce(list_transform(p, lambda i: chr(CAST(65 + i AS INTEGER))), lambda x, y: x || y) AS filter_order, step, 1 << p[step] AS bit,
         list_sum(list_transform(p[:step], lambda i: 1 << i)) - (1 << p[step]) AS before
  FROM (SELECT p, unnest(range(1, 6)) AS step FROM p)
), r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN fails & CAST(before + bit AS BIGINT) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails & CAST(before AS BIGINT) = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails & CAST(before AS BIGINT) > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails & CAST(before AS BIGINT) = 0 AND fails & bit > 0 AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails & CAST(before AS BIGINT) = 0 AND fails & bit > 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


@query("op13_filter_audit", _OP13_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
