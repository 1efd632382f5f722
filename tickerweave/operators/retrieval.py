"""Pages and documents to chunks and vectors, and exact inner-product search."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerweave.functions.text import collapse, normal_url, valid_url, words
from tickerweave.sources.store import stored

# Fixed values.
CHUNK_WORDS = 512
CHUNK_OVERLAP = 64
MIN_PAGE_CHARS = 200
TOP_K = 5
NOISE_TAGS = [
    "script",
    "style",
    "nav",
    "footer",
    "header",
    "aside",
    "form",
    "table",
    "sup",
    "figure",
    "figcaption",
    "iframe",
    "noscript",
    "button",
    "input",
    "select",
    "textarea",
]
_CONTENT_NAMES = ("content", "article", "story", "body", "post")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _PageText(HTMLParser):
    """Collects the title and the text of the first container of each kind in one pass."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str | None]] = []
        self.noise = 0
        self.title: list[str] = []
        self.h1: list[str] = []
        self.text: dict[str, list[str]] = {}
        self.seen: set[str] = set()

    def _kind(self, tag, attrs):
        if tag in ("h1", "title"):  # headings count wherever they stand
            return tag
        if self.noise:
            return None
        if tag in ("article", "main", "body"):
            return tag
        if tag == "div":
            a = dict(attrs)
            if any(n in (a.get("id") or "").lower() for n in _CONTENT_NAMES):
                return "div_id"
            if any(n in (a.get("class") or "").lower() for n in _CONTENT_NAMES):
                return "div_class"
        return None

    def handle_starttag(self, tag, attrs):
        kind = self._kind(tag, attrs)
        if kind in self.seen:
            kind = None
        if kind:
            self.seen.add(kind)
        if tag in _VOID:
            return
        if tag in NOISE_TAGS:
            self.noise += 1
        self.stack.append((tag, kind))

    def handle_endtag(self, tag):
        if tag not in (t for t, _ in self.stack):
            return
        while self.stack:
            t, _ = self.stack.pop()
            if t in NOISE_TAGS:
                self.noise -= 1
            if t == tag:
                return

    def handle_data(self, data):
        piece = data.strip()
        if not piece:
            return
        kinds = {k for _, k in self.stack if k}
        if "title" in kinds:
            self.title.append(piece)
        if "h1" in kinds:
            self.h1.append(piece)
        if self.noise:
            return
        for k in kinds:
            self.text.setdefault(k, []).append(piece)
        if not any(t == "head" for t, _ in self.stack):
            self.text.setdefault("all", []).append(piece)


def page_text(html: str) -> tuple[str, str]:
    """(title, main text) of one page."""
    p = _PageText()
    p.feed(html or "")
    p.close()
    order = [k for k in ("article", "main", "div_id", "div_class", "body") if k in p.seen] or ["all"]
    body = " ".join(" ".join(p.text.get(order[0], [])).split())
    return " ".join(p.title) or "".join(p.h1), body


def extract_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Title, text and status of each page; bad URLs and pages under 200 characters are marked."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            got = [page_text(h) for h in f["html"]]
            yield pd.DataFrame({key: f[key], "url": f["url"], "title": [t for t, _ in got], "text": [b for _, b in got]})

    out = pages.select(key, "url", "html").mapInPandas(run, f"{key} {kind}, url string, title string, text string")
    status = F.when(~valid_url("url"), "bad_url").when(F.length("text") < MIN_PAGE_CHARS, "too_short").otherwise("ok")
    return out.withColumn("status", status)


def new_pages(pages: DataFrame, ingested: DataFrame) -> DataFrame:
    """Pages whose normalised URL is not in the registry yet."""
    seen = ingested.select(normal_url("url").alias("__u"))
    return pages.withColumn("__u", normal_url("url")).join(seen, "__u", "left_anti").drop("__u")


def chunk(docs: DataFrame, text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping word chunks of whole texts; a text without words has none."""
    step = max(1, size - overlap)
    keep = [c for c in docs.columns if c != text]
    df = docs.withColumn("__w", words(text)).filter(F.size("__w") > 0)
    starts = F.sequence(F.lit(0), F.size("__w") - 1, F.lit(step))
    df = df.select(*keep, "__w", F.posexplode(starts).alias("chunk_index", "word_start"))
    return df.select(*keep, "chunk_index", "word_start", F.array_join(F.slice("__w", F.col("word_start") + 1, F.lit(size)), " ").alias("content"))


def embed(chunks: DataFrame, text: str = "content", dim: int = 384, encoder=None) -> DataFrame:
    """Adds a unit-length `embedding` (array of float).

    By default hashed word counts, computed in the JVM. `encoder` (a list of
    texts to a 2-d array) replaces it and is called per Arrow batch.
    """
    if encoder is None:
        df = chunks.withColumn("__w", words(F.lower(text)))
        df = HashingTF(numFeatures=dim, inputCol="__w", outputCol="__tf").transform(df)
        df = Normalizer(p=2.0, inputCol="__tf", outputCol="__n").transform(df)
        return df.withColumn("embedding", vector_to_array("__n", "float32")).drop("__w", "__tf", "__n")

    def run(frames):
        for f in frames:
            v = np.asarray(encoder(list(f[text])), dtype=np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield f.assign(embedding=list(v / np.where(norm == 0, 1, norm)))

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in chunks.schema) + ", embedding array<float>"
    return chunks.mapInPandas(run, schema)


def search(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, block_rows: int = 50_000, query_rows: int = 2_000) -> DataFrame:
    """Exact top-k by inner product: queries(query_id, vector), vectors(vec_id, embedding).

    Both sides are cut into blocks of bounded size by a hash of their id; each
    pair of blocks is one small matrix product that returns k rows per query,
    and the final rank sees k rows per query and block only.
    """
    n_blocks = max(1, -(-vectors.count() // block_rows))
    q_blocks = max(1, -(-queries.count() // query_rows))
    ids = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("vb"))
    v = v.withColumn("qb", ids(q_blocks))
    q = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("qb"))
    q = q.withColumn("vb", ids(n_blocks))

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        s = np.stack(right["vector"]).astype(float) @ np.stack(left["embedding"]).astype(float).T
        ids_ = left["vec_id"].to_numpy()
        frames = []
        for row, qid in zip(s, right["query_id"]):
            order = np.lexsort((ids_, -np.round(row, 9)))[:k]
            frames.append(pd.DataFrame({"query_id": qid, "vec_id": ids_[order], "score": row[order]}))
        return pd.concat(frames)

    qt, vt = q.schema["query_id"].dataType.simpleString(), v.schema["vec_id"].dataType.simpleString()
    hits = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInPandas(
        product, f"query_id {qt}, vec_id {vt}, score double"
    )
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hit_views(hits: DataFrame, chunks: DataFrame, width: int = 300) -> DataFrame:
    """(query_id, rank, vec_id, score, content) with the content cut to its first `width` characters, as agents show
    hits (300) and chats cite them (200)."""
    df = hits.join(chunks.select("vec_id", "content"), "vec_id")
    return df.select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"), F.substring("content", 1, width).alias("content"))


def append_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Adds chunks with their vectors to the table at path, but for pages whose URL is stored already.

    The table is its own URL registry: it is partitioned by a hash of the normalised URL, and a batch reads only the
    URLs of the partitions it touches. Repeating a batch adds nothing.
    """
    spark = chunks.sparkSession
    new = chunks.withColumn("page", normal_url("url")).withColumn("bucket", F.pmod(F.xxhash64("page"), F.lit(buckets)).cast("int"))
    old = stored(spark, path, new.schema, ("bucket",))
    if old is not None:
        touched = old.join(new.select("bucket").distinct(), "bucket", "left_semi").select("page").distinct()
        new = new.join(touched, "page", "left_anti").select(*new.columns)
    new.write.mode("append").partitionBy("bucket").parquet(path)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("page", "bucket")


def context_block(hits: DataFrame, chunks: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Numbered context text per query from its hits; chunks(vec_id, content, source, title).

    With queries(query_id), one without hits has a row too, which says so.
    """
    df = hits.join(chunks, "vec_id")
    label = F.when(F.coalesce("title", F.lit("")) != "", F.concat("title", F.lit(" ("), "source", F.lit(")"))).otherwise(F.col("source"))
    part = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] (source: "), label, F.lit(", score: "),
        F.format_string("%.4f", F.round("score", 4)), F.lit(")\n"), "content", F.lit("\n"),
    )
    parts = F.sort_array(F.collect_list(F.struct("rank", part.alias("p"))))
    out = df.groupBy("query_id").agg(parts.alias("s"))
    # Fixed value: output text of the contract.
    text = F.concat(F.lit("Relevant financial context:\n\n"), F.array_join(F.col("s.p"), "\n"))
    out = out.select("query_id", text.alias("context"))
    if queries is None:
        return out
    # Fixed value: output text of the contract.
    none = F.lit("No relevant context found.")
    return queries.select("query_id").distinct().join(out, "query_id", "left").select("query_id", F.coalesce("context", none).alias("context"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text and JSON files as documents: a JSON list gives one per element, anything else one per file."""
    raw = spark.read.text(path, wholetext=True).withColumn("source", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))
    return json_documents(raw, F.col("source").endswith(".json"))


def json_documents(raw: DataFrame, is_json) -> DataFrame:
    """raw(value, source): elements of a JSON list as single documents."""
    items = F.from_json("value", "array<string>")
    is_list = is_json & F.ltrim("value").startswith("[") & items.isNotNull()
    docs = F.when(is_list, items).otherwise(F.array("value"))
    return raw.select("source", F.posexplode(docs).alias("part", "text"))
