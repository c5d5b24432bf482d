"""Registry of the engine's named queries over the standard tables, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.predicates import matches
from tessera.functions.vectors import cosine
from tessera.operators import chunk, degrade, dense, fuse, keyword, rerank, retrieve, store, tasks
from tessera.sources import formats

_QUERIES: dict = {}
_ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_ORACLE)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows(spark, d) -> DataFrame:
    """Stored rows: id, text, embedding, lang, source, toxic (null where there is no label)."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang", "source")
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "toxic")
    return read(spark, d, "embeddings").join(docs, "vec_id").join(labels, "vec_id", "left").withColumn("id", F.col("vec_id").cast("string"))


def vector_queries(spark, d, where: str) -> DataFrame:
    return read(spark, d, "embeddings").where(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def plain(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")


def documents(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang", "source")


def text_queries(spark, d, where: str) -> DataFrame:
    return read(spark, d, "benchmark").where(where).select(F.col("item_id").alias("query_id"), "text")


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _dense_sql(queries: str, rows: str, k: int) -> str:
    return f"""WITH q AS ({queries}), r AS ({rows}),
s AS (SELECT query_id, id, round(CASE WHEN list_dot_product(a, a) = 0 OR list_dot_product(b, b) = 0 THEN 0.0
  ELSE list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END, 9) AS score
  FROM q, r),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= {k}"""


def _q(where: str) -> str:
    return f"SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE {where}"


_ROWS = "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings"


def _joined(where: str) -> str:
    return f"SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings JOIN documents d ON vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE {where}"


@query(_dense_sql(_q("vec_id = 0"), _ROWS, 10))
def dense_topk(spark, d):
    return shown(dense.dense_topk(plain(spark, d), vector_queries(spark, d, "vec_id = 0"), 10))


@query(_dense_sql(_q("vec_id < 10"), _ROWS, 10))
def dense_topk_batch(spark, d):
    return shown(dense.dense_topk(plain(spark, d), vector_queries(spark, d, "vec_id < 10"), 10))


@query(_dense_sql("SELECT 0::BIGINT AS query_id, [0.0::DOUBLE for x in range(64)] AS a", _ROWS, 5))
def dense_zero_vector(spark, d):
    zero = spark.range(1).select(F.col("id").alias("query_id"), F.array_repeat(F.lit(0.0), 64).alias("vector"))
    return shown(dense.dense_topk(plain(spark, d), zero, 5))


def _filtered(spark, d, given):
    r = rows(spark, d)
    return shown(dense.dense_topk(r, vector_queries(spark, d, "vec_id < 5"), 10, matches(given, {c: r[c] for c in ("lang", "source", "toxic")})))


@query(_dense_sql(_q("vec_id < 5"), _joined("lang = 'de'"), 10))
def dense_filter_eq(spark, d):
    return _filtered(spark, d, {"lang": "de"})


@query(_dense_sql(_q("vec_id < 5"), _joined("lang IN ('de', 'fr')"), 10))
def dense_filter_in(spark, d):
    return _filtered(spark, d, {"lang": ["de", "fr"]})


@query(_dense_sql(_q("vec_id < 5"), _joined("lang = 'en' AND source IN ('src1', 'src2')"), 10))
def dense_filter_and(spark, d):
    return _filtered(spark, d, {"lang": "en", "source": ["src1", "src2"]})


@query(_dense_sql(_q("vec_id < 5"), _joined("toxic IS NULL OR toxic = 1"), 10))
def dense_filter_missing_key(spark, d):
    return _filtered(spark, d, {"toxic": [None, 1]})


@query(_dense_sql(_q("vec_id < 5"), _joined("false"), 10))
def dense_filter_empty_list(spark, d):
    return _filtered(spark, d, {"lang": []})


@query("SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 1")
def cosine_scalar(spark, d):
    e, q = read(spark, d, "embeddings"), read(spark, d, "embeddings").where("vec_id = 1").select(F.col("embedding").alias("v"))
    return e.join(F.broadcast(q)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("v")), 6).alias("similarity"))


_TOK = r"[lower(x) for x in regexp_extract_all(text, '[A-Za-z0-9_]+|[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]')]"
_POST = f"tok AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_TOK} AS t FROM documents), post AS (SELECT id, len(t) AS len, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM tok) GROUP BY ALL), st AS (SELECT count(*) AS n, CASE WHEN avg(len(t)) > 0 THEN avg(len(t)) ELSE 1.0 END AS avgdl FROM tok)"


@query(f"WITH {_POST} SELECT id, term, tf FROM post")
def tokenize_counts(spark, d):
    return keyword.index(documents(spark, d)).postings.select("id", "term", "tf")


@query(f"WITH {_POST} SELECT term, count(*) AS df FROM post GROUP BY term")
def doc_freq(spark, d):
    return keyword.index(documents(spark, d)).frequencies()


@query(f"WITH {_POST} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, d):
    return keyword.index(documents(spark, d)).stats().select("n", F.round("avgdl", 6).alias("avgdl"))


def _bm25_sql(where: str, k: int, keep: str = "true") -> str:
    return f"""{_POST}, q AS (SELECT DISTINCT query_id, unnest(t) AS term FROM (SELECT item_id AS query_id, {_TOK} AS t FROM benchmark WHERE {where})),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bs AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score
 FROM q JOIN post USING (term) JOIN df USING (term), st GROUP BY query_id, id),
bk AS (SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bs WHERE score > 0 AND id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE {keep})),
keyword AS (SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM bk WHERE rank <= {k})"""


@query("WITH " + _bm25_sql("item_id = 0", 10) + " SELECT query_id, id, round(score, 6) AS score, rank FROM keyword")
def bm25_topk(spark, d):
    return shown(keyword.keyword_topk(documents(spark, d), text_queries(spark, d, "item_id = 0"), 10))


@query("WITH " + _bm25_sql("item_id < 5", 10, "lang = 'en'") + " SELECT query_id, id, round(score, 6) AS score, rank FROM keyword")
def bm25_filter_after_score(spark, d):
    return shown(keyword.keyword_topk(documents(spark, d), text_queries(spark, d, "item_id < 5"), 10, F.col("lang") == "en"))


@query("WITH " + _bm25_sql("true", 10) + " SELECT query_id, id, round(score, 6) AS score, rank FROM keyword")
def bm25_multi_query(spark, d):
    return shown(keyword.keyword_topk(documents(spark, d), text_queries(spark, d, "true"), 10))


_VEC = f"vector AS ({_dense_sql('SELECT b.item_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM benchmark b JOIN embeddings ON vec_id = b.item_id WHERE b.item_id < 8', 'SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings JOIN documents ON vec_id = doc_id', 20).replace('round(score, 6) AS score', 'score')})"
_FUSED = """f AS (SELECT query_id, id, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0) AS fusion_score, v.rank AS vector_rank, k.rank AS keyword_rank, v.score AS vector_score, k.score AS keyword_score
 FROM vector v FULL JOIN keyword k USING (query_id, id)), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion_score, 12) DESC, id) AS rank FROM f)"""
_BM_EMB = _bm25_sql("item_id < 8", 20).replace("FROM documents),", "FROM documents JOIN embeddings ON vec_id = doc_id),", 1)


def _hybrid(spark, d, k):
    r = rows(spark, d).select("id", "text", "embedding")
    q = text_queries(spark, d, "item_id < 8").join(vector_queries(spark, d, "vec_id < 8"), "query_id")
    return retrieve.retrieve(r, q, "hybrid", k)[0]


@query(f"WITH {_BM_EMB}, {_VEC}, {_FUSED} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(fusion_score, 9) AS fusion_score, vector_rank, keyword_rank, round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score FROM g WHERE rank <= 5")
def hybrid_topk(spark, d):
    return _hybrid(spark, d, 5).select("query_id", "rank", "id", F.round("fusion_score", 9).alias("fusion_score"), "vector_rank", "keyword_rank", F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 6).alias("keyword_score"))


_CH = "c AS (SELECT CAST(doc_id % 7 AS BIGINT) AS query_id, CAST(doc_id AS VARCHAR) AS id, n_chars, doc_id FROM documents), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, id) AS rank FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_chars, id) AS rank FROM c)"


@query(f"WITH {_CH}, f AS (SELECT query_id, id, coalesce(1.0::DOUBLE / (60 + x.rank), 0) + coalesce(1.0::DOUBLE / (60 + y.rank), 0) AS s, x.rank AS xr, y.rank AS yr FROM (SELECT * FROM a WHERE rank <= 15) x FULL JOIN (SELECT * FROM b WHERE rank <= 15) y USING (query_id, id)), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank FROM f) SELECT query_id, id, round(s, 9) AS fusion_score, CAST(xr AS INTEGER) AS long_rank, CAST(yr AS INTEGER) AS short_rank, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 20")
def rrf_fuse(spark, d):
    c = read(spark, d, "documents").select((F.col("doc_id") % 7).alias("query_id"), F.col("doc_id").cast("string").alias("id"), F.col("n_chars").cast("double").alias("score"))
    top = lambda o: c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(o, "id"))).where("rank <= 15")
    out = fuse.fuse({"long": top(F.desc("score")), "short": top(F.asc("score"))}, 20)
    return out.select("query_id", "id", F.round("fusion_score", 9).alias("fusion_score"), "long_rank", "short_rank", "rank")


@query("SELECT lang, count(*) AS n FROM documents WHERE source IN ('src1', 'src2') GROUP BY lang")
def count_by_filter(spark, d):
    docs = read(spark, d, "documents")
    return docs.where(matches({"source": ["src1", "src2"]}, {"source": docs["source"]})).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_by_ids(spark, d):
    return store.remaining(read(spark, d, "documents"), None, read(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE NOT (lang = 'de' AND doc_id IN (SELECT doc_id FROM labels))")
def delete_by_filter(spark, d):
    return store.remaining(read(spark, d, "documents"), F.col("lang") == "de", read(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("WITH b AS (SELECT doc_id % 50 AS doc_id, text, doc_id AS pos FROM documents), n AS (SELECT doc_id, arg_max(text, pos) AS text FROM b GROUP BY doc_id) SELECT doc_id, md5(text) AS digest FROM (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n)")
def upsert_last_wins(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    batch = docs.select((F.col("doc_id") % 50).alias("doc_id"), "text", F.col("doc_id").alias("pos"))
    return store.upserted(docs, batch, "doc_id", "pos").select("doc_id", F.md5(F.col("text")).alias("digest"))


@query("SELECT conv_id, turn FROM conversations WHERE turn < 2")
def stale_tail(spark, d):
    turns = read(spark, d, "conversations").select("conv_id", "turn")
    return turns.where(~(F.col("turn") >= 2))


@query("SELECT CAST(doc_id AS VARCHAR) AS source_id, sha256(CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR)) AS id, CAST(i AS INTEGER) AS chunk_index, CAST(ceil(length(text) / 400.0) AS INTEGER) AS total_chunks FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 400.0) AS BIGINT))) AS i FROM documents)")
def chunk_ids(spark, d):
    cut = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), chunk.slices(F.col("text"), 400).alias("c"))
    each = cut.select("source_id", F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "t"))
    return each.select("source_id", T.chunk_id(F.col("source_id"), F.col("chunk_index")).alias("id"), "chunk_index", "total_chunks")


@query("SELECT doc_id, CAST(i AS INTEGER) AS i, substring(text, CAST(i * 1000 + 1 AS BIGINT), 1000) AS piece FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents)")
def char_slices(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(chunk.slices(F.col("text"), 1000)).alias("i", "piece"))


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) > 0")
def line_chunks(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(chunk.lines(F.col("text"))).alias("line"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE length(trim(text)) > 0")
def chunk_reconstruct(spark, d):
    """Chunks without overlap, joined again."""
    cut = chunk.splitter_udf(chunk.Splitter(800, 0))
    return read(spark, d, "documents").select("doc_id", cut("text").alias("c")).where(F.size("c") > 0).select("doc_id", F.sha2(F.array_join("c", ""), 256).alias("digest"))


@query("SELECT page_id, true AS fits, true AS filled FROM pages WHERE length(trim(html)) > 0")
def chunk_maxlen(spark, d):
    cut = chunk.splitter_udf(chunk.CHUNKERS["html"])
    c = read(spark, d, "pages").select("page_id", cut("html").alias("c")).where(F.size("c") > 0)
    return c.select("page_id", F.forall("c", lambda x: F.length(x) <= 1500).alias("fits"), F.forall("c", lambda x: F.length(x) > 0).alias("filled"))


@query(r"""SELECT doc_id, md5(rtrim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(replace(text, chr(160), ' ')), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+', ''), chr(10))) AS digest FROM documents WHERE text NOT LIKE '%```%' AND text NOT LIKE '%~~~%' AND text NOT LIKE '%' || chr(13) || '%'""")
def normalize_simple(spark, d):
    free = ~(F.col("text").contains("```") | F.col("text").contains("~~~") | F.col("text").contains("\r"))
    return read(spark, d, "documents").where(free).select("doc_id", F.md5(T.normalize_markdown("text")).alias("digest"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN 'url' ELSE 'local' END AS source_type, sha256(url) AS source_id FROM pages")
def source_classify(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", formats.source_type(u).alias("source_type"), formats.source_id(u).alias("source_id"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, d):
    p = lambda part: F.parse_url("url", F.lit(part))
    return read(spark, d, "pages").select("page_id", p("PROTOCOL").alias("scheme"), p("HOST").alias("host"), F.coalesce(p("PATH"), F.lit("")).alias("path"))


_EXT = "list_value('txt','pdf','csv','json','py','pptx','exe')[CAST(doc_id % 7 + 1 AS BIGINT)]"


@query(f"SELECT doc_id, {_EXT} AS extension, CASE {_EXT} WHEN 'txt' THEN 'prose' WHEN 'pdf' THEN 'mixed' WHEN 'csv' THEN 'tabular' WHEN 'json' THEN 'structured' WHEN 'py' THEN 'code' WHEN 'pptx' THEN 'slide' END AS structure, CASE {_EXT} WHEN 'txt' THEN 'whole' WHEN 'pdf' THEN 'by_chunk' WHEN 'csv' THEN 'by_row' WHEN 'json' THEN 'by_node' WHEN 'py' THEN 'whole' WHEN 'pptx' THEN 'by_page' END AS default_granularity FROM documents")
def format_lookup(spark, d):
    ext = F.get(F.array(*map(F.lit, ("TXT", ".pdf", "csv", " json", "py", "pptx", "exe"))), (F.col("doc_id") % 7).cast("int"))
    docs = read(spark, d, "documents").select("doc_id", T.normalize_extension(ext).alias("extension"))
    return docs.join(F.broadcast(formats.format_table(spark).drop("granularities")), "extension", "left").select("doc_id", "extension", "structure", "default_granularity")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'md' WHEN doc_id % 5 = 1 THEN 'pdf' WHEN doc_id % 5 = 2 THEN NULL WHEN doc_id % 5 = 3 THEN 'docx' ELSE 'csv' END AS resolved FROM documents")
def declared_vs_detected(spark, d):
    """Declared md/pdf/docx/docx/csv against detected txt/pdf/pdf/(none)/csv."""
    k = (F.col("doc_id") % 5).cast("int")
    pick = lambda *v: F.get(F.array(*[F.lit(x).cast("string") for x in v]), k)
    return read(spark, d, "documents").select("doc_id", formats.resolved_type(pick("md", "pdf", "docx", "docx", "csv"), pick("txt", "pdf", "pdf", None, "csv")).alias("resolved"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) IN ('example.com', 'example.org') AS admitted FROM pages")
def source_admission(spark, d):
    return read(spark, d, "pages").select("page_id", formats.admitted(F.col("url"), hosts=["example.com", "example.org"]).alias("admitted"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'bucket-' || source END AS bucket, CASE doc_id % 4 WHEN 0 THEN 'a b/' || CAST(doc_id AS VARCHAR) END AS key FROM documents")
def s3_uri(spark, d):
    doc = F.col("doc_id").cast("string")
    made = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("s3://bucket-"), F.col("source"), F.lit("/a%20b/"), doc)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("s3://u:p@b/"), doc)).when(F.col("doc_id") % 4 == 2, F.lit("s3://b")).otherwise(F.concat(F.lit("s3://b/k?x="), doc))
    return read(spark, d, "documents").select("doc_id", formats.s3_parts(made).alias("p")).select("doc_id", "p.bucket", "p.key")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'http' WHEN doc_id % 3 = 1 THEN 's3' ELSE 'local' END AS route FROM documents")
def source_router(spark, d):
    src = F.concat(F.get(F.array(*map(F.lit, ("https://h/", "minio://b/", "/data/"))), (F.col("doc_id") % 3).cast("int")), F.col("doc_id").cast("string"))
    return read(spark, d, "documents").select("doc_id", formats.routed(src, [("http", "^https?://"), ("s3", "^(s3|minio)://"), ("local", "^/")]).alias("route"))


@query("SELECT doc_id, 'kb_' || substring(regexp_replace(source || '/' || lang, '[^A-Za-z0-9_]', '_', 'g'), 1, 32) || '_' || substring(sha256(source || '/' || lang), 1, 12) AS collection FROM documents")
def collection_name(spark, d):
    return read(spark, d, "documents").select("doc_id", store.collection_name(F.concat_ws("/", "source", "lang")).alias("collection"))


@query("SELECT s.source AS kb_id, coalesce(n, 0) AS chunks FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'es' GROUP BY source) c ON s.source = c.source")
def kb_view(spark, d):
    docs = read(spark, d, "documents")
    counts = docs.where("lang = 'es'").groupBy("source").agg(F.count("*").alias("n"))
    return docs.select("source").distinct().join(counts, "source", "left").select(F.col("source").alias("kb_id"), F.coalesce("n", F.lit(0)).alias("chunks"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def event_seq(spark, d):
    return tasks.sequenced(read(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "seq")


@query("SELECT event_id, seq FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq > 3")
def event_after_seq(spark, d):
    return tasks.after(tasks.sequenced(read(spark, d, "events"), "user_id", "ts", "event_id"), 3).select("event_id", "seq")


@query("SELECT user_id, count(*) + 1 AS next_seq FROM events GROUP BY user_id")
def max_sequence(spark, d):
    return tasks.next_sequence(tasks.sequenced(read(spark, d, "events"), "user_id", "ts", "event_id"), "user_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_event(spark, d):
    return tasks.latest(read(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id").select("user_id", "event_type")


@query("SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS duration_us FROM events")
def stage_intervals(spark, d):
    e = tasks.intervals(tasks.sequenced(read(spark, d, "events"), "user_id", "ts", "event_id"), "user_id", "ts")
    return e.select("event_id", (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("duration_us"))


_TASK = "t AS (SELECT user_id AS task_id, arg_max(CASE WHEN event_id % 4 = 0 THEN 'cancelling' WHEN event_id % 4 = 1 THEN 'pending' ELSE 'running' END, event_id) AS status, max(ts) AS heartbeat_at, min(ts) AS started_at, count(*) % 5 AS attempts FROM events GROUP BY user_id)"


def task_table(spark, d) -> DataFrame:
    status = F.when(F.col("event_id") % 4 == 0, "cancelling").when(F.col("event_id") % 4 == 1, "pending").otherwise("running")
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t = e.groupBy(F.col("user_id").alias("task_id")).agg(F.max_by(status, "event_id").alias("status"), F.max("ts").alias("heartbeat_at"), F.min("ts").alias("started_at"), (F.count("*") % 5).alias("attempts"))
    return t.withColumns({"updated_at": F.col("started_at"), "max_attempts": F.lit(3), "kind": F.lit("ingest")})


@query(f"WITH {_TASK}, m AS (SELECT max(ts) AS now FROM events) SELECT task_id, CASE WHEN status = 'cancelling' THEN 'cancelled' WHEN attempts < 3 THEN 'pending' ELSE 'failed' END AS new_status FROM t, m WHERE status IN ('running', 'cancelling') AND heartbeat_at < now - INTERVAL 1 DAY")
def lease_sweep(spark, d):
    now = read(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    t = task_table(spark, d).join(F.broadcast(now))
    return tasks.sweep(t, F.col("now"), 86_400).select("task_id", "new_status")


@query(f"WITH {_TASK} SELECT task_id, status FROM t ORDER BY started_at DESC, task_id LIMIT 20 OFFSET 10")
def task_list_page(spark, d):
    return tasks.page(task_table(spark, d), "started_at", "task_id", 20, 10).select("task_id", "status")


@query(f"WITH {_TASK} SELECT least(count(*), 7) AS backlog FROM t WHERE status = 'pending'")
def backlog(spark, d):
    return tasks.backlog(task_table(spark, d), 7, F.col("status") == "pending")


@query(f"WITH {_TASK} SELECT task_id, attempts FROM t WHERE status = 'running'")
def task_predicates(spark, d):
    return tasks.select_tasks(task_table(spark, d), kind="ingest", status="running").select("task_id", "attempts")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def idempotent_insert(spark, d):
    return tasks.idempotent(read(spark, d, "events"), "user_id", "event_type", first="event_id")


@query(f"WITH {_TASK} SELECT task_id, 5.0 * pow(2.0, attempts - 1) AS delay, CASE WHEN attempts < 3 THEN 'pending' ELSE 'failed' END AS outcome FROM t")
def retry_backoff(spark, d):
    return task_table(spark, d).select("task_id", tasks.retry_delay(F.lit(5.0), F.col("attempts")).alias("delay"), tasks.after_failure(F.lit(True), F.col("attempts"), F.lit(3)).alias("outcome"))


_MOVES = ", ".join(f"('{a}', '{b}')" for a, to in tasks.ALLOWED.items() for b in (*to, a))


@query(f"WITH s AS (SELECT unnest(['pending','running','cancelling','failed','succeeded','cancelled']) AS src), x AS (SELECT a.src AS src, b.src AS dst FROM s a, s b) SELECT src, dst, (src, dst) IN ({_MOVES}) AS allowed FROM x")
def state_machine(spark, d):
    s = spark.createDataFrame([(x,) for x in tasks.ALLOWED], "src string")
    pairs = s.join(F.broadcast(s.withColumnRenamed("src", "dst")))
    return pairs.select("src", "dst", tasks.can_move(F.col("src"), F.col("dst")).alias("allowed"))


_RATE = "r AS (SELECT event_id, CASE WHEN count(*) OVER w < 20 THEN 0.0 ELSE avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) OVER w END AS rate FROM events WINDOW w AS (PARTITION BY user_id % 16 ORDER BY event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))"


def _rates(spark, d) -> DataFrame:
    e = read(spark, d, "events").withColumns({"failed": F.col("event_type") == "error", "service": F.col("user_id") % 16})
    return degrade.failure_rate(e, "event_id", "failed", ("service",))


@query(f"WITH {_RATE} SELECT event_id, round(rate, 6) AS failure_rate FROM r")
def rolling_failure_rate(spark, d):
    return _rates(spark, d).select("event_id", F.round("failure_rate", 6).alias("failure_rate"))


@query(f"WITH {_RATE}, l AS (SELECT event_id, CASE WHEN rate >= 0.8 THEN 3 WHEN rate >= 0.5 THEN 2 WHEN rate >= 0.2 THEN 1 ELSE 0 END AS level FROM r) SELECT event_id, level, CASE WHEN level >= 2 THEN 3 ELSE 7 END AS top_k, level < 1 AS rerank, level < 3 AS writes FROM l")
def degradation_level(spark, d):
    lv = F.col("level")
    r = _rates(spark, d).withColumn("level", degrade.level(F.col("failure_rate")))
    return r.select("event_id", "level", degrade.adjusted_top_k(F.lit(7), lv).alias("top_k"), degrade.allows_rerank(lv).alias("rerank"), degrade.accepts_writes(lv).alias("writes"))


@query()
def hysteresis_level(spark, d):
    r = _rates(spark, d).select("event_id", "service", F.col("ts").cast("timestamp").alias("at"), degrade.level(F.col("failure_rate") * 3).alias("level"))
    return degrade.hysteresis(r, "service", "at")


@query("SELECT event_id, greatest(4 * (event_id % 30 + 1), 20) AS fetch_k FROM events")
def over_fetch(spark, d):
    return read(spark, d, "events").select("event_id", degrade.fetch_k(F.col("event_id") % 30 + 1).alias("fetch_k"))


_REV = f"WITH d AS ({_dense_sql(_q('vec_id < 5'), _ROWS, 10)}) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS INTEGER) AS rank FROM d"


@query(_REV)
def rerank_reverse(spark, d):
    hits = dense_topk_batch(spark, d).where("query_id < 5").withColumn("pos", F.col("rank") - 1).drop("rank")
    return rerank.apply_scores(hits, hits.select("query_id", "pos", F.col("pos").cast("double").alias("score"))).select("query_id", "id", "rank")


@query("SELECT vec_id % 8 AS query_id, vec_id % 8 <> 3 AS ok FROM embeddings GROUP BY 1, 2")
def rerank_align_check(spark, d):
    e = read(spark, d, "embeddings").select((F.col("vec_id") % 8).alias("query_id"), "vec_id")
    c = e.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id")) - 1)
    broken = c.withColumn("pos", F.when((F.col("query_id") == 3) & (F.col("pos") == 1), 0).otherwise(F.col("pos")))
    return rerank.aligned(broken, c)


@query("WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(CASE WHEN i = greatest(1, least(n, round_even(0.50 * n + 0.5, 0))) THEN value END) AS p50, max(CASE WHEN i = greatest(1, least(n, round_even(0.95 * n + 0.5, 0))) THEN value END) AS p95 FROM o GROUP BY event_type")
def percentiles(spark, d):
    e = read(spark, d, "events")
    w = Window.partitionBy("event_type")
    o = e.select("event_type", "value", F.row_number().over(w.orderBy("value", "event_id")).alias("i"), F.count("*").over(w).alias("n"))
    at = lambda q: F.max(F.when(F.col("i") == F.greatest(F.lit(1), F.least("n", F.bround(q * F.col("n") + 0.5).cast("long"))), F.col("value")))
    return o.groupBy("event_type").agg(at(0.50).alias("p50"), at(0.95).alias("p95"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) % 2 = 0 AND false OR CAST(props->>'k' AS BIGINT) IN (1, 2, 3) AS hit, false AS as_text, props->>'absent' IS NULL AS missing FROM events")
def metadata_variant_filter(spark, d):
    v = F.try_parse_json("props")
    m = lambda g: matches(g, {}, v)
    return read(spark, d, "events").select("event_id", m({"k": [1, 2, 3]}).alias("hit"), m({"k": "1"}).alias("as_text"), m({"absent": None}).alias("missing"))


@query("SELECT doc_id, 'data:image/png;base64,' || base64(encode(substring(text, 1, 30))) AS url, substring(text, 1, 30) AS back FROM documents")
def data_urls(spark, d):
    head = F.substring("text", 1, 30)
    url = T.data_url(T.mime_type(F.lit("a.PNG")), F.encode(head, "UTF-8"))
    return read(spark, d, "documents").select("doc_id", url.alias("url"), F.decode(T.from_data_url(url), "UTF-8").alias("back"))


@query("SELECT doc_id, sha256('data:image/png;base64,' || base64(encode(text))) AS url_sha256, sha256(text) AS back_sha256 FROM documents")
def data_urls_whole(spark, d):
    url = T.data_url(T.mime_type(F.lit("a.PNG")), F.encode("text", "UTF-8"))
    back = F.decode(T.from_data_url(url), "UTF-8")
    return read(spark, d, "documents").select("doc_id", F.sha2(url, 256).alias("url_sha256"), F.sha2(back, 256).alias("back_sha256"))


@query("SELECT conv_id, '| role | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || role || ' | ' || CAST(n AS VARCHAR) || ' |', chr(10) ORDER BY role) AS md FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def table_to_markdown(spark, d):
    n = read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").cast("string").alias("n"))
    cells = n.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.array("role", "n"))).alias("r"))
    return cells.select("conv_id", T.table_markdown(F.concat(F.array(F.array(F.lit("role"), F.lit("n"))), F.col("r"))).alias("md"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'retriable' WHEN 1 THEN 'fatal' WHEN 2 THEN 'retriable' ELSE 'retriable' END AS kind FROM documents")
def error_classify(spark, d):
    status = F.get(F.array(F.lit(503), F.lit(404), F.lit(429), F.lit(None).cast("int")), (F.col("doc_id") % 4).cast("int"))
    return read(spark, d, "documents").select("doc_id", tasks.error_kind(status).alias("kind"))


@query()
def task_fold(spark, d):
    """Each user's events as a task's log, folded to its state."""
    kinds = F.array(*map(F.lit, ("claim", "stage", "progress", "heartbeat", "failed", "retry", "succeeded")))
    e = tasks.sequenced(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "event_id")
    log = e.select(F.col("user_id").cast("string").alias("task_id"), "seq", F.get(kinds, (F.col("event_id") % 7).cast("int")).alias("type"), F.col("ts").alias("at"), F.lit(None).cast("string").alias("worker"), F.col("event_type").alias("stage"), (F.col("value") / 100).alias("progress"))
    return tasks.fold_tasks(log)


@query()
def html_chunks(spark, d):
    pages = read(spark, d, "pages").select(F.col("page_id").cast("string").alias("source_id"), F.col("html").alias("text"))
    return chunk.chunks(pages, chunk.CHUNKERS["html"])


# The searches again, for every row whose id is divisible by 50.
_Q50, _I50 = "vec_id % 50 = 0", "item_id % 50 = 0"


def _dense50(spark, d, k=10):
    return dense.dense_topk(plain(spark, d), vector_queries(spark, d, _Q50), k)


@query(_dense_sql(_q(_Q50), _ROWS, 10))
def dense_topk_every50(spark, d):
    return shown(_dense50(spark, d))


def _filtered50(spark, d, given):
    r = rows(spark, d)
    return shown(dense.dense_topk(r, vector_queries(spark, d, _Q50), 10, matches(given, {c: r[c] for c in ("lang", "source", "toxic")})))


@query(_dense_sql(_q(_Q50), _joined("lang = 'de'"), 10))
def dense_filter_eq_every50(spark, d):
    return _filtered50(spark, d, {"lang": "de"})


@query(_dense_sql(_q(_Q50), _joined("lang IN ('de', 'fr')"), 10))
def dense_filter_in_every50(spark, d):
    return _filtered50(spark, d, {"lang": ["de", "fr"]})


@query(_dense_sql(_q(_Q50), _joined("lang = 'en' AND source IN ('src1', 'src2')"), 10))
def dense_filter_and_every50(spark, d):
    return _filtered50(spark, d, {"lang": "en", "source": ["src1", "src2"]})


@query(_dense_sql(_q(_Q50), _joined("toxic IS NULL OR toxic = 1"), 10))
def dense_filter_missing_key_every50(spark, d):
    return _filtered50(spark, d, {"toxic": [None, 1]})


@query(_dense_sql(_q(_Q50), _joined("false"), 10))
def dense_filter_empty_list_every50(spark, d):
    return _filtered50(spark, d, {"lang": []})


@query(f"SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings e, embeddings q WHERE q.{_Q50}")
def cosine_scalar_every50(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return dense.cosines(e, vector_queries(spark, d, _Q50), 6).select("query_id", F.col("id").alias("vec_id"), F.col("score").alias("similarity"))


@query("WITH " + _bm25_sql("true", 10, "lang = 'en'") + " SELECT query_id, id, round(score, 6) AS score, rank FROM keyword")
def bm25_filter_after_score_all(spark, d):
    return shown(keyword.keyword_topk(documents(spark, d), text_queries(spark, d, "true"), 10, F.col("lang") == "en"))


@query(f"WITH {_BM_EMB.replace('item_id < 8', 'true')}, {_VEC.replace('b.item_id < 8', 'true')}, {_FUSED} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(fusion_score, 9) AS fusion_score, vector_rank, keyword_rank, round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score FROM g WHERE rank <= 5")
def hybrid_topk_all(spark, d):
    """Every benchmark text that has a vector of its id."""
    r = rows(spark, d).select("id", "text", "embedding")
    q = text_queries(spark, d, "true").join(vector_queries(spark, d, "true"), "query_id")
    return retrieve.retrieve(r, q, "hybrid", 5)[0].select("query_id", "rank", "id", F.round("fusion_score", 9).alias("fusion_score"), "vector_rank", "keyword_rank", F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 6).alias("keyword_score"))


@query(_REV.replace("vec_id < 5", _Q50))
def rerank_reverse_every50(spark, d):
    hits = shown(_dense50(spark, d)).withColumn("pos", F.col("rank") - 1).drop("rank")
    return rerank.apply_scores(hits, hits.select("query_id", "pos", F.col("pos").cast("double").alias("score"))).select("query_id", "id", "rank")
