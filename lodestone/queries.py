"""Queries over the test tables, one or more for each operator, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import glob as G
from .functions import segment
from .functions import text as T
from .functions import vector as V
from .operators import codec, diff, embedding, events, product, search, statistics
from .operators.chunking import ChunkConfig, chunk_counts, chunks
from .sources import output
from .sources.files import decoded

EXTENSIONS = ("rs", "py", "js", "ts", "md", "json", "RS", "")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, doc_id, text."""
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), F.pmod("doc_id", F.lit(8)).cast("int"))
    dot = F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))
    return table(spark, sf_dir, "documents").withColumn("path", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), dot))


FILES = """(SELECT *, source || '/' || lang || '/doc_' || doc_id || CASE doc_id % 8 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.js' WHEN 3 THEN '.ts' WHEN 4 THEN '.md' WHEN 5 THEN '.json' WHEN 6 THEN '.RS' ELSE '' END AS path FROM documents)"""
EXT = r"regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\.([^.]*)$', 1)"
# Word boundaries restated for the scripts of the tables: letters with marks, joined by one of . : ' ’ · between letters; digits, joined by one of . , ; ' ’
# between digits; underscores join both.
PATTERN = r"(?:\p{L}\p{M}*(?:[.:''’·]?\p{L}\p{M}*)*|\p{Nd}(?:[.,;''’]?\p{Nd})*|_)+"
WORDS = f"list_filter(regexp_extract_all(text, '{PATTERN}'), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{Nd}}]'))"
Q0 = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
COS = "list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[])"


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _shown(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.round("similarity", 6).alias("similarity"), "rank")


def _top(where: str = "TRUE", k: int = 10) -> str:
    return f"SELECT vec_id, round(greatest(s, 0), 6) AS similarity, CAST(row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS BIGINT) AS rank FROM (SELECT vec_id, {COS} AS s FROM embeddings, {Q0}) WHERE {where} ORDER BY s DESC, vec_id LIMIT {k}"


@query(_top())
def topk_cosine(spark, d):
    return _shown(search.search(table(spark, d, "embeddings"), first_vector(spark, d), ties=["vec_id"]), "vec_id")


@query(_top("s >= 0.15"))
def topk_threshold(spark, d):
    return _shown(search.search(table(spark, d, "embeddings"), first_vector(spark, d), search.SearchRequest().with_threshold(0.15), ties=["vec_id"]), "vec_id")


@query(_top(k=25))
def topk_stored_norm(spark, d):
    rows = table(spark, d, "embeddings").withColumn("norm", V.norm(F.col("embedding")))
    return _shown(search.search(rows, first_vector(spark, d), search.SearchRequest(limit=25), ties=["vec_id"], norm="norm"), "vec_id")


_WIDE = "(SELECT vec_id, flatten(list_transform(range(6), lambda k: list_concat(embedding[k * 9 + 1 :], embedding[: k * 9])))::DOUBLE[] AS e FROM embeddings)"


@query(f"SELECT vec_id, round(greatest(s, 0), 6) AS similarity, CAST(row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS BIGINT) AS rank FROM (SELECT a.vec_id, list_cosine_similarity(a.e, q.e) AS s FROM {_WIDE} a, {_WIDE} q WHERE q.vec_id = 0) ORDER BY s DESC, vec_id LIMIT 10")
def topk_wide(spark, d):
    """Search at 384 dimensions: each vector and five rotations of it."""
    v = F.col("embedding")
    turned = F.concat(*(F.concat(F.slice(v, k * 9 + 1, 64), F.slice(v, 1, k * 9)) for k in range(6)))
    rows = table(spark, d, "embeddings").select("vec_id", turned.alias("embedding"))
    q = rows.where("vec_id = 0").first().embedding
    return _shown(search.search(rows, q, ties=["vec_id"]), "vec_id")


@query(f"SELECT q.vec_id AS query_id, e.vec_id, round(greatest(s, 0), 6) AS similarity, CAST(r - 1 AS BIGINT) AS rank FROM (SELECT q_id, v_id, s, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, v_id) AS r FROM (SELECT q.vec_id AS q_id, e.vec_id AS v_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)) t JOIN embeddings q ON q.vec_id = q_id JOIN embeddings e ON e.vec_id = v_id WHERE r <= 5")
def topk_multi(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return _shown(search.search_all(rows, asked, query_id="query_id", query_vector="query", limit=5, ties=["vec_id"]), "query_id", "vec_id")


@query(f"SELECT vec_id, round({COS}, 9) AS cosine, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS l2 FROM embeddings, {Q0}")
def vector_distances(spark, d):
    rows = table(spark, d, "embeddings")
    q = F.array(*(F.lit(float(x)) for x in first_vector(spark, d)))
    return rows.select("vec_id", F.round(V.cosine(F.col("embedding"), q), 9).alias("cosine"), F.round(V.squared_l2(F.col("embedding"), q), 9).alias("l2"))


@query("SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 8)) AS unit FROM embeddings")
def l2_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.l2_normalized(F.col("embedding")), lambda x: F.round(x, 8)).alias("unit"))


@query("SELECT vec_id, list_transform(range(1, 9), lambda j: round(coalesce(list_avg(list_transform(list_filter(range(8), lambda s: embedding[s * 8 + 1] > 0), lambda s: embedding[s * 8 + j]::DOUBLE)), 0.0), 8)) AS pooled FROM embeddings")
def mean_pool(spark, d):
    """Each vector as eight token vectors, of which those with a positive first component count."""
    v = F.col("embedding")
    slices = F.sequence(F.lit(0), F.lit(7))
    rows = table(spark, d, "embeddings").select("vec_id", F.transform(slices, lambda s: F.slice(v, s * 8 + 1, F.lit(8))).alias("tokens"))
    rows = rows.withColumn("mask", F.transform("tokens", lambda t: F.when(F.get(t, F.lit(0)) > 0, 1.0).otherwise(0.0)))
    return rows.select("vec_id", F.transform(V.mean_pooled(F.col("tokens"), F.col("mask")), lambda x: F.round(x, 8)).alias("pooled"))


def _path_filter(name: str, sql: str, test):
    def f(spark, d):
        return files(spark, d).where(test(F.col("path"))).select("doc_id", "path")

    f.__name__ = name
    query(f"SELECT doc_id, path FROM {FILES} WHERE {sql}")(f)


_path_filter("filter_ext_exact", f"CASE WHEN {EXT} = '' THEN '' ELSE '.' || {EXT} END = '.rs'", lambda p: G.has_extension(p, ".rs"))
_path_filter("filter_ext_none", f"{EXT} = ''", lambda p: G.has_extension(p, ""))
_path_filter("filter_ext_ci", f"lower({EXT}) = 'rs'", lambda p: G.has_extension_any_case(p, "rs"))
_path_filter("filter_glob_star", "suffix(path, '.md')", lambda p: G.matches(p, "*.md"))
_path_filter("filter_glob_dir", "regexp_matches(path, '^src1/.*[.]py$')", lambda p: G.matches(p, "src1/*.py"))
_path_filter("filter_glob_recursive", "regexp_matches(path, '^src[0-9]+/(.*/)?doc_1.*[.]ts$')", lambda p: G.matches_validated(p, "src*/**/doc_1*.ts"))
_path_filter("filter_glob_class", "regexp_matches(path, '^src[0-35]/[^e]./doc_..[13579][.]')", lambda p: G.matches_validated(p, "./src[0-35]//[!e]?/doc_??[13579].*"))
_path_filter("filter_glob_braces", "path LIKE '%{rs,py}'", lambda p: G.matches(p, "*.{rs,py}"))
_path_filter("filter_glob_invalid", "FALSE", lambda p: G.matches(p, "src[0"))
_path_filter("filter_glob_ext", f"path LIKE '%/en/%' AND lower({EXT}) = 'json'", lambda p: G.matches_validated(p, "**/en/**") & G.has_extension_any_case(p, ".JSON"))
_path_filter("filter_wildcard", "contains(lower(path), '/de/') OR suffix(lower(path), '7.rs') OR prefix(lower(path), 'src3/')", lambda p: G.matches_wildcards(p, ["*/DE/*", "*7.rs", "src3/*"]))
_path_filter("known_extensions", f"{EXT} IN ('rs','py','js','ts','md','json')", lambda p: T.extension(p).isin(T.COMMON_EXTENSIONS))


@query("SELECT page_id, url FROM pages WHERE (url LIKE 'http://%.com/%' OR url LIKE 'https://%.com/%') AND url LIKE '%/en/%'")
def filter_url_glob(spark, d):
    p = table(spark, d, "pages")
    return p.where((G.matches(F.col("url"), "http://*.com/**") | G.matches(F.col("url"), "https://*.com/**")) & G.matches(F.col("url"), "*/en/*")).select("page_id", "url")


_HITS = f"(SELECT vec_id, path, {COS} AS s FROM embeddings JOIN {FILES} f ON f.doc_id = vec_id, {Q0})"


def _indexed(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding").join(files(spark, d).select(F.col("doc_id").alias("vec_id"), "path"), "vec_id")


@query(f"SELECT vec_id, path, round(greatest(s, 0), 6) AS similarity, CAST(row_number() OVER (ORDER BY s DESC, path) - 1 AS BIGINT) AS rank FROM {_HITS} WHERE regexp_matches(path, '/en/') AND suffix(path, '.rs') ORDER BY s DESC, path LIMIT 10")
def prefilter_topk(spark, d):
    hits = search.search(_indexed(spark, d), first_vector(spark, d), search.SearchRequest(filetype=".rs", glob="*/en/*"), path="path", ties=["path"])
    return _shown(hits, "vec_id", "path")


@query(f"SELECT * FROM (SELECT vec_id, path, round(greatest(s, 0), 6) AS similarity, CAST(row_number() OVER (ORDER BY s DESC, path) - 1 AS BIGINT) AS rank FROM {_HITS} ORDER BY s DESC, path LIMIT 40) WHERE regexp_matches(path, '/en/') AND lower({EXT}) = 'rs'")
def postfilter_topk(spark, d):
    hits = search.search(_indexed(spark, d), first_vector(spark, d), search.SearchRequest(limit=40), ties=["path"])
    return _shown(search.filter_results(hits, path="path", glob="*/en/*", ext="rs"), "vec_id", "path")


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())


@query(f"SELECT doc_id, {EXT} AS ext, CASE lower({EXT}) {_CASES} END AS language FROM {FILES}")
def language_detect(spark, d):
    return files(spark, d).select("doc_id", T.extension(F.col("path")).alias("ext"), T.language(F.col("path")).alias("language"))


@query(f"SELECT coalesce(CASE lower({EXT}) {_CASES} END, 'unknown') AS language, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM {FILES} WHERE n_chars <= 2048 GROUP BY 1")
def size_filter(spark, d):
    rows = files(spark, d).where(F.col("n_chars") <= T.parse_filesize("2kb"))
    return rows.groupBy(F.coalesce(T.language(F.col("path")), F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("SELECT event_id, s, CASE WHEN regexp_matches(lower(s), '^[0-9]+(b|kb|mb|gb)?$') THEN CAST(regexp_extract(s, '^[0-9]+') AS BIGINT) * CASE WHEN suffix(lower(s), 'kb') THEN 1024 WHEN suffix(lower(s), 'mb') THEN 1048576 WHEN suffix(lower(s), 'gb') THEN 1073741824 ELSE 1 END ELSE -1 END AS bytes FROM (SELECT event_id, CAST(event_id % 97 AS VARCHAR) || CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'b' WHEN 2 THEN 'kb' WHEN 3 THEN 'MB' WHEN 4 THEN 'Gb' WHEN 5 THEN '.5mb' ELSE 'tb' END AS s FROM events)")
def parse_filesize(spark, d):
    unit = F.get(F.array(*map(F.lit, ("", "b", "kb", "MB", "Gb", ".5mb", "tb"))), (F.col("event_id") % 7).cast("int"))
    rows = table(spark, d, "events").select("event_id", F.concat((F.col("event_id") % 97).cast("string"), unit).alias("s"))
    return rows.withColumn("bytes", F.coalesce(T.filesize(F.col("s")), F.lit(-1)))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS preview, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed, CAST(conv_id AS VARCHAR) || ':' || turn AS location FROM conversations".replace("\\\\s", "\\s"))
def previews(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.preview(t, 40).alias("preview"), T.squeezed(t).alias("squeezed"), T.location(F.col("conv_id").cast("string"), F.col("turn")).alias("location"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT suffix(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS lines FROM documents")
def line_char_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.char_length("text").cast("bigint").alias("chars"), T.line_count(F.col("text")).cast("bigint").alias("lines"))


@query("SELECT vec_id, n, CASE WHEN n < 1024 THEN format('{:.1f} B', n) WHEN n < 1048576 THEN format('{:.1f} KB', n / 1024) WHEN n < 1073741824 THEN format('{:.1f} MB', n / 1048576) ELSE format('{:.1f} GB', n / 1073741824) END AS shown FROM (SELECT vec_id, CAST(power(2, vec_id % 33) * 3 AS DOUBLE) AS n FROM embeddings)")
def format_bytes(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", (F.pow(F.lit(2.0), F.col("vec_id") % 33) * 3).alias("n"))
    return rows.withColumn("shown", T.format_bytes(F.col("n")))


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(len(list_distinct(w)) AS BIGINT) AS distinct_words, coalesce(array_to_string(list_slice(w, 1, 3), ' '), '') AS head FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def tokenize_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", segment.words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("words"), F.size(F.array_distinct("w")).cast("bigint").alias("distinct_words"), F.array_join(F.slice("w", 1, 3), " ").alias("head"))


def _chunk_sql(target: int, overlap: int, least: int) -> str:
    step, shortest = target - overlap, max(overlap + 1, least if target >= least else 0)
    return f"""(SELECT path || ':' || k AS id, path, CASE WHEN n <= {target} THEN text ELSE array_to_string(list_slice(w, k * {step} + 1, k * {step} + {target}), ' ') END AS content,
CAST(CASE WHEN n <= {target} THEN n ELSE least({target}, n - k * {step}) END AS BIGINT) AS token_count, k AS chunk_index, CAST(kk AS BIGINT) AS total_chunks
FROM (SELECT *, unnest(range(kk)) AS k FROM (SELECT *, CASE WHEN n <= {target} THEN 1 ELSE 1 + greatest(0, CAST(floor((n - {shortest}) / {step}) AS BIGINT)) END AS kk FROM (SELECT path, text, {WORDS} AS w, len({WORDS}) AS n FROM {FILES} WHERE text <> ''))))"""


@query(f"SELECT id, path AS file_path, md5(content) AS digest, token_count, chunk_index, total_chunks FROM {_chunk_sql(300, 50, 100)}")
def chunk_windows(spark, d):
    rows = chunks(files(spark, d), offsets=False)
    return rows.select("id", "file_path", F.md5("content").alias("digest"), "token_count", "chunk_index", "total_chunks")


@query(f"SELECT id, path AS file_path, md5(content) AS digest, token_count, chunk_index, total_chunks FROM {_chunk_sql(40, 10, 20)}")
def chunk_small_config(spark, d):
    rows = chunks(files(spark, d), ChunkConfig(40, 10, 60, 20).validate(), offsets=False)
    return rows.select("id", "file_path", F.md5("content").alias("digest"), "token_count", "chunk_index", "total_chunks")


_OFFSETS = f"""WITH f AS (SELECT path, text, regexp_extract_all(text, '{PATTERN}') AS m, string_split_regex(text, '{PATTERN}') AS g FROM {FILES} WHERE text <> ''),
m AS (SELECT path, i, m[i] AS w, length(m[i]) AS n, length(g[i]) AS gap FROM (SELECT path, m, g, unnest(range(1, len(m) + 1)) AS i FROM f)),
p AS (SELECT path, i, w, n, sum(gap + n) OVER (PARTITION BY path ORDER BY i) AS e FROM m),
t AS (SELECT path, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY path) AS tokens FROM p WHERE regexp_matches(w, '[\\p{{L}}\\p{{Nd}}]')),
c AS (SELECT c.*, text, coalesce(a.tokens, 0) <= 300 AS whole, a.s, z.e FROM {_chunk_sql(300, 50, 100)} c JOIN f ON f.path = c.path LEFT JOIN t a ON a.path = c.path AND a.j = 250 * chunk_index LEFT JOIN t z ON z.path = c.path AND z.j = 250 * chunk_index + token_count - 1),
o AS (SELECT *, CASE WHEN whole THEN 0 ELSE s END AS start_char, CASE WHEN whole THEN length(text) ELSE e END AS end_char FROM c)
SELECT id, path AS file_path, token_count, chunk_index, total_chunks, CAST(1 + length(left(text, start_char)) - length(replace(left(text, start_char), chr(10), '')) AS BIGINT) AS start_line,
CAST(CASE WHEN whole THEN greatest(1, length(text) - length(replace(text, chr(10), '')) + CASE WHEN suffix(text, chr(10)) THEN 0 ELSE 1 END) ELSE 1 + length(left(text, end_char)) - length(replace(left(text, end_char), chr(10), '')) END AS BIGINT) AS end_line,
CAST(start_char AS BIGINT) AS start_char, CAST(end_char AS BIGINT) AS end_char FROM o"""


@query(_OFFSETS)
def chunk_offsets(spark, d):
    return chunks(files(spark, d)).drop("content")


@query(f"SELECT count(*) AS total_chunks, count(DISTINCT path) AS total_files, CAST(sum(token_count) AS BIGINT) AS total_tokens, round(avg(token_count), 9) AS average_tokens, CAST(0 AS BIGINT) AS dimensions FROM {_chunk_sql(300, 50, 100)}")
def chunk_stats(spark, d):
    out = statistics.index_stats(chunk_counts(files(spark, d)), vector=None)
    return out.withColumn("average_tokens", F.round("average_tokens", 9))


_MOCK = "CASE WHEN text = '' THEN list_transform(range(8), lambda i: 0.0::DOUBLE) ELSE list_transform(range(8), lambda i: round(0.1 + ((b + i) % 100) * 0.001, 9)::DOUBLE) END"


@query(f"SELECT doc_id, {_MOCK} AS embedding FROM (SELECT doc_id, text, CAST(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))) AS BIGINT) AS b FROM documents)")
def mock_embed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.transform(embedding.mock_embedding(F.col("text"), 8), lambda x: F.round(x, 9)).alias("embedding"))


_BASE = "CAST(list_sum(list_transform(string_split({t}, ''), lambda c: unicode(c))) AS BIGINT)"
_MOCK16 = "list_transform(range(16), lambda i: 0.1 + (({b} + i) % 100) * 0.001)::FLOAT[]::DOUBLE[]"


@query(f"""WITH c AS (SELECT id, {_MOCK16.format(b='b')} AS e FROM (SELECT id, {_BASE.format(t='content')} AS b FROM {_chunk_sql(300, 50, 100)})),
q AS (SELECT item_id, {_MOCK16.format(b='b')} AS v FROM (SELECT item_id, {_BASE.format(t='text')} AS b FROM benchmark))
SELECT item_id, id, round(s, 6) AS similarity, CAST(r - 1 AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, id) AS r FROM (SELECT item_id, id, round(list_cosine_similarity(e, v), 9) AS s FROM c, q)) WHERE r <= 3""")
def mock_search(spark, d):
    embed = lambda t: embedding.mock_embedding(t, 16)
    index = embedding.embedded(chunks(files(spark, d), offsets=False).select("id", "content"), embed).select("id", "embedding")
    asked = embedding.embedded(table(spark, d, "benchmark").withColumnRenamed("text", "content"), embed, name="query").select("item_id", "query")
    return _shown(search.search_all(index, asked, query_id="item_id", query_vector="query", limit=3, ties=["id"], digits=9), "item_id", "id")


@query("SELECT conv_id, turn, CASE WHEN octet_length(encode(text)) BETWEEN 1 AND 1024 THEN list_transform(range(4), lambda i: round(0.1 + (octet_length(encode(text)) % 100) * 0.001, 9)::DOUBLE) END AS embedding FROM conversations")
def placeholder_embed(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.transform(embedding.placeholder_embedding(F.col("text"), 4), lambda x: F.round(x, 9)).alias("embedding"))


@query("SELECT item_id, 'Instruct: Find code' || chr(10) || 'Query: ' || text AS prompt FROM benchmark")
def instruction_template(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.instructed(F.lit("Find code"), F.col("text")).alias("prompt"))


@query(f"SELECT doc_id, {_MOCK} AS embedding FROM (SELECT doc_id, text, CAST(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))) AS BIGINT) AS b FROM documents)")
def embed_dedup(spark, d):
    rows = embedding.embedded_once(table(spark, d, "documents").select("doc_id", "text"), lambda t: F.transform(embedding.mock_embedding(t, 8), lambda x: F.round(x, 9)), text="text")
    return rows.select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


SQL["embed_dedup"] = SQL["embed_dedup"].replace("round(0.1 + ((b + i) % 100) * 0.001, 9)", "round(0.1 + ((b + i) % 100) * 0.001, 6)")


def _listings(spark, d):
    rows = files(spark, d).select("doc_id", "path")
    old = rows.where("doc_id % 10 <> 3").select("path", F.when(F.col("doc_id") % 17 != 0, F.timestamp_seconds(1_700_000_000 + F.col("doc_id"))).alias("mtime"))
    new = rows.where("doc_id % 10 <> 7").select("path", F.timestamp_seconds(1_700_000_000 + F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 60).when(F.col("doc_id") % 11 == 0, -60).otherwise(0)).alias("mtime"))
    return old, new


_OLD = f"(SELECT path, CASE WHEN doc_id % 17 <> 0 THEN doc_id END AS mtime FROM {FILES} WHERE doc_id % 10 <> 3)"
_NEW = f"(SELECT path, doc_id + CASE WHEN doc_id % 5 = 0 THEN 60 WHEN doc_id % 11 = 0 THEN -60 ELSE 0 END AS mtime FROM {FILES} WHERE doc_id % 10 <> 7)"
_REMOVED = f"SELECT path FROM {_OLD} o WHERE path NOT IN (SELECT path FROM {_NEW})"
_ADDED = f"SELECT path FROM {_NEW} n WHERE path NOT IN (SELECT path FROM {_OLD})"
_CHANGED = f"SELECT n.path FROM {_NEW} n JOIN {_OLD} o ON o.path = n.path WHERE o.mtime IS NULL OR o.mtime <> n.mtime"


@query(_REMOVED)
def index_diff_removed(spark, d):
    return diff.removed(*_listings(spark, d))


@query(_ADDED)
def index_diff_added(spark, d):
    return diff.added(*_listings(spark, d))


@query(_CHANGED)
def index_diff_changed(spark, d):
    return diff.changed(*_listings(spark, d))


@query(f"SELECT id FROM {_chunk_sql(300, 50, 100)} WHERE path NOT IN ({_REMOVED}) AND path NOT IN ({_CHANGED})")
def index_retained(spark, d):
    old, new = _listings(spark, d)
    return diff.retained(chunks(files(spark, d), offsets=False), diff.removed(old, new), diff.changed(old, new)).select("id")


@query(f"SELECT a AS added, u AS updated, r AS removed, o AS before, n AS after, n - o AS delta, a + u + r > 0 AS has_changes FROM (SELECT (SELECT count(*) FROM {_OLD}) AS o, (SELECT count(*) FROM {_NEW}) AS n, (SELECT count(*) FROM ({_ADDED})) AS a, (SELECT count(*) FROM ({_CHANGED})) AS u, (SELECT count(*) FROM ({_REMOVED})) AS r)")
def update_result(spark, d):
    old, new = _listings(spark, d)
    return diff.update_result(old, new, before=old.count(), after=new.count())


@query(f"SELECT path FROM {_OLD} UNION SELECT path FROM {_NEW}")
def union_tracked(spark, d):
    return diff.united(*_listings(spark, d))


@query("SELECT min(list_min(embedding))::DOUBLE AS low, max(list_max(embedding))::DOUBLE AS high FROM embeddings")
def sq_range(spark, d):
    return codec.value_range(table(spark, d, "embeddings"))


_RANGE = "(SELECT min(list_min(embedding::DOUBLE[])) AS lo, max(list_max(embedding::DOUBLE[])) AS hi FROM embeddings)"
_CODES = "list_transform(embedding::DOUBLE[], lambda x: greatest(0, least(255, round((x - lo) / ((hi - lo) / 255))))::INT)"


@query(f"SELECT vec_id, {_CODES} AS codes FROM embeddings, {_RANGE}")
def sq_encode(spark, d):
    return codec.scalar_encoded(table(spark, d, "embeddings")).select("vec_id", "codes")


@query(f"SELECT label, round(sqrt(avg(e)), 9) AS rmse, count(*) AS n FROM (SELECT label, unnest(list_transform(list_zip(embedding::DOUBLE[], {_CODES}), lambda z: power(z[1] - (lo + z[2] * ((hi - lo) / 255)), 2))) AS e FROM embeddings, {_RANGE}) GROUP BY label")
def sq_roundtrip_error(spark, d):
    rows = codec.scalar_decoded(codec.scalar_encoded(table(spark, d, "embeddings")))
    each = rows.select("label", F.explode(F.zip_with(F.col("embedding").cast("array<double>"), "decoded", lambda x, y: (x - y) * (x - y))).alias("e"))
    return each.groupBy("label").agg(F.round(F.sqrt(F.avg("e")), 9).alias("rmse"), F.count("*").alias("n"))


@query("SELECT vec_id, arg_min(c_id, (dist, c_id)) AS centroid FROM (SELECT e.vec_id, c.vec_id AS c_id, list_sum(list_transform(list_zip(e.embedding::DOUBLE[], c.embedding::DOUBLE[]), lambda z: power(z[1] - z[2], 2))) AS dist FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 16) c) GROUP BY vec_id")
def l2_nearest_centroid(spark, d):
    rows = table(spark, d, "embeddings")
    first = rows.where("vec_id < 16").orderBy("vec_id").select("embedding").collect()
    books = spark.createDataFrame([([list(r[0]) for r in first],)], "c array<array<double>>")
    return rows.join(F.broadcast(books)).select("vec_id", V.nearest(F.col("embedding"), F.col("c")).cast("bigint").alias("centroid"))


# Slices of 8 components; rows floor(i * n / k) in order of id are the first centroids, k = 256 or the rows there are. A step's means; clusters
# without rows are zeros.
_SLICES = "sl AS MATERIALIZED (SELECT vec_id, s, embedding[s * 8 + 1 : s * 8 + 8]::DOUBLE[] AS p FROM embeddings, range(8) u(s))"
_BOOK = "b0 AS MATERIALIZED (SELECT s, k, p AS c FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings) JOIN range(256) t(k) ON k < least(256, n) AND r = (k * n) // least(256, n) JOIN sl USING (vec_id))"


def _assign(i: int) -> str:
    return f"a{i} AS MATERIALIZED (SELECT vec_id, s, any_value(p) AS p, arg_min(k, (d, k)) AS k FROM (SELECT vec_id, sl.s, p, k, list_distance(p, c) AS d FROM sl JOIN b{i} ON b{i}.s = sl.s) GROUP BY vec_id, s)"


def _means(i: int) -> str:
    each = ", ".join(f"coalesce(avg(p[{j}]), 0.0)" for j in range(1, 9))
    return f"b{i + 1} AS MATERIALIZED (SELECT b{i}.s, b{i}.k, [{each}] AS c FROM b{i} LEFT JOIN a{i} ON a{i}.s = b{i}.s AND a{i}.k = b{i}.k GROUP BY b{i}.s, b{i}.k)"


_TRAINED = f"WITH {_SLICES}, {_BOOK}, " + ", ".join(f"{_assign(i)}, {_means(i)}" for i in range(10)) + f", {_assign(10)}"


def _first_book(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rows, product.first_codebook(rows, "vec_id")


@query(f"WITH {_SLICES}, {_BOOK}, {_assign(0)} SELECT s AS sub_id, k AS cluster, dim, round(avg(x), 9) AS x FROM (SELECT s, k, unnest(p) AS x, unnest(range(8)) AS dim FROM a0) GROUP BY ALL")
def kmeans_iter1(spark, d):
    rows, book = _first_book(spark, d)
    means = F.array(*(F.col(f"x{j}") / F.col("n") for j in range(8)))
    return product.kmeans_sums(rows, book).select("sub_id", "cluster", F.posexplode(means).alias("dim", "x")).select("sub_id", "cluster", F.col("dim").cast("bigint").alias("dim"), F.round("x", 9).alias("x"))


@query(f"WITH {_SLICES}, {_BOOK}, {_assign(0)} SELECT vec_id, list(CAST(k AS INT) ORDER BY s) AS codes FROM a0 GROUP BY vec_id")
def pq_encode(spark, d):
    rows, book = _first_book(spark, d)
    return product.code_lists(product.encoded(rows, book)).select("vec_id", "codes")


@query(f"{_TRAINED} SELECT vec_id, round(sqrt(sum(list_distance(p, c) ** 2)), 5) AS error FROM a10 JOIN b10 ON b10.s = a10.s AND b10.k = a10.k GROUP BY vec_id")
def pq_trained_error(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    book = product.trained(rows, "vec_id")
    out = product.decoded(product.encoded(rows, book, keep_vector=True), book, name="decoded")
    return out.select("vec_id", F.round(F.sqrt(V.squared_l2(F.col("embedding"), F.col("decoded"))), 5).alias("error"))


@query(f"WITH {_SLICES}, {_BOOK}, {_assign(0)}, {_means(0)}, {_assign(1)}, q AS (SELECT vec_id AS query_id, s, p, sqrt(sum(list_dot_product(p, p)) OVER (PARTITION BY vec_id)) AS norm FROM sl WHERE vec_id % 50 = 0), c AS (SELECT vec_id, a1.s, c FROM a1 JOIN b1 ON b1.s = a1.s AND b1.k = a1.k), f AS (SELECT query_id, vec_id, round(sum(list_dot_product(p, c)) / (any_value(norm) * sqrt(sum(list_dot_product(c, c)))), 12) AS f FROM q JOIN c ON c.s = q.s GROUP BY query_id, vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, vec_id) AS r FROM f) SELECT query_id, vec_id, round(greatest(f, 0), 6) AS similarity, CAST(r - 1 AS BIGINT) AS rank FROM r WHERE r <= 5")
def pq_topk(spark, d):
    """Search over product codes of a byte for eight components, by lookup tables."""
    rows, book = _first_book(spark, d)
    book = product.kmeans_step(rows, book)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return _shown(product.search_all(product.encoded(rows, book), book, asked, query_id="query_id", query_vector="query", limit=5, ties=["vec_id"]), "query_id", "vec_id")


@query("SELECT 'sq' AS codec, round(sum(o) / sum(c), 6) AS ratio, round(100 * (1 - sum(c) / sum(o)), 6) AS percent FROM (SELECT 4.0 * len(embedding) AS o, 1.0 * len(embedding) + 128 AS c FROM embeddings)")
def compression_stats(spark, d):
    n = F.size("embedding")
    sums = table(spark, d, "embeddings").agg(F.sum(4.0 * n).alias("o"), F.sum(1.0 * n + codec.OVERHEAD).alias("c"))
    return sums.select(F.lit("sq").alias("codec"), codec.compression(F.col("o"), F.col("c")).alias("x")).select("codec", F.round("x.ratio", 6).alias("ratio"), F.round("x.percent", 6).alias("percent"))


def watch_events(spark, d):
    """Events as file events: clicks modify, signups create, errors delete, purchases rename, views touch directories."""
    kind = F.when(F.col("event_type") == "click", "Modified").when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "error", "Deleted").when(F.col("event_type") == "purchase", "Renamed").when(F.col("event_id") % 2 == 0, "DirectoryCreated").otherwise("DirectoryDeleted")
    path = F.concat(F.lit("dir/file_"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), "ts", "user_id", kind.alias("kind"), path.alias("path"), F.concat(path, F.lit(".old")).alias("from_path"))


_EVENTS = "(SELECT event_id AS seq, ts, user_id, CASE event_type WHEN 'click' THEN 'Modified' WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' WHEN 'purchase' THEN 'Renamed' ELSE CASE WHEN event_id % 2 = 0 THEN 'DirectoryCreated' ELSE 'DirectoryDeleted' END END AS kind, 'dir/file_' || user_id AS path FROM events)"
_ACTS = f"(SELECT seq, CASE WHEN kind = 'Modified' THEN 'modified' WHEN kind IN ('Created', 'DirectoryCreated', 'Renamed') THEN 'created' ELSE 'deleted' END AS action, path FROM {_EVENTS} UNION ALL SELECT seq, 'deleted', path || '.old' FROM {_EVENTS} WHERE kind = 'Renamed')"


@query(f"SELECT action, count(*) AS events, count(DISTINCT path) AS paths FROM {_ACTS} GROUP BY action")
def events_group_by_kind(spark, d):
    return events.by_kind(watch_events(spark, d))


@query(f"SELECT path, arg_max(kind, seq) AS kind, max(seq) AS seq FROM {_EVENTS} GROUP BY path")
def events_last_wins(spark, d):
    return events.last_wins(watch_events(spark, d)).select("path", "kind", "seq")


@query(f"SELECT path, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(kind, (ts, seq)) AS kind FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, seq) AS g FROM (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY path ORDER BY ts, seq) + INTERVAL 4 HOURS, TRUE) AS gap FROM {_EVENTS})) GROUP BY path, g")
def events_debounce(spark, d):
    return events.debounced(watch_events(spark, d), "4 hours")


@query(f"SELECT user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1) // 100 AS BIGINT) AS batch, seq FROM {_EVENTS}")
def events_batches(spark, d):
    return events.batches(watch_events(spark, d)).select("user_id", F.col("batch").cast("bigint"), "seq")


_RUN = f"(SELECT k, f.path, lang, {EXT.replace('path', 'f.path')} AS ext, coalesce(n, 0) AS n FROM (SELECT 'a' AS k, path FROM ({_ADDED}) UNION ALL SELECT 'u', path FROM ({_CHANGED}) UNION ALL SELECT 'r', path FROM ({_REMOVED})) r JOIN {FILES} f ON f.path = r.path LEFT JOIN (SELECT path, count(*) AS n FROM {_chunk_sql(300, 50, 100)} GROUP BY path) c ON c.path = f.path)"


def _update_run(spark, d):
    """What an update of one listing to the other does, by file: kind (a, u, r), lang, language and chunks."""
    old, new = _listings(spark, d)
    kinds = [x.select("path", F.lit(k).alias("k")) for k, x in (("a", diff.added(old, new)), ("u", diff.changed(old, new)), ("r", diff.removed(old, new)))]
    sizes = chunk_counts(files(spark, d)).groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n"))
    known = files(spark, d).select("path", "lang", T.language(F.col("path")).alias("language"))
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).join(known, "path").join(sizes, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"SELECT p AS processed, a AS added, u AS updated, r AS removed, ca AS chunks_added, cr AS chunks_removed, f AS failed, round(100.0 * (p - f) / p, 9) AS success_rate FROM (SELECT count(*) AS p, count(*) FILTER (k = 'a') AS a, count(*) FILTER (k = 'u') AS u, count(*) FILTER (k = 'r') AS r, CAST(coalesce(sum(n) FILTER (k <> 'r'), 0) AS BIGINT) AS ca, CAST(coalesce(sum(n) FILTER (k = 'r'), 0) AS BIGINT) AS cr, count(*) FILTER (ext = '') AS f FROM {_RUN})")
def incremental_stats(spark, d):
    """An update in batches, one for each language; a file of no known kind counts as failed."""
    n = lambda c: F.count_if(c)
    k, chunk = F.col("k"), lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    run = _update_run(spark, d).groupBy("lang").agg(F.count("*").alias("processed"), n(k == "a").alias("added"), n(k == "u").alias("updated"), n(k == "r").alias("removed"), chunk(k != "r").alias("chunks_added"), chunk(k == "r").alias("chunks_removed"), n(F.col("language").isNull()).alias("failed"))
    return statistics.incremental_stats(run).withColumn("success_rate", F.round("success_rate", 9))


@query(f"SELECT count(*) AS files, count(*) FILTER (n = 0) AS failed, CAST(sum(least(n, 5)) AS BIGINT) AS chunks, round(100.0 * count(*) FILTER (n > 0) / count(*), 9) AS success_rate FROM (SELECT f.path, count(c.id) AS n FROM {FILES} f LEFT JOIN {_chunk_sql(300, 50, 100)} c ON c.path = f.path GROUP BY f.path)")
def indexing_stats(spark, d):
    """The chunks of each file, counted up to five; a file without any counts as failed."""
    sizes = chunk_counts(files(spark, d)).groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("chunks"))
    rows = files(spark, d).select("path").join(sizes, "path", "left").select(F.coalesce("chunks", F.lit(0)).alias("chunks"), F.col("chunks").isNull().alias("failed"))
    return statistics.indexing_stats(rows, most_chunks=5).withColumn("success_rate", F.round("success_rate", 9))


@query("SELECT event_type, round(100.0 * count(*) FILTER (value > 50) / count(*), 9) AS success_rate FROM events GROUP BY event_type")
def success_rate(spark, d):
    good = F.count(F.when(F.col("value") > 50, 1))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(statistics.success_rate(good, F.count("*") - good), 9).alias("success_rate"))


@query(f"SELECT source, round(avg(words), 6) AS words, round(avg(chars), 6) AS chars, round(avg(bytes), 6) AS bytes FROM (SELECT source, len({WORDS}) AS words, length(text) AS chars, strlen(text) AS bytes FROM documents) GROUP BY source")
def benchmark_average(spark, d):
    """Means of what the texts of each source ask of an embedder."""
    rows = table(spark, d, "documents").select("source", segment.word_count(F.col("text")).alias("words"), F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    out = statistics.benchmark_means(rows, "source", "words", "chars", "bytes")
    return out.select("source", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(f"SELECT c.path AS file_path, make_timestamp((1700000000 + any_value(n.mtime)) * 1000000) AS mtime FROM {_chunk_sql(300, 50, 100)} c JOIN {_NEW} n ON n.path = c.path GROUP BY c.path")
def index_file_mtimes(spark, d):
    """The file times of an index's chunks."""
    _, new = _listings(spark, d)
    rows = chunk_counts(files(spark, d)).join(new.withColumnRenamed("path", "file_path"), "file_path")
    return statistics.file_times(rows, "file_path", "mtime").withColumn("mtime", F.col("mtime").cast("timestamp_ntz"))


@query("SELECT max(strlen(text)) AS peak, CAST(floor(avg(strlen(text))) AS BIGINT) AS mean FROM documents")
def resource_summary(spark, d):
    """Greatest and mean bytes that a task holds of a text."""
    return statistics.resource_summary(table(spark, d, "documents").select(F.octet_length("text").cast("bigint").alias("bytes")), "bytes")


_MESSAGE = "CASE event_type WHEN 'click' THEN 'No files found in ' WHEN 'error' THEN 'Permission denied: ' WHEN 'signup' THEN 'Network down ' WHEN 'view' THEN 'out of disk ' ELSE 'odd ' END || props"


@query(f"SELECT event_id, CASE WHEN contains(m, 'no files found') THEN 'no_files_found' WHEN contains(m, 'failed to initialize embedding generator') THEN 'embedding_init' WHEN contains(m, 'permission denied') THEN 'permission_denied' WHEN contains(m, 'disk') OR contains(m, 'space') THEN 'disk_space' WHEN contains(m, 'timeout') OR contains(m, 'network') THEN 'network' ELSE 'generic' END AS class FROM (SELECT event_id, lower({_MESSAGE}) AS m FROM events)")
def error_classify(spark, d):
    t = F.col("event_type")
    m = F.when(t == "click", "No files found in ").when(t == "error", "Permission denied: ").when(t == "signup", "Network down ").when(t == "view", "out of disk ").otherwise("odd ")
    return table(spark, d, "events").select("event_id", T.error_class(F.concat(m, F.col("props"))).alias("class"))


@query("SELECT event_id, CAST(a AS BIGINT) AS attempt, CASE WHEN a <= 0 THEN 0 ELSE least(250, 100 * power(2, a - 1)) END::DOUBLE AS delay_ms FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS a FROM events WHERE event_type = 'error')")
def backoff_table(spark, d):
    """Each user's errors as tries of one piece of work, and the pause before each."""
    tries = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, d, "events").where("event_type = 'error'").select("event_id", tries.cast("bigint").alias("attempt"))
    return rows.withColumn("delay_ms", T.backoff_ms(F.col("attempt"), 100, 2, 250))


@query("SELECT page_id, translate(url, '/:<>\"|?*.', '_________') AS dir, regexp_matches(url, '^[\\p{L}\\p{N}_.-]+/[\\p{L}\\p{N}_.-]+$') AS is_name, contains(url, 'qwen3') OR contains(url, 'Qwen3') AS instructed, coalesce(NULL, CASE WHEN page_id % 3 = 0 THEN url END, 'default') AS model FROM pages")
def model_path(spark, d):
    u = F.col("url")
    given = F.when(F.col("page_id") % 3 == 0, u)
    return table(spark, d, "pages").select("page_id", T.model_path(u).alias("dir"), T.is_model_name(u).alias("is_name"), T.takes_instruction(u).alias("instructed"), T.effective_model(F.lit(None).cast("string"), given, F.lit("default")).alias("model"))


@query("SELECT p_partkey, CAST(p_size * 1000000 * CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS BIGINT) AS memory FROM part")
def memory_estimate(spark, d):
    backend = F.when(F.col("p_partkey") % 3 == 0, "fastembed").when(F.col("p_partkey") % 3 == 1, "candle").otherwise("custom")
    return table(spark, d, "part").select("p_partkey", T.memory_estimate(F.col("p_size").cast("bigint") * 1_000_000, backend).cast("bigint").alias("memory"))


@query("SELECT doc_id, suffix(text, '.') AS ends, CASE WHEN NOT prefix(c, '[PLACEHOLDER_CONTENT_FROM:') THEN c END AS real FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '[PLACEHOLDER_CONTENT_FROM:' || doc_id || ':1]' ELSE text END AS c FROM documents)")
def real_content(spark, d):
    i = F.col("doc_id")
    c = F.when(i % 2 == 0, F.concat(F.lit(T.PLACEHOLDER), i.cast("string"), F.lit(":1]"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.col("text").endswith(".").alias("ends"), T.real_content(c).alias("real"))


@query(f"SELECT path AS file_path, substring(text, doc_id % 50 + 1, 30) AS content FROM {FILES}")
def rehydrate(spark, d):
    f = files(spark, d)
    hits = f.select(F.col("path").alias("file_path"), (F.col("doc_id") % 50).alias("start_char"), (F.col("doc_id") % 50 + 30).alias("end_char"))
    return search.rehydrated(hits, f.select(F.col("path").alias("file_path"), "text")).select("file_path", "content")


@query(f"SELECT id, path AS file_path, md5(content) AS digest FROM {_chunk_sql(300, 50, 100)} WHERE path IN (SELECT path FROM {FILES} WHERE suffix(path, '.py') AND lang = 'en')")
def chunks_of_file(spark, d):
    f = files(spark, d)
    some = f.where("lang = 'en'").where(F.col("path").endswith(".py")).select("path")
    return search.chunks_of(chunks(f, offsets=False), some).select("id", "file_path", F.md5("content").alias("digest"))


def _sample_results(spark, d):
    hits = search.search(_indexed(spark, d), first_vector(spark, d), search.SearchRequest(limit=12), ties=["path"])
    texts = files(spark, d).select("path", "text")
    return texts.join(F.broadcast(hits), "path").select(F.col("path").alias("file_path"), F.lit(1).alias("start_line"), T.line_count(F.col("text")).cast("int").alias("end_line"), F.round("similarity", 3).alias("similarity"), F.col("text").alias("content"), "rank")


_RESULTS = f"(SELECT h.path AS file_path, 1 AS start_line, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT suffix(text, chr(10)) THEN 1 ELSE 0 END AS INT) AS end_line, round(greatest(s, 0), 3) AS similarity, text AS content, CAST(r - 1 AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY s DESC, path) AS r FROM {_HITS} ORDER BY s DESC, path LIMIT 12) h JOIN {FILES} f ON f.path = h.path)"


@query(f"SELECT to_json({{'file': file_path, 'line_start': start_line, 'line_end': end_line, 'score': similarity, 'content': content, 'rank': rank}})::VARCHAR AS value FROM {_RESULTS}")
def json_results(spark, d):
    return output.json_lines(_sample_results(spark, d))


@query(f"SELECT (rank + 1) || '. ' || file_path || ':1 (similarity: ' || format('{{:.1f}}', similarity * 100) || '%)' || chr(10) || array_to_string(list_transform(list_slice(string_split(content, chr(10)), 1, 3), lambda x, i: lpad(CAST(i AS VARCHAR), 4, ' ') || '│ ' || trim(x)), chr(10)) || CASE WHEN len(string_split(content, chr(10))) > 3 THEN chr(10) || '    │ ...' ELSE '' END AS value FROM {_RESULTS}")
def text_results(spark, d):
    return output.text_lines(_sample_results(spark, d))


@query(f"SELECT regexp_replace(file_path, '^src0/', '') AS file_path, CASE WHEN {EXT.replace('path', 'file_path')} = '' THEN 'unknown' ELSE {EXT.replace('path', 'file_path')} END AS file_type, similarity, rank, start_line, end_line, content, NULL::VARCHAR AS context FROM {_RESULTS}")
def tool_results(spark, d):
    return output.tool_rows(_sample_results(spark, d), "src0")


@query("SELECT source, lang, least(256, floor(CASE WHEN b > 1000 THEN 16 WHEN b < 100 THEN 64 ELSE 32 END * 1.5))::INT AS batch, least(128, CASE WHEN b > 1000 THEN 5 WHEN b < 100 THEN 20 ELSE 10 END)::INT AS unknown_memory FROM (SELECT source, lang, floor(avg(octet_length(encode(text)))) AS b FROM documents GROUP BY ALL)")
def batch_sizing(spark, d):
    mean = table(spark, d, "documents").groupBy("source", "lang").agg(F.floor(F.avg(F.octet_length("text"))).alias("b"))
    return mean.select("source", "lang", embedding.batch_size_of(F.col("b"), 32, 8.0).alias("batch"), embedding.batch_size_of(F.col("b"), 10).alias("unknown_memory"))


@query("SELECT event_type, n AS files, bad AS failed, n - bad AS successful, round(coalesce(s, 0), 6) AS average_ms FROM (SELECT event_type, count(*) AS n, count(*) FILTER (value > 80) AS bad, avg(value) FILTER (value <= 80) AS s FROM events GROUP BY event_type)")
def parallel_stats(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("value") > 80).alias("failed"), F.col("value").alias("ms"))
    return statistics.parallel_stats(rows, "event_type").withColumn("average_ms", F.round("average_ms", 6))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'binary' WHEN 3 THEN 'UTF-16LE' ELSE 'UTF-8' END AS encoding, doc_id % 4 = 0 AS is_binary, md5(t) AS digest, CAST(length(t) AS BIGINT) AS char_count, CAST(length(t) - length(replace(t, chr(10), '')) + CASE WHEN t <> '' AND NOT suffix(t, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS line_count FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS t FROM documents)")
def decode_files(spark, d):
    """Every text as a file: with NUL bytes, as plain UTF-8, as UTF-8 and as UTF-16 behind a byte order mark."""
    t, kind, utf8 = F.col("text"), F.col("doc_id") % 4, F.encode("text", "UTF-8")
    content = F.when(kind == 0, F.concat(F.unhex(F.repeat(F.lit("00"), 100)), utf8)).when(kind == 1, utf8).when(kind == 2, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE")))
    out = decoded(table(spark, d, "documents").select("doc_id", content.alias("content")))
    return out.select("doc_id", "encoding", "is_binary", F.md5("text").alias("digest"), "char_count", "line_count")


_DECODED = f"list_transform({_CODES}, lambda c: (lo + c * ((hi - lo) / 255.0::DOUBLE))::FLOAT)"


@query(f"SELECT vec_id, round(greatest(s, 0), 6) AS similarity, CAST(row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS BIGINT) AS rank FROM (SELECT vec_id, list_cosine_similarity({_DECODED}::DOUBLE[], q::DOUBLE[]) AS s FROM embeddings, {_RANGE}, {Q0}) ORDER BY s DESC, vec_id LIMIT 10")
def codes_topk(spark, d):
    """Search over scalar codes of one byte a component."""
    coded, about = codec.encoded(table(spark, d, "embeddings").select("vec_id", "embedding"), "scalar", "vec_id")
    return _shown(search.search(codec.decoded(coded, about), first_vector(spark, d), ties=["vec_id"]), "vec_id")


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 8)) AS embedding FROM embeddings")
def identity_codec(spark, d):
    coded, about = codec.encoded(table(spark, d, "embeddings").select("vec_id", "embedding"), "none", "vec_id")
    return codec.decoded(coded, about).select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 8)).alias("embedding"))
