"""Line deduplication by a log-template tree, in DataFrame operations only.

A line's tokens are its runs of non-space characters; a token with a digit is a
variable field and reads ``<*>``. The tree has a fixed depth: token count, then
the first ``DEPTH`` tokens; a line falls to one leaf without comparisons.

Templates of a leaf:

* a masked line found in at least ``MIN_DOCS`` documents;
* among the leaf's other lines (a masked line counts once for each document), a
  token's support is the number of them that have it at its position. A line's tokens in falling order of support, those under
  ``MIN_DOCS`` left out, may be cut wherever the support falls; the positions
  before the cut are kept and the others generalised to ``<*>``. Lines that agree
  on what is kept are a template if at least ``MIN_DOCS`` documents have them and a
  share ``KEPT_SHARE`` of the positions is kept. Supports are compared within a
  line only, so other lines in the leaf don't hide a template.

Lines of recurring templates are dropped, but not in the document of least id
that has the template, so that no text is lost altogether, whatever their share
of a document is. A copy of a text whose every line recurs so ends as an empty text.

Defined results: a null text stays null and an empty one empty; blank lines stay
and belong to no template. A null id never counts as a document and never as a
first one. Repeated rows are treated alike. Of tied supports all are kept or none. Extra
columns stay, but for ``n_lines`` and ``n_dropped``, which are replaced. The text's lines
are what line feeds separate; a text of very many lines costs no more for each. An empty
table gives an empty result.

Scale: lines are carried by 64-bit hashes; a template's documents are counted
after a partial distinct, so the commonest line is one row for each task and
document. Only lines of leaves that enough documents share meet again with their
text, and of the texts only those are shuffled that a bitmap of bounded size lets
through. Joins on a line, a leaf's token or a text's hash are salted, so no leaf is
ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, fresh, read, salted_join, sieve, stored

DEPTH, MIN_DOCS, KEPT_SHARE = 3, 5, 0.6
_BLANK = "\t\n\x0b\f\r "
_FIELD = r"[^\x09-\x0D\x200-9]*+[0-9][^\x09-\x0D\x20]*+"


def canonical(line: Column) -> Column:
    """The line's masked tokens, one space between them; only lines with digits or odd white space go through regexes."""
    bare = F.btrim(line, F.lit(_BLANK))
    masked = F.array_join(F.split(F.btrim(F.regexp_replace(bare, _FIELD, "<*>"), F.lit(_BLANK)), r"[\x09-\x0D\x20]+"), " ")
    return F.when(bare.rlike(r"[0-9\x09-\x0D]") | bare.contains("  "), masked).otherwise(bare)


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """id, key, pos, canon, n_tokens, leaf and masked (hashes) of every line that isn't blank; ``docs``: id, key, text."""
    each = docs.select("id", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    each = each.select("id", "key", "pos", canonical(F.col("line")).alias("canon")).where("canon <> ''")
    each = each.withColumn("n_tokens", F.char_length("canon") - F.char_length(F.replace("canon", F.lit(" "), F.lit(""))) + 1)
    return each.withColumns({"leaf": F.xxhash64("n_tokens", F.substring_index("canon", " ", depth)), "masked": F.xxhash64("canon")})


def _recurring(rows: DataFrame, by: list[str], min_docs: int) -> DataFrame:
    """by, first (least id): what at least ``min_docs`` documents have."""
    return rows.select(*by, "id").distinct().groupBy(*by).agg(F.count("id").alias("docs"), F.min("id").alias("first")).where(F.col("docs") >= min_docs).drop("docs")


def _generalised(docs: DataFrame, rest: DataFrame, depth: int, min_docs: int, kept_share: float) -> tuple[DataFrame, list[DataFrame]]:
    """id, key, pos, first of lines that recur once their variable positions are generalised; and the stored stages it reads."""
    leaves = _recurring(rest, ["leaf"], min_docs).select("leaf")
    chosen = stored(rest.join(leaves, "leaf", "left_semi").select("id", "key", "pos").distinct(), "chosen")
    wanted = chosen.select(F.col("id").alias("i"), F.col("key").alias("k")).distinct()
    may_be = sieve(wanted.select(F.xxhash64("i", "k").alias("h")), wanted.count())
    some = docs.where(may_be(F.xxhash64("id", "key")))
    again = _lines(some.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_semi"), depth)
    marks = chosen.select(F.col("id").alias("i"), F.col("key").alias("k"), F.col("pos").alias("p"))
    lines = again.join(marks, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")) & (F.col("pos") == F.col("p")), "left_semi").select("id", "key", "pos", "leaf", "n_tokens", "canon").distinct()
    lines = stored(lines, "lines")
    drop_stored(chosen)
    single = lines.select("leaf", "id", "canon").distinct()
    spots = single.select("leaf", F.posexplode(F.split("canon", " ")).alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    spots = spots.select(F.xxhash64("leaf", "at", "token").alias("spot"), "n", F.xxhash64("at", "token").alias("h"))
    # the leading tokens are the leaf's own, so a leaf's lines share their spots: these are hot, and salted
    each = lines.select("id", "key", "pos", "leaf", "n_tokens", F.posexplode(F.split("canon", " ")).alias("at", "token")).withColumn("spot", F.xxhash64("leaf", "at", "token"))
    each = salted_join(each.drop("token", "at"), spots, "spot", F.struct("id", "pos"))
    line = ["id", "key", "pos", "leaf", "n_tokens"]
    least = F.ceil(kept_share * F.col("n_tokens")).cast("int")
    sorted_by = each.groupBy(*line).agg(F.sort_array(F.collect_list(F.struct("n", "h")), asc=False).alias("s")).where(F.size("s") >= least)
    n = lambda i: F.get("s", i)["n"]
    cuts = F.filter(F.sequence(least, F.size("s")), lambda i: (i == F.size("s")) | (n(i - 1) > n(i)))
    shape = F.aggregate(F.slice("s", 1, F.col("cut")), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x["h"]))
    shaped = stored(sorted_by.withColumn("cut", F.explode(cuts)).select(*line[:3], F.xxhash64("leaf", shape).alias("shape")), "shapes")
    found = salted_join(shaped, _recurring(shaped, ["shape"], min_docs), "shape", F.struct("id", "pos"))
    return found.select("id", "key", "pos", "first"), [lines, shaped]


def _gone(base: DataFrame, depth: int, min_docs: int, kept_share: float) -> DataFrame:
    """id, key, h (their hash) and lost (positions, ascending) of texts that lose lines."""
    lines = stored(_lines(base, depth).select("id", "key", "pos", "leaf", "masked"), "lines")
    exact = stored(_recurring(lines, ["masked"], min_docs), "templates")
    may_recur = sieve(exact.select("masked"), exact.count())(F.col("masked"))
    looked_up = salted_join(lines.where(may_recur), exact, "masked", F.struct("id", "pos"), "left")
    rest = lines.where(~may_recur).unionByName(looked_up.where("first is null").drop("first"))
    more, read_by = _generalised(base, rest, depth, min_docs, kept_share)
    gone = looked_up.where("first is not null").select("id", "key", "pos", "first").unionByName(more)
    gone = gone.where(F.col("id").isNull() | (F.col("id") > F.col("first"))).select("id", "key", "pos").distinct()
    gone = gone.groupBy("id", "key").agg(F.sort_array(F.collect_list("pos")).alias("lost"))
    gone = stored(gone.withColumn("h", F.xxhash64("id", "key")), "gone")
    for x in (lines, exact, *read_by):
        drop_stored(x)
    return gone


def _without(text: Column, lost: Column) -> Column:
    """The text without the lines at ``lost`` (ascending): the runs between them are sliced out, so the cost is linear."""
    parts = F.split(text, "\n")
    ends = F.concat(lost.cast("array<int>"), F.array(F.size(parts)))
    runs = F.transform(ends, lambda end, i: F.slice(parts, F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1) + 1, end - F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1)))
    return F.array_join(F.flatten(runs), "\n")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, kept_share: float = KEPT_SHARE) -> DataFrame:
    """``docs`` with recurring lines dropped from the text, n_lines (before) and n_dropped."""
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    gone = _gone(base, depth, min_docs, kept_share)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    key, h, lost, new, gone_h, gone_key = fresh(docs, "text_key", "row_hash", "lost_lines", "new_text", "gone_hash", "gone_key")
    rows = docs.select(*kept).withColumn(key, F.xxhash64(text_col)).withColumn(h, F.xxhash64(F.col(id_col), F.col(key)))
    may_be = sieve(gone.select("h"), gone.count())
    n_lines = F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("bigint").alias("n_lines")
    whole = rows.where(~may_be(F.col(h))).select(*kept, n_lines, F.lit(0).cast("bigint").alias("n_dropped"))
    own = gone.select(F.col("h").alias(gone_h), F.col("key").alias(gone_key), F.col("lost").alias(lost))
    joined = rows.where(may_be(F.col(h))).join(own, (F.col(h) == F.col(gone_h)) & (F.col(key) == F.col(gone_key)), "left")
    drops = F.col(lost).isNotNull()
    text = F.when(drops, _without(F.col(text_col), F.col(lost))).otherwise(F.col(text_col))
    out = joined.withColumn(new, text).select(*(F.col(new).alias(c) if c == text_col else F.col(c) for c in kept), n_lines, F.when(drops, F.size(lost)).otherwise(0).cast("bigint").alias("n_dropped"))
    return whole.unionByName(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, pos, regexp_extract_all(regexp_replace(line, '[^\x09-\x0D\x200-9]*[0-9][^\x09-\x0D\x20]*', '<*>', 'g'), '[^\x09-\x0D\x20]+') AS t FROM raw),
l AS (SELECT *, len(t) AS n, [CAST(len(t) AS VARCHAR), t[1], t[2], t[3]] AS leaf FROM tok WHERE len(t) > 0),
ex AS (SELECT t, min(doc_id) AS first FROM l GROUP BY t HAVING count(DISTINCT doc_id) >= 5),
rest AS (SELECT l.* FROM l ANTI JOIN ex ON l.t = ex.t),
lf AS (SELECT leaf FROM rest GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5),
c AS (SELECT rest.* FROM rest SEMI JOIN lf ON rest.leaf = lf.leaf),
single AS (SELECT DISTINCT leaf, doc_id, t FROM c),
spot AS (SELECT leaf, p, tk, count(*) AS k FROM (SELECT leaf, unnest(t) AS tk, unnest(range(len(t))) AS p FROM single) GROUP BY ALL HAVING count(*) >= 5),
e AS (SELECT doc_id, pos, x.leaf, n, x.p, x.tk, k FROM (SELECT doc_id, pos, leaf, n, unnest(t) AS tk, unnest(range(len(t))) AS p FROM c) x JOIN spot ON spot.leaf = x.leaf AND spot.p = x.p AND spot.tk = x.tk),
v AS (SELECT DISTINCT doc_id, pos, k AS least FROM e),
shp AS (SELECT e.doc_id, e.pos, leaf, least, list(p || ':' || tk ORDER BY p) AS shape FROM e JOIN v ON v.doc_id = e.doc_id AND v.pos = e.pos AND e.k >= v.least GROUP BY e.doc_id, e.pos, leaf, n, least HAVING count(*) >= 0.6 * n),
gx AS (SELECT leaf, shape, min(doc_id) AS first FROM shp GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5),
gone AS (SELECT DISTINCT doc_id, pos FROM (
  SELECT doc_id, pos, first FROM l JOIN ex ON l.t = ex.t
  UNION ALL SELECT doc_id, pos, first FROM shp JOIN gx ON shp.leaf = gx.leaf AND shp.shape = gx.shape) WHERE doc_id > first),
g AS (SELECT doc_id, list(pos) AS lost FROM gone GROUP BY doc_id),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, coalesce(lost, []) AS lost, lost IS NOT NULL AS drops FROM documents LEFT JOIN g USING (doc_id))
SELECT doc_id, CASE WHEN drops THEN array_to_string(list_filter(ls, lambda x, i: NOT list_contains(lost, i - 1)), chr(10)) ELSE text END AS text,
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(CASE WHEN drops THEN len(lost) ELSE 0 END AS BIGINT) AS n_dropped
FROM d
"""
