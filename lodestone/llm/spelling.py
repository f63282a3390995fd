"""Spelling variants by anagram hashing: each word's most frequent near word is its form.

Words are near if they differ by exactly one inserted, deleted or replaced code
point. A word's anagram key is the sum of its letters' code points to the power
``POWER``, modulo ``RING``, so it doesn't depend on letter order and an edit of one letter
adds, takes away or exchanges one letter's value. Each word is listed under its own key
and under its key less the value of each of its letters. Two words that meet
under a key differ, order aside, by one letter: its own key meets a key less a value for an
addition or removal, and two keys less a value meet for an exchange. Letters whose key
meets no other are done. For the others letter order is verified: what is left without
the letter, and for an exchange the place of the letter too, must be the same.

* ``form``: the near word of largest n, of least code points among equals, if that n is at
  least ``RATIO`` times the word's own n; else null.
* ``root``: where forms lead from the word; the word itself without a form. A form's n is larger
  each time, so there are no cycles and chains are short.

Defined results: a null text has no words, as an empty one. Repeated rows count one by one. Very long
texts and words are taken whole; a word that meets others costs the square of its length. Further columns don't matter. An empty table gives an empty result.
Words are compared by code points.

Scale: occurrences are counted with partial aggregation, so the commonest word is one row for each task. A key's
words are counted, not listed; those that meet pass a bitmap of bounded size and are brought together by key, rest
and place. So at most one word for each letter of the alphabet shares a group, however many words are anagrams
of each other, and no group is paired with itself: its size and its two best words are enough. Links from words to
forms are joined with salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, read, salted_join, sieve, stored

LETTERS, LEAST_CHARS, LEAST_N, RATIO, POWER, RING = r"A-Za-zÀ-ÿ", 7, 2, 10, 5, 1 << 61
#: Words whose letters a task explodes.
WORDS_A_TASK = 50_000
#: One in so many occurrences loses a letter in the registered query, so that there are variants to find.
LOSES = 31
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """id, word: every maximal run of at least ``least`` letters, A to Z lower-cased."""
    found = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    each = docs.select(F.col(id_col).alias("id"), found.alias("word"))
    return each.select("id", F.when(F.col("word").rlike("[A-Z]"), F.translate("word", _UPPER, _UPPER.lower())).otherwise(F.col("word")).alias("word"))


def worn(words: DataFrame, one_in: int = LOSES) -> DataFrame:
    """``words`` with one code point less where ``one_in`` divides the crc32 of id and word."""
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("word")).cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("word")).cast("int")
    short = F.concat(F.left("word", at), F.substr("word", at + 2))
    return words.withColumn("h", h).select("id", F.when(F.col("h") % one_in == 0, short).otherwise(F.col("word")).alias("word"))


def counted(words: DataFrame, *, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """word, n of those long and frequent enough."""
    return words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _value(letter: Column) -> Column:
    """A letter's part of the anagram key."""
    code = F.ascii(letter).cast("bigint")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def _keyed(vocabulary: DataFrame) -> DataFrame:
    """word, n, values (of its letters) and key (their sum)."""
    valued = vocabulary.select("word", "n", F.transform(F.split("word", ""), _value).alias("values"))
    return valued.withColumn("key", F.aggregate("values", F.lit(0).cast("bigint"), lambda a, x: (a + x) % RING))


def _less(key: Column, value: Column) -> Column:
    return F.pmod(key - value, F.lit(RING))


def _meeting(keyed: DataFrame) -> DataFrame:
    """key: those that at least two words are listed under, a word once under each."""
    listed = keyed.select("key", F.explode(F.array_append(F.array_distinct("values"), F.lit(0).cast("bigint"))).alias("value"))
    return listed.groupBy(_less(F.col("key"), F.col("value")).alias("key")).agg(F.count("*").alias("words")).where("words > 1").select("key")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best (minus n and word of the best near word) of the words that have near ones; ``vocabulary``: word, n, each word once."""
    # a row becomes one for each letter, so tasks get rows by number, not by the table's bytes
    keyed = _keyed(vocabulary.repartition(1 + vocabulary.count() // WORDS_A_TASK, "word"))
    meeting = stored(_meeting(keyed), "meeting")
    may_meet = sieve(meeting.select(F.xxhash64("key")), meeting.count())
    # a letter's value is exploded before the key is reduced by it, so that the key is summed up once for each word
    marked = F.transform("values", lambda v, i: F.struct(v.alias("value"), ((i == 0) | (v != F.get("values", i - 1))).alias("starts")))
    places = keyed.select("word", "n", "key", F.posexplode(marked).alias("at", "x")).select("word", "n", "at", _less(F.col("key"), F.col("x.value")).alias("less"), "x.starts")
    rest = F.concat(F.left("word", F.col("at")), F.substr("word", F.col("at") + 2, F.char_length("word")))
    some = places.where(may_meet(F.xxhash64("less"))).select("less", rest.alias("rest"), "at", "starts", "word", "n")
    best = F.struct((-F.col("n")).alias("minus_n"), "word")
    # exchanges: the same rest with a letter at the same place; a group has a word for each letter at most
    met = some.groupBy("less", "rest", "at").agg(F.sort_array(F.collect_list(best)).alias("words")).where(F.size("words") > 1)
    first, second = F.get("words", F.lit(0)), F.get("words", F.lit(1))
    both = F.transform("words", lambda x, i: F.struct(x["word"].alias("word"), F.when(i == 0, second).otherwise(first).alias("best")))
    exchanged = met.select((F.size("words") - 1).cast("bigint").alias("n_near"), F.explode(both).alias("x")).select("x.word", "n_near", "x.best")
    # additions and removals: a rest that is a word itself; of a run of one letter only its first place counts
    longer = some.where("starts").select(F.col("less").alias("key"), F.col("rest").alias("short"), F.col("word").alias("long"), F.col("n").alias("long_n"))
    own = keyed.where(may_meet(F.xxhash64("key"))).select("key", F.col("word").alias("short"), F.col("n").alias("short_n"))
    pairs = longer.join(own.hint("merge"), ["key", "short"])
    ends = [F.struct(F.col(a).alias("word"), F.struct((-F.col(f"{b}_n")).alias("minus_n"), F.col(b).alias("word")).alias("best")) for a, b in (("long", "short"), ("short", "long"))]
    linked = pairs.select(F.explode(F.array(*ends)).alias("x")).select("x.word", F.lit(1).cast("bigint").alias("n_near"), "x.best")
    out = stored(exchanged.unionByName(linked).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")), "near")
    drop_stored(meeting)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where links from word to form end; ``forms``: word, form, each word once, no cycles. Each turn doubles the steps."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = stored(salted_join(now, ahead, "root", F.col("word"), "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        drop_stored(now)
        now = moved
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def grouped(vocabulary: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``vocabulary`` (word, n; each word once)."""
    vocabulary = stored(vocabulary.select("word", "n"), "vocabulary")
    near = near_words(vocabulary)
    joined = vocabulary.join(near.hint("merge"), "word", "left")
    form_n = -F.col("best.minus_n")
    far = form_n >= ratio * F.col("n")
    rows = joined.select("word", F.when(far, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, form_n).alias("form_n"))
    rows = stored(rows, "forms")
    for x in (vocabulary, near):
        drop_stored(x)
    ends = roots(rows.where("form is not null"))
    return rows.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(counted(worn(runs(read(spark, sf_dir, "documents")))))


SQL = r"""
WITH RECURSIVE z AS (SELECT list(c ORDER BY i) AS z FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) r(i))),
o AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY 1, 2),
x AS (SELECT w, n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w) AS x FROM o),
b AS (SELECT w, n, list_transform(range(1, length(x), 2), lambda i: 16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1) AS b FROM x),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c // 256, z[xor(c % 256, y) + 1])), 4294967295) AS h FROM b, z),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
p AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM p a JOIN p b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT p.word, v.word, v.n FROM p JOIN v ON v.word = p.rest
      UNION SELECT v.word, p.word, p.n FROM p JOIN v ON v.word = p.rest),
f AS (SELECT word, count(*) AS n_near, max(near_n) AS m FROM e GROUP BY word),
t AS (SELECT e.word, min(near) AS near FROM e JOIN f ON f.word = e.word AND near_n = m GROUP BY e.word),
g AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN near END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN f ON f.word = v.word LEFT JOIN t ON t.word = v.word),
r(word, top) AS (SELECT word, form FROM g WHERE form IS NOT NULL UNION SELECT r.word, g.form FROM r JOIN g ON g.word = r.top WHERE g.form IS NOT NULL),
l AS (SELECT r.word, r.top FROM r JOIN g ON g.word = r.top WHERE g.form IS NULL)
SELECT g.word, form, coalesce(l.top, g.word) AS root, g.n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM g LEFT JOIN l ON l.word = g.word
"""
