import random

import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, key int, id int, pos int, `rank` int, vector string, text_key int, gone_id int, w_source int, lost_lines int"


@pytest.fixture(scope="session")
def shared_folder(spark):
    return spark.conf.get("spark.checkpoint.dir")


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, repeats, and columns whose names operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t", None, "a"), (4, "one", "en", None), (5, long, "en", "a"), (5, long, "en", "a"), (6, "naïve Ünïcode 漢字 🙂 text", "fr", "b"), (7, "12 34\n\n56", None, "b"), (None, "no id here at all", "en", "b"), (8, "one", "en", "b")]
    return spark.createDataFrame([(i, t, l, s, len(t) if t is not None else None, "x", 1, 2, 3, 4, "v", 5, 6, 7, 8) for i, t, l, s in rows], COLUMNS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    """A small corpus: two invented languages, copies, boilerplate lines and toxic words."""
    r = random.Random(17)
    syllables = {"en": ["tha", "ing", "or", "wel", "sto", "ne"], "fr": ["que", "eau", "oux", "ier", "lai", "ré"]}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "fr"
        word = lambda: "".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4)))  # noqa: E731,B023
        lines = [" ".join(word() for _ in range(r.randrange(8, 30))) for _ in range(r.randrange(1, 6))]
        toxic = i % 8 == 5
        if toxic:
            words = lines[0].split()
            for w in r.sample(["zork", "blarg", "frump"], 2):
                words.insert(r.randrange(len(words)), w)
            lines[0] = " ".join(words)
        if i % 4 == 0:
            lines.insert(r.randrange(len(lines) + 1), f"Visit page {i} of our site for more")
        rows.append([i, "\n".join(lines), lang, f"s{i % 5}", int(toxic)])
    for i in range(160, 180):
        rows.append([i, rows[i - 160][1], *rows[i - 160][2:]])
    return spark.createDataFrame([(*x[:4], len(x[1]), x[4]) for x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic int").coalesce(3)


@pytest.fixture(scope="session")
def held(corpus):
    return corpus.withColumn("one", F.lit(1))
