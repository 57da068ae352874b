"""Fixtures of the text operators: a table with every awkward row, and brute-force versions."""

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, n_words bigint, kept boolean, _pid int"


def prose(rng, n, vocabulary=400):
    words = [f"{a}{b}" for a in ("lor", "ip", "dol", "am", "con", "sec", "te", "ä", "ñu", "zo") for b in range(vocabulary // 10)]
    return " ".join(rng.choice(words) for _ in range(n))


def awkward_rows(seed=5, n=60):
    """doc_id, text, lang, source and columns whose names clash with those that operators make."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 300)) for _ in range(n)]
    texts += [None, "", " ", "\n\t \r\n", "one", "one two", "a" * 9000, "x  y   z\n\n     q", "é́ \U0001f600 naïve <|endoftext|> ok", texts[0], texts[0], texts[1] + " tail"]
    texts += [" ".join(["same line of words here\n"] * 30), "# * $ % & | < > " * 40, prose(rng, 20_000)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "b", None]), None if t is None else len(t), 7, 7, False, 3) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id " * 9, "en", "b", 54, 7, 7, False, 3)]
    return rows


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(5)


def words(text):
    return [] if text is None else WORD.findall(text.encode())


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
