"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SCHEMA = "doc_id long, text string, n long, word string, key int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", 2) for i, t in rows], SCHEMA)


def brute_words(rows):
    lower = {c: c + 32 for c in range(65, 91)}
    count = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    words = brute_words(rows)
    form, near = {}, {}
    for w, n in words.items():
        found = [v for v in words if one_edit(w, v)]
        near[w] = len(found)
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, near[w], form[w], words.get(form[w]), root))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÿÀ×÷ß", "ÿÀ×÷ßa"]

    def typo(w):
        k, how = rng.randrange(len(w)), rng.randrange(3)
        return w[:k] + (rng.choice("abcdeéÉ") if how else "") + w[k + (how < 2) :]

    out = [(None, None), (0, ""), (1, "123 4 !"), (2, "Aaaaa" * 300)]
    for i in range(3, 160):
        words = [rng.choice(base) if rng.random() < 0.6 else typo(rng.choice(base)) for _ in range(60)]
        out.append((i if i % 3 else None, rng.choice(" ,-\n7").join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words)))
    return out + [(5, "straße Straße STRASSE ") for _ in range(4)] + [(6, "längst " * 2000)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_variants(spark, rows):
    got = rows_of(spelling.variants(table(spark, rows).repartition(3)))
    want = brute(rows)
    assert got == want
    assert len(want) > 200


def test_a_chain_of_forms(spark):
    words = ["abcdefgh"[:k] for k in range(5, 9)]
    texts = [(900 + k, " ".join([w] * 3 * 4**k)) for k, w in enumerate(words)]
    got = {r[0]: r for r in rows_of(spelling.variants(table(spark, texts), noise=0))}
    assert {w: got[w][5] for w in words} == dict.fromkeys(words, "abcdefgh")
    assert [got[w][3] for w in words] == [*words[1:], None]


def test_ties_go_to_the_smaller_word(spark):
    text = "abcde " * 3 + "abcdx " * 9 + "abcdé " * 9 + "abcdf " * 9
    got = {r[0]: r for r in rows_of(spelling.variants(table(spark, [(1, text)]), noise=0))}
    assert got["abcde"][2:5] == (3, "abcdf", 9) and got["abcdx"][3] is None


def test_empty_and_extra_columns(spark):
    assert rows_of(spelling.variants(table(spark, []))) == []
    df = table(spark, [(1, "hello " * 3)]).withColumn("a.b", F.lit(1)).withColumn("run", F.lit(1))
    assert rows_of(spelling.variants(df, noise=0)) == [("hello", 3, 0, None, None, "hello")]
