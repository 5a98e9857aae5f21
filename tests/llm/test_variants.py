"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strata.llm import queries, variants

LETTERS = "abcdeéÉ×÷ÿ"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def groups(n, factor=10):
    """word -> (form, root, n, n_near, form_n), from all pairs."""
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= factor * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def collected(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("shortest", [4, 5, 7, 12])
def test_groups_like_all_pairs(spark, shortest):
    rnd = random.Random(shortest)
    n = {}
    for _ in range(25):
        w = "".join(rnd.choice(LETTERS[:rnd.randint(2, 10)]) for _ in range(rnd.randint(shortest, shortest + 5)))
        for _ in range(12):
            n[w] = rnd.choice([2, 2, 3, 20, 200, 2000, 30000])
            i, kind = rnd.randint(0, len(w)), rnd.randint(0, 2)
            w = w[:i] + ("" if kind == 0 else rnd.choice(LETTERS)) + w[i + (kind < 2):]
            if len(w) < shortest:
                break
    n = {w: c for w, c in n.items() if len(w) >= shortest}
    df = spark.createDataFrame([(w, c, "x") for w, c in n.items()], "word string, n long, key string")
    assert collected(variants.group(df)) == groups(n)


def test_chains_ties_and_long_words(spark):
    n = {"abcdefg": 2, "abcdefgh": 30, "abcdefghi": 400, "abcdefghix": 5000, "zbcdefg": 20, "ybcdefg": 20, "alone" * 2: 9}
    long = "".join(random.Random(1).choice("abc") for _ in range(5000))
    n |= {long: 50, long[:2500] + long[2501:]: 3, long[::-1]: 3}
    got = collected(variants.group(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == groups(n)
    assert got["abcdefg"][:2] == ("abcdefgh", "abcdefghix") and got["zbcdefg"][0] is None


def test_query_like_its_contract(spark, tmp_path):
    rnd = random.Random(3)
    base = ["".join(rnd.choice(LETTERS + "FGH") for _ in range(rnd.randint(5, 11))) for _ in range(30)]
    rows = [(i, " ".join(w if rnd.random() < 0.8 else w[1:] for w in rnd.choices(base, k=60)) + " ǄabcdefgǄ") for i in range(60)]
    rows += [(60, None), (61, ""), (62, "1 2 3"), (62, base[0] * 300), (63, rows[0][1]), (63, rows[0][1])]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int").write.parquet(str(tmp_path / "documents.parquet"))
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            k = h % len(run)
            n[run[:k] + run[k + 1:] if h % 31 == 0 else run] += 1
    assert collected(queries.op11_spelling_variants(spark, str(tmp_path))) == groups({w: c for w, c in n.items() if len(w) >= 7 and c >= 2})


def test_empty_tables_and_bad_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group(variants.count_words(variants.letter_runs(none))).count() == 0
    with pytest.raises(Exception, match="four letters"):
        variants.group(spark.createDataFrame([("abc", 3)], "word string, n long")).collect()
    with pytest.raises(Exception, match="four letters"):
        variants.group(spark.createDataFrame([(None, 3)], "word string, n long")).collect()


def test_no_key_grows_with_a_popular_beginning(spark):
    """2,000 words of one beginning and one ending meet in few candidate pairs."""
    rnd = random.Random(4)
    df = spark.createDataFrame([("commun" + "".join(rnd.choice("abcdefghijklmnop") for _ in range(8)) + "ations", 2) for _ in range(2000)], "word string, n long").distinct()
    a, b = variants._keys(df, True), variants._keys(df, False).withColumnRenamed("word", "other").drop("n")
    met = a.join(b, ["key", "kind"]).filter(F.col("word") < F.col("other")).count()
    assert met < 4000
