"""Grouping of spelling variants: words one edit apart, joined on asymmetric q-chunks.

Of two words one edit apart the shorter one (the smaller one if equally long), of ``m`` letters,
owns two disjoint chunks of ``q = m // 2``: its first and its last ``q`` letters.  One edit spoils
one of them at most, so the other word holds a chunk among its positional grams of ``q`` letters,
the first at place 0, the last at place ``m - q`` or, after an insertion, one further: no gram
farther than a shift of one is ever needed.  The rest of the owner beside the preserved chunk
differs by that one edit too, so the same holds once more inside the rest: a key is a preserved
chunk and a preserved half of the rest.  A key thus fixes three quarters of a word's letters, and
the words under one key differ in a stretch of about a quarter of their length, so no key grows
with a popular beginning or ending.  Pairs that share a key are verified by their edit distance
inside the join; a pair that shares several keys is kept under its first one, so nothing has to be
deduplicated.

    words     word, n
    near_pairs    word, other (both ways), with the other's n
    group     word, form, root, n, n_near, form_n
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import staged

RUN = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, FORM_FACTOR = 7, 2, 10


def ascii_lower(word: Column) -> Column:
    """Lower-cases A-Z alone."""
    plain = F.length(word) == F.octet_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def letter_runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, word``: each maximal run of Latin letters of at least ``min_length``, lower-cased,
    as often as it occurs.  A null or empty text has none."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"({RUN}{{{min_length},}})"), F.lit(1))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("word")).select("doc_id", ascii_lower(F.col("word")).alias("word"))


def count_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: distinct words of at least ``min_length`` letters and ``min_count`` occurrences.
    Occurrences are added up in each task before the shuffle, so a frequent word is no hot key."""
    counted = words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _halves(n: Column | int) -> Column:
    return F.floor(n / 2).cast("int")


def _parts(word: Column, length: Column, m: Column) -> list[Column]:
    """The four keys of ``word`` seen from an owner of ``m`` letters: a preserved chunk of the owner
    and the preserved half of its rest."""
    q = _halves(m)
    t = _halves(m - q)
    one = F.lit(1)

    def cut(start, n):
        return F.substr(word, start, n)

    first, last = cut(one, q), cut(length - q + 1, q)
    spots = [(first, cut(q + 1, t)), (first, cut(length - t + 1, t)), (last, cut(one, t)), (last, cut(length - q - t + 1, t))]
    return [F.xxhash64(m, F.lit(i), a, b) for i, (a, b) in enumerate(spots)]


def _keys(words: DataFrame, owner: bool) -> DataFrame:
    """Rows ``key, kind, word, n``: an owner's chunks, or the grams that may meet those of owners
    as long or one letter shorter.  Equal hashes of different keys cost a verification, no more."""
    word, length = F.col("word"), F.length("word")
    keys = _parts(word, length, length) + ([] if owner else _parts(word, length, length - 1))
    rows = F.array(*[F.struct(k.alias("key"), F.lit(i % 4).cast("byte").alias("kind")) for i, k in enumerate(keys)])
    return words.select("word", "n", F.inline(rows))


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: each pair of words one edit apart once, the owner first."""
    a = _keys(words, owner=True)
    b = _keys(words, owner=False).select("key", F.col("kind").alias("other_kind"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    w, v, m = F.col("word"), F.col("other"), F.length("word")
    q = _halves(m)
    t = _halves(m - q)
    # The first kind under which the pair meets; the last one needs no test.
    head, tail = F.left(w, q) == F.left(v, q), F.right(w, q) == F.right(v, q)
    kind = (F.when(F.left(w, q + t) == F.left(v, q + t), 0).when(head & (F.right(w, t) == F.right(v, t)), 1)
            .when(tail & (F.left(w, t) == F.left(v, t)), 2).otherwise(3))
    longer = F.length("other") - m
    met = a.join(b, (a["key"] == b["key"]) & (F.col("kind") == F.col("other_kind")) & ((longer == 1) | ((longer == 0) & (w < v)))
                 & (F.levenshtein(w, v, 1) == 1) & (kind == F.col("kind")))
    return met.select("word", "n", "other", "other_n")


def group(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table of distinct words (``word, n``).

    ``form`` is the near word of largest ``n`` (ties: the smallest by code points) if that is at
    least ``factor`` times the word's own, else null; ``root`` follows forms to the last one.  A
    word without near words has ``n_near`` 0, no form, and is its own root.  An empty table gives
    no rows.  Words shorter than four letters are outside the method and raise; a null word raises."""
    ok = F.assert_true(F.coalesce(F.length("word") >= 4, F.lit(False)), F.lit("words need four letters at least"))
    words = staged(words.filter(ok.isNull()).select("word", "n"))
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(F.struct(F.col("word"), F.col("other").alias("near"), F.col("other_n").alias("near_n")),
                                         F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    near = words.join(best, "word", "left")
    is_form = -F.col("b.less") >= factor * F.col("n")
    found = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                               F.when(is_form, F.col("b.near")).alias("form"), F.when(is_form, -F.col("b.less")).alias("form_n")))
    return found.join(_roots(found.filter(F.col("form").isNotNull()).select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words that have a form, by pointer jumping.  Counts grow along a chain, so
    there is no circle; each round doubles the steps taken, and the loop ends when none moves."""
    roots = forms.withColumnRenamed("form", "root")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = staged(roots.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        roots = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return roots
