"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from strata.llm import periods, queries


def every_run(words, least=periods.MIN_LENGTH):
    """Runs by trying each period at each place; of one stretch the smallest period stays."""
    best, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(least, 2 * p):
                best.setdefault((i, length), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(rnd, most=80):
    words = [rnd.randint(0, rnd.randint(1, 3)) for _ in range(rnd.randint(0, most))]
    for _ in range(rnd.randint(0, 4)):
        if len(words) > 4:
            a, p = rnd.randrange(len(words)), rnd.randint(1, len(words) // 3)
            for i in range(a + p, min(len(words), a + rnd.randint(0, 4 * p))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("least", [12, 3, 7])
def test_runs_like_every_period(least):
    rnd = random.Random(least)
    for _ in range(250):
        texts = [random_words(rnd) for _ in range(rnd.randint(1, 10))]
        got = [[] for _ in texts]
        for t, s, n, p in zip(*(x.tolist() for x in periods.find_runs(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]), least)), strict=True):
            got[t].append((s, n, p))
        assert got == [every_run(t, least) for t in texts]


def test_long_and_awkward_texts():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 2500:
        fib.append(fib[-1] + fib[-2])
    for words in ([0] * 3000, [0, 1] * 1500, fib[-1], sum(([0, 1] * 6 + [i] for i in range(2, 150)), []), [*range(400), *range(400), *range(150)]):
        _, s, n, p = periods.find_runs(np.array(words), np.array([len(words)]))
        assert list(zip(s.tolist(), n.tolist(), p.tolist(), strict=True)) == every_run(words)
    big = np.arange(300_000) % 7
    assert [x.tolist() for x in periods.find_runs(big, np.array([len(big)]))] == [[0], [0], [len(big)], [7]]


def test_runs_never_cross_texts():
    assert not len(periods.find_runs(np.zeros(20, np.int64), np.array([10, 0, 10]))[0])
    assert not len(periods.find_runs(np.zeros(0, np.int64), np.array([], np.int64))[0])


def test_query_like_its_contract(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 150)))) for i in range(-5, 80)]
    rows += [(100, None), (101, ""), (102, " \x1c x y \t\n"), (103, "a " * 12), (103, "a " * 12), (104, "a " * 11), (105, "x y z\x0b" * 6), (None, "b " * 30), (106, "\x00 \x00\x00 " * 10)]
    spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id long, text string, runs array<int>").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = (1 if i is None else zlib.crc32(str(i).encode())), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = every_run(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, n, p in runs), " ".join(collapse(words, runs)))]
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha))
    assert got == sorted(want, key=str)
    assert periods.runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
