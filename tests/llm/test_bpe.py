"""BPE by merge rounds against the tokenizers library, token by token."""

import hashlib
import json
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strata.llm import bpe
from strata.llm.queries import TOKENIZER

LETTERS = "aAbeéÉ'’s td\n\t.=<|>́ 1½Σς中ÅİǄ\x00\x1c"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(TOKENIZER)


def check(own, library, texts):
    ids, offsets = own.encode(pa.array(texts, pa.string()))
    said = own.decode(ids, offsets).to_pylist()
    for i, text in enumerate(texts):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[offsets[i]:offsets[i + 1]].tolist() == want, text[:80]
        assert said[i] == library.decode(want, skip_special_tokens=False)


def test_texts_like_the_library(own, library):
    check(own, library, ["", " ", "a", "It's <|endoftext|>x<|startoftext|> <|endoftext", "Σας ΟΔΟΣ İ", "don't'll 's 123 ½² 中文。\U0001f600\U0001f600", "é ́e"])
    check(own, library, [chr(c) + "a" + chr(c) * 2 for c in range(0x3100)])
    rnd = random.Random(1)
    check(own, library, ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 60))) for _ in range(3000)])


def test_long_pieces_and_long_texts(own, library):
    rnd = random.Random(2)
    mixed = "".join(rnd.choice("etaoins") for _ in range(5 * bpe.LONG))
    check(own, library, ["=" * 7001, "ab" * bpe.LONG, "x" * (bpe.LONG - 1), "x" * bpe.LONG + " x", mixed, " ".join([mixed[:40]] * 30000)])


def test_rounds_equal_the_heap(own):
    """Both ways of merging give the same symbols, also for a vocabulary whose merges are out of order."""
    rnd = random.Random(3)
    words = [own.inner[np.frombuffer("".join(rnd.choice("aen") for _ in range(rnd.randint(1, 40))).encode(), np.uint8)] for _ in range(500)]
    for safe in (own.safe, np.zeros_like(own.safe)):
        own_safe, own.safe = own.safe, safe
        sym, sizes = own.merge(np.concatenate(words), np.array([len(w) for w in words]))
        own.safe = own_safe
        assert np.split(sym, np.cumsum(sizes)[:-1])[0].tolist() == own.merge_long(words[0].tolist())
        assert [x.tolist() for x in np.split(sym, np.cumsum(sizes)[:-1])] == [own.merge_long(w.tolist()) for w in words]


def test_unknown_vocabulary_raises(tmp_path):
    with open(TOKENIZER, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Bpe(str(tmp_path / "v.json"))


def test_tables(spark, library):
    rows = [(1, "Some text, twice.", 7), (1, "Some text, twice.", 7), (2, None, 8), (None, "", 9), (3, "word " * 50000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = sorted(map(tuple, bpe.round_trip(docs, TOKENIZER).collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER).collect()
    assert sorted(len(r["text"]) for r in back) == sorted(len(library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for _, t, _ in rows)
    assert bpe.round_trip(docs.limit(0), TOKENIZER).count() == 0 and bpe.encode(docs.limit(0), TOKENIZER).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), TOKENIZER).collect()
