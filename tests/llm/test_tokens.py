"""BPE and unigram counts against the tokenizers library and brute force."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import regex
from brute import best_tokens
from tokenizers import Tokenizer

from echoloom.llm import bpe, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def strings(n, seed):
    rnd = random.Random(seed)
    letters = "aaabthe rinos  \n\té'12.,<|>endoftext中\u00a0\u0085\x1c"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def test_encoding_equals_the_library(reference, spark, sf):
    coder = bpe.Vocabulary(PATH).coder()
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in [*texts, *strings(3000, 1), "", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", " ", "x " * 3000, "y" * 5000]:
        want = reference.encode(t, add_special_tokens=False).ids
        got = coder.encode(t)
        assert list(memoryview(got).cast("I")) == want, t[:80]
        assert coder.decode(got) == reference.decode(want, skip_special_tokens=False)


def test_all_characters(reference):
    coder = bpe.Vocabulary(PATH).coder()
    for lo in range(0, 0x30000, 512):
        t = " ".join("a" + chr(i) + " b" + chr(i) + "1" for i in range(lo, lo + 512) if not 0xD800 <= i < 0xE000)
        assert list(memoryview(coder.encode(t)).cast("I")) == reference.encode(t, add_special_tokens=False).ids, hex(lo)


def test_small_tables_change_nothing(monkeypatch, reference):
    for name, value in (("REMEMBER", 3), ("MAX_NODES", 5)):
        monkeypatch.setattr(bpe, name, value)
        monkeypatch.setattr(token_count, name, value)
    coder, counting, free = bpe.Vocabulary(PATH).coder(), token_count.Counting(RANKS), token_count.Counting(RANKS)
    for t in strings(300, 2):
        assert list(memoryview(coder.encode(t)).cast("I")) == reference.encode(t, add_special_tokens=False).ids
        assert counting.count(t) == free.count(t)


def test_digests_and_odd_rows(spark, reference):
    rows = [(1, "hello world", 5), (1, "hello world", 5), (None, None, None), (2, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = sorted(bpe.digests(df, PATH).collect(), key=str)
    ids = reference.encode("hello world").ids
    packed = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert [tuple(r) for r in got if r["doc_id"] == 1] == [(1, len(ids), packed, hashlib.sha256(b"hello world").hexdigest())] * 2
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in got if r["doc_id"] != 1} == {(None, 0, empty, empty), (2, 0, empty, empty)}
    assert bpe.digests(df.filter("1 = 0"), PATH).collect() == [] and bpe.encode(df, PATH).count() == 4


def test_counts_equal_brute_force(spark, sf):
    scores = token_count.zipf_scores(RANKS)
    texts = [r["text"][:600] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40).collect()] + strings(300, 3) + ["z" * 3000]
    counting = token_count.Counting(RANKS)
    for t in texts:
        pieces = regex.findall(bpe.PATTERN, t)
        assert counting.count(t) == (len(pieces), sum(best_tokens(p.encode(), scores)[1] for p in pieces)), t[:60]


def test_count_rows(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (2, "a b"), (2, "a b")], "doc_id long, text string")
    got = sorted(map(tuple, token_count.count(df, RANKS).collect()), key=str)
    assert got == sorted([(None, 0, 0), (1, 0, 0), (2, 2, 2), (2, 2, 2)], key=str)
    assert token_count.count(df.filter("1 = 0"), RANKS).collect() == []
