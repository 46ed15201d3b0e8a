"""Mixing to target weights: brute force over odd rows, exact budgets, the written mix."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from echoloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST):
    """Sorted (id, size, source size, target, taken), from the definitions."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = Counter()
    for n, (_, _, s) in zip(size, rows, strict=True):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(size), set(order), {}
    while free:
        part = {s: Fraction(left) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if part[s] > most * total[s]]
        if not over:
            target |= part
            break
        for s in over:
            target[s] = Fraction(most * total[s])
            left -= target[s]
            free.remove(s)
    out = []
    for s in order:
        budget = int(target[s])
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        own = [(int(hashlib.md5(f"{mixing.SEED}|{epochs}|{'' if k is None else k}".encode()).hexdigest()[:15], 16), k is not None, k or 0, n)
               for n, (k, _, x) in zip(size, rows, strict=True) if x == s]
        for _, named, k, n in sorted(own):
            take = max(0, min(rest, n))
            rest -= take
            out.append((k if named else None, n, total[s], float(target[s]), epochs * n + take))
    return sorted(out, key=str)


def made(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def odd_rows(seed=0):
    rnd = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 40))), rnd.choice(["a", "a", "a", "b", "é", "", None])) for i in range(900)]
    rows += [(i, None, "b") for i in range(5)] + [(None, "x y z", "b"), (None, "x y z", None), (7, "one two", "a")]
    return rows + [(1, "only", "tiny"), (2, None, "empty"), (3, "very " * 20_000, "long")] + [(4, "a b c", "copies")] * 700


@pytest.mark.parametrize("rows_in_range", [512, 16])
def test_plan_equals_brute_force(spark, monkeypatch, rows_in_range):
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows_in_range)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = made(mixing.plan(df))
    assert got == expected(rows)
    assert got == made(mixing.plan(df.repartition(5)))                       # partitioning changes nothing
    assert all(t <= 2 * n for _, n, _, _, t in got)


def test_budgets_are_exact_with_other_weights(spark):
    rows = odd_rows(3)
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.plan(df, weights=(1, 7), share=Fraction(1, 2))
    assert made(out) == expected(rows, weights=(1, 7), share=Fraction(1, 2))
    for r in out.groupBy("mix_source").agg({"taken": "sum", "target": "max"}).collect():
        assert r["sum(taken)"] == int(r["max(target)"])


def test_mix_holds_each_document_as_often_as_taken(spark):
    rows = [(k, t, s, 9) for k, t, s in odd_rows(5) if k is not None]
    df = spark.createDataFrame(rows, SCHEMA + ", mix_epoch int")
    out = mixing.mixed(df)
    assert out.columns == ["doc_id", "text", "source", "mix_epoch", "mix_words", "mix_key"]
    words, want = defaultdict(int), defaultdict(int)
    texts = {(k, t or "") for k, t, _, _ in rows}
    for r in out.collect():
        words[r["doc_id"]] += r["mix_words"]
        assert len(WORD.findall(r["text"])) == r["mix_words"] and any((r["doc_id"], x) in texts for x in [r["text"]]) or \
            any(k == r["doc_id"] and t.startswith(r["text"]) for k, t in texts)
    for k, _, _, _, taken in expected([r[:3] for r in rows]):
        want[k] += taken
    assert dict(words) == {k: n for k, n in want.items() if n}


def test_empty_and_wordless_tables(spark):
    assert mixing.plan(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    got = made(mixing.plan(spark.createDataFrame([(1, None, None), (2, " ", "a")], SCHEMA)))
    assert got == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    clash = spark.createDataFrame([(1, "a b", "s", 5, "k", 3)], SCHEMA + ", size int, key string, b int")
    assert made(mixing.plan(clash)) == [(1, 2, 2, 3.0, 3)]
