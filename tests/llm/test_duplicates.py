"""SimHash components and suffix-array dedup against brute force."""

import random

import numpy as np
import pytest
from brute import cut, cut_digest, fingerprint, simhash_groups

from echoloom.llm import simhash, suffix_dedup, suffix_sort
from echoloom.llm.components import components

SCHEMA = "doc_id long, text string"


def near_copies(seed=1, n=60):
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(300)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"v{rnd.randint(0, 99)}"
        rows.append((i + 10, " ".join(w)))
    rows += [(200 + i, " ".join(f"u{rnd.randint(0, 500)}" for _ in range(30))) for i in range(40)]
    return rows + [(300, None), (301, ""), (302, " \n"), (303, "One"), (304, "one"), (None, rows[0][1]), (None, "alone in the world"), (305, rows[0][1])]


def test_fingerprints_equal_brute_force():
    for t in [None, "", "a", "A b", "a b c d e", "é É\x0bx\x1cy z w v", *(t for _, t in near_copies()[:5]), "x " * 9000]:
        assert simhash.fingerprint(t) == fingerprint(t)


@pytest.mark.parametrize("block", [1024, 7])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = near_copies() + near_copies()[:3]
    fp, want = simhash_groups(rows)
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((k, f"{f:016x}", c) for (k, _), f, c in zip(rows, fp, want, strict=True)), key=str)


@pytest.mark.parametrize("bands", [6, 7, 8])
def test_every_close_pair_meets_in_a_block(bands):
    rnd, masks = random.Random(bands), [m & (1 << 64) - 1 for m in simhash.band_masks(bands)]
    for _ in range(500):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_keep_one_keeps_columns_and_one_row(spark):
    rows = [(k, t, "s", 1, 2) for k, t in near_copies()] + [(10, near_copies()[0][1], "s", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, turn string, k int, fp int")
    out = simhash.keep_one(df)
    ids = [r["doc_id"] for r in out.collect()]
    named = [r for r in near_copies() if r[0] is not None]
    want = {k for (k, _), c in zip(named, simhash_groups(named)[1], strict=True) if k == c}
    assert out.columns == df.columns and sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2
    assert simhash.near_duplicates(df.filter("1 = 0")).collect() == [] and simhash.keep_one(df.filter("1 = 0")).collect() == []


def test_keep_one_tells_texts_of_one_id_apart(spark):
    a, b, c = ("one two three four five six", "the weather was fine and nobody had any fruit", "seven eight nine ten eleven twelve")
    rows = [(5, a, "s"), (5, b, "s"), (6, a, "s"), (7, c, "y"), (7, c, "x"), (7, c, "x")]
    out = [{tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)).collect()} for n in (1, 4)]
    assert out[0] == out[1] and sorted((k, t) for k, t, _ in out[0]) == sorted([(5, a), (5, b), (7, c)])
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {(5, 5), (6, 5), (7, 7)}


def test_components_of_paths_stars_and_rings(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(700 + i, 700 + (i + 1) % 9) for i in range(9)] + [(5, 5)]
    rnd.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 600)} | {700 + i: 700 for i in range(9)}


def brute_suffixes(t):
    order, lcp = sorted(range(len(t)), key=lambda i: t[i:], reverse=True), [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k] and k < suffix_sort.CAP:
            k += 1
        lcp.append(k)
    return order, lcp


@pytest.mark.parametrize(("in_memory", "batch"), [(4 << 20, 1 << 16), (5, 4)])
def test_induced_sorting_equals_brute_force(monkeypatch, in_memory, batch):
    monkeypatch.setattr(suffix_sort, "IN_MEMORY", in_memory)
    monkeypatch.setattr(suffix_sort, "BATCH", batch)
    rnd = random.Random(in_memory)
    for _ in range(250):
        t = [rnd.randint(1, rnd.choice([1, 2, 3, 20])) for _ in range(rnd.choice([0, 1, 2, 5, 20, 60, 200]))] * rnd.choice([1, 1, 3]) + [0]
        got = list(suffix_sort.descending(np.array(t, np.int16)))
        order, lcp = brute_suffixes(t)
        assert np.concatenate([g[0] for g in got]).tolist() == order and np.concatenate([g[1] for g in got]).tolist() == lcp
        names = np.unique(np.array(t), return_inverse=True)[1].astype(np.int64)
        assert suffix_sort.sort_names(names).tolist() == order[::-1]


def passages(seed=2):
    rnd = random.Random(seed)
    words = [("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))) for _ in range(300)]
    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))
    shared = [prose(n) for n in (12, 20, 40, 90)]
    rows = [(i, prose(rnd.randint(0, 60)) + rnd.choice(["", *shared]) + prose(rnd.randint(0, 40)) + rnd.choice(["", *shared])) for i in range(1, 90)]
    edited = [(i + 100, t[:len(t) // 2] + "X" + t[len(t) // 2:]) for i, t in rows[:40]]
    return rows + edited + [(300, rows[5][1]), (301, rows[5][1][3:]), (302, "ab" * 400), (303, "a" * 700), (304, None), (305, ""), (306, "short"), (307, shared[3] * 3), (308, "a" * 99)]


@pytest.mark.parametrize("small", [False, True])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("HELD_ANCHORS", 50), ("SHARD_BYTES", 2000), ("STEP_BYTES", 3000), ("CROWD", 1)):
            monkeypatch.setattr(suffix_dedup, name, value)
    rows = passages()
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digests(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == cut_digest(rows)


def test_cut_texts_keeps_columns_and_odd_rows(spark):
    rows = passages()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows] + [(None, rows[5][1], None, None), (rows[5][0], rows[5][1], "x", 1)], "doc_id int, text string, k string, at int")
    out = suffix_dedup.cut_texts(df)
    want = {k: b.decode("utf-8", "ignore") for k, (b, _, _) in cut(rows).items()}
    got = out.collect()
    assert out.columns == df.columns and out.dtypes == df.dtypes and len(got) == len(rows) + 2
    assert all((r["text"] or "") == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["text"] for r in got if r["doc_id"] is None] == [rows[5][1]]
    assert suffix_dedup.digests(df.filter("1 = 0")).collect() == [] and suffix_dedup.cut_texts(df.filter("1 = 0")).collect() == []


def test_texts_of_one_id_are_cut_by_their_own_spans(spark, monkeypatch):
    """Ids with several texts come out as the same texts do under ids of their own, in the order of the text hash."""
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    fill = lambda n: "".join(rnd.choice("ijklmnop ") for _ in range(n))
    rows = [(4, passage + fill(200)), (5, fill(150) + passage), (5, fill(500)), (5, fill(90) + passage[40:260] + fill(80)), (5, passage[:150]), (-3, fill(400)), (6, passage), (6, passage)]
    df = spark.createDataFrame(rows, SCHEMA)
    own = df.selectExpr("doc_id", "text", "xxhash64(text) h").distinct().orderBy("doc_id", "h").collect()
    want = cut({i: r["text"] for i, r in enumerate(own)}.items())
    want = {(r["doc_id"], r["text"]): want[i][0].decode() for i, r in enumerate(own)}
    for small in (False, True):
        if small:
            for name, value in (("HELD_ANCHORS", 5), ("SHARD_BYTES", 200), ("STEP_BYTES", 300), ("CROWD", 1)):
                monkeypatch.setattr(suffix_dedup, name, value)
        out = suffix_dedup.cut_texts(df.selectExpr("doc_id", "text", "text AS before").repartition(3)).collect()
        assert len(out) == len(rows) and all(r["text"] == want[r["doc_id"], r["before"]] for r in out)
    assert sum(len(t) for t in want.values()) < sum(len(t) for _, t in set(rows)) - 500
    big = suffix_dedup.PLACE + 1
    k, s, e = suffix_dedup.merged(np.array([1, 1, 1, 2]), np.array([0, 50, 7 * big + 3, big]), np.array([100, 160, 7 * big + 103, big + 100]))
    assert (k.tolist(), s.tolist(), e.tolist()) == ([1, 1, 2], [0, 7 * big + 3, big], [160, 7 * big + 103, big + 100])


def test_keep_one_joins_only_what_goes_or_repeats(spark, monkeypatch):
    sizes = []
    seen = simhash.broadcast_if_small
    monkeypatch.setattr(simhash, "broadcast_if_small", lambda df, *more: (sizes.append(df.count()), seen(df, *more))[1])
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))                    # noqa: E731
    texts = [" ".join(word() for _ in range(40)) for _ in range(30)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(100, texts[3], "s"), (7, texts[7], "s"), (7, texts[7], "t"), (None, texts[1], "s")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == list(range(30)) and sum(r.doc_id is None for r in out) == 1
    assert sizes[-1] == 2                                                      # one copy, and the rows of 7
