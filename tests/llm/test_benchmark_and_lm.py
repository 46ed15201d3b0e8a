"""Decontamination and language-model scores."""

import random

import duckdb
import numpy as np
from brute import leaks, template

from echoloom.llm import decontaminate, lm_score
from echoloom.llm.tokenscan import Scan

ITEM = "Alice has 12 apples and gives 5 kg of them to Bob, so how many of the apples does Alice keep in the old basket after 12 days"
OTHER = "Carol has 90 apples and gives 7 kg of them to Dave, so how many of the apples does Carol keep in the old basket after 90 days"
TORN = "Carol has 90 apples and gives 7 kg of them to Dave, so how many of the apples does Erin keep in the old basket after 91 days"
CLEAN = "the weather was fine and nobody had any fruit at all, so they went to the lake and swam until the evening came"


def test_numbers_names_and_units_are_slots(spark):
    docs = [(1, f"before {ITEM} after"), (2, OTHER), (3, CLEAN), (4, TORN), (5, None), (6, ""), (None, f"x {ITEM}"), (1, f"before {ITEM} after")]
    items = [(1, ITEM), (2, ""), (3, None), (4, "two words"), (5, ITEM)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, k int")
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_found"]) for r in decontaminate.leaks(d, b).collect()}
    assert got == leaks(docs, items)
    assert got[1, 1][0] == got[1, 1][1] and got[2, 1] == got[1, 1] and (3, 1) not in got
    assert (4, 1) not in got or got[4, 1][1] < got[2, 1][1]
    kept = decontaminate.drop_leaked(d, b)
    assert kept.columns == d.columns and {1, 2, None} & {r["doc_id"] for r in kept.collect()} == set()
    assert decontaminate.leaks(d.filter("1 = 0"), b).collect() == [] and decontaminate.leaks(d, b.filter("1 = 0")).collect() == []
    assert decontaminate.drop_leaked(d, b.filter("1 = 0")).count() == len(docs)


def test_leaks_equal_brute_force(spark, sf):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = leaks([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in b.select("item_id", "text").collect()])
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_found"]) for r in decontaminate.leaks(d, b).collect()}
    assert got == want
    exact = duckdb.sql(f"SELECT doc_id, item_id FROM '{sf}/documents.parquet' d, '{sf}/benchmark.parquet' b WHERE contains(d.text, b.text)").fetchall()
    assert set(exact) <= set(got)


def test_copies_in_another_case_and_items_without_plain_words_are_found(spark):
    shout, digits = "WHY DOES THE RIVER BEND NEAR THE OLD MILL AND NOT BEFORE", "12 7 55 1 90 4 8 33 21 6"
    umlaut = "Wie viele Äpfel trägt der große Baum über dem Öltank im September nach der Ernte"
    items = [(1, ITEM), (2, shout), (3, digits), (4, umlaut)]
    docs = [(1, f"x {ITEM.upper()} y"), (2, f"x {ITEM.lower()} y"), (3, f"x {shout} y"), (4, shout.lower()), (5, f"so {digits} it is"), (6, umlaut.upper()), (7, CLEAN), (8, ITEM.title()), (9, "1 2 3 4 5 6 7 8 9 10")]
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_found"]) for r in decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 4), (8, 1)} and all(a == b for a, b in got.values())


PENS = "{n} has {a} red pens and buys {b} blue ones at a price of {c} dollars each, so what does {n} pay for all the blue pens of the week"


def test_numbers_with_separators_or_in_words_and_long_names_fill_one_slot(spark):
    item = PENS.format(n="Sam", a=3, b=4, c=2)
    fills = [dict(n="Sam", a="12,500", b="7", c="2.5"), dict(n="Élodie", a=3, b=4, c=2), dict(n="Mary Jane", a=3, b=4, c=2), dict(n="Иван", a="twenty-five", b="1.250,75", c="two hundred"),
             dict(n="Jean-Luc O'Neil", a="3.14", b="nine", c="1,000,000")]
    docs = [(i, f"as it was said, {PENS.format(**f)} or not") for i, f in enumerate(fills)]
    # one value in place of two, and two in place of one: every window that holds both is out
    docs += [(10, PENS.format(n="Ann Lee", a="5", b="5", c="5")), (11, PENS.replace("does {n}", "does Bob Ray").format(n="Ann Lee", a="1.5", b="2.5", c="3.5")), (12, CLEAN)]
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_found"]) for r in decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == leaks(docs, [(1, item)])
    assert all(got[i, 1][0] == got[i, 1][1] for i in range(5)) and (12, 1) not in got and got[10, 1][1] < got[0, 1][1]


def test_template_tokens_equal_plain_version():
    rnd = random.Random(9)
    words = "a b the Élan école Ünal ünal Дом дом 12 3.5 1,000 two Twenty five kg days Mary Jane O ǅ 東京 𝐀b x1 X1 ß".split()
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "-", ", ", ".", "'", ",", "\n"]) for _ in range(rnd.randrange(30))) for _ in range(400)]
    made = decontaminate.Template(Scan([t.encode() for t in texts]))
    for i, t in enumerate(texts):
        own, plain = np.flatnonzero(made.doc == i), template(t)
        first = own[0] if len(own) else 0
        base = made.raw[first] if len(own) else 0
        assert [int(made.raw[j] - base) for j in own] == [at for *_, at in plain], t
        assert made.slots(first, len(own)) == [v for _, v, _ in plain if v is not None], t
    assert len(decontaminate.Template(Scan([])).hash) == 0


def test_short_items_do_not_drop_documents(spark):
    b = spark.createDataFrame([(1, "yes"), (2, "what is the capital city of France today")], "item_id long, text string")
    docs = [(1, "oh yes it is"), (2, "tell me what is the capital city of our land"), (3, "so, What is the capital city of Peru today?"), (4, CLEAN)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()} == {(1, 1), (3, 2)}
    assert {r["doc_id"] for r in decontaminate.drop_leaked(d, b).collect()} == {1, 2, 4}


def test_scan_tokens():
    s = Scan([b"Ab c1-\xc3\xa9", b"", b"zz", b"ab"])
    assert [s.data[a:b] for a, b in zip(s.start, s.stop, strict=True)] == [b"Ab", b"c1", "é".encode(), b"zz", b"ab"]
    assert s.doc.tolist() == [0, 0, 0, 2, 3] and s.hash[0] == s.hash[4] and len(set(s.hash.tolist())) == 4
    assert len(Scan([]).hash) == 0 and len(Scan([b"x" * 3000]).hash) == 1


def test_counts_and_scores_equal_brute_force(spark):
    rows = [(1, "the cat sat on the mat the cat"), (2, ""), (3, None), (None, "mat the"), (1, "the cat sat on the mat the cat")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    known, network = lm_score.train(df)
    table = network.table().reshape((lm_score.CLASSES,) * 3)
    counts = {r["word"]: r["n"] for r in lm_score.word_counts(df).collect()}
    assert sum(counts.values()) == 18 and max(counts.values()) == 7
    for r in lm_score.score(df, known, network).collect():
        text = next(t for k, t in rows if k == r["doc_id"])
        own = lm_score.classes(Scan([(text or "").encode()]), known)[1]
        padded = [0, *own.tolist(), 0]
        want = sum(float(table[padded[i - 1], padded[i + 1], padded[i]]) for i in range(1, len(padded) - 1))
        assert r["n_tokens"] == len(own) and abs(r["log_likelihood"] - want) < 1e-3
        assert (r["mean_log_likelihood"] is None) == (len(own) == 0)
    assert lm_score.train_and_score(df.filter("1 = 0")).collect() == []


def test_held_out_order_beats_shuffled_order_and_word_frequencies(spark, sf):
    rnd = random.Random(2)
    rows = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en' AND n_chars > 300").collect()]
    grammar = [" ".join(rnd.choice([["the", rnd.choice("cat dog bird".split()), "sees"], ["a", rnd.choice("cat dog bird".split()), "eats"]])[i % 3] for i in range(60)) for _ in range(80)]
    texts = rows + grammar
    train, held = texts[::2], grammar[1::2]
    known, network = lm_score.train(spark.createDataFrame([(t,) for t in train], "text string"))
    shuffled = [" ".join(rnd.sample(t.split(), len(t.split()))) for t in held]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(held + shuffled)], "doc_id long, text string")
    score = {r["doc_id"]: r["mean_log_likelihood"] for r in lm_score.score(df, known, network).collect()}
    n = len(held)
    assert sum(score[i] > score[n + i] for i in range(n)) >= 0.95 * n


def test_training_lowers_the_loss():
    counts = np.zeros(lm_score.CLASSES ** 3, np.int64)
    for left in range(1, 20):
        counts[(left * lm_score.CLASSES + left + 1) * lm_score.CLASSES + left + 2] = 50
    losses = lm_score.WindowNetwork().fit(counts)
    assert losses[-1] < 0.5 * losses[0]


def test_rare_words_have_scores_of_their_own_and_probabilities_add_up(spark):
    rnd = random.Random(5)
    many = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choice(many[:1 + rnd.randrange(400)]) for _ in range(60)) for _ in range(200)]
    known, network = lm_score.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert len(known) >= lm_score.FREQUENT and network.words.count() == len({w for t in texts for w in t.split()})
    rare = sorted({w for t in texts for w in t.split()} - {w for w in many if Scan([w.encode()]).hash[0] in known})
    counts = {r["word"]: r["n"] for r in network.words.collect()}
    hashed = {w: int(Scan([w.encode()]).hash.view(np.int64)[0]) for w in [*many, "unseen"]}
    alone = spark.createDataFrame([(i, w) for i, w in enumerate([*many, "unseen"])], "doc_id long, text string")
    got = {w: r["log_likelihood"] for w, r in zip([*many, "unseen"], lm_score.score(alone, known, network).orderBy("doc_id").collect(), strict=True)}
    own = {w: int(lm_score.classes(Scan([w.encode()]), known)[1][0]) for w in got}
    for c in {own[w] for w in rare}:
        same = sorted((w for w in rare if own[w] == c), key=lambda w: counts[hashed[w]])
        assert all(abs(got[b] - got[a] - np.log(counts[hashed[b]] / counts[hashed[a]])) < 1e-3 for a, b in zip(same, same[1:], strict=False))
    # every word of the corpus, and one unseen word in each shared class, have probability one together (classes without words aside)
    free = {c: -np.log(sum(n for w, n in ((w, counts[hashed[w]]) for w in rare) if own[w] == c) + 1) for c in {own[w] for w in rare}}
    left = network.table().reshape((network.size,) * 3)[0, 0]
    seen = sum(np.exp(got[w]) for w in hashed if w != "unseen" and hashed[w] in counts)
    assert abs(seen + sum(np.exp(left[c] + free[c]) for c in free) + sum(np.exp(left[c]) for c in range(network.size) if c not in set(own.values()) - {own["unseen"]} | set(free)) - 1) < 0.02


def test_classes_grow_with_the_corpus_and_gradients_add_up_over_partitions(spark, monkeypatch):
    rnd = random.Random(6)
    df = spark.createDataFrame([(i, " ".join(f"v{rnd.randrange(150)}" for _ in range(400))) for i in range(100)], "doc_id long, text string")
    known, whole = lm_score.train(df)
    assert len(known) == 150 > lm_score.FREQUENT and whole.size == 151 + lm_score.SHARED
    monkeypatch.setattr(lm_score, "LOCAL_TRIPLES", 0)
    monkeypatch.setattr(lm_score, "STEPS", 6)
    dealt = lm_score.train(df.repartition(5))[1]
    monkeypatch.setattr(lm_score, "NORMS", 0)
    a, b = (lm_score.score(df, known, n).agg({"log_likelihood": "sum"}).first()[0] for n in (whole, dealt))
    assert abs(a / b - 1) < 0.1
