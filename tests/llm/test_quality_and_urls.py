"""Quality rules and URL filter: brute force, odd rows, host verdicts, trust flow."""

import random

from brute import measures

from echoloom.llm import quality_rules, url_filter
from echoloom.llm.queries import URL_RULES

ODD = [None, "", "  \n\t\v", "a", "a b c d e f g h i j", "x y z w v " * 6, "é É ü #*$%&|<> 1\n\nsame line\nsame line\n same line", "word " * 5000,
       "a\x0bb\x0cc\rd\te", "one two three four five six seven eight nine ten eleven one two three four five", "z" * 100_000]


def frame(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


def test_measures_equal_brute_force(spark):
    rnd = random.Random(5)
    texts = ODD + [" ".join(rnd.choice(["a", "b", "cc", "d#"]) + rnd.choice(["", "\n", " "]) for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
           for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert got == {i: measures(t) for i, t, _ in rows}


def test_bad_host_is_rejected_and_good_one_kept(spark):
    good = "these are ten different words that make one clean text"
    rows = [(i, good + f" {i}", "clean") for i in range(40)] + [(100 + i, "too short", "junk") for i in range(39)] + [(200, good, "junk"), (300, good, None)]
    out = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert out[0]["kept"] and not out[0]["base_failed"]
    assert not out[200]["base_failed"] and not out[200]["kept"]
    assert out[300]["kept"] and out[300]["host"] is None
    kept = quality_rules.keep_good(frame(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in out.items() if r["kept"]}


def test_clashing_columns_repeats_and_empty_tables(spark):
    good = "these are ten different words that make one clean text"
    schema = "doc_id long, text string, source string, n_words int, host string, k0 string, packed_row string, w int"
    df = spark.createDataFrame([(1, good, "a", 5, "h", "k", "p", 7), (1, good, "a", 5, "h", "k", "p", 7), (None, good, None, None, None, None, None, None)], schema)
    assert quality_rules.keep_good(df).columns == df.columns
    assert sorted(map(str, quality_rules.keep_good(df).collect())) == sorted(map(str, df.collect()))
    assert quality_rules.judge(df).count() == 3
    none = df.filter("1 = 0")
    assert quality_rules.judge(none).collect() == [] and quality_rules.keep_good(none).collect() == []


def test_rules_and_url_parts(spark):
    urls = ["https://a.com/x?y#z", "HTTP://WWW.Example.com/en/1", "http://m.example.com/en/", "http://example.com/fr/", "http://x.net/es/a", "http://x.net/es",
            "http://b.net?x/es/", "no scheme", None, "http://com", "http://notexample.com/en/", "a://b://c/d", "http://ÄX.org/\npath?q", ""]
    got = url_filter.judge(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string"), URL_RULES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow")
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("m.example.com", "/en/", "example.com/en/", "block")
    assert got[3][2:] == ("com/", "allow")
    assert got[4][2:] == ("net/es/", "block")
    assert got[5][2] is None and got[6][:3] == ("b.net", "", None)
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("com", "", None, "allow")
    assert got[10][2] == "com/"
    assert got[11][:2] == ("b:", "//c/d")
    assert got[12][:2] == ("Äx.org", "/\npath")


def test_distrust_runs_against_links_and_trust_along(spark):
    def a(*hosts):
        return "".join(f'<a href="http://{h}/1">x</a>' for h in hosts)
    pages = [(1, "http://good.com/1", a("friend.org", "self.com")), (2, "http://bad.net/es/1", a("victim.org")), (3, "http://fan.org/1", a("bad.net")),
             (4, "http://friend.org/1", a("fan2.org")), (5, "http://far.org/1", a("fan.org")), (6, "http://victim.org/", None), (7, "http://mixed.org/", a("bad.net")),
             (8, "http://good.com/2", a("mixed.org", "mixed.org"))]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got[3]["verdict"] == "block" and got[5]["verdict"] == "block"       # they lead to a blocked host
    assert got[4]["verdict"] == "allow" and got[4]["trust"] > 0
    assert got[6]["verdict"] == "allow"                                        # being linked from a blocked host is no guilt
    assert got[7]["trust"] > 0 and got[7]["distrust"] > 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).collect() == []


def plain_masses(links, seeds, unit, rest):
    """{host: [trust, distrust]} by walking the definitions."""
    out = {}
    now = {(k, h): unit // sum(x == k for x in seeds.values()) for h, k in seeds.items()}
    edges = {"trust": links, "distrust": {(b, a) for a, b in links}}
    while now:
        for (k, h), m in now.items():
            out.setdefault(h, [0, 0])[k == "distrust"] += m
        if sum(now.values()) <= rest:
            break
        then = {}
        for (k, h), m in now.items():
            to = [b for a, b in edges[k] if a == h]
            for b in to:
                then[k, b] = then.get((k, b), 0) + (m // 100 * 85 + m % 100 * 85 // 100) // len(to)
        now = {k: m for k, m in then.items() if m}
    return out


def test_flow_reaches_far_hosts_and_equals_its_twin(spark):
    import duckdb

    from echoloom.llm import queries

    links = {(f"c{i}.org", f"c{i + 1}.org") for i in range(40)} | {("c40.org", "bad.net"), ("good.com", "r0.org")}
    links |= {(f"r{i}.org", f"r{(i + 1) % 7}.org") for i in range(7)} | {("hub.org", f"h{i}.org") for i in range(300)} | {("good.com", "hub.org"), ("h5.org", "c3.org")}
    hosts = sorted({h for e in links for h in e})
    pages = [(i, f"http://{h}/es/{i}", "".join(f'<a href="http://{b}/x">t</a>' for a, b in sorted(links) if a == h)) for i, h in enumerate(hosts)]
    got = {r["host"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    want = plain_masses(links, {"bad.net": "distrust", "good.com": "trust"}, url_filter.UNIT, url_filter.REST)
    assert {h: (r["trust"], r["distrust"]) for h, r in got.items()} == {h: tuple(want.get(h, (0, 0))) for h in hosts}
    assert got["c0.org"]["verdict"] == "block" and got["c0.org"]["distrust"] > 0          # 41 links away
    assert got["h299.org"]["trust"] > 0 and got["r6.org"]["verdict"] == "allow"
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    rel = con.execute(queries.oracles()["op3_url_filter"])
    cols = [d[0] for d in rel.description]
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in got.values())
