"""HTML extraction and WARC files."""

import random

import pytest

from echoloom.llm import html_text, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">buy <div>now</div> this</div>
<article><h1>Head &amp; line</h1><p><b>first   {n}<br>more</p><p>second &lt;b&gt; &#233;<aside>side</aside>tail<div id="comments"><p>comment</p></div>
<form><input value=">">send</form><ul><li>one<li>two</ul></article><footer>foot</footer></body></html>"""


def test_article_is_cut_out():
    inside, free = html_text.blocks(PAGE.format(n=1))
    assert inside == ["Head & line", "first 1 more", "second <b> é", "tail", "one", "two"] and free == []


def test_odd_markup_does_not_break():
    for h in ["", "<", "<p", "a < b", "<article>x", "</article>y", "<nav>lost", "<p class=ad>gone<p>kept", "<script>x", "<div class='sidebar'><p>a</div>b", "&#xZZ;&bogus;", "<" * 5000, "<div>" * 3000 + "x"]:
        html_text.blocks(h)
    assert html_text.blocks("<p class=ad>gone<p>kept")[1] == ["kept"]
    assert html_text.blocks("<div class='sidebar'><p>a</div>b")[1] == ["b"]
    assert html_text.blocks("<p>a<br>b&nbsp; c</p><p> </p>d")[1] == ["a b c", "d"]
    assert html_text.blocks("<p class='read adventure'>kept</p>")[1] == ["kept"]
    assert html_text.blocks("<div class='page with-sidebar no-ads'><p>kept</p><div class='left sidebar'>gone</div></div>")[1] == ["kept"]


def test_hints_are_whole_names_and_end_with_their_parent():
    for c in ("post category-social", "hentry comments-open", "sidebar"):
        assert html_text.blocks(f"<div class='widget'><article class='{c}'><p>kept</p></article></div>")[0] == ["kept"]
    page = "<article><section id='related-work'><h2 id='search'>Search</h2>kept</section><div class='ad'>gone<p>gone</article><p>free</p>"
    assert html_text.blocks(page) == (["Search", "kept"], ["free"])
    assert html_text.blocks("<article>a<ul><li class=ad>gone<div>gone</div><li>b</ul><div class=related><article>gone</article></div>c</article>")[0] == ["a", "b", "c"]


def test_common_lines_is_a_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        left, right = html_text.common_lines(a, b)
        assert [a[i] for i in left] == [b[j] for j in right] and len(left) == best[-1][-1]
        assert left == sorted(set(left)) and right == sorted(set(right))


def test_lines_that_neighbours_share_are_deleted(spark):
    def page(n):
        return f"<body><p>Our site</p><p>Text number {n} is long and {n * 7} is its own.</p><p>Contact us</p></body>"
    rows = [(n, f"http://h.org/a/{n:03d}", page(n)) for n in range(60)] + [(100, "http://one.org/x", page(100)), (101, None, page(101)), (102, "http://c.org/1", page(5)), (103, "http://c.org/2", page(5)),
                                                                         (None, "http://n.org/", None), (104, "http://a.org/1", PAGE.format(n=2)), (104, "http://a.org/1", PAGE.format(n=2))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, host string").repartition(7)
    got = html_text.extract(df).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(by[n] == f"Text number {n} is long and {n * 7} is its own." for n in range(60))
    assert by[100].startswith("Our site\n") and by[101].startswith("Our site\n")        # no neighbour, no template
    assert by[102] == by[103] and by[102].count("\n") == 2                               # copies delete nothing
    assert by[None] == "" and by[104].startswith("Head & line\nfirst 2 more")
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.filter("1 = 0")).collect() == []


def test_short_pages_and_runs_of_equal_pages_lose_the_template(spark):
    top = "".join(f"<p>Template line {i} of this site, the same everywhere, {'x' * 70}</p>" for i in range(5))
    long = " and so on with more and more words of its own" * 40
    rows = [(n, f"http://s.org/{n:03d}", f"{top}<p>Page {n}</p>") for n in range(30)]                       # nearly all template
    rows += [(100 + n, f"http://e.org/{n:03d}", f"{top}<p>Text {n if n < 10 or n > 13 else 'copied'}{long}</p>") for n in range(25)]
    rows += [(200 + n, f"http://c.org/{n}", f"<p>A long article text{long}</p><p>version {n}</p>") for n in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 9):
        by = {r["page_id"]: r["text"] for r in html_text.extract(df.repartition(parts)).collect()}
        assert all(by[n] == f"Page {n}" for n in range(30))
        assert all(by[100 + n] == f"Text {n if n < 10 or n > 13 else 'copied'}{long}" for n in range(25))
        assert all("article" in by[200 + n] for n in range(2))                                             # two copies, no third page


def pages(n=40):
    rnd = random.Random(3)
    rows = [(i, f"http://h/{i}", "".join(rnd.choice("abc <>é") for _ in range(rnd.randint(0, 3000)))) for i in range(n)]
    return rows + [(n, "http://h/x", rows[3][2]), (n + 1, None, rows[3][2]), (n + 2, "u\r\nX-Evil: 1", None), (n + 3, "v", ""), (None, "w", ""), (n + 3, "v", "")]


def test_round_trip_and_revisits(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, k int").repartition(3)
    root = str(tmp_path / "w")
    files = warc.write_archive(df, root, roll=2000).collect()
    assert len(files) > 3 and len({f["file"] for f in files}) == len(files) and sum(f["n_records"] for f in files) == len(rows)
    got = warc.read_archive(spark, root).collect()
    newest = {}
    for k, _, h in rows:
        if k is not None:
            newest[h or ""] = max(newest.get(h or "", k), k)
    want = sorted(((k, len((h or "").encode()), warc.base32_sha1((h or "").encode()), "response" if newest[h or ""] == k else "revisit", None if newest[h or ""] == k else newest[h or ""])
                   for k, _, h in rows), key=str)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == want
    assert all(r["payload"].decode() == (dict((k, h) for k, _, h in rows)[r["page_id"]] or "") for r in got if r["payload"] is not None and r["page_id"] is not None)
    assert [r["url"] for r in got if r["page_id"] == 42] == ["u%0D%0AX-Evil: 1"]


def test_files_do_not_depend_on_partitions(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    made = [sorted(map(tuple, warc.write_archive(df.repartition(n), str(tmp_path / str(n)), roll=2000).collect())) for n in (1, 6)]
    assert made[0] == made[1] and not list((tmp_path / "6" / "temporary").iterdir())
    assert all((tmp_path / "1" / "files" / f[0]).read_bytes() == (tmp_path / "6" / "files" / f[0]).read_bytes() for f in made[0])


def test_archives_are_read_back_by_several_tasks(spark, tmp_path):
    df = spark.range(3000).selectExpr("id page_id", "concat('http://h/', id) url", "repeat(cast(id AS string), 50) html")
    n = warc.write_archive(df, str(tmp_path / "w")).count()
    back = warc.read_archive(spark, str(tmp_path / "w"))
    assert n > 8 and back.count() == 3000 and back.rdd.getNumPartitions() == n


def test_damage_is_noticed_and_empty_tables_work(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    assert warc.round_trip(df.filter("1 = 0")).collect() == []
    data = warc.record(1, "u", b"payload", None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(data.replace(b"payload", b"paylord"))
    assert [warc.parse(m)["page_id"] for m in warc.members(__import__("io").BytesIO(warc.member(data) * 3), 7)] == [1, 1, 1]


def test_a_heavy_cell_is_dealt_to_several_shards(spark):
    rows = [(1, 10)] + [(10 ** 12, 5000)] * 400 + [(None, 5)]
    df = spark.createDataFrame([(k, b, str(i), str(i)) for i, (k, b) in enumerate(rows)], "k long, bytes long, url string, digest string")
    out = warc.with_shards(df).collect()
    assert len(out) == len(rows) and len({r["shard"] for r in out if r["k"] == 10 ** 12}) > 10
