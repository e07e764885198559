from tabweave.llm import html_text, url_filter

PAGE = "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li>Home</li></ul></nav><div class='ad'>Buy</div>{main}<div id=\"comments\">Nice!</div><footer>&copy; x</footer></body></html>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as host", "'z' as bucket")


def texts(df):
    return {(r["page_id"], r["text"], r["n_chars"]) for r in df.collect()}


def test_main_text(spark):
    main = "<article><header><h1>A &amp; B</h1></header><p>one \n two<br>three<p>f&uuml;r <b>x</b>y<aside>side</aside><form>f</form></article>"
    out = html_text.extract(pages(spark, [(1, "http://a.b/c", PAGE.replace("{main}", main)), (2, None, None), (3, "nohost", ""), (1, "http://a.b/c", PAGE.replace("{main}", main))]))
    want = "A & B\none two\nthree\nfür xy"
    assert texts(out) == {(1, want, len(want)), (2, "", 0), (3, "", 0)} and out.count() == 4


def test_shared_lines_go_where_no_main_element_marks_the_text(spark):
    rows = [(i, f"http://h/x/{i}", f"<div>Menu</div><div>All rights</div><p>Story {i}</p><div>Bye</div>") for i in range(9)]
    rows += [(100, "http://other/", "<div>Menu</div><p>Alone</p>")]
    for size in (2, 5000):
        got = texts(html_text.extract(pages(spark, rows), rows_a_bucket=size))
        assert got == {(i, f"Story {i}", 7) for i in range(9)} | {(100, "Menu\nAlone", 10)}


def test_broken_pages(spark):
    assert html_text.lines_of("<p>a<!-- b <p>c") == [("o", "a")]
    assert html_text.lines_of("a <b and 3 < 4 & 5<p") == [("o", "a <b and 3 < 4 & 5")] or html_text.lines_of("x<p")[0][1] == "x"
    assert html_text.lines_of("<article>x<script>1") == [("m", "x")]
    assert html_text.lines_of("<div hidden>no</div><p title='>'>yes</p>") == [("a", "no"), ("o", "yes")]
    assert len(html_text.lines_of("<p>w</p>" * 20000)) == 20000


def test_hostile_pages_take_time_in_proportion():
    import time

    for piece in ('<a "', "<a '", '<a b="', "<a b='", "<!--", "<", "</", "<a b=c ", "<p>x", "'\"<>", '<div class="ad">', "&amp;<"):
        start = time.process_time()
        html_text.lines_of(piece * ((1 << 20) // len(piece)))
        assert time.process_time() - start < 3, piece


def test_class_names_and_quotes():
    page = '<article>a<div class="share-price"><p>The share price rose</div><p class="related-work">more<p title="hidden role=nav">seen<div class="x cookie-banner top">no</div><div id="comments_list">no</div>b</article>'
    assert [x for p, x in html_text.lines_of(page) if p == "m"] == ["a", "The share price rose", "more", "seen", "b"]
    assert html_text.lines_of('<p title="it>text') == [("o", "text")] and html_text.lines_of("<p title=\"a>b\" id='>'>text</p>") == [("o", "text")]


def test_clashing_columns_do_no_harm(spark, clashes):
    rows = [(1, "http://h/a", "<p>x</p>"), (2, "http://h/b", "<p>y</p>")]
    df = pages(spark, rows)
    for c in ("key", "parts", "lines", "context", "sort_key", *clashes):
        if c not in df.columns:
            df = df.withColumn(c, df["url"])
    assert texts(html_text.extract(df)) == {(1, "x", 1), (2, "y", 1)}


def test_longest_common_subsequence():
    assert html_text.shared(list("abcbdab"), list("bdcaba")) and len(html_text.shared(list("abcbdab"), list("bdcaba"))) == 4
    assert html_text.shared([], ["a"]) == set()


def test_empty_pages(spark):
    assert html_text.extract(pages(spark, [])).count() == 0


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def test_verdicts(spark):
    urls = ["http://A.Example.NET/en/x?y", "https://example.net/de/", "http://bad.com", "http://x.bad.com/a#b", "http://notbad.com/", "http://example.com/de/1", "http://q.org/fr/", "http://net", None, "bad.com", "://bad.com/p"]
    blocked = spark.createDataFrame([("bad.com",), ("bad.com",), (None,), ("",)], "entry string")
    df = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").selectExpr("*", "'c' as host", "'c' as verdict")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, blocked, RULES).collect()}
    assert out[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert out[1] == ("example.net", "/de/", "net/", "block")
    assert out[2] == ("bad.com", "", None, "block") and out[3] == ("x.bad.com", "/a", None, "block") and out[4][3] == "allow"
    assert out[5][2:] == ("example.com/de/", "block") and out[6][2:] == ("org/fr/", "allow") and out[7] == ("net", "", None, "allow")
    assert out[8] == ("", "", None, "allow") and out[9] == ("", "", None, "allow") and out[10] == ("bad.com", "/p", None, "block")
    assert url_filter.judge(df, blocked.limit(0), RULES).count() == 12 and url_filter.judge(df.limit(0), blocked, RULES).count() == 0


def test_verdicts_without_broadcast_and_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(url_filter, "SHARD", 8)
    urls = [f"http://h{i % 40}.s{i % 7}.com/{i}" for i in range(400)] + [f"http://{'a.' * 3000}s1.com/{'b' * 30000}"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    blocked = spark.createDataFrame([(x,) for x in [*(f"h{i}.s{i % 7}.com" for i in range(0, 40, 3)), "s1.com"]], "entry string")
    listed = {r[0] for r in blocked.collect()}
    for r in url_filter.judge(df, blocked).collect():
        parents = r["host"].split(".")
        assert (r["verdict"] == "block") == any(".".join(parents[k:]) in listed for k in range(len(parents)))


def test_digest_array_confirms_strings():
    a = url_filter.DigestArray(["x", "y", "x"])
    a.strings[0] = "other"  # as if two strings had one key
    assert list(a.holds(["x", "y", "z"])).count(True) == 1
    assert not url_filter.DigestArray([]).holds(["x"]).any()


def test_compound_names_of_comments_and_adverts(spark):
    from tabweave.llm import html_text

    page = "<html><body class='has-comments'><article class='post no-comments'><p>Kept.</p>{}</article></body></html>"
    out = [f"<{t} {a}='{n}'>out</{t}>" for t, a, n in (("div", "class", "user-comments"), ("section", "id", "reader-comments"), ("div", "class", "adsbygoogle"), ("div", "class", "x story_ads"), ("ul", "class", "all-replies"))]
    kept = ["<div class='share-price'>kept</div>", "<p class='menu-card'>kept</p>", "<p class='commentary'>kept</p>", "<p class='comments-policy-text-of-ours'>kept</p>"]
    rows = [(i, f"http://h{i}/p", page.format(x)) for i, x in enumerate(out + kept)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(rows))] == ["Kept."] * len(out) + ["Kept.\nkept"] * len(kept)
