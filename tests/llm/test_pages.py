import hashlib
import io

import pytest

from driftline.llm import html_extract as H
from driftline.llm import warc as W

LONG = "This is the running text of an article, long enough to count as such. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>hi", "hi"),
        ("<script>var a='</p>';if(a<b){}</script><p>a &lt;b&gt; &eacute;&#8364; c</p>", "a <b> é€ c"),
        (f"<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>T</h1><p>{LONG}</p><p>x\n  y</p></article><footer>foot</footer>", f"T\n{' '.join(LONG.split())}\nx y"),
        (f"<div class='cookie-notice'>We use cookies</div><div><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div>", " ".join(LONG.split())),
        (f"<main><aside>{LONG}</aside><form><p>{LONG}</p></form><p>one<br>two <i>th</i>ree</p></main>", "one two three"),
        (f"<div class=ad>buy<article><p>{LONG}</p></article>", " ".join(LONG.split())),
        (f"<p><b>{LONG}<br><p>second &amp;", f"{' '.join(LONG.split())}\nsecond &"),
        ("<!-- <p>no</p> --><style>p{}</style>", ""),
        ("a" * 300_000, "a" * 300_000),
    ],
)
def test_extract(page, text):
    assert H.extract(page) == text


def test_broken_markup_is_linear():
    for junk in ("<" * 100_000, "<p " * 50_000, '<a "' * 50_000, "<!-" * 50_000, "&" * 100_000):
        H.extract(junk)


def test_lines_without_an_article_follow_surge_and_dive():
    page = "<div>Start</div>" + "<div><a href=2>menu</a></div>" * 3 + "".join(f"<div>{LONG}{i}</div>" for i in range(3)) + "<div><a href=1>more</a></div>" * 4 + "<div>tiny</div>"
    assert H.extract(page) == "\n".join(f"{LONG}{i}" for i in range(3))


COMMENT = "A reader wrote this remark, long enough to look like text of its own. " * 3


@pytest.mark.parametrize(
    "page",
    [
        "<article><p>{}</p><section class=comments><article class=comment><p>{}</p></article></section></article>",
        "<article><p>{}</p><aside><article><p>{}</p></article></aside></article>",
        "<article><p>{}</p></article><div id=comments><article><p>{}</p></article></div>",
        "<article><p>{}</p></article><article class=comment><p>{}</p></article>",
    ],
)
def test_articles_of_comments_and_asides_are_no_text(page):
    assert H.extract(page.format(LONG, COMMENT)) == " ".join(LONG.split())


def test_articles_bound_the_runs():
    outer = f"<div><p>{COMMENT}</p></div>"
    assert H.extract(f"{outer}<article><p>{LONG}</p></article>{outer}<article><p>x</p></article>") == " ".join(LONG.split())
    assert H.extract(f"{outer}<article><p>{LONG}</p></article><article><p>x</p></article>{outer}") == f"{' '.join(LONG.split())}\nx"
    assert H.extract(f"<article><p>{LONG}</p></article><div>{COMMENT * 9}</div>") == f"{' '.join(LONG.split())}\n{' '.join((COMMENT * 9).split())}"  # twice as dense
    assert H.extract(f"{outer}<article><p>x</p></article>") == " ".join(COMMENT.split())
    assert H.extract(f"<div class=widget><article><p>{LONG}</p></article></div>") == " ".join(LONG.split())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1><a href=/x>Title</a></h1><p>{LONG}</p><ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li><li><a>four</a></li></ul><p>end</p></article>", f"Title\n{' '.join(LONG.split())}\none\ntwo\nthree\nfour\nend"),
        (f"<article><h1><a href=/x>Title</h1><p>{LONG}</p><p>end</p></article>", f"Title\n{' '.join(LONG.split())}\nend"),
        (f"<div><a href=/x>Open</div><div>{LONG}</div><div>end</div>", f"{' '.join(LONG.split())}\nend"),
        (f"<div>{LONG}</div><div><a href=/x>{LONG}</a></div><div>end</div>", f"{' '.join(LONG.split())}\n{' '.join(LONG.split())}\nend"),
        (f"<div>{LONG}</div>" + f"<a href=1><div>{COMMENT}</div><div>{COMMENT}</div></a>" * 2, " ".join(LONG.split())),
        ("<article><a href=/x>only</a></article>", "only"),
        (f"<div>{LONG}</div><article class=card><a href=/x>{COMMENT}</a></article>", " ".join(LONG.split())),
    ],
)
def test_links_find_the_runs_but_drop_no_line_of_them(page, text):
    assert H.extract(page) == text


@pytest.mark.parametrize("element", ["<h2 id=related-work>", "<h2 id=share-prices>", "<h2 class=banner>", "<p id=notice-period>", "<p id=comments>", "<div class=overflow-hidden>", "<div class='layout no-sidebar'>", "<div title='A hidden treasure'>", "<p data-class=ad data-x='class=ad id=ads'>", "<span class=comment>", "<div class='hidden md:block'>", "<section id=cookie-recipes>"])
@pytest.mark.parametrize("around", ["<div>{}</div>", "<article>{}</article>"])
def test_names_that_hold_an_unwanted_word_are_kept(element, around):
    end = f"</{H.re.match('<([a-z0-9]+)', element)[1]}>"
    assert H.extract(around.format(f"<p>{LONG}</p>{element}Some text{end}")).replace("\n", " ") == f"{' '.join(LONG.split())} Some text"


@pytest.mark.parametrize("element", ["<div class='x ad'>", "<div class=ad-300x250>", "<section id=related-posts>", "<ul class='share-buttons'>", "<p class=Newsletter_Signup>", "<div id=\"disqus_thread\">", "<h2 class=sr-only>", "<p hidden>", "<p title='>' style='color:red; display : none'>", "<p aria-hidden=TRUE>", "<div role=navigation>", "<main hidden>"])
def test_whole_unwanted_names_are_dropped(element):
    end = f"</{H.re.match('<([a-z0-9]+)', element)[1]}>"
    assert H.extract(f"<article><p>{LONG}</p>{element}{COMMENT}{end}</article>") == " ".join(LONG.split())


@pytest.mark.parametrize("size", [0, 500, 999, 1000, 1500, 100_000])
@pytest.mark.parametrize("quote", ["\"", "'"])
def test_quoted_values_of_any_size_are_no_text(size, quote):
    for value in ("<b>" + "y" * size, "<script>" + "y" * size + "<style>", "y" * size + "</div><p>no"):
        assert H.extract(f"<div data-x={quote}{value}{quote} data-y = {quote}>{quote}>Text</div><p>more") == "Text\nmore"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<main><p><a href="foo>{LONG}</a><p>end', f"{' '.join(LONG.split())}\nend"),
        (f'<article><p><a href="foo>{LONG}</a></p><p class="x">end</p></article>', f"{' '.join(LONG.split())}\nend"),
        ("<p title=it's>one</p><p>two's</p>", "one\ntwo's"),
        ('<p a"b>one</p><p>two"</p>', 'one\ntwo"'),
        ("<p>a <b and c < d", "a <b and c < d"),
        ("<p>text</p><p clas", "text"),
    ],
)
def test_unpaired_quotes(page, text):
    assert H.extract(page) == text


def test_broken_values_are_linear():
    for junk in ('<a x="<b y=z" ' * 50_000, '<a x="<"' + 'y="<b "' * 50_000, '<a x=">" ' * 50_000, "<a x='<b \"" * 50_000, '<a x="' * 50_000, "<a x= " * 50_000, '<a x="<b \'="' * 50_000):
        H.extract(junk)


def test_many_open_elements_are_linear():
    for junk in ("<b>" * 50_000 + "<div></div>" * 50_000, "<div class=ad>" * 50_000 + "<article>", "<a><p></a>" * 50_000, "<td><p><i>" * 50_000):
        H.extract(junk)


PLAIN = " ".join(LONG.split())


def test_windows_tell_the_article_from_the_rest(data):
    """Without the windows' choice nearly each page has text that does not belong to the article."""
    import pyarrow.parquet as pq

    html = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    own = [H.extract(x) for x in html]
    assert sum("\n".join(y.text for y in H.lines(x or "")) != t for x, t in zip(html, own)) > 0.9 * len(html)


@pytest.mark.parametrize(
    "page",
    [
        "<div><div><a href=1>Home</a></div><div><a href=2>News</a></div><div><a href=3>About</a></div></div><div><div>{0}</div><div>{0}</div><div>Of.</div></div><div><div><div><div>All rights</div></div></div></div>",
        "<div><div><div>Slogan</div></div></div><div><div><div><b>{0}</b></div><div>{0}</div><div>Of.</div></div></div><div><div><a href=1>one</a><a href=2>two</a></div></div>",
        "<table><tr><td><a href=1>x</a><td><a href=1>y</a></table><table><tr><td><p>{0}<p>{0}<p>Of.</table><table><tr><td><table><tr><td>small print</table></table>",
    ],
)
def test_pages_without_telling_tags_or_names(page):
    assert H.extract(page.format(PLAIN)) == f"{PLAIN}\n{PLAIN}\nOf."


def test_what_looks_like_a_menu_inside_the_text_survives():
    page = "<div>{0}</div><div class=related-work><h2>Related work</h2><p>see <a href=x>a long title of another text</a></p></div><div>{0}</div>".format(PLAIN)
    text = f"{PLAIN}\nRelated work\nsee a long title of another text\n{PLAIN}"
    assert H.extract(page) == text
    assert H.extract(f"<article>{page}</article>") == text


def test_lines_aside_inside_an_article_interrupt_nothing():
    page = "<article><p>{0}</p><div class=ad>Buy</div><nav><a href=1>next</a></nav><p>Of.</p><footer>by me</footer></article>"
    assert H.extract(page.format(PLAIN)) == f"{PLAIN}\nOf."


def test_extract_pages_takes_odd_tables(spark):
    rows = [(None, "u", None, "mine", 1), (1, None, f"<p>{PLAIN}", None, 2), (1, None, f"<p>{PLAIN}", None, 2), (2, "", "", "x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, TEXT_input int")
    got = H.extract_pages(df)
    assert got.columns == ["page_id", "url", "text_input_", "TEXT_input", "text"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(None, "u", "mine", 1, ""), (1, None, None, 2, PLAIN), (1, None, None, 2, PLAIN), (2, "", "x", None, "")], key=str)
    assert H.extract_pages(df.limit(0)).count() == 0
    assert H.extract_pages(df.select("html").filter("html <> ''").limit(1), text_col="html").collect()[0][0] == PLAIN


def test_sf_pages(spark, data):
    got = H.extract_pages(spark.read.parquet(f"{data}/pages.parquet")).collect()
    assert len(got) == 50
    assert all(r.text and "<" not in r.text for r in got)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def archive(spark, tmp_path, rows):
    path = f"file://{tmp_path}/w"
    W.write(W.page_records(pages(spark, rows)), path)
    return path


def test_round_trip_with_revisits(spark, tmp_path):
    big, small = "<p>é" * 400, "<p>small"
    rows = [(1, "http://a/ b\r\nX: y", big), (7, None, big), (3, "u", big), (4, "u", small), (5, "u", small), (6, "", None), (None, "n", big), (8, "v", ""), (7, "again", big)]
    got = sorted(W.page_index(spark, archive(spark, tmp_path, rows)).collect(), key=str)
    exp = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = h == big and i is not None and i != 7
        exp.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 7 if again else None))
    assert sorted([tuple(r) for r in got], key=str) == sorted(exp, key=str)


def test_pushdown_skips_payloads_and_rejects_by_header(spark, tmp_path, monkeypatch):
    path = archive(spark, tmp_path, [(i, f"http://h{i % 2}/p", f"<p>{i} " * 300) for i in range(40)])
    uris = W.read(spark, path, "target_uri string, warc_type string").filter("target_uri = 'http://h1/p' and warc_type = 'response'")
    assert uris.count() == 20
    plan = uris._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and ") Filter" not in plan  # done by the source
    decoded = []
    real = W._split_block
    monkeypatch.setattr(W, "_split_block", lambda b, k: decoded.append(len(b)) or real(b, k))
    part = W.plan(path)[0]
    with open(part.file, "rb") as f:
        seen = list(W.records(W._Source(f, 0, part.end), lambda h: h["warc-target-uri"] == "http://h1/p", False))
    assert len(seen) == len(decoded) and max(decoded) < 2048


def test_plain_and_foreign_gzip_records():
    import gzip

    body = b"x" * 70_000
    one = W.record("response", "urn:x-page:1", "http://a", None, hashlib.sha1(body).hexdigest(), len(body), body, "2020-01-01T00:00:00Z")
    for raw in (one * 3, gzip.compress(one) * 3, W.member(one) * 3):
        for payload in (True, False):
            got = list(W.records(W._Source(io.BytesIO(raw), 0, len(raw)), lambda h: True, payload))
            assert [(p if payload else body) for _, _, p in got] == [body] * 3
            assert all(h["content-length"] == str(len(body)) for _, h, _ in got)
    assert W.digest_hex(W.digest_header("0" * 39 + "a")) == "0" * 39 + "a"


def test_empty_archive(spark, tmp_path):
    assert W.page_index(spark, archive(spark, tmp_path, [])).count() == 0


def test_overwrite_replaces_and_append_adds(spark, tmp_path):
    path = f"{tmp_path}/w"  # without scheme: the default file system
    rows = lambda *ids: W.page_records(pages(spark, [(i, "u", f"<p>{i}") for i in ids]))
    ids = lambda: sorted(r.page_id for r in W.page_index(spark, path).collect())
    W.write(rows(1, 2, 3), path)
    W.write(rows(4), path)
    assert ids() == [1, 2, 3, 4]
    W.write(rows(5, 6), path, "overwrite")
    assert ids() == [5, 6]
    rows(7).write.format("warc").mode("overwrite").save(path)
    assert ids() == [7]
    W.write(rows(8), path)
    assert ids() == [7, 8]
    assert sum(f.name.endswith(".warc.gz") for f in (tmp_path / "w").iterdir()) == 2


def test_long_http_headers_are_read_without_the_payload():
    body = b"x" * 5000
    http = b"HTTP/1.1 200 OK\r\nX: " + b"h" * 9000 + b"\r\nContent-Length: 5000\r\n\r\n"
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(http + body) + http + body + b"\r\n\r\n"
    for raw in (one * 3, W.member(one) * 3):
        for payload in (True, False):
            got = list(W.records(W._Source(io.BytesIO(raw), 0, len(raw)), lambda h: True, payload))
            assert [x["content-length"] for _, x, _ in got] == ["5000"] * 3
            assert all(p == (body if payload else None) for _, _, p in got)


def test_many_repeated_digests_are_joined_by_shuffle(spark, tmp_path, monkeypatch):
    rows = [(i, "u", f"<p>{i % 7} " * 400) for i in range(40)]
    few = sorted(map(tuple, W.page_index(spark, archive(spark, tmp_path, rows)).collect()), key=str)
    monkeypatch.setattr(W, "BROADCAST_DIGESTS", 0)
    assert sorted(map(tuple, W.page_index(spark, archive(spark, tmp_path / "x", rows)).collect()), key=str) == few
    assert sum(r[3] == "response" for r in few) == 7
