import re
from html import unescape

from docveil.llm import html


def text(page, templates=()):
    return html.main_text(html.parse(page), set(templates))


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Top</header><nav><ul><li><a href="/x">x</a></ul></nav><!-- c <p>no</p> --><div class="ad big">Buy</div>
    <div id="cookie-notice">We use</div><article class="post"><header><h1>One &amp; <b>two</b></h1></header>
    <p>First  line<br>goes\n on &lt;here&gt; <a href='a>b'>link</a>.<p>Second &eacute;&#233;
    <form><input>Mail</form><aside>Also</aside><section class="comments"><p>Great!</p></section>
    <ul><li>a<li>b</ul><script>x</script></article><div class="sidebar">s</div><footer>&copy;</footer></body></html>"""
    assert text(page) == "One & two\n\nFirst line goes on <here> link.\n\nSecond éé\n\na\n\nb"


def test_odd_markup():
    assert text("") == "" and text("a < b & c") == "a < b & c"
    assert text("<p>one<div>two</div>three") == "one\n\ntwo\n\nthree"
    assert text("<script>never closed <p>x") == "" and text("x<!-- open") == "x"
    assert text("<p title='a>'>q</p>r") == "q\n\nr"
    assert text("</p></div>t") == "t"
    assert text("<b>" * 3000 + "deep") == "deep"


def test_names_that_only_speak_of_marks():
    story = "<p>A long story that goes on and on.</p><p>More of it, and a <a href='/'>link</a>.</p>"
    want = "A long story that goes on and on.\n\nMore of it, and a link."
    for name in ("content with-sidebar", "layout has-menu", "post comments-open", "promo-free", "share-page", "no-ads", "research-related"):
        for attr in ("class", "id"):
            assert text(f'<body><div {attr}="{name}">{story}</div><div class="sidebar">Side</div></body>') == want, name
    for name in ("sidebar", "left-sidebar", "site-footer", "ad-slot", "x cookie-notice", "newsletter_box", "comments-area", "social-links"):
        assert text(f'<body><div class="x">{story}</div><div class="{name}">Besides</div></body>') == want, name


def test_what_holds_most_of_a_page_is_the_page():
    story = "<p>A long story that goes on and on.</p><p>More of it, at some length.</p>"
    want = "A long story that goes on and on.\n\nMore of it, at some length."
    for around in ('<div class="sidebar">', '<form action="x">', '<div role="search"><aside>', '<div class="modal"><div class="popup"><nav>'):
        assert text(f"<body>{around}{story}<nav><a>Next</a></nav></body>") == want, around
    for gone in ('<div class="comments">', "<div hidden>", '<div style="display: none">'):
        assert text(f"<body><p>Short.</p>{gone}{story}{story}</div></body>") == "Short.", gone


def test_self_closed_elements():
    assert text('<p>a</p><svg class="i"/><p>b</p>') == "a\n\nb" and text("<p>Let <math><mi>x</mi> = 1</math> be<math/> so</p><p>b</p>") == "Let x = 1 be so\n\nb"
    assert text('<svg class="a/b"><text>t</text></svg>c') == "c" and text("<script src=/a/b.js>v<p>no</p></script>yes") == "yes"
    assert text("<p>a</p><iframe src='/x'/><p>b</p><object/>c") == "a\n\nb\n\nc"
    assert text('<script src="x"/>var t;</script><p>k</p>') == "k", "a script is not closed by its own tag"


def rows_of(n):
    for i in range(n):
        yield (i, f"http://A.example/{i}", f"<body><div>Site menu of all</div><div><p>Story {i} tells</p><p>{'even' if i % 2 else 'odd'} more {i // 2}</p></div></body>", "t")


def test_templates_recur_by_host(spark):
    rows = [*rows_of(10), (50, "http://b.example/", "<div>Site menu of all</div><p>Alone</p>", "t"), (51, None, None, None), (52, "", "", "t"), (52, "", "", "t")]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for i in range(10):
        assert out[i] == f"Story {i} tells\n\n{'even' if i % 2 else 'odd'} more {i // 2}"
    assert out[50] == "Site menu of all\n\nAlone" and out[51] == out[52] == ""
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copied_articles_stay(spark):
    rows = [(i, "http://c/", f"<div>Site</div><article><p>The same article</p><ul><li><a>Next</a></li></ul></article>") for i in range(9)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"The same article"} and len(out) == 9


def extracted(spark, rows):
    rows = [(i, "http://d/", h) for i, h in enumerate(rows)]
    return [r.text for r in sorted(html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_templates_within_articles(spark):
    rows = [f"<main><div>Get our letter each day</div><article><p>By the staff</p><p>Story {i} tells a lot</p></article><p>All rights</p></main>" for i in range(9)]
    rows += ["<main><div>Get our letter each day</div><article><p>Copied story</p><p>in two parts</p></article><p>All rights</p></main>"] * 9
    assert extracted(spark, rows) == [f"Story {i} tells a lot" for i in range(9)] + ["Copied story\n\nin two parts"] * 9


def test_story_outside_of_teasers(spark):
    rows = [f"<div><p>Story {i} tells at length what {i} did</p></div><article><p>Read this next</p></article><article><p>Teaser {i}</p></article>" for i in range(9)]
    for i, text in enumerate(extracted(spark, rows)):
        assert text.startswith(f"Story {i} tells at length what {i} did") and "Read this next" not in text


def test_weak_marks_and_readers():
    page = """<article><h1>T</h1><div class="related work"><p>Prose on related work in full</p></div><div class="share"><a>x</a> <a>y</a></div>
    <p>A <span class="search">search</span> word</p></article><article class="comment"><p>Nice!</p></article><div class="search">Find</div>"""
    assert text(page) == "T\n\nProse on related work in full\n\nA search word"


def site(i, words):
    """A page without any class, role or tag that tells what is what."""
    say = lambda k: " ".join(words[(i * 7 + j * 3) % len(words)] for j in range(k))
    menu = "".join(f"<li><a href='/{j}'>{words[(i + j) % len(words)]}</a></li>" for j in range(4 + i % 3))
    story = [f"Title {i} {say(3)}", *(f"Part {k} of {i}: {say(40)}" for k in range(2 + i % 3))]
    body = f"<div><h1>{story[0]}</h1>" + "".join(f"<p>{s}</p>" for s in story[1:]) + "</div>"
    return f"<body><table><tr><td><ul>{menu}</ul></td></tr></table><center>{say(4)}</center><section>{body}</section><dl><dd>{say(3)} {i}</dd></dl></body>", "\n\n".join(story)


def test_templates_of_changing_words_by_skeleton(spark):
    words = [f"w{k}" for k in range(53)]
    rows = [(i, f"http://h{i % 3}/", *site(i, words)) for i in range(60)]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string"), declared=False).collect()}
    assert out == {r[0]: r[3] for r in rows}


def test_skeletons_against_a_brute_force_count(spark):
    """The skeletons that the method takes for templates of a host, counted again page by page."""
    words = [f"w{k}" for k in range(53)]
    pages = [(i, f"http://h{i % 2}/", site(i, words)[0] if i % 5 else f"<p>{i} lone</p>") for i in range(40)]
    found = {r["host"]: r for r in html.templates(html.parsed(spark.createDataFrame(pages, "page_id long, url string, html string"), False)).collect()}
    for h in ("h0", "h1"):
        mine = [html.parse(p[2], False) for p in pages if p[1] == f"http://{h}/"]
        total = sum(p.size for p in mine)
        places = {}
        for p in mine:
            for (kind, key), c in p.counts.items():
                places.setdefault((kind, key), []).append((p, c))
        often = {k: v for k, v in places.items() if len(v) >= max(html.LEAST_PAGES, html.LEAST_SHARE * len(mine))}
        most = [(v[0][1][3], sum(c[1] for _, c in v), k[1]) for k, v in often.items() if k[0] == html.PLACE]
        most = [(d, n, k) for d, n, k in most if n >= html.CONTENT_SHARE * total and sum(c[0] for _, c in often[html.PLACE, k]) <= html.CONTENT_TIMES * len(often[html.PLACE, k])]
        content = max(most)[2]
        templates = set()
        for (kind, key), v in often.items():
            size, linked, around = sum(c[1] for _, c in v), sum(c[2] for _, c in v), sum(p.size for p, _ in v)
            if kind == html.SKELETON and (2 * linked >= size or size <= html.LITTLE * around):
                templates.add(key)
        assert found[h]["content"] == content and set(found[h]["skeletons"]) == templates and len(templates) > 3


def test_ids_ties_and_extra_columns(spark):
    words = [f"w{k}" for k in range(53)]
    rows = [(None if i % 2 else 7, f"http://h/{i}", site(i, words)[0], "t", [i], 0) for i in range(12)]
    rows += [rows[0]] * 3
    kind = "page_id long, url string, html string, text string, blocks array<int>, templates int"
    out = html.extract(spark.createDataFrame(rows, kind), declared=False).collect()
    assert sorted((r.url, r.text) for r in out) == sorted((u, site(int(u.rpartition("/")[2]), words)[1]) for _, u, *_ in rows)
    named = html.extract(spark.createDataFrame([("a", None, "<p>x</p>")], "page_id string, url string, html string")).first()
    assert named.page_id == "a" and named.text == "x"


def test_very_long_pages():
    many = "".join(f"<p>{i} words</p>" for i in range(60_000))
    assert text(f"<article>{many}</article>").count("\n\n") == 59_999
    assert text("<b>" * 200_000 + "<p>a<p>b") == "a\n\nb" and text("</div>" * 200_000 + "x") == "x"
    assert len(text("x" * 3_000_000)) == 3_000_000


def test_many_hosts_meet_their_templates_in_groups(spark, monkeypatch):
    monkeypatch.setattr(html, "SMALL", 1)
    words = [f"w{k}" for k in range(53)]
    rows = [(i, f"http://h{i % 3}/", *site(i, words)) for i in range(60)]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string"), declared=False).collect()}
    assert out == {r[0]: r[3] for r in rows}


def test_query_by_templates_alone(spark):
    """On hosts of at least three pages, the templates find what the page's own marks declare."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("host", html.host())
    hosts = {r["host"]: r["count"] for r in pages.groupBy("host").count().collect()}
    both = [{r.page_id: r.text for r in html.extract(pages, declared=d).collect()} for d in (True, False)]
    large = [r.page_id for r in pages.select("page_id", "host").collect() if hosts[r.host] >= 3]
    assert sum(both[0][k] == both[1][k] for k in large) >= 0.95 * len(large) > 200


def test_query(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = html.op1(spark, sf_dir).collect()
    assert len(out) == len(pages)
    for r in out:
        # an independent reading of these pages, whose articles hold just headings, paragraphs, <b> and <br>
        body = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p)))).strip() for p in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(filter(None, parts)) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
