import random

from weir.llm.pages import extract, main_text

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id long, url string, html string, key int, text string")


def texts(spark, rows, **kw):
    return {r.page_id: r.text for r in extract(table(spark, rows), **kw).collect()}


def test_blocks_references_and_open_elements():
    page = ('<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><!-- <p>no</p> --><article>'
            '<h1>A &amp; B</h1><p><b>One\n two<br>three<p>four &lt;b&gt;&nbsp;x</p><ul><li>i<li>j</ul>tail<script>var t="</p>";</script>'
            '<div class="ad">buy</div><pre> a\n  b </pre></article><section class="comments"><article>me too</article></section>'
            '<footer>&copy;</footer>')
    assert main_text(page, set()) == "A & B\nOne two three\nfour <b> x\ni\nj\ntail\na b"


def test_odd_pages():
    assert main_text("", set()) == main_text("<p>", set()) == main_text("<!-- x", set()) == ""
    assert main_text("just text < 3 & <a title=it's>more</a>", set()) == "just text < 3 & more"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 10, set()) == "deep"
    assert main_text("<article>" + "<p>word</p>" * 20_000 + "</article>", set()) == "\n".join(["word"] * 20_000)
    assert main_text("<div id='content'><p>kept</p></div><div class=sidebar>gone</div><form>gone</form>", set()) == "kept"


def test_names_alone_do_not_take_the_article():
    long = "own words of the page " * 10
    text = long.strip()
    for page in (f"<div class='layout no-sidebar'><p>{long}</p></div>", f"<div id='page' class='has-navbar'><article>{long}</article></div>",
                 f"<article class='post category-promotion tag-social'>{long}</article>", f"<div class='sidebar'><article>{long}</article></div>",
                 f"<div class=widget><p>{long}</p></div><div class=ad>buy</div>", f"<div title='class=ad' data-id='menu'>{long}</div>",
                 f"<div class=widget><article>{long}</article></div><article>teaser</article>",
                 f"<div class='main-menu'>a b</div><div><p>{long}</p></div><div class='cookie-notice'>gone</div>".replace("a b", "")):
        assert main_text(f"<body>{page}</body>", set()) == text, page
    page = (f"<article><h2 id='cookies-and-cream'>Ice</h2><p class='notice'>{long}</p><section id='related-work'>Others</section>"
            "<section id=cookies>Jar</section><h3 id=share>Share</h3><div class='social-share'>gone</div></article>")
    assert main_text(page, set()) == f"Ice\n{text}\nOthers\nJar\nShare"
    page = f"<article>short</article><section class=comments><article>{long}</article><article>{long}</article></section>"
    assert main_text(page, set()) == "short"


def test_forms_and_roles_do_not_take_the_page():
    long = "own words of the page " * 10
    text = long.strip()
    for page in (f"<form action=x><div><p>{long}</p></div><input></form>", f"<form><nav>m</nav><article>{long}</article></form>",
                 f"<div role=search><article>{long}</article></div>", f"<div role=complementary><p>{long}</p></div>",
                 f"<article>{long}<form>mail us <input></form><div role=navigation>next</div></article>"):
        assert main_text(f"<body>{page}</body>", set()) == text, page


def test_several_articles_beside_each_other():
    page = "<main><article><h2>A</h2>first text</article><article>second longer text</article></main><aside><article>teaser</article></aside>"
    assert main_text(page, set()) == "A\nfirst text\nsecond longer text"
    assert main_text("<article>the whole of it <div class=comments><article>me too</article></div></article>", set()) == "the whole of it"


def test_long_broken_pages_take_linear_time():
    import time

    n = 20_000
    for page, want in (("<span>" * n + "<hr>" * n + "x", "x"), ("<div>" * n + "</b>" * n + "x", "x"), ('<a b="' * n, None),
                       ("<article>" * n + "x", "x"), ("<b" * n, None), ("<!--" * n, ""), ("<p><i>" * n + "x", "x"), ("<dt>" * n + "<hr>" * n + "x", "x"),
                       ('<a b="' * n + ">x", None), ("<li><p>" * n + "</ul>" * n + "x", "x")):
        start = time.process_time()
        got = main_text(page, set())
        assert time.process_time() - start < 2.5, page[:20]
        assert want is None or got == want, page[:20]


def brute_templates(rows, want_host):
    """Subtrees of one host that stand beside enough different articles, counted one page after the other."""
    from collections import defaultdict

    from weir.llm.pages import INSIDE_FEW, INSIDE_PAGES, INSIDE_SHARE, MIN_PAGES, OUTSIDE_SHARE, subtrees

    beside, mains = defaultdict(set), set()
    for _, url, page in rows:
        if url.split("/")[2] == want_host:
            main, *parts = subtrees(page)
            mains.add(main)
            for kind, hashes in zip(("outer", "inner", "plain"), parts):
                for h in hashes:
                    beside[kind, h].add(main)
    least = {"outer": len(mains) * OUTSIDE_SHARE, "plain": len(mains) * INSIDE_SHARE,
             "inner": min(len(mains) * INSIDE_SHARE, max(INSIDE_PAGES, len(mains) * INSIDE_FEW))}
    return {(kind, h) for (kind, h), pages in beside.items() if len(pages) >= max(MIN_PAGES, least[kind])}


def brute_text(page, found):
    """A subtree is cut where it stands in the part of the page in which it is a template."""
    from weir.llm.pages import subtrees

    own = zip(("outer", "inner", "plain"), subtrees(page)[1:])
    return main_text(page, {h for kind, hashes in own for h in hashes if (kind, h) in found})


def test_templates_equal_a_count_page_by_page(spark):
    rng, rows = random.Random(9), []
    for i in range(120):
        parts = [f"<div>box {rng.randrange(3)}</div>", f"<ul><li>{rng.choice(WORDS)}</li></ul>", f"<p>{rng.choice(WORDS)} said</p>",
                 f"<table><tr><td>{rng.choice(WORDS)}</td></tr></table>"]
        inside = "".join(rng.sample(parts, 2))
        rows.append((i, f"http://{rng.choice('ab')}/{i}", f"<body>{rng.choice(parts)}<article><p>own {i % 90}</p>{inside}</article>{rng.choice(parts)}</body>"))
    found = {host: brute_templates(rows, host) for host in "ab"}
    want = {i: brute_text(page, found[url.split("/")[2]]) for i, url, page in rows}
    assert texts(spark, rows) == want
    assert any(want[i] != main_text(page, set()) for i, _, page in rows)


def site(pages, host="a.example.org", copies=0):
    rng, rows, want = random.Random(host), [], {}
    for i in range(pages):
        said = [" ".join(rng.choice(WORDS) for _ in range(30)) + f" {host} {i} {k}" for k in range(3)]
        page = ("<body><div><a href=1>Home</a> <a href=2>About</a></div><div><p>Read our rules first.</p></div><div>"
                + "".join(f"<p>{s}</p>" for s in said) + f"</div><div>All rights {rng.randrange(3)}</div></body>")
        rows.append((i, f"http://{host}/{i}", page))
        want[i] = "\n".join(said)
    for i in range(copies):
        rows.append((1000 + i, f"http://{host}/copy{i}", rows[0][2]))
        want[1000 + i] = want[0]
    return rows, want


def test_templates_are_cut_and_copies_stay(spark):
    rows, want = site(40, copies=60)
    assert texts(spark, rows) == want


def test_templates_belong_to_a_host(spark):
    rows, want = site(40)
    other = (77, "https://u:p@B.example.org:8080/x", "<body><div><p>Read our rules first.</p></div><div><p>Own words</p></div></body>")
    got = texts(spark, rows + [other])
    assert got == want | {77: "Read our rules first.\nOwn words"}


def test_shared_paragraphs_of_articles_stay(spark):
    rows = [(i, "http://c.org/", f"<nav>m</nav><article><h1>Title {i}</h1><p>The same passage in all of them</p><div>Follow us {i % 2}</div>"
             f"<p>own {i}</p></article>") for i in range(30)]
    assert texts(spark, rows) == {i: f"Title {i}\nThe same passage in all of them\nown {i}" for i in range(30)}


def test_rotating_notices_inside_articles_are_cut(spark):
    page = ("<article><h1>Title {0}</h1><div>Notice number {1} of this site</div><p>own {0}</p>"
            "<table><tr><td>Yes</td></tr><tr><td>{0}</td></tr></table></article>")
    rows = [(i, "http://d.org/", page.format(i, i % 25).replace("Yes", "Yes" if i % 10 == 0 else f"No {i}")) for i in range(400)]
    assert texts(spark, rows) == {
        i: f"Title {i}\nown {i}\n{'Yes' if i % 10 == 0 else f'No {i}'}\n{i}" for i in range(400)}


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "http://x/", None), (2, "nonsense", "")]
    got = extract(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, None, "a", 1), (1, None, "a", 1), (None, "http://x/", "", 0), (2, "nonsense", "", 0)], key=repr)
    assert extract(table(spark, rows)).columns == ["page_id", "url", "text", "n_chars"]
    assert extract(table(spark, [])).collect() == []


def test_test_pages_give_their_articles(spark, data):
    """The pages of the test tables hold nothing but paragraphs in their article elements."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    import html
    import re
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        assert got[r.page_id] == "\n".join(filter(None, (" ".join(html.unescape(p).split()) for p in parts)))
