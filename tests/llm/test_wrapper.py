"""Main text of pages."""

import html
import random
import re

import pytest

from prefixloom.llm import wrapper as X

FOLDER = "/root/testdata/sf0.001"


def plain(page):
    """The blocks of the article of a page as the test tables have them."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)\b[^>]*>", body)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n\n".join(x for x in lines if x)


def test_pages_as_by_a_plain_version(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = X.op5_wrapper(spark, FOLDER).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == plain(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def site(i, body):
    """A page without marked parts: what is template shows only by comparison."""
    return (f"<html><body><div><div>The Daily Page</div><p>All rights kept since 1999</p></div><div class=x><h2>Story {i}</h2>{body}</div>"
            f"<div id='reader-comments'><p>first! {i}</p></div><div class='sidebarLeft'>side {i}</div><form>name {i}</form>"
            f"<div><a href=/a>more {i}</a> <a href=/b>and more {i}</a></div><p>Printed on paper</p></body></html>")


def test_constant_slots_are_template_and_varying_ones_content(spark):
    rows = [(i, f"http://one.example/{i}", site(i, f"<p>text  {i} &amp; more&nbsp;text</p><p>second<br>part {i}")) for i in range(12)]
    rows += [(100, "http://two.example/x", site(1, "<p>alone</p>"))]
    got = {r["page_id"]: r["text"] for r in X.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Story {i}\n\ntext {i} & more text\n\nsecond part {i}"
    assert got[100].startswith("The Daily Page")  # one page shows no template


def test_copies_do_not_make_a_template(spark):
    rows = [(i, "http://one.example/", site(0, "<p>a copied story</p>")) for i in range(30)]
    rows += [(100 + i, "http://one.example/", site(i, f"<p>story {i}</p>")) for i in range(1, 9)]
    got = {r["page_id"]: r["text"] for r in X.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 0\n\na copied story" and got[104] == "Story 4\n\nstory 4"


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain text &lt;b&gt;", "plain text <b>"), ("<main><p>in</main><p>out", "in"), ("<p>a<p>b<ul><li>c<li>d</ul>e", "a\n\nb\n\nc\n\nd\n\ne"),
    ("<article><header><h1>t</h1></header><p>x</p><footer>f</footer><div class='ad-box'>buy</div></article>", "t\n\nx"),
    ("<header>site</header><p>x</p><script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> -->", "x"),
    ("<p title='a > b'>x</p></div></p>y <", "x\n\ny <"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<article><p>unclosed <b>bold", "unclosed bold"),
    ("<article><p>we <a href=x>link all of this text</a></p></article>", "we link all of this text"), ("<P CLASS=x>Up</P>", "Up")])
def test_single_pages(page, want):
    _, blocks = X.parse(page)
    inside = [line for node, line, _ in blocks if node.inside] or [line for _, line, _ in blocks]
    assert "\n\n".join(inside) == want


def test_matching_of_trees():
    a, b = (X.parse(p)[0] for p in ("<div><h1>x</h1><ul><li>1</li></ul><p>y</p></div>", "<div><ul><li>1<li>2</ul><h1>z</h1><p>y</p><pre>q</pre></div>"))
    size, _ = X.match(a, b)
    assert size == 5  # root, div, ul, li, p: h1 and ul cannot both keep their order


def plain_match(a, b):
    """The size of the largest mapping by the recursive programme over all children."""
    left, right = list(a.children.values()), list(b.children.values())
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left, 1):
        for j, y in enumerate(right, 1):
            best[i][j] = max(best[i][j - 1], best[i - 1][j], best[i - 1][j - 1] + plain_match(x, y) if x.label == y.label else 0)
    return 1 + best[-1][-1]


def random_tree(rng, depth=0):
    node = X.Node("", None)
    for label in rng.sample("abcdefg", rng.randrange(max(1, 8 - 2 * depth))):
        child = random_tree(rng, depth + 1)
        child.label, child.parent, node.children[label] = label, node, child
    return node


def test_matching_as_by_the_recursive_programme():
    rng = random.Random(7)
    for _ in range(150):
        a, b = random_tree(rng), random_tree(rng)
        size, partner = X.match(a, b)
        assert size == plain_match(a, b)
        n, todo = 0, [a]
        while todo:  # the partners keep labels, parents and order, and there are as many as the size says
            x = todo.pop()
            n += 1
            kept = [c for c in x.children.values() if id(c) in partner]
            places = [list(partner[id(x)].children.values()).index(partner[id(c)]) for c in kept]
            assert places == sorted(places) and all(c.label == partner[id(c)].label for c in kept)
            todo += kept
        assert n == size
        assert [x[0] for x in X.dumped(X.loaded(X.dumped(a)))] == [x[0] for x in X.dumped(a)]


@pytest.mark.parametrize("deep", ["<div class=ad>", "<div class=ad><article>", "<article><div class=menu><p>"])
def test_deep_pages(spark, deep):
    page = "<body><h1>Story {i}</h1><p>text {i} of some length, as a story has</p>{deep}buried {i}</body>"
    rows = [(i, f"http://one.example/{i}", page.replace("{i}", str(i)).replace("{deep}", deep * 5_000 if i == 3 else "")) for i in range(6)]
    got = texts(spark, rows)
    assert got[2] == "Story 2\n\ntext 2 of some length, as a story has\n\nburied 2"
    assert got[3].startswith("Story 3\n\ntext 3 of some length, as a story has")
    root, blocks = X.parse(rows[3][2])
    assert max(node.depth for node, _, _ in blocks) <= X.DEPTH + 1 and len(blocks) == 3


def test_many_slots_and_many_copies(spark):
    """1,500 different classes on a page, and 1,000 copies of one page among ten others."""
    page = "<body><div>The Daily Page</div>" + "".join(f"<div class=c{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}>slot {a} {b} {c} of {{i}}</div>" for a in range(12) for b in range(12) for c in range(11)) + "</body>"
    rows = [(i, f"http://one.example/{i}", page.replace("{i}", str(i))) for i in range(5)]
    other = "<body><div>The Other Page</div><p>story {i}</p><p>told {i}</p></body>"
    rows += [(1_000 + i, "http://two.example", other.replace("{i}", "0" if i < 1_000 else str(i))) for i in range(1_010)]
    got = texts(spark, rows)
    assert got[4].startswith("slot 0 0 0 of 4\n\nslot 0 0 1 of 4") and got[4].count("\n\n") == 12 * 12 * 11 - 1
    assert got[1_007] == "story 0\n\ntold 0" and got[2_005] == "story 1005\n\ntold 1005"


def plain_text(page, host_pages):
    """Content by slots and constants for pages of one structure: a slot is the path of labels, no trees are matched."""
    def lines(one):
        return [("/".join(path(n)), text, linked, n) for n, text, linked in X.parse(one)[1]]

    def path(node):
        return path(node.parent) + [node.label] if node.parent else []

    held = [{(slot, text) for slot, text, _, _ in lines(p)} for p in dict.fromkeys(host_pages)]
    slots = [{slot for slot, _ in h} for h in held]
    out = []
    for slot, text, linked, node in lines(page):
        own = sum((slot, text) in h for h in held)
        constant = len(held) >= 4 and own >= 4 * 0.9 and own >= 0.9 * sum(slot in s for s in slots)
        if not constant and not node.doubt and not (linked > 0.6 * len(text) and not node.inside):
            out.append(text)
    return "\n\n".join(out)


def test_pages_as_by_plain_slots_and_constants(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    hosts = {}
    for r in pages:
        hosts.setdefault(re.match(r"\w+://([^/]*)", r["url"])[1], []).append(r["html"])
    got = {r["page_id"]: r["text"] for r in X.op5_wrapper(spark, FOLDER).collect()}
    for r in pages:
        assert got[r["page_id"]] == plain_text(r["html"], hosts[re.match(r"\w+://([^/]*)", r["url"])[1]])


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "http://a.example", "", None), (None, "no address", "<p>t", None), (3, "//h.example/q", "<p>" + "w " * 100_000, None)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = X.main_text(df)
    assert out.columns == ["page_id", "url", "text"]
    assert sorted((r["page_id"] or 0, len(r["text"])) for r in out.collect()) == sorted([(1, 0), (2, 0), (0, 1), (3, 199_999)] * 2)
    assert X.main_text(df.limit(0)).count() == 0


def test_many_hosts_by_plain_joins(spark, monkeypatch):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    want = sorted(map(tuple, X.main_text(pages).collect()))
    monkeypatch.setattr(X, "FEW_BYTES", 0)
    assert sorted(map(tuple, X.main_text(pages).collect())) == want


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in X.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_constant_blocks_of_an_article_are_template_and_text_outside_stays(spark):
    page = ("<body><p>Weather on day {i} is fine</p><article><h1>Story {i}</h1><p>By our staff</p><p>text {i} of some length</p>"
            "<p><a href=/s{i}>linked paragraph {i}</a></p><div class=tools><span>Print or send this page</span></div></article><div>A late correction, number {i}</div></body>")
    got = texts(spark, [(i, f"http://one.example/{i}", page.replace("{i}", str(i))) for i in range(12)])
    for i in range(12):
        assert got[i] == f"Weather on day {i} is fine\n\nStory {i}\n\ntext {i} of some length\n\nlinked paragraph {i}\n\nA late correction, number {i}"


def test_lists_of_links_in_an_article(spark):
    page = "<article><h1>Story {i}</h1><p>text {i} of some length</p><ul><li><a href=/a>more {i}</a><li><a href=/b>and more {i}</a></ul></article>"
    got = texts(spark, [(i, f"http://one.example/{i}", page.replace("{i}", str(i))) for i in range(12)])
    assert got[3] == "Story 3\n\ntext 3 of some length"


@pytest.mark.parametrize("open_", ["class='content with-sidebar'", "class=no-sidebar", "class=has-banner", "class=search-results", "id=post-comments-open"])
def test_words_of_an_ancestor_take_no_story_away(spark, open_):
    for inner in ("<article><h1>Story {i}</h1><p>text {i}</p></article>", "<h2>Story {i}</h2><p>text {i}</p>"):
        page = f"<body><div {open_}>{inner}<div class=sidebar>side {{i}}</div></div></body>"
        got = texts(spark, [(i, f"http://one.example/{i}", page.replace("{i}", str(i))) for i in range(6)])
        assert got == {i: f"Story {i}\n\ntext {i}" for i in range(6)}


@pytest.mark.parametrize("word", ["comment", "related"])
def test_words_count_on_articles(spark, word):
    page = f"<body><div class=x><h1>Story {{i}}</h1><p>text {{i}}</p></div><article class={word}><header>reader {{i}}</header><p>I say {{i}}, and very much more than the story does</p></article></body>"
    got = texts(spark, [(i, f"http://one.example/{i}", page.replace("{i}", str(i))) for i in range(6)])
    assert got == {i: f"Story {i}\n\ntext {i}" for i in range(6)}


@pytest.mark.parametrize("copies,others", [(6, 6), (9, 3), (8, 0), (30, 2)])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_near_copies_do_not_make_a_template(spark, copies, others, tag):
    page = (f"<body><div>The Daily Page</div><{tag} class=story><span>on day {{i}}</span><h2>{{t}}</h2><p>The first {{t}} has a paragraph of some length, as they do.</p>"
            f"<p>The second paragraph of {{t}} is shorter.</p></{tag}><div class=ad>buy {{i}}</div></body>")
    rows = [(i, f"http://one.example/{i}", page.replace("{i}", str(i)).replace("{t}", "story" if i < copies else f"tale {i}")) for i in range(copies + others)]
    for i, text in texts(spark, rows).items():
        name = "story" if i < copies else f"tale {i}"
        want = f"on day {i}\n\n{name}\n\nThe first {name} has a paragraph of some length, as they do.\n\nThe second paragraph of {name} is shorter."
        assert text == want if others else text.endswith(want)  # where all are copies nothing tells the template from the story
