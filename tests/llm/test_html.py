import math
from collections import Counter, defaultdict

import pytest

from sluice.llm import html_text
from sluice.llm.html_text import Page, Tree, path_key

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""), ("plain &lt;text&gt; only", "plain <text> only"), ("<p>a<b>b</b> c\n\td<p>e", "ab c d\ne"), ("<body><p>unclosed <b", "unclosed <b"),
        ("<nav>menu</nav><article><h1>T</h1><p>one<br>two</p></article><footer>f</footer>", "T\none two"), ("<article><p>x<aside>no</aside><p>z</article>", "x\nz"),
        ("<div id=main><header><h1>Site</h1></header><main><header><h1>T</h1></header><p>a &amp; b &#233; &eacute &nbsp;x</main></div>", "T\na & b é é x"),
        ("<div class='adBox'>q</div><div class=ad-box>z</div><div class=reader>k</div>", "k"), ("<p>a<script>if(a<b){'</p>'}</script>b</p><style>p{}</style><!-- c --><p>d", "ab\nd"),
        ("<article><p>x</p><section class='comments'><article><p>reader</p></article></section></article>", "x"), ("<table><tr><td>1<td>2<tr><td>3</table><ul><li>x<li>y</ul>", "1\n2\n3\nx\ny"),
        ("<div role=navigation>n</div><div hidden>h</div><div style='display: none'>s</div><form>f</form><p>k", "k"), ("<article><p>a > b \"q\" </p></article>", 'a > b "q"'),
        ("<p title='a > b'>t</p>", "t"), ("<textarea><p>raw</textarea><select><option>o</select><p>k", "k"), ("<article><div class='cookie notice'>c</div>loose<p>x</p></article>", "loose\nx"),
    ],
)
def test_pages(html, text):
    assert Page(html).text() == text


LONG = "words of the article " * 5


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "search-page", "menu-open", "related-layout", "hasSidebar", "page has-header", "widget", "sidebar"])
def test_named_wrappers_keep_the_article(name):
    assert Page(f"<div class='{name}'><article><h1>T</h1><p>one</p></article></div>").text() == "T\none"
    assert Page(f"<body class='{name}'><div id='{name}'><nav>n</nav><div class='ad'>buy</div><main><header>H</header><p>one</p></main></div><p>stray</p>").text() == "H\none"
    assert Page(f"<div class='{name}'><div class='{name}'><article><p>one</p></article></div></div>").text() == "one"


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<div class='has-sidebar'><div class=post><p>{LONG}</div><div class=sidebar>links</div></div><p>end", f"{LONG.strip()}\nend"),
        (f"<main><h1>T</h1><div class='with-sidebar'><p>{LONG}</div></main>", f"T\n{LONG.strip()}"),
        (f"<p>{LONG}</p><div class='no-sidebar'><article>short</article></div>", f"{LONG.strip()}\nshort"),
        ("<div class='entry'><header><h1>Title</h1></header><p>one</div>", "Title\none"), ("<header><h1>Site</h1></header><p>one", "one"),
        ("<article><div class='post share-enabled'>a</div><p class='notice-board'>b</p><section class='related-work'>c</section></article>", "a\nb\nc"),
        ("<article>x<svg><path>drawn</svg>y</article><p>z", "xy"), ("<canvas>c<p>no</canvas><p>k", "k"), ("<p>a <span class=ad>buy</span>b</p>", "a b"),
        (f"<div class=post>post</div><div class=comments><article>{LONG}</article></div>", "post"), (f"<main>post<div class='comments-area'><article>{LONG}</article></div></main>", "post"),
        (f"<div class=post>{LONG}</div><div class='related-posts'><article>teaser</article></div>", LONG.strip()), ("<div class='no-sidebar'><form>f</form><div hidden>h</div></div>", ""),
    ],
)
def test_names_are_weighed_once_the_page_is_read(html, text):
    assert Page(html).text() == text


def test_site_style_tree(spark):
    """A branch with no boilerplate name that reads the same on every page of a host goes; on few pages, or with own text, it stays."""
    def page(i, box):
        return f"<body><div class=story{i % 3}><p>{'<p>'.join(f'own text {i} {k}' for k in range(1 + i % 4))}</div><div class=box><p>{box}</div></body>"

    rows = [(i, f"http://u@big.example:80/{i}", page(i, "the same words")) for i in range(30)]
    rows += [(100 + i, f"http://small.example/{i}", page(i, "the same words")) for i in range(3)] + [(200 + i, f"http://own.example/{i}", page(i, f"box {i}")) for i in range(30)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all("same words" not in got[i].text and "own text" in got[i].text for i in range(30))
    assert all("same words" in got[100 + i].text for i in range(3)) and all(f"box {i}" in got[200 + i].text for i in range(30))
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_repeated_pages_keep_their_article(spark):
    rows = [(i, "http://a.example/", "<article><div><p>same article</div></article>") for i in range(12)]
    assert {r.text for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {"same article"}


@pytest.mark.parametrize("most", [200_000, 0])
def test_nulls_extra_columns_and_joins(spark, monkeypatch, most):
    monkeypatch.setattr(html_text, "BROADCAST_PATHS", most)
    rows = [(1, None, "<p>x"), (2, "not a url", None), (None, "http://a/", ""), (1, None, "<p>x"), (3, "http://a/", "<p>" + "long " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'h' as host", "1 as low", "2 as text")
    got = sorted(((r.page_id or 0, r.url, r.text[:5], r.n_chars) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, None, "x", 1), (1, None, "x", 1), (2, "not a url", "", 0), (0, "http://a/", "", 0), (3, "http://a/", "long ", 249_999)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


def plain_importances(rows):
    """The style tree by plain counting: {path key: (importance, styles)}, and under path_key(host, 0, 0) the hosts that have one."""
    pages, styles, blocks = defaultdict(set), defaultdict(Counter), defaultdict(lambda: defaultdict(set))
    for i, (host, source) in enumerate(rows):
        page = Page(source or "")
        pages[path_key(host, 0, 0)].add(i)
        seen = set()
        for node in range(1, len(page.tag)):
            key = path_key(host, page.path[node], 1)
            if not page.hard[node]:
                pages[key].add(i)
                seen.add((key, tuple(page.children[node])))
        for key, style in seen:
            styles[key][style] += 1
        for holder, _, pieces in page.blocks:
            key = path_key(host, page.path[holder], 2)
            pages[key].add(i)
            blocks[key][" ".join("".join(pieces).split())].add(i)
    out = {}
    for key, held in pages.items():
        m = len(held)
        if m < html_text.PAGES:
            continue
        if key in blocks:
            worth = 1 - sum(math.log(len(x), m) for x in blocks[key].values()) / len(blocks[key])
        elif key in styles:
            total = sum(styles[key].values())
            worth = -sum(n / total * math.log(n / total, m) for n in styles[key].values())
        else:
            worth = 1.0
        out[key] = (worth, max(len(styles[key]), 1))
    return out


def test_against_a_plain_style_tree(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("page_id", "replace(url, 'www.', '') as url", "html")
    extra = [(-i, "http://lists.example/x", f"<header><h1>Headline {i}</h1></header><div>{'<p>'.join(f'{i} {k}' for k in range(i % 5 + 1))}</div><div class=box>all alike</div>") for i in range(1, 20)]
    pages = pages.unionByName(spark.createDataFrame(extra, SCHEMA))
    host = "xxhash64(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)))"
    rows = pages.selectExpr("page_id", f"{host} as host", "html").collect()
    known = plain_importances([(r.host, r.html) for r in rows])
    want = sorted((r.page_id, Page(r.html or "").text(Tree(r.host, known) if path_key(r.host, 0, 0) in known else None)) for r in rows)
    assert sorted((r.page_id, r.text) for r in html_text.extract(pages).collect()) == want
    assert all(text.startswith(f"Headline {-i}\n") and "alike" not in text for i, text in want if i < 0)


def test_the_tree_decides(spark):
    """Pages that change once every path is worth 1, with names and without them: adverts stand outside the article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = lambda **how: {r.page_id: r.text for r in html_text.extract(pages, **how).collect()}
    right, blind, nameless, neither = texts(), texts(use_tree=False), texts(names=False), texts(use_tree=False, names=False)
    changed = lambda a, b: sum(a[i] != b[i] for i in a) / len(a)
    assert changed(right, blind) > 0.5 and changed(nameless, neither) > 0.5
    assert right == {r.page_id: Page(r.html).text() for r in pages.collect()}
