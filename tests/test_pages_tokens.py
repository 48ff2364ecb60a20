import random
from html.parser import HTMLParser

import pytest

from weft.operators import pages as P

VOID = {x for x in P.VOID_TAGS if x not in ("script", "style")}


class Tree(HTMLParser):
    """Elements with their first and last place, as Python's parser sees the page."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.html, self.open, self.elements, self.starts = html, [], [], [0]
        for line in html.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.feed(html)
        self.close()
        for e in self.open:
            e[3] = len(html)

    def at(self):
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            e = [tag, dict(attrs), self.at() + len(self.get_starttag_text()), None]
            self.open.append(e)
            self.elements.append(e)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in [e[0] for e in self.open]:
            while True:
                e = self.open.pop()
                e[3] = self.at()
                if e[0] == tag:
                    break

    def container(self):
        for s in P.CONTAINER_SELECTORS:
            for tag, attrs, a, b in self.elements:
                if tag == s or (s[0] == "." and s[1:] in (attrs.get("class") or "").split()) or (s[0] == "#" and attrs.get("id") == s[1:]):
                    return self.html[a:b]
        return None


HAND = [
    '<div class="content"><div>one</div> two <span>three</span> four</div> x', "<article>a<article>b</article>c</article>d", "<div id=main><p>open",
    "<p>none</p>", "<section><div class=content>x <b>y</section>after</div>", "<div class='a content b'>x</span></p> y</div> z", '<div title="> class=\'content\'">no</div><main>yes</main>',
    "<!-- <article>no</article> --><main>a<!-- </main> -->b</main>c", "<script>var a = '<article>';</script><div id=content>x<script>'</div>'</script>y</div>z",
    '<article data-x="a > b">q <img alt="</article>"> r</article> s', "<ARTICLE>up<Br/>per</aRTICLE>", "<main>a<input class=content>b</main>", "<div><div class=main>one<div></div></div>two</div>",
    "<style>.content{}</style><div class='content'></div><p>t", "<a class='contents'>n</a><b id='contents'>n</b><i class='post-content'>y</i>", "<div class=content><ul><li>1<li>2</ul>3</div>4",
    "<article/>x<main>y</main>", "", "a < b <main>1 < 2 & 3</main>",
]


def random_page(r):
    names = ["div", "p", "section", "article", "main", "b", "span"]
    attrs = ["", "", " class='content'", ' class="x main"', " id=content", ' id="main"', " data-a='<div>'", ' title=">"']
    out = []
    for _ in range(r.randrange(3, 40)):
        kind = r.randrange(5)
        out.append(f"<{r.choice(names)}{r.choice(attrs)}>" if kind < 2 else f"</{r.choice(names)}>" if kind < 4 else r.choice(["text ", "<br>", "<!-- <main> -->", "<img src=x />", "\n", "&amp;"]))
    return "".join(out)


def test_containers_are_those_of_a_parser(spark):
    r = random.Random(11)
    pages = HAND + [random_page(r) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = {x.page_id: (x.inner, x.tokens) for x in P.container_tokens(df).selectExpr("page_id", "array_join(_inner, '') inner", "array_join(_tok, '') tokens").collect()}
    for i, html in enumerate(pages):
        assert got[i][1] == html
        assert got[i][0] == Tree(html).container(), html


def test_content_without_python_workers(spark):
    pages = [(1, "<body>x<div class=content>a &lt; b<p>c<td title='>'>d</div>y</body>z", "a < b c d"), (2, "<body class=q>only<script>no</script> body", "only body"),
             (3, "<body><article> </article>all<br>of it</body>out", "all of it"), (4, "no body", ""), (5, None, ""), (6, "", ""), (7, "<main>" + "w " * 9000 + "</main>", ("w " * 9000)[:10000])]
    df = spark.createDataFrame([p[:2] for p in pages], "page_id int, html string")
    out = P.with_content(df)
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()
    assert {x.page_id: x.content for x in out.collect()} == {i: t.rstrip() if i != 7 else t for i, _, t in pages}


@pytest.mark.parametrize("n", [20000])
def test_long_pages(spark, n):
    html = "<div>" * 300 + "<article>" + "<p>x</p>" * n + "</article>tail" + "</div>" * 300
    x = P.container_tokens(spark.createDataFrame([(1, html)], "page_id int, html string")).selectExpr("size(_inner) n").first()
    assert x.n == 3 * n
