"""Selectors over saved pages against a plain tree built by Python's own HTML reader."""

from html.parser import HTMLParser

from lotwise.sources import dom, html_queries

PAGES = {
    1: '<html><body><ul class="list big"><li id=a><a href="/x/17?p=1&amp;q=2">First&nbsp;lot &amp; more</a> <b>Org</b></li><li><a href=\'/y/last\'>Second</a><li><a>Third <i>in</i> parts</a></ul></li></b></body>',
    2: "<div class=card><h2> One </h2><p>a<p>b<br>c</div><div class='card wide'><h2>Two</h2><div><p>inner</p></div></div><!-- <h2>no</h2> --><script>var x = '<h2>no</h2>';</script>",
    3: "",
    4: None,
    5: "</p></div>just text <",
    6: "<div>" * 40 + "<span data-k=\"v\">deep</span>" + "</div>" * 30,
    7: "<table>" + "".join(f"<tr><td>{k}</td><td class=n>{k * k}</td></tr>" for k in range(300)) + "</table>",
}


class Tree(HTMLParser):
    """name, attributes, parent, and texts with the elements around them; ends close up to the element of their name."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.nodes, self.stack, self.held, self.skip = [], [], [], False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip = True
            return
        self.nodes.append((tag, dict(attrs), list(self.stack)))
        if tag not in dom.VOID:
            self.stack.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = False
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[k]][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        if not self.skip and data.strip() and data.strip() != "<":
            self.held.append((data.strip(), list(self.stack)))

    def text(self, i):
        return "".join(t for t, around in self.held if i in around).replace("\xa0", " ")


def brute(container, inner, nth=0, attr=None):
    out = {}
    for page, html in PAGES.items():
        tree = Tree(html or "")
        boxes = [i for i, n in enumerate(tree.nodes) if container(tree, i)]
        for place, box in enumerate(boxes, 1):
            met = [i for i, n in enumerate(tree.nodes) if box in n[2] and inner(tree, i)]
            value = "" if len(met) <= nth else (tree.nodes[met[nth]][1].get(attr) or "") if attr else tree.text(met[nth])
            out[page, place] = value
    return out


def named(*names, cls=None):
    return lambda tree, i: tree.nodes[i][0] in names and (cls is None or cls in (tree.nodes[i][1].get("class") or "").split())


def test_fields_equal_plain_trees(spark):
    pages = spark.createDataFrame(list(PAGES.items()) + [(7, PAGES[7]), (None, "<li><a>x</a></li>")], "page_id long, html string")
    cases = [
        ("li", "a", named("li"), named("a"), 0, None),
        ("li", "a@href", named("li"), named("a"), 0, "href"),
        ("div.card", "h2", named("div", cls="card"), named("h2"), 0, None),
        ("div.card", "p:nth-match(1)", named("div", cls="card"), named("p"), 1, None),
        ("tr", "td:nth-match(1)", named("tr"), named("td"), 1, None),
        ("div", "span@data-k", named("div"), named("span"), 0, "data-k"),
        ("ul, table", "li,td", named("ul", "table"), named("li", "td"), 0, None),
        ("tr", "td.n", named("tr"), named("td", cls="n"), 0, None),
        ("div", "div > p", named("div"), lambda t, i: t.nodes[i][0] == "p" and t.nodes[i][2] and t.nodes[t.nodes[i][2][-1]][0] == "div", 0, None),
        ("body", "ul li b", named("body"), lambda t, i: t.nodes[i][0] == "b" and {"ul", "li"} <= {t.nodes[k][0] for k in t.nodes[i][2]}, 0, None),
    ]
    for container, selector, box, inner, nth, attr in cases:
        got = {(r.page_id, r.place): r.value for r in dom.container_records(pages, container, {"value": selector}).collect()}
        assert got == brute(box, inner, nth, attr), (container, selector)


def test_attributes_as_written(spark):
    rows = spark.createDataFrame([("<a title='href=\"no\"' HREF = \"/a b\" x>",), ("<a href=/c>",), ("<a data-href=\"z\">",), ("<a href='&amp;1'>",)], "tag string")
    assert [r.v for r in rows.select(dom.attribute(rows.tag, "href").alias("v")).collect()] == ["/a b", "/c", None, "&1"]


def test_rows_of_lots(spark):
    records = [(1, 1, "Lot one", "", "/lot/12-3/", "", "text UZB"), (1, 2, "ab", "o", "/x", "", "UZB"), (1, 3, "Lot two", "Org", "/a/b/", "d", "uzb"), (1, 4, "Lot three", "Org", "", "d", "UZB"), (1, 5, "Lot four", "Org", "/9", "", "KAZ")]
    df = spark.createDataFrame(records, "page_id long, place int, title string, organization string, link string, description string, whole string")
    got = {r.place: (r.external_id, r.organization, r.search_text) for r in dom.tender_rows(df, "Src", "s", country="uzb").collect()}
    import hashlib

    assert got == {1: ("12", "Src", "Lot one Src"), 3: ("b", "Org", "Lot two Org d"), 4: (hashlib.md5(b"Lot three|Org|Src").hexdigest()[:12], "Org", "Lot three Org d")}


def test_empty_table(spark):
    assert dom.container_records(spark.createDataFrame([], "page_id long, html string"), "li", {"a": "a"}).count() == 0


def test_two_layouts_read_pages_once(spark, monkeypatch):
    read, real = [], dom.tokens
    monkeypatch.setattr(dom, "tokens", lambda pages: read.append(1) or real(pages))
    html_queries.QUERIES["s05_containers"](spark, "/root/testdata/sf0.001")
    assert len(read) == 1
