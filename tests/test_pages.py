"""Headlines of pages against Python's own HTML parser."""

import random
from html.parser import HTMLParser

import pytest

from barloom.operators import news


class Plain(HTMLParser):
    """The texts of elements of a tag and class, by events of the parser."""

    def __init__(self, tag, css):
        super().__init__(convert_charrefs=True)
        self.tag, self.css, self.depth, self.found = tag, css, 0, []

    def handle_starttag(self, tag, attrs):
        if tag != self.tag:
            return
        if self.depth and self.tag != "a":
            self.depth += 1
        else:
            self.depth = int(not self.css or self.css in (dict(attrs).get("class") or "").split())
            if self.depth:
                self.found.append("")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == self.tag and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and self.lasttag not in ("script", "style"):
            self.found[-1] += data


def expected(html, tag, css, n):
    parser = Plain(tag, css)
    parser.feed(html or "")
    parser.close()
    return [t for t in (x.strip(" ") for x in parser.found) if t][:n]


PIECES = ['<a class="tit">', "<a class='x tit y'>", '<a class="title">', '<A HREF=/x CLASS=tit>', '<a title="1 > 0" class="tit">', '<a title=\'class="tit"\'>', "</a>", "</A >", "<abbr>", "</abbr>", '<div class="tit">', "<div>", "</div>", "<b>", "</b>", "<br/>", '<!-- <a class="tit">no</a> -->', "<!-- > -->", "one", " two ", "3 &lt; 4 &amp; more", "&#39;q&quot;", "가격", "\n"]


@pytest.mark.parametrize("tag,css", [("a", "tit"), ("a", ""), ("div", "tit"), ("div", "")])
def test_headlines_equal_those_of_a_parser(spark, tag, css):
    rng = random.Random(3)
    pages = [(k, "".join(rng.choice(PIECES) for _ in range(rng.randrange(30)))) for k in range(600)]
    pages.append((600, None))
    got = news.headlines_from_pages(spark.createDataFrame(pages, "id int, html string"), css, tag=tag).collect()
    assert {r["id"]: r["headlines"] for r in got} == {k: expected(h, tag, css, 5) for k, h in pages}
    assert sum(len(r["headlines"]) for r in got) > 100


def test_scripts_long_tags_and_class_names_with_signs(spark):
    long = '<a class="t.t" data="' + "x > y " * 50_000 + '">kept</a>'
    pages = [(1, "<script>var s = '<a>no</a>';</script><style>a > b {}</style><a>yes</a>"), (2, long), (3, '<a class="txt">no</a>'), (4, "<a " + "k='v' " * 2000 + ">end<!-- open"), (5, "a < b <a>c < d")]
    made = spark.createDataFrame(pages, "id int, html string")
    some = {r["id"]: r["headlines"] for r in news.headlines_from_pages(made).collect()}
    assert some == {1: ["yes"], 2: ["kept"], 3: ["no"], 4: ["end"], 5: ["c < d"]}
    assert {r["id"]: r["headlines"] for r in news.headlines_from_pages(made, "t.t").collect()} == {1: [], 2: ["kept"], 3: [], 4: [], 5: []}


def test_attribute_values_of_the_first_elements(spark):
    html = '<a class="t" title="A &amp; B">x</a><a class="t">none</a><a class=t title=\'C "q"\'>y</a><a title="no">z</a><!--<a class="t" title="no">--><a class="t" data-title="no" title=D>w</a>'
    made = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert {r["id"]: r["headlines"] for r in news.headlines_from_pages(made, "t", attribute="title").collect()} == {1: ["A & B", 'C "q"', "D"], 2: []}
    assert news.headlines_from_pages(made, "t", 2, attribute="title").first()["headlines"] == ["A & B"]
    with pytest.raises(ValueError):
        news.headlines_from_pages(made, tag="a|b")
