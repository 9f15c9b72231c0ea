from html.parser import HTMLParser

import numpy as np

from lexisearch.llm import html as H


def test_blocks():
    page = "<html><head><title>no</title></head><body>a <b>bold</b> word<p>x &amp; y<br>z<script>var t='</p>'</script><ul><li><a href='/'>one two</a> three</ul><!-- no --> end"
    assert H.blocks(page) == [("a bold word", 3, 0), ("x & y", 3, 0), ("z", 1, 0), ("one two three", 3, 2), ("end", 1, 0)]


def test_awkward_pages():
    assert H.extract(None) is None
    assert H.extract("") == ("", 0, 0) == H.extract("<p></p> &nbsp;")
    assert H.blocks("<!-- never closed <p>x") == [] == H.blocks("<script>x")
    assert H.blocks("a < b > c") == [("a < b > c", 5, 0)]
    assert H.blocks("<a " * 20000)[0][1] == 20000
    assert H.blocks("<p>" * 50000 + "x") == [("x", 1, 0)]
    assert H.blocks("<a>x</a></a></a> y") == [("x y", 2, 1)]


def test_features():
    f = H.features([("", 4, 2), ("", 10, 0)])
    assert f.tolist() == [[0, 0, 4, 0.5, 10, 0], [4, 0.5, 10, 0, 0, 0]]


def test_tree_learns():
    rng = np.random.default_rng(0)
    x = rng.random((300, 6))
    y = ((x[:, 2] > 0.4) & (x[:, 3] < 0.6)).astype(float)
    assert (H.classify(H.grow(x, y), x) == y).all()
    table = np.array(H.LABELLED, float)
    assert (H.classify(H.trained(), table[:, :6]) == table[:, 6]).mean() >= 0.97
    assert H.grow(np.empty((0, 6)), np.empty(0)).share == 0


def test_pages_that_were_not_trained_on(spark, sf):
    """Blocks inside the article element are the content of these pages."""
    right = wrong = missed = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        a, b = r.html.find("<article>"), r.html.find("</article>")
        if a < 0:
            continue
        want = [t for t, _, _ in H.blocks(r.html[a:b])]
        got = H.extract(r.html)[0].split("\n")
        right += len(set(want) & set(got))
        wrong += len(set(got) - set(want))
        missed += len(set(want) - set(got))
    assert right > 100 and right >= 0.95 * (right + wrong) and right >= 0.95 * (right + missed)


def test_table(spark, sf, rows_of):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert rows_of(H.extract_text(pages.repartition(5))) == rows_of(H.extract_text(pages))
    long = "<p>" + "word " * 200000 + "</p>"
    rows = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 5), (None, "<p>" + "a " * 30, 5), (3, long, 5)], "page_id bigint, html string, n_blocks int")
    got = sorted(H.extract_text(rows).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [(r.page_id, r.n_blocks) for r in got] == [(1, None), (1, None), (2, 0), (3, 1), (None, 1)]
    assert len(got[3].text.split()) == 200000
    assert H.extract_text(rows.where("false")).count() == 0


def test_elements_without_an_end_tag():
    text = [("some words", 2, 0)]
    for body in ("<body><p>some words", "<p>some words", "<div>some words</div></body></html>"):
        assert H.blocks("<html><head><meta charset=utf-8><title>x</title><style>p {}</style>" + body) == text
    assert H.blocks("<head><title>a < b</title></head><p>some words") == text
    for name in ("select", "svg", "noscript", "iframe", "template"):
        assert H.blocks(f"<p><{name}>some words") == H.blocks(f"<p><{name}-box>some words</{name}-box>") == text
        assert H.blocks(f"<{name}>no</{name}><p>some words") == text
    assert H.blocks("<p>some words<textarea>no") == H.blocks("<p>some words<style>no<p>no") == text
    assert H.blocks("<svg>" * 50000 + "some words") == text


class Flat(HTMLParser):
    """The blocks of a page whose elements are all closed, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.linked, self.links, self.skip = [], [], 0, 0, 0

    def close_block(self):
        words = "".join(self.text).split()
        if words:
            self.out.append((" ".join(words), len(words), min(self.linked, len(words))))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "noscript", "template", "select", "iframe", "textarea"):
            self.close_block()
            self.skip += 1
        elif tag == "a":
            self.links += 1
        elif tag not in H._INLINE and not self.skip:
            self.close_block()
            self.links = 0

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "noscript", "template", "select", "iframe", "textarea"):
            self.skip -= 1
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag not in H._INLINE and not self.skip:
            self.close_block()
            self.links = 0

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            self.linked += len(data.split()) if self.links else 0


def walked(node, x):
    """A row's way down the tree, by itself."""
    while node.feature >= 0:
        node = node.left if x[node.feature] <= node.cut else node.right
    return node.share >= 0.5


def test_as_brute_force(spark, sf):
    """The whole query against another parser, features block by block, and the tree row by row."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r for r in H.op6_html_text(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        parser = Flat()
        parser.feed(r.html)
        parser.close()
        parser.close_block()
        found, keep = parser.out, []
        for i, (text, n, k) in enumerate(found):
            x = []
            for j in (i - 1, i, i + 1):
                x += [found[j][1], found[j][2] / found[j][1]] if 0 <= j < len(found) else [0, 0.0]
            if walked(H.trained(), x):
                keep.append(text)
        mine = got[r.page_id]
        assert (mine.n_blocks, mine.n_content, mine.text) == (len(found), len(keep), "\n".join(keep)), r.page_id
