"""Zones of a page's blocks, and lines that near copies share."""

from pivotscore.llm import op7_html


def main_text(page: str) -> str:
    return " ".join(t for z, t in op7_html.blocks(page) if z == "main")


def test_names_do_not_drop_an_article():
    for page in ("<article class='post alert'><p>Body text.</p></article>", "<div class='widget'><article>Body text.</article></div>",
                 "<div ROLE='Main' class=search>Body text.</div>", "<div role=main>Body text.</div>",
                 "<div class='notice'><main><div class='search-results'><p>Body text.</p></div></main></div>",
                 "<article><header class='entry-header'>Body</header><section class='social related'>text.</section></article>"):
        assert main_text(page) == "Body text.", page


def test_boilerplate_in_and_around_an_article():
    page = ("<div class=related><article>Teaser, and it is longer than the text of the page itself.</article></div>"
            "<article>Body.<div class=share><a href=1>Tell a friend</a> or not</div><div class='related'>Prose with <a href=1>one</a> link in it stays."
            "</div><div class=search><form>find</form>Type here</div><div class=ad>Buy</div><p class=notice>Closed.</p><div class=toolbar></div>"
            "<article class=comment>Me too</article> End.</article><div id=comments><article>First!</article></div>")
    assert main_text(page) == "Body. Prose with one link in it stays. End."
    assert main_text("<div id=comments><article>First! A long comment.</article></div><p>Text.</p>") == ""
    assert [b for b in op7_html.blocks("<div class=alert><article>tiny</article></div><p>Longer open text.</p>") if b[0] != "drop"] == [("open", "Longer open text.")]


def test_references_are_decoded_before_joining():
    assert main_text("<article>a &amp;&lt;b&gt; &<b>lt;</b> &amp;lt; x&nbsp;y</article>") == "a &<b> &lt; &lt; x y"


def test_unclosed_and_stray_ends():
    assert main_text("<article>a<div class=share><a>link</a>") == "a"
    assert main_text("</div></article><article>a</p>b</article>") == "a b"


def extracted(spark, pages: list[tuple[str, str]]) -> list[str]:
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in op7_html.extract(df).orderBy("page_id").collect()]


def para(*lines: str) -> str:
    return "".join(f"<p>{x}</p>" for x in lines)


def test_near_copies_keep_their_text(spark):
    first, second = "First paragraph of it.", "Second one goes on."
    near = [para(first, second, "Third one ends it."), para(first, second, "Third one was edited.")]
    assert extracted(spark, [("http://h/a/1", near[0]), ("http://h/a/2", near[1])]) == [f"{first} {second} Third one ends it.", f"{first} {second} Third one was edited."]


def test_templates_go_also_where_pages_are_near_copies(spark):
    top, end = "Our site has a long line on top of every page, and it goes on.", "And a line at the end of every page, no shorter than that one."
    texts = [[f"Text {k} has its own first line, about as long as others.", f"And a second one, {k * 7919}, which no other has at all."] for k in range(12)]
    texts[5] = [texts[4][0], texts[4][1], "Edited."]
    texts[9] = texts[8] = texts[7]
    got = extracted(spark, [(f"http://h/p/{k:02d}", para(top, *t, end)) for k, t in enumerate(texts)] + [("http://other/x", para(top, "Alone."))])
    assert got == [" ".join(t) for t in texts] + [f"{top} Alone."]


def test_frequent_lines_are_joined_apart(spark):
    lines = spark.createDataFrame([(k, 1) for k in range(3000)] + [(-1, 5000)], "line long, n long")
    rows = spark.createDataFrame([(k, -1 if k % 2 else k) for k in range(50)] + [(50, 99999)], "at long, line long")
    got = {r["at"]: r.n for r in op7_html._by_line(rows, lines, 8000, "left").collect()}
    assert got == {k: 5000 if k % 2 else 1 for k in range(50)} | {50: None}
    assert op7_html._by_line(rows, lines, 8000, "inner").count() == 50
