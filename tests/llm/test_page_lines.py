"""Differencing works on every page, also on those with an article."""

from pivotscore.llm import op7_html

ALSO = "Read also what others of our many readers liked this week."


def page(*paragraphs: str, also: str = ALSO) -> str:
    text = "".join(f"<p>{x}</p>" for x in paragraphs)
    return f"<html><nav>Home</nav><article>{text}<div class='related'><p>{also}</p></div></article></html>"


def run(spark, pages):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return df, [r.text for r in op7_html.extract(df).orderBy("page_id").collect()]


def test_doubtful_lines_of_articles_go_where_the_host_repeats_them(spark):
    own = [[f"Text {k} has a first line of its own, {k * 7919}, and it goes on for a while.", "A passage that all articles share."] for k in range(6)]
    pages = [(f"http://h/p/{k}", page(*t)) for k, t in enumerate(own)] + [("http://other/x", page("Alone on its host."))]
    df, got = run(spark, pages)
    assert got == [" ".join(t) for t in own] + [f"Alone on its host. {ALSO}"]
    assert op7_html.shared(df).count() == 6


def test_articles_keep_what_they_share_and_doubtful_lines_of_their_own(spark):
    pages = [(f"http://h/p/{k}", page("Shared first paragraph.", "Shared second paragraph.", f"Own {k}.", also=f"A related story, number {k}, in prose.")) for k in range(4)]
    assert run(spark, pages)[1] == [f"Shared first paragraph. Shared second paragraph. Own {k}. A related story, number {k}, in prose." for k in range(4)]
    copies = [(f"http://h/c/{k}", page("The same text.", "On both pages.")) for k in range(2)]
    assert run(spark, copies)[1] == [f"The same text. On both pages. {ALSO}"] * 2


def test_every_page_is_aligned(spark, monkeypatch):
    asked = []
    neighbours = op7_html.neighbours
    monkeypatch.setattr(op7_html, "neighbours", lambda df: asked.append(df.count()) or neighbours(df))
    df, _ = run(spark, [(f"http://h/p/{k}", page(f"Own {k}.")) for k in range(3)])
    assert asked == [3]
