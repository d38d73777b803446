from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from correctionlab.functions import fixed_values as V
from correctionlab.functions import html as H
from correctionlab.functions.expressions import era_column, url_file_name
from correctionlab.operators import catalogue as C


def era_cases():
    """Each bound from both sides, and each listed name inside a longer one in capitals."""
    for era, below in V.ERA_YEAR_BOUNDS:
        yield "", below - 1, era
    yield from (("", below, era) for (_, below), era in zip(V.ERA_YEAR_BOUNDS, V.ERAS[1:]))
    for era, names in V.ERA_COMPOSERS:
        yield from ((f"A. {name.upper()} junior", None, era) for name in names)
    yield from [("Ina Velde", None, V.DEFAULT_ERA), (V.ERA_COMPOSERS[0][1][0], 2001, V.DEFAULT_ERA), (None, None, V.DEFAULT_ERA)]


def test_era(spark):
    df = spark.createDataFrame(list(era_cases()), "c string, y int, want string")
    assert df.where(~era_column(F.col("c"), F.col("y")).eqNullSafe(F.col("want"))).collect() == []


def page(spark, html, url="https://imslp.org/wiki/Score"):
    return spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string")


def metadata(spark, html):
    row = C.page_metadata(page(spark, html)).first()
    return row.composer, row.description


def wiki(heading, content):
    return f"""<html><body><h1 id="x" class="firstHeading mw">{heading}</h1>
    <div class='a mw-parser-output b'>{content}</div></body></html>"""


def test_composer_from_heading(spark):
    assert metadata(spark, wiki("Harbour Pieces, 2nd set (Velde, Ina)", "<p>Six short ones.</p>")) == (
        "Velde, Ina", "")


def test_description_is_first_long_paragraph(spark):
    text = "Written for the opening of the new quay, and played there by two bands."
    assert metadata(spark, wiki("Quay Music", f"<p>Stub</p><p>  {text[:20]}<b>{text[20:]}</b></p><p>{text}{text}</p>"))[1] == (
        text[:20].strip() + text[20:].strip())


def test_description_is_cut(spark):
    assert metadata(spark, wiki("W (C)", f"<p>{'A' * 500}</p>"))[1] == "A" * 300
    assert metadata(spark, wiki("W (C)", f"<p>{'A' * 40}</p>"))[1] == ""


def test_description_only_from_the_body(spark):
    outside = "<p>" + "outside " * 10 + "</p>"
    assert metadata(spark, outside + wiki("W", "<div><p>short</p></div><p>x</p>") + outside)[1] == ""
    inside = wiki("W", "<div><div>a</div></div><p>" + "inside " * 10 + "</p>") + outside
    assert metadata(spark, inside)[1].startswith("inside")


def test_unclosed_paragraphs_end_at_the_next_block(spark):
    assert metadata(spark, wiki("W", "<p>short<p>" + "long " * 10 + "<ul><li>item</ul>"))[1] == ("long " * 10).strip()


def test_infobox_wins(spark):
    table = "<table><tr><th>Parts</th><td>6</td></tr><tr><th> <b>Composer</b> </th>\n<td>Ina <i>M.</i> Velde</td></tr></table>"
    assert metadata(spark, table + wiki("Quay (Reuter)", ""))[0] == "InaM.Velde"
    assert metadata(spark, "<tr><th>Composer<td>x</td></tr>" + wiki("Q (Reuter)", ""))[0] == "Reuter"
    plain = "<table><tr><th>Composer</th><td>Ina Velde</td></tr></table>"
    assert metadata(spark, plain)[0] == "Ina Velde"


def test_category_is_the_last_resort(spark):
    links = ('<a href="/wiki/Category:Orchestra">For orchestra</a><a href="/wiki/Help">?</a>'
             '<a class="c" href="/wiki/Category:Velde">  Velde &amp; Reuter </a>')
    assert metadata(spark, wiki("No parentheses", "") + links)[0] == "Velde & Reuter"


def test_nothing_found(spark):
    assert metadata(spark, "<html><body></body></html>") == ("", "")


def links(spark, html, url="https://imslp.org/wiki/Score"):
    return [r.link for r in C.page_links(page(spark, html, url)).orderBy("position").collect()]


def test_rows_come_first_then_gateways_files_and_images(spark):
    gateway = f"/wiki/Special:{V.LINK_GATEWAY}/"
    html = f"""<!-- <a href="/quay0.pdf">no</a> --><a href="/quay/set2.PDF">all</a>
      <a title='a > b' href='{gateway}701'>first</a><a HREF=//images/imslp.org/quay.pdf?n=4&amp;s=1>scan</a>
      <table><tr><td><a href="/help">h</a></td></tr><tr class="odd we_have_file"><td>
      <a href="parts.pdf">p</a><a href="{gateway}702">second</a></td></tr></table>"""
    site = "https://imslp.org"
    assert links(spark, html) == [f"{site}/wiki/parts.pdf", f"{site}{gateway}702", f"{site}{gateway}701", f"{site}/quay/set2.PDF",
                                  "https://images/imslp.org/quay.pdf?n=4&s=1"]


@pytest.mark.parametrize("tag", ["<a ", "<p ", "<th>", "<td ", "<h1 class='firstHeading' ", "<a href='", "<tr class=\"we_have_file\" ", "<!--", "<th><b>x</b>"])
@pytest.mark.parametrize("end", ["", ">"])
def test_broken_tags_of_any_length(spark, tag, end):
    html = tag + "x y " * 250_000 + end
    assert C.page_links(page(spark, html)).count() == 0
    assert len(metadata(spark, html)) == 2


def test_links_are_distinct_after_resolving(spark):
    assert links(spark, '<a href="/f/s.pdf">1</a><a href="https://imslp.org/f/s.pdf">2</a>') == ["https://imslp.org/f/s.pdf"]


def test_five_links_at_most(spark):
    assert len(links(spark, "".join(f'<a href="/s{i}.pdf">x</a>' for i in range(10)))) == 5


@pytest.mark.parametrize("base", [
    "https://h.org/a/b/c?q=1#f", "http://h.org", "http://h.org/", "https://h.org:80/x/", "https://h.org/a/./b/../c",
])
def test_resolution_equals_urljoin(spark, base):
    hrefs = ["", "x.pdf", "./x.pdf", "../x.pdf", "../../x.pdf", "../../../../x.pdf", "/x/../y.pdf", "/", "?n=2", "#z",
             "//other.org/p.pdf", "https://o.org/a/../b.pdf", "mailto:me@x.org", "a/b/../c/./d.pdf?x=1#y", "d/..", "d/."]
    df = spark.createDataFrame([(base, h, urljoin(base, h)) for h in hrefs], "base string, href string, want string")
    bad = df.withColumn("got", H.absolute_url(F.col("base"), F.col("href"))).where("got <> want").collect()
    assert bad == []


def test_file_names(spark):
    urls = {"https://x.org/a/b.pdf?x=1/2": "2.pdf", "https://x.org/a/": "score.pdf", "https://x.org/a/Score.PDF": "Score.PDF",
            "https://x.org/a/name?q": "name.pdf", "name": "name.pdf", "https://x.org/?x": "score.pdf"}
    df = spark.createDataFrame(list(urls.items()), "u string, want string")
    assert df.where(url_file_name(F.col("u")) != F.col("want")).collect() == []
