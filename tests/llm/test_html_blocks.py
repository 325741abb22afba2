import re

import pytest

from emberfield.llm.html_blocks import cut_page, extract_text, targets, train_labeller, training_pages

PAGES = "/root/testdata/sf0.001/pages.parquet"


def test_cutting():
    page = ('<div class="comments"><p>hi <b>x</b>y<br>z<p>2 &lt; 3 &amp; 4 < 5</div><script>if(a<b){"</p>"}</script>t'
            '<p hidden>no</p><textarea>q</textarea><ul><li>a<li>b</ul><p title="a>b">c<!-- no --> d &#233;&copy; <a href=x>e</a></p><p cut')
    assert [b.text for b in cut_page(page)] == ["hi xy z", "2 < 3 & 4 < 5", "t", "a", "b", "c d é© e"]
    assert cut_page(None) == cut_page("") == cut_page("<p></p><br>") == []
    assert targets(cut_page("<nav>x</nav><article><p>y</p><div class='share ad'>z</div></article>")) == [0, 1, 0]


def texts(page):
    return [b.text for b in cut_page(page)]


@pytest.mark.parametrize("page", [
    "<head><title>t</title><meta charset=x><body><p>article", "<html><head><link rel=x><div>article</div>",
    "<head><style>p{}</style><script>x</script>\n article", "<head></head><body>article", "<head><noscript><p>n</p></noscript><template><p>n</p></template><p>article"])
def test_head_without_end_tag(page):
    assert texts(page) == ["article"]


@pytest.mark.parametrize("page", [
    "<script>for(i=0;i<n;i++){ // don't stop</script><p>The town's mayor</p><script>it's</script>",
    "<style>a<b don't</STYLE ><p>The town's mayor", "<title>a<b don't</title><p>The town's mayor", "<textarea><p it's</textarea><p>The town's mayor",
    "<iframe>a<b don't</iframe><p>The town's mayor", "<script><!-- w('<script>x</script>') // it's --></script><p>The town's mayor",
    "<script src=/a/>it's</script><p>The town's mayor", "<p title=don't>The town's mayor"])
def test_raw_text_ends_at_its_own_end_tag(page):
    assert texts(page) == ["The town's mayor"]


@pytest.mark.parametrize("page", [
    '<p class="md:block hidden lg">seen', "<p title='x hidden y'>seen", "<p data-hidden=1>seen", '<p data-note="display:none">seen',
    "<p style='x-display:none'>seen", "<p style='display:none;display:block'>seen", "<p style='content:none'>seen",
    "<div hidden>a<div>b</div>c</div>seen", "<div style='color:red; DISPLAY : none !important'><div>b</div>c</div><p>seen",
    "<p hidden>no<p>seen", "<ul><li hidden><p>no<li>seen</ul>", "<table><tr hidden><td>no<td>no<tr><td>seen</table>",
    "<table><thead hidden><tr><td>no<tbody><tr><td>seen</table>", "<p hidden>no<picture></picture>no</p>seen", "<p>se<span hidden>no<br></span>en",
    "<svg><path d=x/><svg>no</svg>no</svg>seen", "<template><p>no</div><template>no</template>no</template>seen"])
def test_hidden_by_attributes_with_balanced_nesting(page):
    assert texts(page) == ["seen"]


@pytest.fixture(scope="module")
def labeller(spark):
    return train_labeller(training_pages(spark.read.parquet(PAGES)))


def test_article_of_the_given_pages(spark, labeller):
    import html

    df = spark.read.parquet(PAGES)
    got = {r.page_id: r.text for r in extract_text(df, labeller).collect()}
    wrong = 0
    for r in df.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)
        parts = re.split(r"</?(?:p|h1|article)[^>]*>", re.sub(r"<[^>]*\Z", "", body[1].replace("<br>", " ")) if body else "")
        text = " ".join(filter(None, (" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in parts)))
        wrong += text != got[r.page_id]
    assert wrong <= len(got) // 100


def test_other_layouts(spark, labeller):
    """Without article elements the words, links and neighbours decide."""
    prose = "".join(f"<p>This is sentence number {i} of a longer text that tells a story in plain words.</p>" for i in range(8))
    page = f"<body><nav><a href=/>Home</a> <a href=/a>News</a></nav><main>{prose}</main><footer>&copy; site</footer><div class='comments'><p>first!</p></div></body>"
    text = extract_text(spark.createDataFrame([(1, page)], "page_id long, html string"), labeller).first().text
    assert text.startswith("This is sentence number 0") and "Home" not in text and "site" not in text


def test_awkward_rows(spark, labeller):
    rows = [(1, None), (2, ""), (3, "<"), (4, "plain text"), (4, "plain text"), (None, "<p>" * 3000), (6, "<script>x"), (7, "&am")]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS text")
    got = extract_text(df, labeller)
    assert got.columns == ["page_id", "text"] and got.count() == len(rows)
    assert {r.text for r in got.collect() if r.page_id in (1, 2, 6)} == {""}
    assert extract_text(df.limit(0), labeller).count() == 0 and train_labeller([]).probabilities([]) == []
