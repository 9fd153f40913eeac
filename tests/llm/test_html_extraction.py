import re

import numpy as np
import pytest

from siltbed.llm.html_extraction import Labeller, hinted, padded, plain, read_blocks, train, with_main_text
from siltbed.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def by_markup(page):
    """The article of the given pages, cut out with patterns."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    return "\n".join(t for part in re.split(r"</?(?:h1|p)>", inner) if (t := plain(re.sub(r"<br>", " ", re.sub(r"</?b>", "", part)))))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def labeller(pages):
    return train(pages)


def test_registered_query(spark, pages):
    want = {r.page_id: by_markup(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in QUERIES["op7_html_extraction"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert sum(got[i].text == want[i] for i in want) >= 0.98 * len(want)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_other_markup(spark, labeller):
    text = "The and attion to thanedble, the anea. Eriner thanea and others, too. " * 3
    page = f"""<html><body><header><nav><ul><li><a href=1>Home</a></ul></nav></header><div class="cookie-notice">We use cookies.</div>
      <aside><h2>Popular</h2><p>Other story here.</p></aside><article><h1>Tom &amp; Jerry</h1><p>{text}<p>{text}&nbsp;x<script>var a="<p>no</p>"</script>
      </article><section class="comments"><p>Nice post!</p><p>I agree.</p></section><form><label>Name</label><button>Send</button></form>
      <footer>&copy; 2020</footer></body></html>"""
    row = with_main_text(spark.createDataFrame([(page,)], "html string"), labeller).first()
    lines = row.text.split("\n")
    assert "Tom & Jerry" in lines and plain(text) in lines and plain(text + "&nbsp;x") in lines
    assert not {"Nice post!", "I agree.", "We use cookies.", "Home", "Send", "© 2020", "Other story here."} & set(lines)


def test_odd_pages(spark, labeller):
    rows = [(1, None, "x"), (2, "", "x"), (3, "<p", "x"), (4, "<article>" + "<p>word and word.</p>" * 5000, "x"), (None, "</div></p>&#x41;&bogus;", "x"),
            (6, "<article><p>same, here.</p></article>", "x"), (6, "<article><p>same, here.</p></article>", "x")]
    out = with_main_text(spark.createDataFrame(rows, "page_id long, html string, text string"), labeller).collect()
    assert len(out) == 7 and all(isinstance(r.text, str) for r in out)
    assert out[0].text == out[1].text == "" and out[5].text == out[6].text
    assert out[3].text.count("\n") == 4999
    assert with_main_text(spark.createDataFrame([], "html string"), labeller).count() == 0
    assert train(spark.createDataFrame([], "html string")).label([np.zeros((0, 125), np.float32)])[0].size == 0


def test_reading():
    blocks = read_blocks('<title>T</title><script>"</p>"</script><p><b>One &lt;1&gt;<br><p class="A b">two\n  <i>three</i></p>tail')
    assert [(b.text, b.path) for b in blocks] == [
        ("T", ("title",)), ("One <1>", ("p", "b")), ("two three", ("p", ".a", ".b")), ("tail", ())]
    assert hinted(read_blocks("<article><p>x</p></article>")[0]) and not hinted(read_blocks("<article><aside>x</aside></article>")[0])


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    model = Labeller(6, 3)
    model.p = {n: w.astype(np.float64) for n, w in model.p.items()}
    x, mask = padded([rng.standard_normal((n, 6)).astype(np.float32) for n in (4, 2, 1)])
    x, y = x.astype(np.float64), (rng.random(mask.shape) < 0.5) * mask
    def loss():
        p = model.probabilities(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()
    grad = model.gradients(x, mask, y)
    for name, w in model.p.items():
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 5)]:
            old = w[at]
            w[at] = old + 1e-4
            up = loss()
            w[at] = old - 1e-4
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-4 - grad[name][at]) < 2e-3
