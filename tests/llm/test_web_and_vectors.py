"""Main text of pages and whitening of embeddings."""

import html as references
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import main_text as M
from lodestone.llm import queries as Q
from lodestone.llm import whitening as W

SF = "/root/testdata/sf0.01"

# --- pages to trees ---------------------------------------------------------------------------------------------------


def leaves(source):
    page = M.parse(source)
    return [(page.tag[page.parent[v]], page.text[v]) for v in range(len(page.text)) if page.text[v] is not None]


def test_parse_blocks_and_references():
    assert leaves("<p>a &amp; b<b> c</b><p>d<br>e\n\t f</p>g") == [("p", "a & b c"), ("p", "d e f"), ("html", "g")]
    assert leaves("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d")]
    assert leaves("<table><tr><td>1<td>2<tr><td>3</table>") == [("td", "1"), ("td", "2"), ("td", "3")]
    assert leaves("<div title='a>b'>x</div><!-- <p>no --><script>var t='</p><p>no'</script><style>p{}</style>y<textarea>no</textarea>") == [("div", "x"), ("html", "y")]
    assert leaves("<p>2 < 3 and 4 > 1 &lt;p&gt; &eacute;&#233;&#xe9; &nosuch; &nbsp;") == [("p", "2 < 3 and 4 > 1 <p> ééé &nosuch;")]
    assert leaves("<head><title>no</title></head><body>yes") == [("body", "yes")]
    assert leaves("") == leaves("<!-- never closed <p>x") == leaves("<script>never closed <p>x") == leaves('<p class="never closed>x') == []


def test_parse_is_linear_and_deep():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert [t for _, t in leaves(deep)] == ["x"]
    many = "<p>" + "word & <b>more</b> " * 100_000
    assert len(leaves(many)) == 1 and len(leaves(many)[0][1]) == len("word & more " * 100_000) - 1
    assert len(leaves("<p>a" * 50_000)) == 50_000


# --- the model --------------------------------------------------------------------------------------------------------


def test_marginals_against_all_markings():
    """Sum-product against the sum over all 2^n markings of each tree, with edge marginals and log Z."""
    draw, npr = random.Random(5), np.random.default_rng(5)
    for _ in range(20):
        n = draw.randint(1, 9)
        forest = M.Forest([])
        forest.size, forest.parent = n, np.array([-1, *(draw.randrange(v) for v in range(1, n))])
        forest.kind = npr.integers(0, 3, n)
        depth = [0] * n
        for v in range(1, n):
            depth[v] = depth[forest.parent[v]] + 1
        forest.levels = [np.array([v for v in range(n) if depth[v] == d]) for d in range(1, max(depth) + 1)]
        unary, pair = npr.normal(0, 2, n), npr.normal(0, 2, (3, 2, 2))
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            weight[y] = math.exp(sum(unary[v] * y[v] for v in range(n)) + sum(pair[forest.kind[v], y[forest.parent[v]], y[v]] for v in range(1, n)))
        z = sum(weight.values())
        content, joint, log_z = M.marginals(forest, unary, pair)
        assert log_z == pytest.approx(math.log(z))
        for v in range(n):
            assert content[v] == pytest.approx(sum(w for y, w in weight.items() if y[v]) / z)
        for k, v in enumerate(range(1, n)):
            for a, b in itertools.product((0, 1), repeat=2):
                assert joint[k, a, b] == pytest.approx(sum(w for y, w in weight.items() if y[forest.parent[v]] == a and y[v] == b) / z)


@pytest.fixture(scope="module")
def model():
    writer = M.Writer(7)
    return M.fit([writer.page() for _ in range(700)])


def test_fit_finds_a_stationary_point():
    """The trained weights leave a small gradient: what features occur in labelled content is what the model expects."""
    writer = M.Writer(3)
    data = [writer.page() for _ in range(60)]
    model = M.fit(data, steps=1500, rate=0.05, ridge=1.0)
    forest = M.Forest([p for p, _ in data])
    y = np.array([m for (page, leaf), old in zip(data, forest.old) for m in M.spread_up(page, old, leaf)], float)
    content = M.marginals(forest, model.unary(forest), model.pair)[0]
    g = np.bincount(forest.flat, (content - y)[forest.of], M.WIDTH) + model.weights
    assert np.abs(g).max() < 0.5


def test_held_out_layouts(model):
    writer = M.Writer(1234)
    pages = [writer.page() for _ in range(300)]
    forest = M.Forest([p for p, _ in pages])
    content = M.marginals(forest, model.unary(forest), model.pair)[0]
    right = [(content[s + k] >= 0.5) == leaf[v] for (page, leaf), old, s in zip(pages, forest.old, forest.starts) for k, v in enumerate(old) if page.text[v] is not None]
    assert np.mean(right) > 0.98


SENTENCE = "This is a sentence of the story, and it goes on for a while. Another one follows it!"
PAGE = f"""<!doctype html><html><head><title>T</title></head><body>
<header class="site-header"><h1><a href="/">Daily paper</a></h1><nav><a href=/a>Home</a> <a href=/b>World</a></nav></header>
<div class="cookie-notice">We use cookies on this site. <a href=/c>More</a><button>OK</button></div>
<div id="content"><div class="post"><h1>The  story&#39;s title</h1><p>{SENTENCE} <a href=/d>linked words</a> go on.</p>
<div class="ad">Buy our things now.</div><h2>Part</h2><p>{SENTENCE}<p>{SENTENCE}<ul><li>One thing, said in words.</li><li>Another thing, said too.</li></ul></div>
<div class="comments"><h3>Comments</h3><ul><li><b>Kim</b> {SENTENCE}</li><li><b>Sam</b> {SENTENCE}</li></ul></div></div>
<div class="sidebar"><h3>Related</h3><ul><li><a href=/e>Other story</a></li><li><a href=/f>Third story</a></li></ul></div>
<form class="newsletter"><label>Your mail</label><input name=m><p>Get our letter.</p></form><footer>&copy; Daily paper. All rights.</footer></body></html>"""


def test_written_page(model):
    assert model.texts([PAGE, "", "<p></p>"]) == [f"The story's title\n{SENTENCE} linked words go on.\nPart\n{SENTENCE}\n{SENTENCE}\nOne thing, said in words.\nAnother thing, said too.", "", ""]


def test_main_texts_whole_table(spark):
    """Every page of the table against its article, cut out by the tags of this table's one template."""
    got = {r.page_id: r for r in Q.op11_main_texts(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(references.unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_main_texts_odd_rows(spark):
    long = "<p>" + "word " * 300_000 + "."
    rows = [(1, "u", PAGE, 0), (1, "u", PAGE, 0), (None, None, None, 1), (3, "v", "", 2), (4, None, "<article>" + long + "</article>", 3), (5, "w", "plain", 4)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int").withColumn("n_chars", F.lit("x"))
    got = M.main_texts(table, made_up=200).collect()
    assert sorted((r.page_id or 0, r.url or "") for r in got) == sorted((r[0] or 0, r[1] or "") for r in rows)
    by = {r.page_id: r for r in got}
    assert by[None].text == by[3].text == "" and by[None].n_chars == 0
    assert by[4].n_chars == len(by[4].text) == len(" ".join(("word " * 300_000 + ".").split()))
    assert M.main_texts(table.where("false"), made_up=50).count() == 0


# --- whitening --------------------------------------------------------------------------------------------------------


def by_hand(vectors, k=16):
    """Levels, exact deviations, eigenpairs and whitened values by the whole covariance matrix."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), [sum(map(int, c)) for c in fit.T]
    mean = np.array([v / n for v in s])
    v = (fit - mean).T @ (fit - mean) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x], (x - mean) @ q / np.sqrt(e), e / np.trace(v)


def test_whitening_whole_table(spark):
    got = Q.op12_whiten_embeddings(spark, SF).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, explained = by_hand([r.embedding for r in rows])
    assert len(got) == 16 * len(rows) and set(got.n) == {n}
    mine = got.whitened.to_numpy().reshape(-1, 16)
    assert got.deviation.to_numpy().reshape(-1, 16)[:, 0].tolist() == deviation
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white * signs).max() < 1e-9
    assert np.allclose(got.explained.to_numpy()[:16], explained, rtol=1e-10)
    assert got.identity_error.max() < 1e-10 and got.identity_error.nunique() == 1


def test_iteration_beyond_the_block():
    """300 dimensions of which the block holds 12; clustered, tied and decaying spectra, and one without variance."""
    npr = np.random.default_rng(4)
    turn = np.linalg.qr(npr.standard_normal((300, 300)))[0]
    for e in (np.linspace(2, 1, 300), np.r_[np.full(3, 9.0), np.full(297, 8.0)], 10.0 ** -np.linspace(0, 14, 300), np.r_[5.0, np.zeros(299)], np.zeros(300)):
        v = turn * e @ turn.T
        calls = []
        q, values, residual, passes = W.subspace_iteration(lambda b: calls.append(b.shape) or v @ b, 300, 4)
        assert np.allclose(values, e[:4], atol=1e-11) and residual < 1e-10 and passes == len(calls)
        assert all(c == (300, 12) for c in calls)
        assert np.abs(q.T @ q - np.eye(4)).max() < 1e-12
        assert np.linalg.norm(v @ q - q * e[:4], axis=0).max() < 1e-10


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(8)
    good = [[float(c) for c in v] for v in draw.normal(0, 1, (30, 5))]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(3, good[3], "x"), (None, good[4], "x"), (50, None, "x"), (51, [1.0, None, 0.0, 0.0, 0.0], "x"), (52, [nan] * 5, "x"), (53, [inf, 0.0, 0.0, 0.0, 0.0], "x"), (54, good[0][:3], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").withColumn("component", F.lit("clash"))
    got = W.whiten(table).collect()
    vectors = good + [good[0][:3] + [0.0, 0.0]]
    n, deviation, white, _ = by_hand(vectors, 5)
    assert len(got) == 5 * (30 + 2 + 1) and {r.n for r in got} == {n} == {31}
    of = {(r.vec_id, r.component): r for r in got}
    assert of[54, 1].deviation == deviation[30] and abs(of[54, 5].whitened) == pytest.approx(abs(white[30][4]))
    assert of[None, 2].whitened == of[4, 2].whitened
    assert sum(r.vec_id == 3 for r in got) == 10
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(4)], "vec_id long, embedding array<float>")
    assert W.whiten(same).count() == 0 and W.whiten(table.where("false")).count() == 0 and W.whiten(table.where("vec_id = 50")).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert all(r.deviation is None for r in W.whiten(huge).where("vec_id = 1").collect())
