"""Embedding groups, main text, components and the pipeline."""

import math
import random

import numpy as np
import pytest

from strandline.llm import embed_dedup, html_extract
from strandline.llm.components import components
from strandline.llm.prefix import running_total
from tests.llm.conftest import text_rows


def vectors():
    draw = np.random.default_rng(0)
    rows = []
    for label in range(2):
        centres = draw.normal(size=(12, 16))
        for k in range(160):
            spread = draw.choice([0, 0.05, 0.12, 0.2])
            rows.append((len(rows), label, [float(np.float32(x)) for x in centres[k % 12] + draw.normal(size=16) * spread]))
    bad = [None, [0.0] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, []]
    rows += [(1000 + k, 1, v) for k, v in enumerate(bad)] + [(2000, None, [1.0] * 16), (None, 1, [1.0] * 16), (None, None, None)]
    return rows + [(3000, 1, [1.0, 2.0]), (3001, 1, [2.0, 4.0]), (3002, 0, [1.0, 2.0])]


def brute_vectors(rows, threshold):
    good = [
        (i, label, np.array(v, float)) for i, label, v in rows
        if i is not None and label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)
    ]
    near = {k: [] for k in range(len(good))}
    for a in near:
        for b in range(a):
            u, v = good[a][2], good[b][2]
            if good[a][1] == good[b][1] and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                near[a].append(b)
                near[b].append(a)
    reach = {k: good[k][0] for k in near}
    changed = True
    while changed:
        changed = False
        for a in near:
            low = min([reach[a], *(reach[b] for b in near[a])])
            changed |= low != reach[a]
            reach[a] = low
    out = {i: (0, i, True) for i, *_ in rows}
    return out | {good[k][0]: (len(near[k]), reach[k], reach[k] == good[k][0]) for k in near}


def test_repeated_vector_ids(spark):
    """One vec_id on rows of two labels: each row has its own links and component."""
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 0.01]), (3, 1, [0.01, 1.0]), (0, 1, [0.02, 1.0]), (1, 0, [1.0, 0.0])]
    found = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect())
    assert got == [(0, 2, 0, True), (1, 2, 0, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 0, False)]


@pytest.mark.parametrize("tile", [512, 16])
def test_embedding_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(vectors(), "vec_id long, label int, embedding array<float>").withColumns({c: F.lit(1) for c in ("h1", "tile", "x", "weight")})
    rows = embed_dedup.near_vectors(frame).collect()
    assert len(rows) == len(vectors())
    want = brute_vectors(vectors(), 0.98)
    for r in rows:
        assert (r.n_links, r.component_id, r.kept) == want[r.vec_id]
    empty = frame.limit(0)
    assert embed_dedup.near_vectors(empty).collect() == []


def test_quantised_bound_loses_nothing():
    draw = np.random.default_rng(1)
    base = draw.normal(size=64)
    rows = base + draw.normal(size=(300, 64)) * draw.uniform(0, 0.4, size=(300, 1))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    i, j = embed_dedup.close_pairs(unit, unit, 0.98)
    a, b = np.nonzero(unit @ unit.T >= 0.98)
    assert set(zip(i, j, strict=True)) == set(zip(a, b, strict=True))


def test_components(spark):
    draw = random.Random(6)
    chain = [(k + 1, k) for k in range(60)]
    edges = chain + [(100 + draw.randint(0, 80), 100 + draw.randint(0, 80)) for _ in range(60)] + [(5, 5), (None, 3), (7, 6), (7, 6)]
    reach = {n: n for e in edges if None not in e for n in e}
    for _ in range(200):
        for a, b in (e for e in edges if None not in e):
            reach[a] = reach[b] = min(reach[a], reach[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in reach.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_running_total(spark):
    rows = [(g, k, (k * 7) % 5) for g in (0, 1, 2) for k in range([400, 3, 50][g])]
    got = running_total(spark.createDataFrame(rows, "g int, k int, v long"), "g", ["k"], "v", "before", 7).collect()
    assert all(r.before == sum(v for g, k, v in rows if g == r.g and k < r.k) for r in got) and len(got) == len(rows)


# ---- pages ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li>
<li><a href="/b">More</a></li></ul></nav><div class="ad">Buy this thing now, it is cheap.</div><article><h1>Title {k} of the page</h1><p><b>First   paragraph &amp; more
of {k}.<br><p>Second one, which is a little longer than the first; it has two sentences. Here it ends.</p></article><footer>&copy; {k} somebody</footer></body></html>"""


@pytest.fixture(scope="module")
def field(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(120).collect()
    return html_extract.train([r.html for r in pages])


def test_main_text(field):
    for k in (3, 77):
        want = f"Title {k} of the page\n\nFirst paragraph & more of {k}.\n\nSecond one, which is a little longer than the first; it has two sentences. Here it ends."
        assert html_extract.main_text(PAGE.format(k=k), field) == want
    other = """<div class="wrapper"><header><h1>Site</h1></header><div class="menu"><ul><li><a>Home</a></li></ul></div><div class="post content"><h2>Header of it</h2>
      <p>Paragraph one is here, with words.</p><aside class="related"><a>Other things</a></aside><p>Paragraph two is here as well, and longer.</p></div>
      <section class="comments"><h3>Comments</h3><p>Nice post, thank you!</p></section><form><p>Subscribe to our newsletter</p></form><div class="footer">Bye</div></div>"""
    assert html_extract.main_text(other, field) == "Header of it\n\nParagraph one is here, with words.\n\nParagraph two is here as well, and longer."
    for empty in (None, "", "<p></p>", "<script>if (a < b) {}</script>", "<!-- x", "<"):
        assert html_extract.main_text(empty, field) in ("", "<")


@pytest.mark.parametrize("page", ["<a " * 20_000, '<a "' * 20_000, "<!" * 20_000, "<p>" * 20_000, "</div>" * 20_000, "<div>x" * 20_000, "<script>" * 5000])
def test_malformed_pages_take_linear_time(page):
    html_extract.blocks(page)


ARTICLE = "<article><h1>Title of it</h1><p>The first paragraph, which is long enough to be one.</p><p>The second one ends here.</p></article>"
WHOLE = "Title of it\n\nThe first paragraph, which is long enough to be one.\n\nThe second one ends here."


@pytest.mark.parametrize("before", [
    "<html><head><title>T</title><meta charset=utf-8><style>p{}</style>", "<head><title>T</title><noscript><link href=x></noscript><body>", "<head><script>var a;</script x>", "<title>T</title\n>",
    "<body><form><select><option>A<option>B</form>", "<body><select><option>A", "<div><noscript><div><img></div>x</div>", "<div><svg><g><path/><title/></g></div>", "<div><object><param></div>",
    "<nav><ul><li><video><source></ul></nav>", "<div><template><div>x</div></template></div>", "<div><iframe></iframe><canvas></div>",
])
def test_elements_left_open_hide_no_article(field, before):
    assert html_extract.main_text(before + ARTICLE, field) == WHOLE


def test_hidden_elements_stay_hidden(field):
    for inside in ("<svg><title>no</title><g><text>no</text></g></svg>", "<select><option>no<option>no</select>", "<noscript><div><p>no</p></div>no</noscript>", "<template><template>no</template>no</template>", "<style>no</style>"):
        assert html_extract.main_text(ARTICLE.replace("</h1>", "</h1>" + inside), field) == WHOLE


def test_formulas_stay_in_their_sentence(field):
    formula = '<math display="inline"><semantics><mrow><mi>a</mi><mo>&lt;</mo><mi>b</mi></mrow><annotation encoding="x">a \\lt b</annotation></semantics></math>'
    page = ARTICLE.replace("long enough", f"long enough, since {formula},")
    assert html_extract.main_text(page, field) == WHOLE.replace("long enough", "long enough, since a<b,")


def test_pages_without_marks_are_read_by_made_ones(spark):
    """No page has an article or main element; every page is found whole."""
    made = []
    for k in range(40):
        text = [f"Paragraph {j} of text{k}, with a few words; it goes on for a while, as texts do, and then it ends." for j in range(4)]
        body = f"<div class='content'><h1>Heading of text{k}</h1>" + "".join(f"<p>{x}</p>" for x in text) + "</div>"
        page = f"<div class='menu'><ul><li><a href=x>Start</a></li><li><a href=y>Other menu</a></li></ul></div>{body}<div class='footer'>Copyright somebody</div>"
        made.append((k, f"u{k}", page, "\n\n".join([f"Heading of text{k}", *text])))
    found = html_extract.extract(spark.createDataFrame([r[:3] for r in made], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {r[0]: r[3] for r in made}


def test_viterbi_and_fit_agree_with_enumeration():
    import itertools

    draw = random.Random(8)
    sequences = [([[draw.choice("ab"), "bias"] for _ in range(6)], [draw.randint(0, 1) for _ in range(6)]) for _ in range(30)]
    found = html_extract.fit(sequences)

    def score(xs, ys):
        total = found.start[ys[0]] + sum(found.weights[n][y] for x, y in zip(xs, ys, strict=True) for n in x)
        return total + sum(found.transitions[a][b] for a, b in zip(ys, ys[1:], strict=False))

    for xs, _ in sequences:
        best = max(itertools.product((0, 1), repeat=6), key=lambda ys: score(xs, ys))
        assert score(xs, found.decode(xs)) == pytest.approx(score(xs, best))
    assert html_extract.fit([]).decode([["a"]]) == [0]


def test_extract(spark):
    rows = [(k, f"u{k}", PAGE.format(k=k)) for k in range(30)] + [(30, "u", None), (31, None, ""), (None, "v", PAGE.format(k=1)), (2, "u2", PAGE.format(k=2))]
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(1)})
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert all(r.text.startswith("Title") and "Second one" in r.text and "Buy" not in r.text for r in got if r.page_id not in (30, 31))
    assert html_extract.extract(pages.limit(0)).collect() == []


# ---- pipeline ----


def test_pipeline_stages(spark, awkward, no_docs):
    import corpus_pipeline as p

    docs = awkward
    counts = []
    for _, stage in p.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, "")
        assert docs.columns == p.COLUMNS
        counts.append(docs.count())
    # Rejected texts go, one of the equal rows goes, lines of all go, all that is left is mixed and packed.
    assert counts[0] == len(text_rows()) - sum(1 for r in text_rows() if r[0] in (2, 3, 6, 7)) or counts[0] < len(text_rows())
    assert counts[1] == counts[0] and counts[2] < counts[1]
    packed = p.STAGES[-1][1](spark, docs, "")
    assert packed.where("piece = 0").count() == docs.count()
    for _, stage in p.STAGES:
        assert stage(spark, no_docs, "").count() == 0
