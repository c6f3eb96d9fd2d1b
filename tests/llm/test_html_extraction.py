"""Main text: given pages, held-out layouts, odd rows."""

import numpy as np

from txnclean.llm.html_blocks import blocks
from txnclean.llm.html_extraction import _padded, extract, fit, layouts, train, vectors

S = " ".join(["The quiet river ran past the old mill, and nobody in the village could say why."] * 3)
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy now.</div>
<article><h1>A &amp; B</h1><p><b>{S}<br><p>Second&nbsp;&lt;part&gt;
 with   space.</p><div class="ad">Great offer.</div><p>{S} End &am</p></article>
<div class="comments"><p>First!</p><p>I liked it.</p></div><form><label>Name</label></form><footer>&copy; 2020
Les.</footer>"""
WANT = f"A & B\n{S}\nSecond <part> with space.\n{S} End &am"


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, 3), (None, "u", "", 3), (4, "u", "< < <b", 3),
                                   (5, "u", "<article>" + f"<p>{S}</p>" * 3000 + "</article>", 3)], "page_id long, url string, html string, n_chars int")
    got = sorted(extract(pages, fit(pages)).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    assert [r["text"] for r in got[:2]] == [WANT, WANT] and got[0]["n_chars"] == len(WANT)
    assert [(r["text"], r["n_chars"]) for r in got if r["page_id"] in (2, None)] == [("", 0)] * 2
    assert [r["text"] for r in got if r["page_id"] == 5] == ["\n".join([S] * 3000)]
    assert extract(pages.limit(0), fit(pages.limit(0))).count() == 0


def test_held_out_layouts():
    lay = list(layouts([f"w{k}" for k in range(300)], 300))
    x = vectors([p for p, _ in lay])
    net = train(list(zip(x[:240], [y for _, y in lay[:240]])))
    wrong = total = 0
    for f, (_, y) in zip(x[240:], lay[240:]):
        got = net.forward(*_padded([f]))[0][:, 0] >= 0.5
        wrong, total = wrong + (got != y).sum(), total + len(y)
    assert wrong / total < 0.05


def test_gradients():
    rng = np.random.default_rng(0)
    (p, y), = layouts(["a", "b"], 1)
    from txnclean.llm.html_extraction import Labeller
    net = Labeller.new(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, on = _padded(vectors([p]))
    want = y[:, None]

    def loss():
        c = net.forward(x, on)[0]
        return -(want * np.log(c) + (1 - want) * np.log(1 - c)).sum() / on.sum()

    g = net.gradients(x, on, want)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        i = int(np.abs(g[k].reshape(-1)).argmax())
        old = flat[i]
        flat[i] = old + 1e-4
        up = loss()
        flat[i] = old - 1e-4
        down = loss()
        flat[i] = old
        assert abs((up - down) / 2e-4 - g[k].reshape(-1)[i]) < 1e-3 * max(1, abs(g[k].reshape(-1)[i]))


def test_blocks_bear_broken_markup():
    assert [b.text for b in blocks('a<p>b<p>c</div></p><a href="x>y">d</a><p title=\'q"e>f')] == ["a", "b", "c", "d", "f"]
    assert [b.text for b in blocks("<ul><li>x<ul><li>y</ul><li>z")] == ["x", "y", "z"]
    assert blocks("<script>if (a<b) {") == []
