import itertools

import numpy as np

from scholia.llm.html_text import Field, blocks, extract_text, field, labelled_pages, main_text

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, please accept them.</p></div>
<article><h1>Head &amp; line</h1><p>First   paragraph with <b>bold</b>&nbsp;words,<br>a break and an end.</p>
<div class="ad">Buy this now.</div><p>Second one has more words in it, and it ends here.</p><ul><li>An item of the list.</li></ul></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked the article very much, thank you.</p></div></section>
<form><label>Mail</label><p>Sign up to our letter, it comes every week.</p><button>Go</button></form>
<aside class="sidebar"><p>Related things to read in the side bar.</p></aside><footer>&copy; 2024 somebody</footer></body></html>"""


def test_article_only():
    want = "Head & line\n\nFirst paragraph with bold words, a break and an end.\n\nSecond one has more words in it, and it ends here.\n\nAn item of the list."
    assert main_text(PAGE, field()) == want
    cut = main_text(PAGE[: PAGE.index("Second one") + 8], field())
    assert cut == "Head & line\n\nFirst paragraph with bold words, a break and an end.\n\nSecond o"


def test_unseen_layouts():
    m, right, total = field(), 0, 0
    for html, main in labelled_pages(seed=77, pages=150):
        got, want = set(main_text(html, m).split("\n\n")), set(main)
        right += len(got & want)
        total += len(got | want)
    assert right / total > 0.97


def test_blocks_close_what_is_left_open():
    assert [b[0] for b in blocks("<p><b>A<br>x<p>B<li>c<li>d</ul>e<td>f<td>g")] == ["A x", "B", "c", "d", "e", "f", "g"]
    assert blocks("") == [] and blocks("<script>a<b</script>") == []
    assert len(blocks("<div>" * 20_000 + "deep")) == 1


def test_fields_of_forms_split_no_paragraph_and_noscript_is_text():
    page = "<article><h1>A head line</h1><p>Choose <select><option>one<option>two</select> of the words in this sentence here.</p><noscript><p>Said without a script, in the article, for all readers.</p></noscript><p>And the end of it all, with some more words.</p><template><p>never shown</p></template></article>"
    want = ["A head line", "Choose of the words in this sentence here.", "Said without a script, in the article, for all readers.", "And the end of it all, with some more words."]
    assert [b[0] for b in blocks(page)] == want and main_text(page, field()).split("\n\n") == want


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<article>" + "<p>Long text of many words, all the same.</p>" * 5000, "x")], "page_id long, url string, html string, text string")
    got = extract_text(df).collect()
    assert len(got) == 5 and all(g["n_chars"] == len(g["text"]) for g in got)
    by = {g["page_id"]: g["text"] for g in got}
    assert by[2] == "" and by[None] == "" and by[3].count("\n\n") == 4999
    assert extract_text(df.where("false")).collect() == []


def test_viterbi_equals_the_best_of_all_labellings():
    r = np.random.default_rng(3)
    f = Field({})
    for n in (1, 2, 5, 9):
        f.pair, f.start, e = r.normal(size=(2, 2)), r.normal(size=2), r.normal(size=n) * 2
        score = lambda y: f.start[y[0]] + sum(e[i] * y[i] for i in range(n)) + sum(f.pair[y[i - 1], y[i]] for i in range(1, n))
        assert f.viterbi(e) == list(max(itertools.product((0, 1), repeat=n), key=score))


def test_the_fit_finds_a_maximum_of_the_likelihood():
    """Against all labellings: no small step from the fitted weights makes the pages likelier."""
    pages = [([["a"], ["b"], ["a", "b"]], [1, 0, 1]), ([["b"], ["b"]], [0, 1]), ([["a"], ["c"], ["c"], ["a"]], [1, 1, 0, 0]), ([["c"]], [0])]
    f = Field({"a": 0, "b": 1, "c": 2}).fit(pages, rounds=2000, rate=0.05)

    def objective(theta):
        w, pair, start = theta[:3], theta[3:7].reshape(2, 2), theta[7:]
        total = 0.0
        for names, labels in pages:
            e = [sum(w[f.index[x]] for x in fs) for fs in names]
            score = lambda y: start[y[0]] + sum(e[i] * y[i] for i in range(len(y))) + sum(pair[y[i - 1], y[i]] for i in range(1, len(y)))
            total += score(labels) - np.log(sum(np.exp(score(y)) for y in itertools.product((0, 1), repeat=len(labels))))
        return total / 10 - 0.02 * (theta @ theta) / (2 * len(theta))

    theta, r = np.concatenate((f.w, f.pair.ravel(), f.start)), np.random.default_rng(1)
    assert all(objective(theta) >= objective(theta + 0.05 * r.normal(size=9)) for _ in range(200))
