"""Main text: paths of any depth count, math is text, and unclosed elements hide nothing."""

from __future__ import annotations

from pressloom.llm.extract import blocks, describe, extract, train_labeller


def test_every_path_token_counts():
    deep = lambda mark: f'<div class="{mark}">' + '<div class="a b c d e">' * 6 + "<p>Some words of text." + "</div>" * 7
    comments, article = blocks(deep("comments")), blocks(deep("article"))
    assert len(comments[0][1]) > 24
    path, article_path = (sorted(describe(x)[0].tolist()) for x in (comments, article))
    assert path != article_path and len(path) == len(comments[0][1])


def test_math_is_inline_text():
    assert [b[0] for b in blocks("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>")] == ["where x=2 holds"]


def test_a_missing_end_hides_nothing():
    for name in ("svg", "noscript", "template"):
        assert [b[0] for b in blocks(f"<p>one</p><{name}><p>two</p><{name}><p>three</p>")] == ["one", "two", "three"]
        assert [b[0] for b in blocks(f"<p>one</p><{name}>two</{name}><p>three</p>")] == ["one", "three"]
    assert [b[0] for b in blocks("<p>one</p><script>two")] == ["one"]


def test_quotes_open_values_behind_an_equals_sign_only():
    page = "<p title=it's>Hello</p><p>World don't stop</p><p class=\"a>b\" x = 'q>r'>End</p>"
    assert [b[0] for b in blocks(page)] == ["Hello", "World don't stop", "End"]


def test_labels_of_whole_pages_agree_with_their_articles(spark):
    """Accuracy by page on the smallest table: the blocks under <article>, but for notices and forms in it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages, train_labeller()).select("page_id", "text").collect()}
    want = {r.page_id: " ".join(t for t, path, _ in blocks(r.html or "") if "article" in path) for r in pages.collect()}
    inside = sum(bool(got[k]) and all(w in want[k] for w in got[k].split()) for k in got if want[k])
    assert inside >= 0.95 * sum(bool(want[k]) for k in got)
