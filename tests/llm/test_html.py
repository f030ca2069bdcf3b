import sys
import time
import tracemalloc
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from lexivec.llm import html_crf
from lexivec.llm.html_blocks import blocks
from lexivec.llm.html_pages import labelled_pages

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad -->'
    '<div class="ad">Buy now this thing.</div><article><h1>The title &amp; more</h1><p><b>First line of&nbsp;text.<br><p>Second  line\nof it &lt;tag&gt; &#233;.</p></article>'
    '<section class="comments"><p>I like this article very much.</p></section><footer>&copy; site &middot; words.</footer></body></html>'
)


def test_blocks():
    assert [b.text for b in blocks(PAGE)] == ["T", "Menu", "Buy now this thing.", "The title & more", "First line of text.", "Second line of it <tag> é.", "I like this article very much.", "© site · words."]
    assert blocks("") == [] and [b.text for b in blocks("a < b <!-- never closed <p>x")] == ["a < b"]
    assert [b.text for b in blocks("<p>one<div>two</p>three")] == ["one", "two", "three"]
    assert len(blocks("<div>" * 5000 + "deep")[0].path) == 5000 and blocks("<a '" * 50_000)


def test_custom_and_unclosed_elements():
    said = lambda page: [b.text for b in blocks(page)]
    for tag in ("svg-icon", "video-js", "audio-player", "object-view", "style-guide", "script-box"):
        assert said(f"<p>One <{tag} a='>'></{tag}>two.</p><p>Three.</p>") == ["One two.", "Three."]
    for tag in ("svg", "math", "object", "canvas", "audio", "video", "noscript", "template"):
        assert said(f"<div><{tag} src=x></div><article><p>One.</p><p>Two.</p></article>") == ["One.", "Two."]
        assert said(f"<div><{tag} src=x></div><p>One.</p><{tag} src=y><p>other</p></{tag}><p>Two.</p>") == ["One.", "Two."]
        assert said(f"<p>One <{tag} a='x>y'><title>no</title><p>no</p></{tag}>two <{tag}/>three</p>") == ["One two three"]
    assert said("<object>a<object>b</object>c</object><noscript></p></div>d</noscript>e<svg><math>f</svg>g") == ["eg"]
    assert said("<p>a<script>b</script x>c<style>d") == ["ac"]
    assert len(blocks("<video><p>x" * 20_000)) == 20_000 == len(blocks("<noscript><p>x" * 20_000))


def test_letters_far_into_a_block():
    rows = html_crf.featurize(blocks(f"<p>{'1 ' * 150}words</p><p>{'1 ' * 150}</p>"))
    assert rows[:, html_crf.FEATURES.index("no letters")].tolist() == [0, 1]


def test_article_with_custom_and_unclosed_elements():
    field = html_crf.default_field()
    for broken in ("<svg-icon></svg-icon>", '<div><video src="x"></div>', '<video src="x">'):
        page = PAGE.replace("<h1>", f"{broken}<h1>")
        assert page != PAGE and html_crf.main_text(page, field) == html_crf.main_text(PAGE, field) != ""


def test_pages_made_by_hand(capsys):
    """Block F1 on pages of other makers."""
    sys.path.insert(0, str(Path(__file__).parent))
    from hand_pages import PAGES

    field = html_crf.default_field()
    hit = got_n = want_n = 0
    for page, want in PAGES:
        got = html_crf.main_text(page, field).split("\n")
        hit, got_n, want_n = hit + sum((Counter(got) & Counter(want)).values()), got_n + len(got), want_n + len(want)
    f1 = 2 * hit / (got_n + want_n)
    with capsys.disabled():
        print(f"\nop1: block F1 {f1:.3f} on pages made by hand")
    assert f1 >= 0.95


def test_hostile_pages_take_little_time_and_memory():
    field = html_crf.default_field()
    deep = "<div>x " * 100_000
    tracemalloc.start()
    assert html_crf.main_text(deep, field).count("x") <= 100_000
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    began = time.monotonic()
    assert len(blocks(deep)) == 100_000
    html_crf.main_text("<div>" * 50_000 + "</p>" * 50_000 + "y</div>" * 50_000, field)
    html_crf.main_text("<blockquote>" * 50_000 + "<p>z</p>" * 20_000, field)
    for part in ("<svg ", "<!", "</"):
        blocks(part * (2_000_000 // len(part)))
    for part in ("<!--", "<script ", "<script>", "</script ", "<noscript ", "<noscript>", "<a ", "<a '", '<a "', "<style></style ", "&", "<svg "):
        blocks(part * (200_000 // len(part)) + ">")
        blocks(part * (200_000 // len(part)) + "<p>One.")
    blocks("<script>" + "</script " * 200_000)
    assert most < 1 << 30 and time.monotonic() - began < 100


def test_text_after_the_last_tag():
    said = lambda page: [b.text for b in blocks(page)]
    assert said("<p>one</p>two <svg ") == ["one", "two <svg"]
    assert said("<p>one<!-- a > b -- c") == said("<p>one<!-- c") == said("<p>one<script>if (a > b) c") == said("<p>one<style>c") == ["one"]
    assert said("<p>one<!-- a -->two<!-- b") == ["one" + "two"] and said("no tags <b at all") == ["no tags <b at all"]


def test_the_stored_weights_are_those_of_training():
    trained = html_crf.train(labelled_pages(html_crf.TRAINING_PAGES, html_crf.TRAINING_SEED))
    stored = html_crf.default_field()
    assert abs(trained.weights - stored.weights).max() < 1e-3 and abs(trained.turns - stored.turns).max() < 1e-3


def test_one_page_of_many_blocks():
    page = "<article><h1>Title of it</h1>" + "<p>A sentence of some length that ends here.</p>" * 20_000 + "</article>"
    assert html_crf.main_text(page, html_crf.default_field()).count("\n") == 20_000


def test_held_out_accuracy():
    field, wrong, total = html_crf.default_field(), 0, 0
    for page, labels in labelled_pages(200, seed=77):
        got = field.decode(html_crf.featurize(blocks(page)))
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.005


def test_viterbi_is_the_best_labelling():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 7))
        field = html_crf.ChainField(rng.normal(size=3), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, 3))
        score = lambda y: sum((x[i] @ field.weights) * y[i] for i in range(n)) + sum(field.turns[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        assert np.isclose(score(field.decode(x)), max(map(score, itertools.product([0, 1], repeat=n))))


def test_extract(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = html_crf.extract(pages).collect()
    assert len(out) == 5 and [r["text"] for r in out[:2]] == ["The title & more\nFirst line of text.\nSecond line of it <tag> é."] * 2 and out[2]["text"] == out[3]["text"] == ""
    assert html_crf.extract(pages.limit(0)).count() == 0
