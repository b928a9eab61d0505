"""Quality rules, mixing, main text and top-k search against brute force, with edge cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rectpart.llm import html, maxscore, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


PROSE = "This line is plain prose, and it ends as it should. "
TEXTS = [None, "", " \n\t ", "short", PROSE * 4, PROSE + "\n" + PROSE, "a b c d e f g h " * 3, "x y  z " * 9, "é𝄞 " * 30, "\n".join(["same line here"] * 9), "\x0b a\x0cb\rc ", "w " * 7, "w " * 8, "w " * 9, " ".join(map(str, range(25000))),
         PROSE * 3 + "\n" + " | ".join(["Home", "About", "News", "Contact"]) + "\nAll rights reserved.", "\n".join("$$$ ### &&& *** word%%% !" for _ in range(9)), "\n".join(f"Home | Page{k} | More" for k in range(12))]


def test_quality_counts(spark):
    rows = spark.createDataFrame([(k, t, 1, True) for k, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_words int, kept boolean")
    got = quality.judged(rows).select("doc_id", "n_words", "kept", "_q.*").collect()
    assert len(got) == 2 * len(TEXTS)
    for r in quality.judged(rows).select("doc_id", "_q.*").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_quality_verdicts(spark):
    prose = " ".join(f"word{k} and another{k}" + "." * (k % 3 == 0) for k in range(30)) + "."
    menu = "\n".join(f"Home | Page{k} | More{k}" for k in range(15))
    texts = [prose, menu, prose + "\n" + "Click here | Home | Next", "\n".join(f"$$$ ### w{k} &&& *** x{k}%%% !" for k in range(30)), "\n".join(f"All rights reserved {k}." for k in range(15))]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "_q.*").collect()}
    assert [got[k].kept for k in range(5)] == [True, False, True, False, False]
    assert got[2].clean == prose
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quality_phrases_in_prose(spark):
    """A phrase counts in any case, as whole words, and condemns short lines and lines that are mostly phrase, not a long line of prose."""
    prose = " ".join(f"word{k} and another{k}" + "." * (k % 3 == 0) for k in range(30))
    long = [prose + f" {x} in the middle of it, " + prose[::-1] + "." for x in ("powered by", "Terms of use", "click here")]
    inner = [f"The {x} the wind of the sea, as the people say." for x in ("price was lowered by", "town was empowered by", "boy gave a flick here and there to", "rules were the terms of useful things and")]
    gone = ["All Rights Reserved.", "Read our Privacy Policy.", "Terms Of Service.", "Please click HERE.", "ALL RIGHTS RESERVED.", "Enable JavaScript, please.", "COPYRIGHT (C) by us.", "This site is powered by a thing.", "Powered by X.", "(copyright (c) by us)." , "All rights reserved. Terms of use. Privacy policy. Cookie policy. Click here, Copyright (c) of all that is here and not elsewhere."]
    texts = [*long, *(prose + ".\n" + x for x in inner + gone)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "_q.*").collect()}
    assert all(got[k].kept for k in range(len(texts)))
    assert [got[k].clean for k in range(7)] == texts[:7] and all(got[k].clean == prose + "." for k in range(7, len(texts)))


def test_quality_filter_stays_outside(spark):
    """A filter on the verdict must not be pushed into the steps."""
    kept = quality.judged(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).filter("_q.kept")
    assert kept.count() < len(TEXTS)


def sources(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "B", None, "é", "z"]
    rows = [(k, " ".join(["w"] * int(min(4000, rng.pareto(1.2) * 30))) if k % 50 else None, names[min(5, int(rng.exponential(1.2)))], 3) for k in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_mixing(spark):
    rows, df = sources(spark)
    got = mixing.copies_of(df).collect()
    assert len(got) == len(rows) and sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in mixing.copies_of(df.repartition(7)).collect())
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(size.values())
    full: set = set()
    while True:  # the definition: share what is left until nobody is above the bound
        left = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and left * weight[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    taken = Counter()
    for r in got:
        want = 3 * size[r.source] if r.source in full else left * weight[r.source]
        assert r.source_size == size[r.source] and np.isclose(r.target, want) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    longest = max(r.size for r in got)
    assert all(abs(taken[r.source] - r.target) <= 3 * longest for r in got)


def test_mixing_moves_carried_rows_once(spark, capsys):
    """Texts are carried along: the window and the join of a row with its cell share one exchange, null sources included."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(k, "word " * (k % 30), f"s{k % 3}" if k % 4 else None) for k in range(200)], "doc_id long, text string, source string")
        mixed = mixing.copies_of(df, carry=True)
        mixed.explain("formatted")
        blocks = [x for x in capsys.readouterr().out.split("\n\n") if x.partition("\n")[0].endswith(") Exchange")]
        assert len(blocks) > 3 and sum("row#" in x for x in blocks) == 1
        assert mixed.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mixing_edge_cases(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.copies_of(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y")], schema)
    got = mixing.copies_of(rows, carry=True)
    assert got.count() == 4 and got.select("row.*").columns == ["doc_id", "text", "source"]
    assert all(r.copies == 0 for r in got.collect() if r.size == 0 and r.source_size == 0)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home"><nav><ul><li><a href="/a">Menu a</a></li><li><a href="/b">Menu b</a></ul></nav>
<!-- ad --><div class="ad">Buy now, cheap and good and long enough to look like text</div><div id="cookie-notice"><p>We use cookies on this page and more.</p></div><article><h1>The title &amp; more</h1>
<p><b>First   line&nbsp;here.<br>goes on<p>Of.</p><form><p>Your name</p></form><p>Last one &lt;b&gt; &#233;.</article><aside><p>See also this and that and those.</p></aside>
<section class="comments"><p>A reader says a lot of things about this.</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "The title & more\n\nFirst line here. goes on\n\nOf.\n\nLast one <b> é."
    assert html.main_text(PAGE.replace("article", "div")) == html.main_text(PAGE)
    assert html.main_text(None) == html.main_text("") == html.main_text("<html><nav>a</nav></html>") == ""
    assert html.main_text("just text") == "just text" and html.main_text("<p>cut off <b") .startswith("cut off")


def test_main_text_beside_a_teaser():
    """The windows choose the text on pages with an article, too: a teaser in an <article> doesn't replace a plain div's text."""
    story = "".join(f"<p>Paragraph {k} of the story, which stands in a plain div.</p>" for k in range(5))
    page = f"<body><nav><a href='/'>Home</a></nav><div>{story}</div><nav><a href='/1'>One</a></nav>{'<nav>x</nav>' * 3}<article><h2>Teaser</h2></article>{'<nav>x</nav>' * 3}<p>Hi.</p></body>"
    assert html.main_text(page) == "\n\n".join([*(f"Paragraph {k} of the story, which stands in a plain div." for k in range(5)), "Teaser", "Hi."])


STORY = "<h1>The heading</h1><p>A paragraph of the story that is long enough.</p><p>And one more of them, as long as that.</p>"
KEPT = ["The heading", "A paragraph of the story that is long enough.", "And one more of them, as long as that."]


def test_main_text_keeps_the_story():
    """Size of other passages, links in an article, layout classes, page-wide forms and inline elements drop nothing."""
    got = lambda page: html.main_text(page).split("\n\n")
    short, long = "A passage of some sixty characters, cut off by an advert.", "word " * 8000
    assert got(f"<p>{short}</p><div class=ad>Buy</div><div class=ad>Buy</div><div class=ad>Buy</div><p>{long}</p>") == [short, long.strip()]
    assert got(f"<article>{STORY}<ul><li><a href=x>A linked reference</a></li></ul></article>") == [*KEPT, "A linked reference"]
    for around in ("content has-sidebar", "no-sidebar", "entry-header", "sidebar-left", "ad-free"):
        assert got(f'<div class="{around}"><article>{STORY}</article></div><p>Bye.</p>')[:3] == KEPT
    for around in ("content has-sidebar", "no-sidebar", "entry-header"):
        assert got(f'<div class="{around}">{STORY}</div>') == KEPT
    assert got(f"<article><div class='header'><h1>The heading</h1></div>{STORY[len('<h1>The heading</h1>'):]}</article>") == KEPT
    assert got(f"<form id=all>{STORY}<fieldset>Name</fieldset></form>")[:3] == KEPT and got(f"<form><article>{STORY}</article></form>") == KEPT
    assert got(f"{STORY}<form><p>Your name</p></form>") == KEPT
    assert got("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='t'>x = 2</annotation></math> be so, <svg><title>i</title><text>two</text></svg> or <script>x</script>not.</p>") == ["Let x=2 be so, two or not."]
    assert got(f"<article>{STORY}<h2><button>A question?</button></h2></article>") == [*KEPT, "A question?"]
    for name in ("sidebar", "site-header", "cookie-notice", "ad", "main-nav", "footer-widget", "related posts", "comments"):
        assert got(f"{STORY}<div class='{name}'><p>Something else that is long enough to count as text.</p></div>") == KEPT


@pytest.mark.parametrize(("page", "text"), [
    ("<p>Hello <svg/> world of many words here</p>", "Hello world of many words here"), ("<p>one<!-- c -->two and so on, long enough</p>", "onetwo and so on, long enough"), ("<p>one <b>bold</b><i>er</i> word and others</p>", "one bolder word and others"),
    *((f"<p>An unclosed <{x}>one</p><p>The rest of the page is here.</p>", "An unclosed one\n\nThe rest of the page is here.") for x in ("button", "select", "svg", "math", "object", "canvas", "template")),
    ("<p class=tags-of-war>Some words about the wars of tags</p><div class=notice-board>The notice board of the town hall</div>", "Some words about the wars of tags\n\nThe notice board of the town hall"),
    ("<p>A form's <select><option>1</select> choice isn't text, nor <textarea>this</textarea> is</p>", "A form's choice isn't text, nor is"),
])
def test_main_text_of_inline_and_unclosed_elements(page, text):
    assert html.main_text(page) == text


def test_the_sums_alone_decide():
    """A page of nothing but div: links have no weight, and short lines among them never surge; the story is what stands between the surge and the dive."""
    menu = "".join(f"<div><a href='/{k}'>Menu entry {k}</a></div>" for k in range(6))
    story = "".join(f"<div>Paragraph {k} of the story is a line of some length.</div>" for k in range(4)) + "<div>A short line.</div>"
    page = f"{menu}<div>Welcome!</div>{menu}{story}{menu}<div>(c) us</div>{menu}"
    assert html.main_text(page).split("\n\n") == [*(f"Paragraph {k} of the story is a line of some length." for k in range(4)), "A short line."]


def test_short_blocks_stay_and_asides_have_to_surge():
    """Menus don't part a short block from the story; discounted lines are text only above the body's peak, condemned ones never; without the sums, asides would leak."""
    menu = "<ul class=menu><li><a href=a>One</a><li>Two</ul>"
    assert html.main_text(f"<p>{KEPT[1]}</p>{menu}<p>Short end.</p>{menu}") == f"{KEPT[1]}\n\nShort end."
    assert html.main_text(f"{menu}<p>Short end.</p>{menu}<div><a href=b>Link</a></div>" * 2).split() == ["Short", "end."] * 2
    for name in ("post-comments", "comment-body", "user-comments", "ad-slot", "cookie-wall", "Advertisement2", "the_comments"):
        assert html.main_text(f"<article>{STORY}<div class='x {name}'><p>{'I say a lot about this. ' * 90}</p></div></article>").split("\n\n") == KEPT
        assert html.main_text(f"{STORY}<section id={name}><article><p>{'I say a lot about this. ' * 90}</p></article></section>").split("\n\n") == KEPT
    for name in ("no-comments", "has-ads", "without_ads", "download", "commentary"):
        assert html.main_text(f"<div class='{name}'>{STORY}</div>").split("\n\n") == KEPT
    long = "<p>" + "The story stands in a box that is called a sidebar. " * 40 + "</p>"
    assert html.main_text(f"<div class=sidebar>{long}</div><p>Bye.</p>").startswith("The story stands") and not html.main_text(f"<div class=sidebar><p>Bye.</p></div>{long}").startswith("Bye")


def plain_list(page):
    """What lines with any weight would give, if no sums were asked."""
    return "\n\n".join(line[0] for line in html.lines_of(page) if html.weight_of(*line))


def test_sums_change_pages():
    import pyarrow.parquet as pq

    pages = [x or "" for x in pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"])["html"].to_pylist()]
    assert sum(html.main_text(x) != plain_list(x) for x in pages) > len(pages) / 2


def test_surges_by_definition():
    """Brute force: a line stays if it has weight and a line, reached over lines whose sums aren't 0, has a sum that surges."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        weight = [int(w) for w in rng.integers(0, 40, int(rng.integers(0, 25))) * (rng.random(1) < 0.9) * 1]
        weight = [w if rng.random() < 0.5 else 0 for w in weight]
        n = len(weight)
        sums = [sum(weight[k] for k in range(n) if abs(k - i) <= html.WINDOW // 2) for i in range(n)]
        surge = min(html.SURGE, max(sums, default=0))
        want = [weight[i] > 0 and any(sums[j] >= surge and all(sums[min(i, j) : max(i, j) + 1]) for j in range(n)) for i in range(n)]
        assert html.between_surge_and_dive(weight, surge) == want


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (3, "v", "<p>" + "long " * 50_000, "t")], "page_id long, url string, html string, text string")
    got = html.extract_pages(rows).collect()
    assert [len(r.text) for r in got] == [len(html.main_text(PAGE))] * 2 + [0, 249_999]
    assert html.extract_pages(rows.limit(0)).count() == 0


def top_brute(ids, vectors, k):
    out = {}
    for q, v in zip(ids, vectors):
        if q % 50 == 0:
            score = vectors @ v
            best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
            out[int(q)] = [(int(ids[i]), int(score[i])) for i in best]
    return out


@pytest.mark.parametrize(("shard", "block"), [(1 << 22, 1 << 24), (20_000, 600)])
def test_top_k(spark, monkeypatch, shard, block):
    monkeypatch.setattr(maxscore, "SHARD_BYTES", shard)
    monkeypatch.setattr(maxscore, "BLOCK_BYTES", block)
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(0, 60, (700, 24)))
    vectors[100:400] = vectors[100]  # many ties
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], "vec_id long, vector array<double>, score int")
    bad = spark.createDataFrame([(700, None, 0), (750, [float("nan")] * 24, 0), (800, [None, 1.0], 0), (850, [float("inf")], 0)], df.schema)
    both = df.unionByName(bad)
    got = {}
    for r in maxscore.top_k(both, both.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == top_brute(np.arange(700), vectors, 5)


def test_top_k_edge_cases(spark):
    none = spark.createDataFrame([], "vec_id long, vector array<double>")
    assert maxscore.top_k(none, none).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, []), (50, [0.0, 0.0])], "vec_id long, vector array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in maxscore.top_k(few, few.filter(F.col("vec_id") % 50 == 0)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 3), (0, 2, 2, 0), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]


@pytest.mark.parametrize("kind", ["normal", "skewed", "sparse", "equal"])
def test_search_of_a_shard(kind):
    """The k best by definition; where terms differ in weight or vectors are sparse, only a part of the postings is looked at."""
    rng = np.random.default_rng(2)
    x = {"normal": rng.normal(0, 60, (1500, 16)), "skewed": rng.normal(0, 60, (1500, 32)) * np.linspace(1, 0.01, 32) ** 3, "sparse": rng.exponential(50, (1500, 40)) * (rng.random((1500, 40)) < 0.05), "equal": np.ones((40, 3))}[kind]
    x, ids = np.floor(x), rng.permutation(len(x)).astype(np.int64) * 7
    shard, full = maxscore.Shard(ids, x), 0
    for q, w in list(zip(ids.tolist(), x))[:60]:
        score = x @ w
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:5]
        got = shard.search(q, w, 5)
        assert got[0].tolist() == ids[best].tolist() and got[1].tolist() == score[best].tolist()
        full += x.size
    assert shard.visited < {"normal": 1.05, "skewed": 0.5, "sparse": 0.02, "equal": 1}[kind] * full


def test_top_k_beyond_exact_doubles(spark):
    big = float(1 << 40)
    rows = [(0, [big, 1.0]), (1, [big, 3.0]), (2, [big, 2.0]), (3, [2.0**70, 0.0]), (None, [big, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = [(r.vec_id, r.score) for r in maxscore.top_k(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(k, 2**63 - 1) for k in (1, 2, 3)]  # cut off, and so ties
    small = spark.createDataFrame([(0, [float(1 << 30), 1.0]), (1, [float(1 << 30), 3.0]), (2, [float(1 << 30), 2.0])], df.schema)
    assert [(r.vec_id, r.score) for r in maxscore.top_k(small, small.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, (1 << 60) + 3), (2, (1 << 60) + 2)]
