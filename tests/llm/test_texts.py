"""HTML extraction and toxicity chains."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import extract, toxicity
from tidemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def main_of(page):
    found = extract.blocks(page)
    proposed, closed = extract.propose(found)
    return [b.text for b, x in zip(found, proposed, strict=True) if x and closed]


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>if (a < b) "</p>"</script>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href='>'>Home</a></ul></nav>
    <article><header><h2>Title &amp; more</h2></header><p>One <b>two</b>&nbsp;three<br>four<p>five
    <div class="share-buttons">Share</div><table><tr><td>a<td>b</table><!-- no <p>comment</p> --><aside>See also</aside>
    <div id=comments><p>nice</p></div><form>mail</form><noscript>js</noscript></article><div class="cookie-notice">ok?</div><footer>&copy; x"""
    assert main_of(page) == ["Title & more", "One two three four", "five", "a", "b"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<main><p>a &lt; b &#233; &euro;</p></main>", ["a < b é €"]),
        ("<div role=main>x<div hidden>y</div><div aria-hidden='true'>z</div><div style='display: none'>w</div></div>", ["x"]),
        ("<form><article>in a form</article></form>", ["in a form"]),
        ("<aside><article>teaser</article></aside><main>m</main>", ["m"]),
        ("<article><script>x", []),
        ("<article>a<!-- never closed", ["a"]),
        ("<article>1 < 2 <p title=\"a>b\">3</p>", ["1 < 2", "3"]),
        ("<article><p><b>One.<br><p>Two.</p></article>after", ["One.", "Two."]),
        ("<article><p>a</b>b</div>c</p>d</article>", ["ab", "c", "d"]),
        ("", []),
        ("plain", []),
        ("<div class='layout-sidebar'><article>x</article></div>", ["x"]),
        ("<div class='sidebar'><article>x</article></div>", ["x"]),
        ("<div class='sidebar'><article>x</article></div><article>story</article>", ["story"]),
        ("<div id='comments'><article>I agree</article></div><article>story</article>", ["story"]),
        ("<article><div class='entry-header'><h1>Headline</h1></div><p>x</article>", ["Headline", "x"]),
        ("<article><p class='share-price'>1</p><p class='ad-hoc'>2</p><p id='related-work'>3</p><p class='share-buttons'>4</p><p class='ad'>5</p></article>", ["1", "2", "3"]),
        ("<main><h1>Title</h1><p>Intro</p><article>one two three four</article></main>", ["Title", "Intro", "one two three four"]),
        ("<main><h1>The story</h1><p>is long and told here</p><article>teaser</article><article>another</article></main><article>aside</article>", ["The story", "is long and told here"]),
        ("<main><article>one</article><article>two</article></main>", ["one", "two"]),
    ],
)
def test_odd_pages(page, text):
    assert [t for t in main_of(page)] == text


def test_deep_and_unbalanced_pages_take_linear_time():
    for page in ("<b>" * 20_000 + "</i>" * 20_000 + "x", "<div>" * 20_000 + "x", "<p>" * 20_000 + "x", "<article>" + "</p>" * 20_000 + "x", "<article " + "<" * 200_000):
        assert len(extract.blocks(page)) <= 1


def brute_text(pages, page, length=8):
    """What is left of a page (a list of blocks) without the runs of ``length`` tokens or more that another page of ``pages`` has."""
    streams = [[t for block in p for t in [*block.split(" "), None]] for p in pages]
    mine = streams[page]
    gone = set()
    for i in range(len(mine) - length + 1):
        for other, theirs in enumerate(streams):
            if pages[other] is not pages[page] and any(mine[i : i + length] == theirs[j : j + length] for j in range(len(theirs) - length + 1)):
                gone.update(range(i, i + length))
    left = [[]]
    for i, t in enumerate(mine):
        if t is None:
            left.append([])
        elif i not in gone:
            left[-1].append(t)
    return "\n".join(" ".join(x) for x in left if x) or "\n".join(pages[page])


def test_repeated_runs_of_a_host_go(spark):
    """Shared passages of 8 to 200 tokens, and of 7, on pages without an article."""
    shared = [" ".join(f"s{n}t{k}" for k in range(n)) for n in (7, 8, 9, 50, 200)]
    menu = ["Home", "News", "Sport today", "About", "Contact us now"]  # short blocks, long together
    rng = np.random.default_rng(0)
    sites = []
    for i in range(12):
        body = [" ".join(f"w{i}x{j}y{k}" for k in range(int(rng.integers(1, 30)))) for j in range(4)]
        body.insert(int(rng.integers(5)), shared[i % 5])
        body[0] += " " + shared[(i + 1) % 5]
        sites.append([*menu, *body])
    copy = ["the very same page", "with more than eight words in it", "twice"]
    rows = [(i, f"http://h.com/{i}", "".join(f"<p>{b}" for b in p)) for i, p in enumerate(sites)]
    rows += [(100, "http://other.org/0", f"<p>{shared[4]}</p>"), (101, "http://h.com/1", rows[1][2]), (102, None, None), (103, "http://[bad", ""), (None, None, "<main>kept &amp; <p>whole</main>")]
    rows += [(200 + k, f"http://copy.net/{k}", "".join(f"<div>{b}</div>" for b in copy)) for k in (0, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract.extract(df).collect()}
    assert extract.extract(df).count() == len(rows)
    for i in range(len(sites)):
        want = brute_text(sites, i)
        assert (got[i].text, got[i].n_chars) == (want, len(want))
        assert "Home" not in want and shared[4] not in want and f"w{i}x1" in want
    assert got[100].text == shared[4]  # of another host, where it is unique
    assert got[101].text == got[1].text
    assert (got[102].text, got[103].text, got[102].n_chars) == ("", "", 0)
    assert got[None].text == "kept &\nwhole"
    assert got[200].text == got[201].text == "\n".join(copy)
    assert extract.extract(df.limit(0)).count() == 0


def test_boilerplate_in_articles_goes_and_shared_text_stays(spark):
    notice = "Sign up for our weekly letter and never miss a single story"
    quote = "All happy families are alike but every unhappy family is unhappy in its own way"
    lead = "This opening of the third story is shown again on the pages that list it"

    def page(i):
        body = [f"Story {i} {' '.join(f'v{i}w{k}' for k in range(20))}", quote if i < 4 else "short", lead if i == 3 else "End", notice if i % 2 else f"no letter here {i}"]
        return f"<nav>menu</nav><article>{''.join(f'<p>{b}</p>' for b in body)}</article><div>{notice}</div><div>{lead if i > 5 else ''}</div>", body

    rows = [(i, f"http://h.com/{i}", page(i)[0]) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in extract.extract(df).collect()}
    got = {r.page_id: r.text for r in extract.extract(df, strays=True).collect()}
    for i in range(8):
        assert whole[i] == "\n".join(page(i)[1])
        assert got[i] == "\n".join(b for b in page(i)[1] if b != notice)


def test_articles_that_the_host_repeats_go_beside_a_unique_one(spark):
    teasers = [" ".join(f"t{k}w{i}" for i in range(12)) for k in range(3)]
    story = [" ".join(f"s{k}w{i}" for i in range(30)) for k in range(6)]
    card = lambda t: f"<article><h2>{t.split()[0]}</h2><p>{t}</p></article>"
    text = lambda t: f"{t.split()[0]}\n{t}"
    pages = {k: (f"<nav>menu</nav>{card(story[k])}{card(teasers[k % 2])}", text(story[k])) for k in range(4)}
    pages[4] = (f"{card(story[4])}{card(teasers[2])}", f"{text(story[4])}\n{text(teasers[2])}")  # on no other page
    pages[5] = (card(teasers[0]), text(teasers[0]))  # the story's own page
    pages[6] = (f"{card(teasers[0])}{card(teasers[1])}", f"{text(teasers[0])}\n{text(teasers[1])}")  # nothing else there
    pages[7] = (f"{card(story[5] + ' ' + teasers[0])}{card(teasers[1])}", text(story[5] + " " + teasers[0]))  # a quote stays
    pages[0] = (pages[0][0], f"{text(story[0])}\n{text(teasers[0])}")  # the next one is a copy: nothing is unique
    pages[8] = (f"{card(story[0])}<article>short one</article>", f"{text(story[0])}\nshort one")  # beside less than a run
    short = "shorter " + " ".join(f"u{i}" for i in range(9))
    pages[10] = (f"{card(story[1])}{card(short)}", f"{text(story[1])}\n{text(short)}")  # a copy, beside a shorter unique one
    pages[1] = (pages[1][0], f"{text(story[1])}\n{text(teasers[1])}")
    rows = [(k, f"http://h.com/{k}", page) for k, (page, _) in pages.items()]
    df = spark.createDataFrame([*rows, (9, "http://other.com/9", pages[0][0])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract(df).collect()}
    want = {k: t for k, (_, t) in pages.items()}
    assert {k: got[k] for k in pages} == want
    assert got[9] == f"{text(story[0])}\n{text(teasers[0])}"


@needs_data
def test_without_article_tags_unique_text_stays(spark):
    """The pages of the test data with their article and footer tags taken away: the suffix array decides alone."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").limit(60)
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    texts = {r.page_id: r.text for r in extract.extract(bare).collect()}
    whole = {r.page_id: r.text for r in extract.extract(pages).collect()}
    same = sum(texts[i] == whole[i] for i in whole)
    assert len(texts) == len(whole) and same >= 0.8 * len(whole)


@needs_data
def test_articles_of_the_test_data(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in QUERIES["op4_html_extraction"](spark, "/root/testdata/sf0.01").collect()}
    import html

    for r in pages:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [html.unescape(re.sub(r"<br>", " ", p)) for p in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(t for t in (" ".join(re.sub(r"</?b>", "", p).split()) for p in parts) if t)
        assert got[r.page_id] == want


def labelled(spark, n=400):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choice(words, 40).tolist()
        toxic = i % 5 == 0
        if toxic:
            text[int(rng.integers(40))] = rng.choice(["Nasty", "vileness", "vilest", "vileful"])
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(rng.random() < 0.8), int(toxic)))
    docs += [(1000 + i, docs[0][1], "x") for i in range(50)]
    labels += [(1000 + i, 1, 1) for i in range(50)] + [(9999, 1, 1), (None, 1, 1), (2, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, p_toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_finds_the_telling_words(spark):
    docs, labels = labelled(spark)
    chain = toxicity.fit(docs, labels)
    assert chain.names == ("low_quality", "toxic") and chain.accuracy[1] > 0.95
    assert len(chain.models[1].earlier) == 1 and {"nasty", "vile*"} <= set(chain.models[1].weights)
    held_out = spark.createDataFrame([(1, "word1 NASTY word2"), (2, "word1 word2"), (3, None), (4, "vilenesses word9 " * 5), (None, "word3 vileness")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(held_out, chain).collect()}
    assert [got[i].is_toxic for i in (1, 2, 3, 4, None)] == [True, False, False, True, True]
    assert all(0 < r.p_low_quality < 1 and 0 < r.p_toxic < 1 for r in got.values())
    again = toxicity.fit(docs.repartition(3), labels.repartition(2))
    assert again == chain
    kept = toxicity.clean(docs, chain)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in toxicity.score(docs, chain).where(~F.col("is_toxic")).collect())


def test_long_and_repeated_rows_are_scored_one_by_one(spark):
    docs, labels = labelled(spark)
    chain = toxicity.fit(docs, labels)
    rows = [(1, "word1 " * 300_000 + "vileness"), (1, "word1 " * 300_000 + "vileness"), (2, "word2"), (2, "word2"), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, p_toxic string, is_toxic boolean")
    got = toxicity.score(df, chain).collect()
    assert sorted(((r.doc_id, r.is_toxic) for r in got), key=str) == sorted([(1, True), (1, True), (2, False), (2, False), (None, False), (None, False)], key=str)
    assert toxicity.clean(df, chain).columns == df.columns and toxicity.clean(df, chain).count() == 4


def test_later_models_use_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    n = 600
    first = rng.random(n) < 0.5
    rows = [{f"n{k}" for k in rng.integers(0, 50, 5)} | ({"first"} if f else set()) for f in first]
    labels = np.column_stack([first, first])
    chain = toxicity.train(rows, labels, np.arange(n), ("a", "b"))
    assert chain.models[1].earlier[0] > 0.5  # the earlier category tells the later one
    assert chain.accuracy[0] > 0.99 and chain.accuracy[1] > 0.99
    noise = toxicity.train(rows, np.column_stack([rng.random(n) < 0.5, first]), np.arange(n), ("a", "b"))
    assert abs(noise.models[1].earlier[0]) < 0.5  # in-sample predictions of noise would look telling


def test_thresholds():
    p, y = np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])
    assert 0.2 < toxicity.best_threshold(p, y) < 0.8
    assert toxicity.best_threshold(np.full(4, 0.3), y) == 0.5 and toxicity.best_threshold(p, np.zeros(4)) == 0.5
    assert toxicity.best_threshold(np.zeros(0), np.zeros(0)) == 0.5


def test_chain_without_labels(spark):
    docs, labels = labelled(spark, 10)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        chain = toxicity.fit(docs, some)
        assert not any(r.is_toxic for r in toxicity.score(docs, chain).collect())
    assert toxicity.score(docs.limit(0), chain).count() == 0 and toxicity.clean(docs.limit(0), chain).count() == 0


@needs_data
def test_probabilities_of_held_out_documents(spark):
    """Half of the labels train, the other half is scored: by the operator, and by the plain sum of the weights."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    rest = labels.where("doc_id % 2 = 1").select("doc_id", "toxic").distinct()
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in toxicity.score(docs, chain).join(rest, "doc_id").collect()}
    assert len(got) > 100
    for i, r in got.items():
        words = set(re.findall(r"\w+", (texts[i] or "").lower()))
        held = [f for w in words for f in (w, *(f"{w[:n]}*" for n in (4, 5) if len(w) > n))]
        first, second = chain.models
        p = 1 / (1 + np.exp(-first.intercept - sum(first.weights.get(f, 0) for f in set(held))))
        q = 1 / (1 + np.exp(-second.intercept - second.earlier[0] * p - sum(second.weights.get(f, 0) for f in set(held))))
        assert (r.p_low_quality, r.p_toxic) == (pytest.approx(p, abs=1e-9), pytest.approx(q, abs=1e-9))
    toxic = {i for i, r in got.items() if r.toxic}
    called = {i for i, r in got.items() if r.is_toxic}
    assert called <= toxic and len(called) >= 0.5 * len(toxic)
