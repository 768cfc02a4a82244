import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.llm import html_lstm, quality_forest, toxicity_subword

WORDS = ["".join(random.Random(k).choice("abcdefghklmnoprstu") for _ in range(3 + k % 6)) for k in range(600)]


def labelled(n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.3
        if toxic:
            words[r.randrange(len(words))] = r.choice(("idiotic", "idiots", "moronic", "morons")) + r.choice(("", "!", "ly"))
        rows.append((" ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = labelled(1500, 1)
    return toxicity_subword.train_calibrated([t for t, _ in rows], [y for _, y in rows])


def test_toxicity_held_out(model):
    rows = labelled(400, 2)
    s = toxicity_subword.scores([t for t, _ in rows], model.margins(), model.offset(), model.base)
    assert np.mean((s >= 0.5) == [y == 1 for _, y in rows]) > 0.97


def test_unseen_misspellings_share_subwords(model):
    s = toxicity_subword.scores(["an idiotik thing", "a kind thing", "MORONISH talk"], model.margins(), model.offset(), model.base)
    assert s[0] > 0.5 > s[1] and s[2] > 0.5


def test_score_does_not_depend_on_batch_or_length(model):
    text = " ".join(WORDS) + " idiotic " + " ".join(WORDS)
    long = " ".join(WORDS * 120) + " morons " + " ".join(WORDS * 60)
    assert len(long) > toxicity_subword._CHUNK
    alone = [toxicity_subword.scores([t], model.margins(), model.offset(), model.base)[0] for t in (text, "", None, long, "x")]
    together = toxicity_subword.scores([text, "", None, long, "x"], model.margins(), model.offset(), model.base)
    assert together.tolist() == pytest.approx(alone) and together[3] > 0.5 and together[1] == together[2] == model.base


def test_toxicity_frame(spark, awkward, empty, labels):
    rows = labelled(600, 3)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    known = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    found = toxicity_subword.toxicity(docs, known, toxic_rows=150, clean_rows=300).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["predicted"] == rows[r["doc_id"]][1] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert toxicity_subword.toxicity(awkward, labels).count() == awkward.count()
    assert toxicity_subword.toxicity(empty, labels).count() == 0 and toxicity_subword.toxicity(awkward, labels.limit(0)).agg({"score": "max"}).first()[0] == 0.0
    left = toxicity_subword.drop_toxic(docs, known, toxic_rows=150, clean_rows=300)
    assert left.columns == docs.columns and 0 < left.count() < docs.count()
    assert toxicity_subword.drop_toxic(awkward, labels).columns == awkward.columns


def brute_statistics(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


def test_statistics():
    r = random.Random(4)
    for _ in range(150):
        text = "".join(r.choice(("a ", "b ", "é ", "\n", "\t", "#", "|x ", "a b a b a b a b ", "same line\n", " ")) for _ in range(r.randint(0, 80)))
        assert quality_forest.statistics(text) == brute_statistics(text), text
    assert quality_forest.statistics(None) == (0, 0, 0, 0, 0)


def test_forest_finds_outliers():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 2))
    forest = quality_forest.IsolationForest.grow(x)
    paths = forest.path_lengths(np.array([[0, 0], [9, 9], [0.2, -0.1], [-8, 0]]))
    assert paths[[1, 3]].max() < paths[[0, 2]].min()
    assert quality_forest.calibrated(np.array([1.0, 2, 3, 4]), np.array([False, True, True, True])) == 1.5
    assert quality_forest.calibrated(np.array([1.0, 2]), np.array([True, True])) == 0.0


def plain_path(tree, row):
    """A walk down one tree, and what its leaf adds."""
    feature, cut, left, depth = tree
    node = 0
    while feature[node] >= 0:
        node = left[node] + int(row[feature[node]] >= cut[node])
    return depth[node]


def test_verdicts_equal_plain_walks(spark):
    """kept of every row against walks down the trees, row by row, and thresholds by trying every cut."""
    r = random.Random(6)
    rows = [" ".join(r.choice(WORDS) + ("#" if r.random() < 0.3 * (k % 7 == 0) else "") for _ in range(r.randint(10, 120))) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    known = spark.createDataFrame([(k, int(k % 7 != 0)) for k in range(0, 300, 2)], "doc_id long, quality int")
    stats = quality_forest.rule_statistics(docs)
    judge = quality_forest.fit(stats, known)
    by_id = {x["doc_id"]: x for x in quality_forest.judged(stats, judge).collect()}
    x = quality_forest.features(np.array([[by_id[k][s] for s in quality_forest.STATISTICS] for k in range(300)]))
    paths = [[sum(plain_path(t, row[list(view)]) for t in forest.trees) / len(forest.trees) / forest.norm for row in x] for view, forest in zip(quality_forest.VIEWS, judge.forests)]
    for k in range(300):
        odd = any(p[k] < t for p, t in zip(paths, judge.thresholds))
        assert by_id[k]["path_length"] == pytest.approx(paths[0][k]) and by_id[k]["kept"] == (not by_id[k]["base_failed"] and not odd)
    labelled_rows = [k for k in range(0, 300, 2) if not by_id[k]["base_failed"]]
    for p, threshold in zip(paths, judge.thresholds):
        good = [p[k] for k in labelled_rows if k % 7]
        bad = [p[k] for k in labelled_rows if not k % 7]
        gain = lambda t: sum(v < t for v in bad) / len(bad) - sum(v < t for v in good) / len(good)
        allowed = [v for v in sorted({*good, *bad}) if sum(g <= v for g in good) <= quality_forest.GOOD_LOST * len(good)]
        most = max([0.0, *(gain(np.nextafter(v, 9)) for v in allowed)])
        assert gain(threshold) == pytest.approx(most) and (threshold > 0) == (most > 0)


def test_thresholds_come_from_all_labelled_rows(spark):
    """A bad kind of text that 60 of 30,000 labelled rows have, and trees that draw from the whole table."""
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 500 == 7).alias("bad"), F.xxhash64("id").alias("h"))
    zero = F.lit(0).cast("long")
    symbols = F.when(F.col("bad"), 8 + F.pmod("h", F.lit(90))).otherwise(F.pmod("h", F.lit(11))).cast("long")
    stats = rows.select("doc_id", F.lit(100).cast("long").alias("n_words"), (500 + F.pmod("h", F.lit(200))).alias("word_chars"), symbols.alias("n_symbols"), zero.alias("n_dup_lines"), zero.alias("n_repeat_words"), F.lit(False).alias("base_failed"))
    known = rows.select("doc_id", F.when(F.col("bad"), 0).otherwise(1).alias("quality"))
    judge = quality_forest.fit(stats, known)
    local = stats.join(known, "doc_id").toPandas()
    paths = judge.paths(quality_forest.features(local[list(quality_forest.STATISTICS)].to_numpy()))
    good = local["quality"].to_numpy() == 1
    assert judge.thresholds == [quality_forest.calibrated(p, good) for p in paths] and judge.thresholds[2] > 0
    nameless = stats.withColumn("doc_id", F.lit(None).cast("long"))  # drawn one by one, not those of the least statistics
    seen = []
    grown = quality_forest.Judge
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality_forest, "Judge", lambda x: seen.append(x) or grown(x))
        quality_forest.fit(nameless, known)
    assert len(seen[0]) == quality_forest.TREES * quality_forest.TREE_ROWS and 5.9 < seen[0][:, 0].mean() < 6.1


def test_thresholds_equal_the_plain_ones(spark):
    """Any counts: ties, one class only, cuts between buckets."""
    r = np.random.default_rng(4)
    for k, (n, values, share) in enumerate([(3000, 4000, 0.2), (500, 12, 0.5), (2000, 10**9, 0.01), (50, 30, 0.0), (40, 9, 1.0)]):
        paths = [np.sort(r.integers(0, values, n)) / values * 2 for _ in range(2)]
        bad = r.random(n) < share
        bad[: n // 50] = share > 0
        frame = spark.createDataFrame([(view, float(p), int(not b), int(b)) for view, own in enumerate(paths) for p, b in zip(own, bad)], "view int, path double, good int, bad int")
        counts = frame.groupBy("view", "path").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        for lost in (0.001, 0.1):
            found = quality_forest.thresholds(counts, lost)
            assert [found.get(view, 0.0) for view in range(2)] == [quality_forest.calibrated(p, ~bad, lost) for p in paths], (k, lost)


def test_quality_frame(spark, awkward, empty, labels):
    r = random.Random(5)
    good = [" ".join(r.choice(WORDS) for _ in range(r.randint(30, 200))) for _ in range(500)]
    bad = [" ".join(r.choice(WORDS) + "$$$" for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    known = spark.createDataFrame([(k, int(k < 500)) for k in range(540)], "doc_id long, quality int")
    found = {x["doc_id"]: x for x in quality_forest.quality(docs, known).collect()}
    assert not any(found[k]["kept"] for k in range(500, 540)) and sum(not found[k]["kept"] for k in range(500)) <= 2
    for k, text in enumerate(good[:50]):
        assert tuple(found[k][s] for s in quality_forest.STATISTICS) == brute_statistics(text)
    rows = quality_forest.quality(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(x["base_failed"] and not x["kept"] for x in rows)
    assert quality_forest.quality(empty, labels).count() == 0
    assert quality_forest.quality(docs, known.limit(0)).filter("kept").count() == 540


def test_blocks():
    page = '<title>t</title><script>var a="</p>";</script><style>x</style><nav class="top-menu"><ul><li><a href="/x>y">one</a><li>two</ul></nav><p>a &amp; b<br>c <!-- gone -->d<p>&eacute;\n  &nbsp; e</p>1 < 2 <b>bold</b><div'
    found = html_lstm.blocks(page)
    assert [b.text for b in found] == ["one", "two", "a & b c d", "é e", "1 < 2 bold"]
    assert found[0].path == (("nav", "menu", "top"), ("ul",), ("li",)) and found[0].links == 1.0 and found[2].path == (("p",),)
    assert html_lstm.blocks(None) == html_lstm.blocks("") == html_lstm.blocks("<p></p>") == []
    assert [b.text for b in html_lstm.blocks("<div" * 2000 + ">x")] == ["x"] and html_lstm.blocks('<p title="' * 3000) == []


def test_gradients():
    """Back-propagation against differences."""
    net = html_lstm.BiLstm(1, 5, 3)
    r = np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, y = r.normal(size=(4, 2, 5)), r.integers(0, 2, (4, 2))
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    _, grads = net.gradients(x, mask, y)
    for k in ("xf", "hb", "w", "cf"):
        at = tuple(int(r.integers(n)) for n in net.p[k].shape)
        old, eps = net.p[k][at], 1e-4
        net.p[k][at] = old + eps
        up = net.gradients(x, mask, y)[0]
        net.p[k][at] = old - eps
        down = net.gradients(x, mask, y)[0]
        net.p[k][at] = old
        assert grads[k][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_blocks_keep_what_the_network_judges():
    """Only raw-text elements are skipped; formulas stay within their block, fallback text has a path of its own, and an element that isn't closed loses nothing."""
    found = html_lstm.blocks('<p>a <math><mi>x</mi></math> b</p><div><object data="x">old browser</div><p>c<select><option>1<option>2</select><noscript>turn it on</noscript><p>d<canvas>e')
    assert [b.text for b in found] == ["a x b", "old browser", "c", "1", "2", "turn it on", "d", "e"]
    assert found[1].path == (("div",), ("object",)) and found[-1].path[-1] == ("canvas",)


def test_memory_grows_with_the_page_and_no_faster(labeller):
    """Deep nesting and many blocks: blocks share the elements above them."""
    peaks = []
    for n in (4000, 16000):
        tracemalloc.start()
        found = html_lstm.blocks("<div>x" * n + "</section>" * n)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(found) == n and found[-1].node.depth == n
    assert peaks[1] < 5 * peaks[0] < 50e6
    page = "<p>some words, here.</p>" * 20_000
    assert len(html_lstm.labelled([html_lstm.blocks(page)], labeller)[0]) == 20_000


def test_slices_change_nothing(labeller):
    pages = [html_lstm.blocks(html_lstm.PageMaker(k).page()[0]) for k in range(5)]
    whole, cut = labeller.logits(pages), labeller.logits(pages, most=15)
    for k, page in enumerate(pages):
        assert np.allclose(whole[: len(page), k], cut[: len(page), k], atol=1e-4)


@pytest.fixture(scope="module")
def labeller():
    return html_lstm.trained()


#: Pages written by hand, each with the lines of its main text.
PAGES = {
    "wiki": (
        '<!DOCTYPE html><html><body><div id="mw-head"><a href="/">Log in</a></div><div id="content"><h1 id="firstHeading">Ada Lovelace</h1><div id="bodyContent"><table class="infobox"><tr><th>Born</th><td>10 December 1815</td></tr></table>'
        "<p>Augusta Ada King, Countess of Lovelace, was an English mathematician and writer, chiefly known for her work on the Analytical Engine.</p><h2>Life</h2><p>She was the first to recognise that the machine had applications beyond pure calculation, and published the first algorithm intended for it.</p></div></div>"
        '<div id="footer"><ul><li><a href="/p">Privacy policy</a></li><li><a href="/a">About</a></li></ul></div></body></html>',
        ["Ada Lovelace", "Born", "10 December 1815", "Augusta Ada King, Countess of Lovelace, was an English mathematician and writer, chiefly known for her work on the Analytical Engine.", "Life", "She was the first to recognise that the machine had applications beyond pure calculation, and published the first algorithm intended for it."],
    ),
    "blog": (
        '<html><body><div class="site-header"><a href="/">My blog</a></div><nav><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav><main><article class="post"><header class="entry-header"><h1>How I bake bread</h1></header><div class="entry-content"><p>Bread needs only flour, water, salt and time. I mix everything in the evening.</p><p>In the morning the dough has doubled, and I shape it into a loaf.</p><blockquote>Patience is the best yeast.</blockquote></div></article>'
        '<section id="comments"><h2>2 comments</h2><ol><li><p>Great post, thanks for sharing it!</p></li><li><p>What flour do you use?</p></li></ol></section></main><aside class="sidebar"><h3>Recent posts</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside><footer>Copyright 2020</footer></body></html>',
        ["How I bake bread", "Bread needs only flour, water, salt and time. I mix everything in the evening.", "In the morning the dough has doubled, and I shape it into a loaf.", "Patience is the best yeast."],
    ),
    "docs": (
        '<html><body><div class="topbar"><a href="/">Docs</a> <a href="/api">API</a></div><div class="layout"><div class="sidebar"><ul><li><a>Intro</a></li><li><a>Install</a></li></ul></div><div class="markdown-body"><h1>Install</h1><p>Run the command below to install the package on your machine.</p><pre>make install</pre><p>Then check the version, which should be the latest one.</p><ul><li>Needs a compiler.</li><li>Needs two gigabytes of memory.</li></ul></div></div><div class="cookie-notice">We use cookies. <button>Accept</button></div></body></html>',
        ["Install", "Run the command below to install the package on your machine.", "make install", "Then check the version, which should be the latest one.", "Needs a compiler.", "Needs two gigabytes of memory."],
    ),
    "news": (
        '<html><body><header><div class="logo">The Daily</div><nav><a href=1>World</a> <a href=2>Sport</a></nav></header><div class="ad">Buy now, save big!</div><div class="wrapper"><div class="row"><div class="col-md-8"><h1>Storm reaches coast</h1><p>A heavy storm reached the coast on Monday, cutting power to thousands of homes.</p><div class="ad-slot">Advertisement</div><p>Officials said that repairs would take several days, and asked people to stay inside.</p><figure><figcaption>Waves at the harbour wall.</figcaption></figure><p>Schools remain closed until Thursday.</p></div><div class="col-md-4"><h3>Most read</h3><ul><li><a>Cat rescued</a></li><li><a>Election results</a></li></ul></div></div></div><footer><p>All rights reserved. <a>Contact</a></p></footer></body></html>',
        ["Storm reaches coast", "A heavy storm reached the coast on Monday, cutting power to thousands of homes.", "Officials said that repairs would take several days, and asked people to stay inside.", "Waves at the harbour wall.", "Schools remain closed until Thursday."],
    ),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_written_pages(labeller, name):
    page, lines = PAGES[name]
    assert html_lstm.main_texts([page], labeller)[0].split("\n") == lines


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="no test tables")
def test_pages_table(spark, labeller):
    """The query's text of every page against what stands in its article element."""
    wrong = 0
    for row in html_lstm.extracted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), labeller).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.sub(r'<(div|aside|section) class="(?:ad|cookie|comments|sidebar|related)[^"]*">.*?</\1>', "", row["html"].partition("<article>")[2].partition("</article>")[0], flags=re.DOTALL)
        wrong += row["text"] != "\n".join(b.text for b in html_lstm.blocks(body))
        assert row["n_chars"] == len(row["text"])
    assert wrong <= 2


def test_labeller_on_unseen_layouts(spark, labeller):
    maker, right, total = html_lstm.PageMaker(12345), 0, 0
    for _ in range(80):
        page, labels = maker.page()
        found = html_lstm.blocks(page)
        assert len(found) == len(labels)
        right, total = right + (html_lstm.labelled([found], labeller)[0] == np.array(labels)).sum(), total + len(labels)
    assert right / total > 0.975
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "y"), (None, "u", "<article><h1>A b</h1><p>Some text, with words. And more of it here.</p></article><footer><p>c</p></footer>", "z"), (3, "u", "<nav><ul><li><a>x</a></li></ul></nav>", "z")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_lstm.extracted(pages, labeller).collect()}
    assert got[1]["text"] == got[2]["text"] == got[3]["text"] == "" and got[1]["n_chars"] == 0
    assert got[None]["text"] == "A b\nSome text, with words. And more of it here." and got[None]["n_chars"] == len(got[None]["text"])
    assert html_lstm.extracted(pages.limit(0), labeller).count() == 0
