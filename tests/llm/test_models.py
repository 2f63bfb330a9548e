import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from trialframe.llm import htmlblocks, langid, suffixtree, urlfilter


def test_language_held_out_accuracy(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "123 !", "en", "s", 5), (10**6 + 1, "", "en", "s", 0)], docs.schema)
    rows = langid.identify(docs.union(extra)).toPandas()
    assert len(rows) == docs.count() + 3
    assert set(rows[rows.doc_id >= 10**6].lang_pred) == {"und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.itertuples())
    known = docs.where("lang is not null").select("doc_id", "lang").toPandas().merge(rows, on="doc_id")
    known = known[known.held_out & (known.lang_pred != "und")]
    assert (known.lang == known.lang_pred).mean() > 0.95 and rows.score.between(0, 1).all()


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert langid.identify(df).first()["lang_pred"] == "und"
    assert langid.identify(df.limit(0)).count() == 0


def base_score(texts, learn):
    counts = Counter()
    for t in learn:
        counts.update([*(t or "").encode().lower().split(), suffixtree.END])
    n, v = sum(counts.values()), len(counts)
    out = []
    for t in texts:
        w = [*(t or "").encode().lower().split(), suffixtree.END]
        out.append((len(w), sum(x in counts for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return n, out


@pytest.mark.parametrize("common", [5, 10_000])
def test_scores_match_brute_force(spark, common):
    rng = random.Random(6)
    words = ["w%d" % i for i in range(60)]
    texts = []
    for _ in range(150):
        w = rng.choices(range(60), [1 / (i + 1) for i in range(60)], k=rng.randint(0, 80))
        for i in range(1, len(w)):  # words often bring their follower with them, which a context can learn
            w[i] = (w[i - 1] * 7 + 1) % 60 if rng.random() < 0.6 else w[i]
        texts.append(" ".join(words[i] for i in w))
    texts += [None, "new words only", "A b\tA"]
    learn = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    n, want = base_score(texts, learn)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(suffixtree.score_texts(df, common_words=common).collect())
    for r, (tokens, known, base) in zip(rows, want):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_tree_is_a_distribution(spark):
    texts = ["a b a b a c"] * 40 + ["b a c c"] * 20
    df = spark.createDataFrame([(t,) for t in texts], "x string").selectExpr("cast(x as binary) as t")
    words = suffixtree.count_words(df).persist()
    total, vocabulary = sum(r["n"] for r in words.collect()), words.count()
    tree, counts, discount = suffixtree.learn_tree(df, words, total, vocabulary, cutoff=1.0)
    assert [len(x.contexts) > 0 for x in tree.levels] == [True, True]
    unseen = discount * vocabulary / total
    # After each context the probabilities of all words, the end and unseen words add up to 1.
    depth = len(tree.levels)
    for context in ([b"a"], [b"a", b"b"], []):
        probs = _next(tree, context, [*counts], unseen, depth)
        assert probs == pytest.approx(1.0, abs=1e-6)


def _next(tree, context, words, unseen, depth):
    ids = [tree.start] * depth + [tree.number[w] for w in context]
    total = 0.0
    for x in [*[tree.number[w] for w in words], suffixtree.OTHER]:
        p = unseen if x == suffixtree.OTHER else tree.root[x]
        for d, level in enumerate(tree.levels, 1):
            key = sum(i << suffixtree.ID_BITS * k for k, i in enumerate(reversed(ids[-d:])))
            at = suffixtree._find(level.contexts, np.array([key]))[0]
            if at >= 0:
                own = suffixtree._find(level.pairs, np.array([at << suffixtree.ID_BITS | x]))[0]
                p = (level.direct[own] if own >= 0 else 0.0) + level.rest[at] * p
        total += p
    return total


def test_scores_with_nothing_to_learn(spark):
    df = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert suffixtree.score_texts(df.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = suffixtree.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_trees_learn_and_urls_parse(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = urlfilter.BoostedTrees().fit(x[:400], y[:400])
    assert ((model.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.9
    urls = ["http://A.Example.NET/en/1?x", "https://example.com/de/", "x://foo.org/fr/a#b", "http://org", None, "nothing", "http://badnet/x", "ftp://a.net", "http://u://v.net/y"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urlfilter.filter_urls(df).collect()}
    assert got == {
        0: ("a.example.net", "/en/1", "example.net/en/"), 1: ("example.com", "/de/", "example.com/de/"), 2: ("foo.org", "/fr/a", "org/fr/"), 3: ("org", "", None), 4: ("", "", None),
        5: ("", "", None), 6: ("badnet", "/x", None), 7: ("a.net", "", "net/"), 8: ("u:", "//v.net/y", None),
    }
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    model = htmlblocks.BiLstm(width=5, hidden=3)
    x, mask, y = rng.standard_normal((2, 4, 5)).astype(np.float64), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]]), np.array([[1, 0, 1, 1], [0, 1, 0, 0.0]])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, grad = model.gradients(x, mask, y)
    for k in model.p:
        at = tuple(0 for _ in model.p[k].shape)
        old = model.p[k][at]
        values = []
        for step in (1e-3, -1e-3):
            model.p[k][at] = old + step
            values.append(model.gradients(x, mask, y)[0])
        model.p[k][at] = old
        assert grad[k][at] == pytest.approx((values[0] - values[1]) / 2e-3, abs=2e-3)


def test_main_text(spark, data_dir):
    model = htmlblocks.train()
    rng, wrong, total = np.random.default_rng(77), 0, 0
    for _ in range(150):
        html, main = htmlblocks.made_up_page(rng)
        found = htmlblocks.blocks(html)
        got = htmlblocks.main_text([html], model)[0].split("\n\n")
        wrong += sum((b.text in got) != m for b, m in zip(found, main))
        total += len(main)
    assert wrong < 0.03 * total
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></ul></nav><article><h1>A &amp; B</h1><p>one <b>two\n three<br>four<p>five</article><footer>&copy; me</footer></body></html>'
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (3, "u", "<<<>"), (4, None, "<p>" * 3000)]
    got = {r["page_id"]: r for r in htmlblocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got[1]["text"] == "A & B\n\none two three four\n\nfive" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[4]["text"] == ""


def test_markup_stays_out_whatever_its_quotes():
    text = lambda h: [b.text for b in htmlblocks.blocks(h)]
    assert text("<p class=don't>long <b>text</b> isn't done</p><p>next</p>") == ["long text isn't done", "next"]
    assert text('<p><a title="foo>bar</a> more</p><p class="x">z</p>') == ["bar more", "z"]
    assert text("<p title=\"a > b\" data-x='<'>one</p><img alt='>'/>two<p a=b/>three") == ["one", "two", "three"]
    assert text("1 < 2 and <3 > 2") == ["1 < 2 and <3 > 2"]


def test_whole_blocks_and_whole_paths_count():
    deep = "<aside>" + "<div>" * 5000 + "text" + "</div>" * 5000 + "</aside><p>after</p>"
    one, two = htmlblocks.blocks(deep)
    slot = htmlblocks._slot("aside", "t", htmlblocks._PATH)
    assert one.above[slot] > 0 and (two.text, two.above[slot]) == ("after", 0)
    a, b = (htmlblocks.vectors(htmlblocks.blocks(f"<p>{'w ' * 400}{last}</p>")) for last in ("home", "zebra"))
    assert not np.array_equal(a, b)  # the last of 401 words tells them apart


def test_forward_pass_equals_plain_loops():
    rng = np.random.default_rng(8)
    model = htmlblocks.BiLstm(width=htmlblocks.WIDTH, hidden=4)
    seqs = [rng.standard_normal((n, htmlblocks.WIDTH)).astype(np.float32) for n in (1, 5, 3)]
    x, mask = htmlblocks.padded(seqs)
    got = model.scores(x, mask)
    sig = lambda v: 1 / (1 + math.exp(-v))
    for s, row in zip(seqs, got):
        sides = {}
        for d in "fb":
            h, c, out = [0.0] * 4, [0.0] * 4, {}
            for k in range(len(s)) if d == "f" else reversed(range(len(s))):
                a = [sum(s[k][i] * model.p["x" + d][i][j] for i in range(len(s[k]))) + sum(h[i] * model.p["h" + d][i][j] for i in range(4)) + model.p["c" + d][j] for j in range(16)]
                c = [sig(a[4 + j]) * c[j] + sig(a[j]) * math.tanh(a[12 + j]) for j in range(4)]
                h = [sig(a[8 + j]) * math.tanh(c[j]) for j in range(4)]
                out[k] = h
            sides[d] = out
        for k in range(len(s)):
            want = sig(sum(v * w for v, w in zip(sides["f"][k] + sides["b"][k], model.p["o"])) + model.p["ob"][0])
            assert row[k] == pytest.approx(want, abs=1e-5)
