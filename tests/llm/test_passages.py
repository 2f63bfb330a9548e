import random
import re

from trialframe.llm import decontaminate, paragraphs


def say(rng, n):
    return " ".join("".join(rng.choices("abcdefghijkl", k=rng.randint(2, 7))) for _ in range(n))


def windows_brute(text, item):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    a, b = words(text), words(item)
    k = min(5, len(b))
    if not b or len(a) < k:
        return 0.0
    best, own, all_ = 0.0, grams(b, k), grams(a, k)
    for i in range(max(1, len(all_) - len(own) + 1)):
        w = all_[i : i + len(own)]
        shared = sum(min(w.count(g), own.count(g)) for g in set(w))
        best = max(best, shared / (len(w) + len(own) - shared))
    return best


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    items = [(i, say(rng, rng.randint(12, 60))) for i in range(12)] + [(50, None), (51, ""), (52, "zzz yyy xxx")]
    docs = []
    for i in range(60):
        text = say(rng, rng.randint(5, 200))
        if i % 3 == 0:
            w = items[i % 12][1].split()
            if i % 2:
                w[rng.randrange(len(w))] = "edited"
            text += " " + " ".join(w).upper() + ". " + say(rng, 20)
        docs.append((i, text))
    docs += [(60, None), (61, ""), (62, "so ZZZ, yyy xxx"), (None, docs[0][1]), (0, docs[0][1])]
    d, b = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, key string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(d, b).collect()}
    want = {}
    for i, t in docs:
        for j, x in items:
            s = windows_brute(t, x)
            if s >= 0.8:
                want[i, j] = max(s, want.get((i, j), 0))
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    clean = sorted((i or 0, t or "") for i, t in docs if not any(windows_brute(t, x) >= 0.8 for _, x in items))
    left = decontaminate.drop_leaks(d, b)
    assert left.columns == d.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == clean
    assert decontaminate.find_leaks(d, b.limit(0)).count() == 0 and decontaminate.find_leaks(d.limit(0), b).count() == 0


def test_passages(spark):
    rng = random.Random(9)
    docs = [[i, say(rng, 60) + "\n" + say(rng, 80) + "\n" + say(rng, 9)] for i in range(40)]
    passage = say(rng, 70)
    for i in (3, 9, 17):  # inside of other text
        docs[i][1] += "\n" + say(rng, 30) + " " + passage + " " + say(rng, 25)
    near = docs[20][1].split("\n")[1].split()
    near[40] = "edited"
    docs[21][1] += "\n" + " ".join(near)  # a near copy of a paragraph
    docs[30][1] = docs[31][1].upper()
    docs += [[90, None], [91, ""], [92, "a b c"]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = paragraphs.repeated_passages(df).collect()
    assert {r["doc_id"] for r in rows} == {3, 9, 17, 20, 21, 30, 31}
    text = dict(docs)
    for r in rows:
        part = text[r["doc_id"]][r["start"] : r["end"]]
        assert len(part.split()) == r["n_words"] >= 25
        assert r["removed"] == (r["doc_id"] in (9, 17, 21, 31))
        if r["doc_id"] in (3, 9, 17):
            assert part in passage and r["cluster_id"] == 3
    assert paragraphs.repeated_passages(df.limit(0)).count() == 0


def test_large_bucket_of_near_copies(spark):
    rng = random.Random(10)
    base = say(rng, 60).split()
    docs = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(60)] = f"edit{i}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in docs]
    linked = {i for i in range(90) for j in range(90) if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {r["doc_id"] for r in paragraphs.repeated_passages(df).collect()}
    assert linked <= got


def test_every_long_passage_is_found_whole(spark):
    rng = random.Random(11)
    docs, want = [], {}
    for i, n in enumerate([51, 52, 55, 60] * 30):
        passage = say(rng, n)
        for k in range(2):
            head = say(rng, 60 + k)
            docs.append((2 * i + k, f"{head} {passage} {say(rng, 60)}"))
            want[2 * i + k] = (len(head) + 1, len(head) + 1 + len(passage), n, 2 * i, k == 1)
    docs += [(1000, "no no " * 80), (1001, "Short line\n" + say(rng, 30)), (1002, say(rng, 30) + "\nshort line")]
    rows = paragraphs.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["start"], r["end"], r["n_words"], r["cluster_id"], r["removed"]) for r in rows if r["doc_id"] < 1000}
    assert got == want and len(rows) == len(want) + 2
    assert {(r["doc_id"], r["n_words"], r["removed"]) for r in rows if r["doc_id"] >= 1000} == {(1001, 2, False), (1002, 2, True)}


def test_block_index_finds_all_within_the_radius_and_few_others(spark):
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(40)]
    items = [(i, 30 + i % 2, x) for i, x in enumerate(base)]
    windows = [(k, 30 + rng.randrange(2), x ^ sum(1 << p for p in rng.sample(range(64), d))) for k, (x, d) in enumerate((x, d) for x in base for d in (0, 5, 12, 15, 16, 20))]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    i = spark.createDataFrame([(a, n, signed(x)) for a, n, x in items], "item_id int, n int, fp long")
    w = spark.createDataFrame([(a, n, signed(x)) for a, n, x in windows], "doc int, n int, wfp long")
    want = {(a, b): (x ^ y).bit_count() for a, n, x in windows for b, m, y in items if n == m and (x ^ y).bit_count() <= 15}
    assert {(r["doc"], r["item_id"]): r["distance"] for r in decontaminate.near_items(w, i, 15).collect()} == want
    # Without the distance the index alone already leaves out most pairs.
    left = w.select("*", decontaminate.F.explode(decontaminate.blocks(w["wfp"])).alias("b")).select("doc", "n", "b.no", "b.value")
    met = left.join(decontaminate.block_index(i, 15), ["n", "no", "value"]).select("doc", "item_id").distinct().count()
    assert len(want) <= met < 0.15 * len(windows) * len(items)


def test_leaks_recall_on_edited_passages(spark):
    rng = random.Random(13)
    items = [(i, say(rng, rng.randint(40, 90))) for i in range(25)]
    docs = []
    for i, (_, t) in enumerate(items * 2):
        w = t.split()
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = f"edit{i}"
        docs.append((i, say(rng, 50) + " " + " ".join(w) + " " + say(rng, 50)))
    docs += [(1000, items[0][1] + " " + items[1][1]), (1001, " ".join(items[2][1].split()[40 // 2 :] + items[2][1].split()[: 40 // 2])), (1002, say(rng, 30_000))]
    d, b = spark.createDataFrame([(*x, 1, "k", 2) for x in docs], "doc_id long, text string, d long, k string, n long"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, b).collect()}
    pairs = [(i, i % 25) for i in range(50)] + [(1000, 0), (1000, 1), (1001, 2)]  # all others share next to nothing
    want = {(i, j) for i, j in pairs if windows_brute(dict(docs)[i], items[j][1]) >= 0.8}
    assert got <= want and len(got) >= 0.97 * len(want) and {(1000, 0), (1000, 1)} <= got
