import random
from collections import Counter

import xxhash

from trialframe.llm import simhash
from trialframe.llm.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
    return sum(1 << b for b, n in votes.items() if 2 * n > len(grams))


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def documents():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(40)]
    for t in texts[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0].upper(), None, "", " \n", "one", "two words", texts[1] * 9]
    return list(enumerate(texts))


def test_matches_brute_force(spark):
    docs = documents()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fp = {i: brute_fingerprint(t) for i, t in docs}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    root = brute_components(list(fp), links)
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in fp}


def test_near_pairs_complete_for_every_index(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))) for b in base for _ in range(4)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    for width in (3, 4):
        assert {tuple(r) for r in simhash.near_pairs(df, 3, width).collect()} == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_empty_and_one_of_each(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    rows = [(3, "a b c d"), (1, "A b c d"), (1, "a b c d"), (2, "other words here"), (None, "a b c d"), (None, "a b c d")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [1, 2]
    assert sum(r["doc_id"] is None for r in got) == 1


def test_count_filter_drops_pairs_that_share_too_few_bytes(spark):
    # The two share exactly three bytes, those of one set: they meet in its list, and the tally drops them.
    sets = simhash.position_sets(5, 3)
    for x in __import__("itertools").combinations(range(8), 5):
        inside = [set(s) for s in sets if set(s) <= set(x)]
        assert set().union(*inside) == set(x)
    a = 0x0123456789ABCDEF
    b = a ^ sum(1 << 8 * p for p in range(8) if p not in sets[0])
    near = a ^ (1 << 8 * sets[0][0])
    df = spark.createDataFrame([(a,), (b,), (near,)], "fp long")
    assert {tuple(sorted(r)) for r in simhash.near_pairs(df, 5 - 2).collect()} == {tuple(sorted((a, near)))}


def test_rows_are_told_apart_by_id_and_text(spark):
    rows = [(1, "first text of some words"), (1, "quite another one with other words"), (1, "first text of some words"), (2, "first text of some words"), (None, None), (None, ""), (None, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, key long, fp long, _drop long")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == [(0, ""), (0, ""), (1, rows[0][1]), (1, rows[1][1])]
