import random
import re

from trialframe.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                ok = 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            else:
                ok = kind == "email" or 8 <= len(d) <= 15
            if ok:
                out[kind].append(m.span())
    return out


def test_base_equals_the_patterns():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choices("a1@.+- ()5é", weights=[3, 5, 2, 4, 1, 2, 2, 1, 1, 4, 1], k=rng.randint(0, 60)))
        assert pii.base_spans(t) == brute(t), t
    for t in ("4111 1111 1111 1111 x a.b@c.d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 +1 (988) 555-2485", "9" * 5000, "1." * 3000, "a@" * 2000, "+" + "1 " * 3000):
        assert pii.base_spans(t) == brute(t)


def test_contexts_discover_more(spark):
    rows = [(i, f"words call me at +1 (98{i % 10}) 555-01{i:02d} soon") for i in range(30)]
    rows += [(100 + i, f"other text call me at 555-01{i:02d}-99{i} now") for i in range(6)]
    rows += [(200, "size 555-0100-998 of it"), (201, None), (202, ""), (202, "")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i]["n_found"] == 1 and got[100 + i]["n_phone"] == 0 and got[100 + i]["spans"].startswith("phone:") for i in range(6))
    assert got[200]["spans"] == "" and got[201]["spans"] == ""
    masked = pii.mask_personal_data(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", pii.F.length("text").cast("long")))
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in masked.collect()}
    assert text[0] == ("words call me at <PHONE> soon", 29) and "<PHONE>" in text[101][0] and text[201] == (None, None)


def test_empty(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_identifiers_and_far_words_count(spark):
    long = "x" * 300
    rows = [(i, f"mail to {'a' * (i + 1)}@site{i}.org today") for i in range(12)]
    rows += [(50, f"mail to   {long}(at){long}(dot)com today"), (51, f"{'y' * 500} {' ' * 200}mail to {long}@localhost today"), (52, f"some {long}@localhost thing")]
    df = spark.createDataFrame([(*r, "k", [1], 2) for r in rows], "doc_id long, text string, key string, added array<int>, mentions int")
    got = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    a = 10
    assert got[50]["spans"] == f"email:{a}:{a + 300 + 4 + 300 + 5 + 3}" and got[50]["n_email"] == 0
    assert got[51]["n_found"] == 1 and got[52]["n_found"] == 0
    masked = pii.mask_personal_data(df)
    assert masked.columns == df.columns and {r["doc_id"]: r["text"] for r in masked.collect()}[50] == "mail to   <EMAIL> today"


def test_the_word_after_counts_and_scores_equal_a_plain_loop(spark):
    texts = [f"n{i} then +1 (98{i % 10}) 555-01{i:02d} is my number" for i in range(20)] + [f"o{i} now 555-02{i:02d}-77{i} is here" for i in range(5)] + [f"p{i} now 555-03{i:02d}-66{i} was sold" for i in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = pii.scan(df)
    edges = {}
    for r in scanned.collect():
        for m in r["mentions"]:
            for p in m["patterns"]:
                key = (m["kind"], m["instance"], p)
                edges[key] = max(edges.get(key, 0.0), float(m["known"]))
    score, good = dict(edges), {}
    for i in range(3):
        good = {}
        for kind, p in {(k, p) for k, _, p in edges}:
            hits = sum(v for (k, _, q), v in score.items() if (k, q) == (kind, p))
            if hits >= 5 and hits / (sum(q == p for _, _, q in edges) + 1) >= 0.8:
                good[kind, p] = hits / (sum(q == p for _, _, q in edges) + 1)
        best = {}
        for k, x, p in edges:
            if not edges[k, x, p] and (k, p) in good:
                best[k, x] = max(best.get((k, x), 0), good[k, p])
        score = {(k, x, p): max(v, best.get((k, x), 0.0)) for (k, x, p), v in edges.items()}
    got = {(r["kind"], r["pattern"]): r["score"] for r in pii.learn_patterns(scanned).collect()}
    assert got.keys() == good.keys() and all(abs(got[k] - good[k]) < 1e-9 for k in got)
    assert any(p.startswith("1 then") for _, p in got)
