import random
from collections import Counter

from trialframe.llm import quality

SPACES = " \t\n\r\x0b\x0c"


def brute(text):
    text = text or ""
    words, w = [], ""
    for c in text + " ":
        if c in SPACES:
            if w:
                words.append(w)
            w = ""
        else:
            w += c
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if any(c not in SPACES for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "b", "çé", "#x", "<y>"], k=rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", "\n\n", "a b\na b\n a b\n\n", "x " * 50, "ab cd\x0bef\x85gh\u2003ij", "one two three four five six seven eight " * 2]
    df = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in quality.quality_rules(df).collect():
        want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_outliers_go_and_clean_stay(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    clean = [say(rng.randint(25, 400)) for _ in range(200)]
    junk = [" ".join(x + "***" for x in say(80).split()) for _ in range(10)] + [say(80).upper() + " !!" * 40 for _ in range(10)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(clean + junk)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int"))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[i] for i in range(200, 220))


def test_empty(spark):
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_fit_equals_plain_concentration_steps(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    d, rows = len(quality.FEATURES), []
    for g, (n, shift) in enumerate(((400, 0.0), (60, 2.0), (3, 5.0))):
        x = rng.normal(shift, 0.2, (n, d))
        x[: n // 10] += 3
        rows += [(g * 1000 + i, "en", f"s{g}", *map(float, v)) for i, v in enumerate(x)]
    names = ", ".join(f"{f} double" for f in quality.FEATURES)
    df = spark.createDataFrame(rows, f"doc_id long, lang string, source string, {names}")
    got = {r["doc_id"]: r["distance"] for r in quality.robust_distances(df, ["lang", "source"]).collect()}
    floor, core, prior = np.diag(np.square(quality.FLOORS)), 0.75, 20.0
    for g in range(3):
        own = [r for r in rows if r[2] == f"s{g}"]
        x = np.array([r[3:] for r in own])
        low = lambda v, p: np.sort(v, 0)[max(0, int(np.ceil(p * len(v))) - 1)]
        center, cov, last = low(x, 0.5), floor, None
        for _ in range(12):
            far = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)
            near = x[far <= low(far, core)]
            center, m = near.mean(0), len(near)
            cov = (m * (near.T @ near / m - np.outer(center, center)) + prior * floor) / (m + prior) / core + floor
            now = np.linalg.slogdet(cov)[1]
            if last is not None and abs(now - last) <= 1e-12:
                break
            last = now
        want = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)
        have = np.array([got[r[0]] for r in own])
        assert np.allclose(have, want, rtol=0.1, atol=0.2)
        assert ((have > 25) == (want > 25)).all()


def test_rows_with_shared_or_no_id_are_judged_alone(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "en", "s"), (1, "short", "en", "s"), (None, good + " end", "en", None), (None, None, "en", None), (2, "", None, "s"), (2, " ".join(f"word{i}" for i in range(50_000)), "fr", "s")]
    df = spark.createDataFrame([(*r, 1, 2, 3.0, 4) for r in rows], "doc_id long, text string, lang string, source string, _bad int, g int, distance double, key int")
    out = quality.keep_good(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, len(r["text"])) for r in out.collect()) == sorted((i or 0, len(t)) for i, t, *_ in (rows[0], rows[2], rows[5]))
    assert quality.keep_good(df.limit(0)).count() == 0
