import pytest
from oracle import compare, connect

from trialframe.llm import curriculum
from trialframe.llm.queries import oracle_sql, queries


def test_query_matches_sql(spark, data_dir):
    compare(queries()["op3_mix_curriculum"](spark, data_dir), connect(data_dir), oracle_sql()["op3_mix_curriculum"])


def test_targets_stop_at_the_cap_and_add_up(spark):
    rows = [(i, "w " * (1 + i % 7), s) for s, n in (("a", 5), ("b", 300), ("c", 40), (None, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = curriculum.curriculum(df, rows_per_bucket=16).toPandas()
    per = out.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert per.target.sum() == pytest.approx(1.5 * per["size"].sum())
    assert (per.target <= 2 * per["size"] + 1e-9).all() and ((per.taken - per.target).abs() <= 7).all()
    assert (out.taken <= 2 * out["size"]).all() and len(out) == len(rows)
    again = curriculum.curriculum(df.repartition(7), rows_per_bucket=16).toPandas()
    key = ["source", "doc_id", "size", "taken", "position"]
    assert out[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_time_inverts_the_schedule(spark):
    shares = [(i / 50.0,) for i in range(50)]
    for n, knots in enumerate(curriculum.SCHEDULES):
        df = spark.createDataFrame(shares, "s double")
        for r in df.select("s", curriculum.time_of(df["s"], curriculum.F.lit(n)).alias("t")).collect():
            steps = 20000
            at = lambda t: next(a[1] + (b[1] - a[1]) * (t - a[0]) / (b[0] - a[0]) for a, b in zip(knots, knots[1:]) if t <= b[0])
            total = sum(at((i + 0.5) / steps) for i in range(steps)) / steps if r["s"] == 0 else total  # noqa: F821
            if r["s"] in (0.0, 0.1, 0.5, 0.9):
                got = sum(at((i + 0.5) / steps * r["t"]) for i in range(steps)) / steps * r["t"] / total
                assert got == pytest.approx(r["s"], abs=1e-3)


def test_empty(spark):
    assert curriculum.curriculum(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_every_copy_has_a_position(spark):
    rows = [(i, "w " * 5, s) for s, n in (("a", 20), ("b", 300), ("c", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = curriculum.curriculum(df, rows_per_bucket=16).toPandas()
    assert (out.positions.map(len) == out.copies).all() and out.copies.max() == 2
    capped = out[out.source == "a"]
    assert (capped.copies == 2).all() and capped.positions.map(max).max() > 0.9
    assert all(p[0] < p[1] for p in out[out.copies == 2].positions)
    order = curriculum.training_order(df, rows_per_bucket=16).toPandas()
    assert order.taken.sum() == out.taken.sum() and order.position.notna().sum() == out.copies.sum()
    assert order.position.dropna().is_monotonic_increasing


def test_rows_without_id_clashing_columns_and_long_texts(spark):
    rows = [(None, f"words {i} of it", "a") for i in range(60)] + [(None, None, "a"), (7, "x " * 100_000, None), (7, "x " * 100_000, None), (8, "", "b")]
    df = spark.createDataFrame([(*r, 1, 2.0, 3, "k") for r in rows], "doc_id long, text string, source string, size long, position double, piece long, key string")
    out = curriculum.curriculum(df, rows_per_bucket=8).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all() and out[out["size"] == 0].taken.sum() == 0
    whole = curriculum.training_order(df, rows_per_bucket=8)
    assert whole.columns == [*df.columns, "size_", "source_size", "target", "copies", "taken", "position_", "copy"]
    got = whole.toPandas()
    assert got.taken.sum() == out.taken.sum() and got.position_.dropna().is_monotonic_increasing
    assert sorted(got[got.text.notna()].text.unique()) == sorted({t for _, t, _ in rows if t is not None})
    assert curriculum.training_order(df.limit(0)).count() == 0


def test_pieces_stay_small_when_rows_have_no_id(spark):
    df = spark.createDataFrame([(None, f"words {i}", "a") for i in range(2000)], "doc_id long, text string, source string")
    by_piece = curriculum._placed(df, rows_per_bucket=100)
    assert by_piece.select("position").distinct().count() > 1000


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, f"w{i} x", s) for i, s in enumerate("ab" * 100)], "doc_id long, text string, source string")
    even = curriculum.curriculum(docs, schedules=(((0.0, 1.0), (1.0, 1.0)),)).toPandas().set_index("doc_id").sort_index()
    bent = curriculum.curriculum(docs).toPandas().set_index("doc_id").sort_index()
    assert (even.taken == bent.taken).all() and not (even.position - bent.position).abs().fillna(0).lt(1e-6).all()
