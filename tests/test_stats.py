"""The reference's statistics tests on the 4-row frame, with numeric values."""

import pytest

from pivotscore.operators import relate, stats


@pytest.fixture
def small(spark):
    rows = [("t", "a", "a1", "x", 80.0, 0.99, 10.0), ("t", "a", "a1", "y", 78.0, 0.98, 12.0),
            ("t", "b", "b1", "x", 60.0, 0.97, 25.0), ("t", "b", "b1", "y", 55.0, 0.96, 30.0)]
    return spark.createDataFrame(rows, "translator string, family string, language string, domain string, "
                                       "bleu double, cosine double, ter double")


def test_summary_by_family_best_first(small):
    out = stats.summary_by(small, "family", "bleu").orderBy("rank").collect()
    assert out[0]["family"] == "a" and out[0]["mean"] == 79.0 and out[0]["n"] == 2


def test_summary_by_ter_sorts_ascending(small):
    out = stats.summary_by(small, "family", "ter").orderBy("rank").collect()
    assert out[0]["family"] == "a"


def test_variance_decomposition(small):
    rows = {r["factor"]: r for r in stats.variance_decomposition(small, "bleu").collect()}
    assert rows["total"]["eta_squared"] == 1.0
    assert rows["family"]["ss"] == 462.25 and rows["total"]["ss"] == 476.75
    assert rows["family"]["eta_squared"] == pytest.approx(0.9696, abs=1e-4)


def test_anova_values(small):
    r = stats.anova(small, "family", "bleu").collect()[0]
    assert set(r.asDict()) >= {"F", "df_between", "df_within", "eta_squared"}
    assert (r["df_between"], r["df_within"]) == (1, 2)
    assert r["F"] == pytest.approx(63.76, abs=0.01)
    assert r["eta_squared"] == pytest.approx(0.969586, abs=1e-6)


def test_extreme_cells(small):
    out = stats.extreme_cells(small, "bleu", 2).collect()
    best = [r for r in out if r["kind"] == "best" and r["rank"] == 1][0]
    worst = [r for r in out if r["kind"] == "worst" and r["rank"] == 1][0]
    assert best["bleu"] == 80.0 and worst["bleu"] == 55.0


def test_extreme_cells_tie_break_is_deterministic(spark):
    df = spark.createDataFrame([("t", "f", "l2", "d", 1.0), ("t", "f", "l1", "d", 1.0)],
                               "translator string, family string, language string, domain string, bleu double")
    top = stats.extreme_cells(df, "bleu", 1).filter("kind = 'best'").collect()
    assert top[0]["language"] == "l1"


def test_single_row_group_sd_is_null(spark):
    df = spark.createDataFrame([("t", "a", 1.0)], "translator string, family string, bleu double")
    assert stats.summary_by(df, "family", "bleu").collect()[0]["std"] is None


def test_asymmetry_drops_missing_direction(spark):
    rt = spark.createDataFrame([("g", "ja", "d", "ABA", 0.9), ("g", "ja", "d", "BAB", 0.5),
                                ("g", "ar", "d", "ABA", 0.8)],
                               "translator string, language string, domain string, direction string, cosine double")
    out = {r["language"]: r["asymmetry"] for r in relate.asymmetry(rt).collect()}
    assert out == {"ja": 0.4}


def test_zscore_zero_sd(spark):
    from pivotscore.operators import marts
    df = spark.createDataFrame([("t", "l", "x", 5.0), ("t", "l", "y", 5.0)],
                               "translator string, language string, domain string, bleu double")
    assert {r["z"] for r in marts.zscore_cells(df, "bleu").collect()} == {0.0}


def test_family_bands_unclassified(spark):
    from pivotscore.operators import marts
    cells = spark.createDataFrame([("fr",), ("es",), ("xx",)], "language string")
    langs = spark.createDataFrame([("fr", "romance", 0, 2), ("es", "romance", 0, 1)],
                                  "language string, family string, family_ord int, lang_ord int")
    rows = {r["language"]: r for r in marts.family_bands(cells, langs).collect()}
    assert rows["es"]["row"] == 0 and rows["fr"]["row"] == 1
    assert rows["xx"]["family"] == "unclassified" and (rows["xx"]["start"], rows["xx"]["stop"]) == (2, 3)


def test_unlisted_domain_raises(spark):
    from pivotscore.operators import marts
    df = spark.createDataFrame([("t", "f", "l", "LARGE", 1.0), ("t", "f", "l", "ODD", 2.0)],
                               "translator string, family string, language string, domain string, bleu double")
    with pytest.raises(Exception, match="domain not in the report"):
        marts.long_to_wide(df, ["LARGE"], ["bleu"]).collect()
    with pytest.raises(Exception, match="domain not in the report"):
        marts.heatmap_matrix(df, ["LARGE"], "bleu").collect()


def test_box_stats_are_exact_whatever_the_partitions(spark):
    import numpy as np
    from pivotscore.operators import marts
    rng = np.random.RandomState(2)
    v = rng.randn(999).round(2)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(x)) for i, x in enumerate(v)], "k string, m double").repartition(7)
    for r in marts.box_stats(df, ["k"], "m").collect():
        mine = np.array([x for i, x in enumerate(v) if bool(i % 3) == (r["k"] == "a")])
        assert [r["q1"], r["median"], r["q3"]] == pytest.approx(np.quantile(mine, [0.25, 0.5, 0.75]).round(4).tolist(), abs=1e-4)


def test_result_files_and_sinks(spark, tmp_path):
    """Typed CSV read, partition overwrite, append per (translator, order)."""
    (tmp_path / "r.csv").write_text("translator,order,bleu\ng,x,1.5\nn,y,\n")
    df = spark.read.schema("translator string, order string, bleu double").csv(str(tmp_path / "r.csv"), header=True)
    assert [r["bleu"] for r in df.orderBy("translator").collect()] == [1.5, None]
    out = str(tmp_path / "out")
    for _ in range(2):
        df.write.mode("append").partitionBy("translator", "order").parquet(out)
    assert spark.read.parquet(out).count() == 4
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.filter("translator = 'g'").write.mode("overwrite").partitionBy("translator", "order").parquet(out)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert sorted(r["translator"] for r in spark.read.parquet(out).collect()) == ["g", "n", "n"]
