"""Registered queries against their DuckDB oracle on the smallest tables."""

import pytest

from compare import canon, duck
from conftest import SF

FAST = ["headline", "anova_family", "variance_decomposition", "eta2_all_metrics", "extreme_cells",
        "corr_pooled", "spearman_cells", "kendall_tau", "box_stats", "long_to_wide", "zscore_cells",
        "family_bands", "display_labels", "code_map", "load_sentences", "request_keys", "corpus_bleu",
        "lexical_cosine", "embedding_cosine", "length_profile", "exact_dups", "near_dups",
        "register_markers", "union_integrity", "word_edit_rate", "anova_p", "corr_pvalues"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    sc, sr = canon(df.columns, df.collect())
    res = con.execute(E.oracle_sql()[name])
    dc, dr = canon([d[0] for d in res.description], res.fetchall())
    assert sc == dc
    assert sr == dr


def test_entry_runs(spark):
    import __spark_entry__ as E
    assert E.entry(spark).count() >= 1


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
