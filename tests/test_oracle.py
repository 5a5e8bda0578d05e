"""Every registered query against its DuckDB oracle on sf0.001 (a fast subset by default; set
TABLETWIN_FULL_ORACLE=1 for all of them)."""

import os

import pytest

from helpers import canon
from tabletwin.plans.catalog import ORACLE, QUERIES

FAST = ["profile_numeric", "profile_percentiles", "profile_base", "profile_value_counts", "profile_mode",
        "profile_binary", "profile_table", "fd_candidates", "fd_all_pairs", "fd_composite", "fd_exact",
        "fd_probabilistic", "fd_lookup", "contract_learn", "validate_report", "validate_report_lines",
        "histogram_equal_width", "describe_numeric", "top_values", "inspect_column", "kpi_row",
        "uniform_draws", "label_exact_rate", "sample_weighted", "pool_flag", "pool_fallback",
        "alloc_count", "alloc_rest_equal", "alloc_rest_prop", "alloc_unknown", "perturb_numeric",
        "synth_numeric_expon", "sample_jitter", "synth_table", "req_all", "fit_best", "ks_uniform",
        "csv_roundtrip", "validate_stream"]
NAMES = sorted(ORACLE) if os.environ.get("TABLETWIN_FULL_ORACLE") else FAST


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    from conftest import SF_SMALL

    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert canon(df.columns, srows) == canon(dcols, drows)


def test_every_query_has_a_callable_and_most_have_oracles():
    assert set(ORACLE) <= set(QUERIES)
    assert len(ORACLE) >= 100
