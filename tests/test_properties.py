"""Property tests (hypothesis): FD confidences equal pandas' groupby/nunique, histogram counts equal pd.cut."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabletwin.operators import fd as FD
from tabletwin.operators.compare import histogram

small = st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 3), st.sampled_from(["x", "y", None])),
                 min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=small)
def test_fd_confidence_matches_pandas(spark, rows):
    df = spark.createDataFrame(rows, "a string, b bigint, c string")
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"])
    got = {(r["lhs"][0], r["rhs"]): r["confidence"] for r in FD.confidences(df, ["a", "b", "c"]).collect()}
    for (lhs, rhs), conf in got.items():
        g = pdf.dropna(subset=[lhs]).groupby(lhs)[rhs].nunique()
        if len(g) == 0:
            continue
        assert conf == pytest.approx((g == 1).sum() / len(g))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.integers(-1000, 1000), min_size=2, max_size=60), bins=st.sampled_from([4, 15, 20]))
def test_histogram_matches_pandas_cut(spark, xs, bins):
    pdf = pd.DataFrame({"x": [float(v) for v in xs]})
    got = [r["count"] for r in histogram(spark.createDataFrame(pdf), ["x"], bins).orderBy("bin").collect()]
    assert got == pd.cut(pdf["x"], bins=bins).value_counts().sort_index().tolist()
