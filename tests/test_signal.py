import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.operators import signal as sig


def test_smoother_keeps_quadratics():
    x = np.arange(40.0)
    y = 3 - 2 * x + 0.5 * x * x
    for width in (9, 15):
        assert np.allclose(sig.smooth(y, width), y)


def test_short_input_is_left_alone():
    assert sig.smooth(np.array([1.0, 5, 2]), 9).tolist() == [1, 5, 2]


def test_peaks_plateau_edges_distance():
    assert sig.peaks(np.array([0, 2, 2, 2, 0.0])).tolist() == [2]
    assert sig.peaks(np.array([3, 1, 0.0])).tolist() == []
    assert sig.peaks(np.array([0, 1, 0, 3, 0, 1, 0.0]), distance=3).tolist() == [3]
    assert sig.peaks(np.array([0, 5, 4, 6, 0.0]), prominence=2).tolist() == [3]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=3, max_size=30))
def test_prominence_by_definition(values):
    y = np.array(values, float)
    for i in sig.peaks(y):
        lo = hi = y[i]
        for j in range(i, -1, -1):
            if y[j] > y[i]:
                break
            lo = min(lo, y[j])
        for j in range(i, len(y)):
            if y[j] > y[i]:
                break
            hi = min(hi, y[j])
        assert sig.prominences(y)[i] == y[i] - max(lo, hi)


def test_native_peaks_and_smoothing_match_kernels(spark):
    rng = np.random.default_rng(0)
    data = [(k, i, float(v)) for k in (1, 2) for i, v in enumerate(rng.integers(0, 12, 60))]
    df = spark.createDataFrame(data, "k int, p long, v double")
    got = {(r["k"], r["p"]) for r in sig.peaks_of_series(df, ["k"], "p", "v", 3).collect()}
    far = {(r["k"], r["p"]) for r in sig.peaks_of_series(df, ["k"], "p", "v", 2, distance=5).collect()}
    full = {(r["k"], r["p"]): r["s"] for r in sig.smooth_full(df, "v", ["k"], ["p"], "s", 9).collect()}
    for k in (1, 2):
        y = np.array([v for kk, _, v in data if kk == k])
        assert {p for kk, p in got if kk == k} == set(sig.peaks(y, 3).tolist())
        assert {p for kk, p in far if kk == k} == set(sig.peaks(y, 2, 5).tolist())
        assert np.allclose([full[k, i] for i in range(60)], sig.smooth(y, 9))
