import datetime as dt
import itertools
import math

import numpy as np
import pytest

from cashweave.operators.change_points import ERROR_FLOOR, best_cuts, changing_trend_projection, trend_segments


def _error(y):
    t = np.arange(len(y), dtype=float)
    return float(((y - np.polyval(np.polyfit(t, y, 1), t)) ** 2).sum())


def _all_cuts(y, most, least, penalty):
    n = len(y)
    found = []
    for k in range(1, max(1, min(most, n // least)) + 1):
        for cuts in itertools.combinations(range(1, n), k - 1):
            edges = [0, *cuts, n]
            if k == 1 or min(b - a for a, b in zip(edges, edges[1:])) >= least:
                err = sum(_error(y[a:b]) for a, b in zip(edges, edges[1:]))
                found.append((n * math.log(err / n + ERROR_FLOOR) + penalty * k * math.log(n), [0, *cuts]))
    return min(found)


@pytest.mark.parametrize("seed", range(12))
def test_cuts_equal_all_possible_cuts_tried(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(6, 23))
    y = np.cumsum(rng.normal(rng.normal(0, 5, 3).repeat(8)[:n], 3.0)) + 1e6
    assert best_cuts(y, 4, 4, 3.0) == _all_cuts(y, 4, 4, 3.0)[1]


def _ledger(spark, nets, account=1):
    day = dt.date(2031, 1, 1)
    rows = [(account, day + dt.timedelta(days=i), float(v)) for i, v in enumerate(nets)]
    return spark.createDataFrame(rows, "account_id long, transaction_date date, amount double")


def test_a_turn_is_found_and_the_last_trend_carried_on(spark):
    t = _ledger(spark, [10.0] * 40 + [-25.0] * 40).unionByName(_ledger(spark, [3.0] * 60, 2)).unionByName(_ledger(spark, [7.0], 3))
    got = {(r.account_id, r.segment): r for r in trend_segments(t, 100.0).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (3, 1)]
    assert got[1, 1].slope == pytest.approx(10) and got[1, 2].slope == pytest.approx(-25)
    assert got[1, 2].first_date in (dt.date(2031, 2, 9), dt.date(2031, 2, 10)) and got[1, 1].n_days + got[1, 2].n_days == 80
    assert (got[3, 1].slope, got[3, 1].intercept, got[3, 1].error) == (0.0, 107.0, 0.0)
    p = {(r.account_id, r.day_no): r.projected_balance for r in changing_trend_projection(t, 100.0, 10).collect()}
    assert len(p) == 30 and p[1, 10] == pytest.approx(100 + 400 - 1000 - 250) and p[2, 1] == pytest.approx(283) and p[3, 9] == pytest.approx(107)


def test_no_rows_and_bad_arguments(spark):
    t = _ledger(spark, [1.0]).where("false")
    assert trend_segments(t).collect() == [] and changing_trend_projection(t).collect() == []
    assert changing_trend_projection(_ledger(spark, [1.0]), 0.0, 0).collect() == []
    with pytest.raises(ValueError):
        trend_segments(t, min_days=2)
