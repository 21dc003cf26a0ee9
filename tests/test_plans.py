"""Physical-plan properties the design relies on at scale."""

from pyspark.sql import functions as F

from cashweave.operators.dedup import deduplicate
from cashweave.operators.forecast import forecast_summary
from cashweave.operators.notes import prepare_notes, search_notes, upsert_notes
from cashweave.plans.queries import canonical_orders
from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_limits_before_the_shuffle(spark):
    plan = _plan(deduplicate(canonical_orders(spark, SF_SMALL), order_by=["row_ord"]))
    assert plan.count("WindowGroupLimit") >= 2          # partial (map side) + final


def test_forecast_shuffles_partial_aggregates_only(spark):
    s = forecast_summary(canonical_orders(spark, SF_SMALL), 0.0)
    plan = _plan(s)
    assert "HashAggregate" in plan and "partial_sum" in plan
    assert "Window" not in plan                         # no per-account window over raw rows


def test_search_has_no_cartesian_join(spark):
    b = spark.createDataFrame([(f"note {i} about cash", i) for i in range(20)], "text string, o int")
    store = upsert_notes(None, prepare_notes(b, order_by="o")[0])
    q = spark.createDataFrame([(1, "cash note")], "question_id long, question string")
    plan = _plan(search_notes(store, q))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "MapInArrow" in plan


def test_scans_prune_columns(spark):
    from cashweave.operators.reports import kpis
    plan = _plan(kpis(canonical_orders(spark, SF_SMALL)))
    assert "o_orderpriority" not in plan and "o_comment" not in plan


def _scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_window_totals_scan_the_ledger_once(spark):
    from cashweave.plans.queries import QUERIES
    assert _scans(QUERIES["window_30d_net"](spark, SF_SMALL)) == 1
    assert _scans(QUERIES["category_spend_30d"](spark, SF_SMALL)) == 1


def test_citation_sets_have_no_union(spark):
    """One read of the rows; the account's latest date needs two columns more."""
    from cashweave.plans.queries import QUERIES
    df = QUERIES["citation_sets"](spark, SF_SMALL)
    assert _scans(df) <= 2 and "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_ingest_compiles_and_coerces_once(spark):
    from cashweave.plans.queries import QUERIES
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        df = QUERIES["canonical_normalize"](spark, SF_SMALL)
        assert df.count() > 0
        df.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("try_to_date") == 1


def test_seasonal_fit_is_one_aggregation_over_one_scan(spark):
    from cashweave.operators.seasonal import seasonal_projection
    plan = seasonal_projection(canonical_orders(spark, SF_SMALL), 0.0, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regr_slope") >= 1 and _scans(seasonal_projection(canonical_orders(spark, SF_SMALL), 0.0, 5)) <= 2


def test_search_collects_nothing():
    import inspect

    from cashweave.operators import notes
    assert ".collect()" not in inspect.getsource(notes)
