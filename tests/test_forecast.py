import datetime as dt
from decimal import Decimal

from cashweave.operators.forecast import daily_series, forecast_projection, forecast_summary


def _ledger(spark, start, days, amount):
    rows = [(start + dt.timedelta(days=i), Decimal(str(amount)), f"daily {i}") for i in range(days)]
    return spark.createDataFrame(rows, "transaction_date date, amount decimal(18,2), description string")


def test_gap_fill(spark):
    d = dt.date(2026, 3, 1)
    df = spark.createDataFrame([(d, Decimal("-10"), "a"), (d, Decimal("-5"), "b"),
                                (d + dt.timedelta(days=2), Decimal("100"), "c")],
                               "transaction_date date, amount decimal(18,2), description string")
    s = daily_series(df, account_col=None).orderBy("date").collect()
    assert [float(r.net) for r in s] == [-15.0, 0.0, 100.0]


def test_burning_business(spark):
    df = _ledger(spark, dt.date(2026, 1, 1), 30, -100.0)
    f = forecast_summary(df, 1000.0, horizon_days=60, account_col=None).first()
    assert f.death_date == dt.date(2026, 1, 31)
    assert f.mean_daily_burn == 100.0
    p = forecast_projection(forecast_summary(df, 1000.0, horizon_days=60, account_col=None))
    assert p.count() == 60


def test_profitable_business(spark):
    df = _ledger(spark, dt.date(2026, 1, 1), 30, 250.0)
    f = forecast_summary(df, 5000.0, horizon_days=90, account_col=None).first()
    assert f.death_date is None and f.mean_daily_net == 250.0 and f.mean_daily_burn == 0.0
    assert f.summary.startswith("Cash-flow positive")


def test_exact_zero_day(spark):
    df = _ledger(spark, dt.date(2026, 1, 1), 10, -100.0)
    f = forecast_summary(df, 3000.0, horizon_days=60, account_col=None).first()
    assert f.death_date == dt.date(2026, 1, 30)


def test_closed_form_equals_scan(spark):
    from pyspark.sql import functions as F
    import random
    random.seed(7)
    rows = []
    for acct in range(60):
        for i in range(random.randint(1, 20)):
            rows.append((acct, dt.date(2026, 1, 1) + dt.timedelta(days=random.randint(0, 40)),
                         Decimal(str(round(random.uniform(-500, 300), 2))), "x"))
    df = spark.createDataFrame(rows, "account_id long, transaction_date date, amount decimal(18,2), description string")
    s = forecast_summary(df, 200.0, horizon_days=120)
    scan = forecast_projection(s).where("projected_balance <= 0").groupBy("account_id") \
        .agg(F.min("date").alias("scan_death"))
    j = s.join(scan, "account_id", "left").collect()
    assert all(r.death_date == r.scan_death for r in j)


def test_empty_is_safe(spark):
    df = spark.createDataFrame([], "transaction_date date, amount decimal(18,2), description string")
    assert forecast_summary(df, 100.0, account_col=None).count() == 0
    bal = spark.createDataFrame([(1, 100.0)], "account_id long, starting_balance double")
    df2 = spark.createDataFrame([], "account_id long, transaction_date date, amount decimal(18,2)")
    f = forecast_summary(df2, bal).first()
    assert f.death_date is None and f.mean_daily_net == 0.0
