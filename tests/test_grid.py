"""The stock of every product on many dates, against a day loop."""

import datetime as dt
import random

from stockroom.operators import inventory as inv

KEYS = ["k"]


def test_grid_equals_a_day_loop(spark):
    r, day = random.Random(1), lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    moves = {(k, n): r.randint(0, 99) for k in "abc" for n in r.sample(range(0, 500), 12)}
    opening = {"a": 5, "z": 8}
    dates = [day(n) for n in r.sample(range(-60, 700), 100)]
    balances = spark.createDataFrame([(k, day(n), q) for (k, n), q in moves.items()], "k string, Date date, Closing_Qty long")
    asked = spark.createDataFrame([(d,) for d in [*dates, dates[0], None]], "Date date")
    start = spark.createDataFrame(list(opening.items()), "k string, Qty long")
    want = []
    for d in set(dates):
        for k in "abcz":
            past = [n for q, n in moves if q == k and day(n) <= d]
            if past or k in opening:
                want.append((k, d, moves[k, max(past)] if past else opening[k]))
    got = inv.stock_on_dates(balances, asked, KEYS, opening=start)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    none = [x for x in want if any(q == x[0] and day(n) <= x[1] for q, n in moves)]
    assert sorted(map(tuple, inv.stock_on_dates(balances, asked, KEYS).collect())) == sorted(none)
    assert inv.stock_on_dates(balances, asked.limit(0), KEYS, opening=start).count() == 0


def test_one_plan_for_all_dates(spark):
    balances = spark.createDataFrame([("a", dt.date(2026, 1, 1), 1)], "k string, Date date, Closing_Qty long")
    plans = [inv.stock_on_dates(balances, spark.createDataFrame([(dt.date(2026, 1, 1 + i),) for i in range(n)], "Date date"), KEYS)
             for n in (1, 28)]
    size = [str(p._jdf.queryExecution().executedPlan()).count("Scan") for p in plans]
    assert size[0] == size[1]
