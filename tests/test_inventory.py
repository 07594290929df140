"""Inventory closed forms against naive day loops, plus the reference's goldens."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from stockroom.operators import inventory as inv

PRODUCT = ["Brand_Category", "Brand", "Size_ML"]
D0 = dt.date(2026, 4, 1)
SCHEMA_TX = "Date date, Brand_Category string, Brand string, Size_ML int, Qty int"
SCHEMA_INIT = "Brand_Category string, Brand string, Size_ML int, Qty int"


def _prod(i):
    return ("CAT", f"B{i}", 750)


def random_case(rng, n_products=4, n_days=6, n_rows=25):
    init = [(*_prod(i), rng.randint(0, 8)) for i in range(n_products) if rng.random() < 0.6]
    inc = [(D0 + dt.timedelta(days=rng.randrange(n_days)), *_prod(rng.randrange(n_products)), rng.randint(0, 6))
           for _ in range(rng.randint(0, n_rows))]
    sal = [(D0 + dt.timedelta(days=rng.randrange(n_days)), *_prod(rng.randrange(n_products)), rng.randint(0, 6))
           for _ in range(rng.randint(0, n_rows))]
    return init, inc, sal


def naive_run(init, inc, sal):
    """The reference's loop: receipts (outer) then sales (left) per day;
    returns final stock, violations (product, date) and ignored sales."""
    init = sorted(set(init))
    inc, sal = sorted(set(inc)), sorted(set(sal))  # exact duplicates dropped first
    stock = defaultdict(int)
    known = set()
    for *p, q in init:
        stock[tuple(p)] += q
        known.add(tuple(p))
    inc_d, sal_d = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    for d, *p, q in inc:
        inc_d[d][tuple(p)] += q
    for d, *p, q in sal:
        sal_d[d][tuple(p)] += q
    violations, ignored = set(), set()
    for d in sorted(set(inc_d) | set(sal_d)):
        for p, q in inc_d[d].items():
            stock[p] += q
            known.add(p)
        for p, q in sal_d[d].items():
            if p not in known:
                ignored.add((d, p, q))
                continue
            if q > stock[p]:
                violations.add((p, d))
            stock[p] -= q
    return {p: stock[p] for p in known}, violations, ignored


def test_multi_day_closed_form_equals_day_loop(spark):
    rng = random.Random(7)
    for _ in range(12):
        init, inc, sal = random_case(rng)
        r = inv.multi_day_inventory(spark.createDataFrame(init, SCHEMA_INIT), spark.createDataFrame(inc, SCHEMA_TX),
                                    spark.createDataFrame(sal, SCHEMA_TX))
        final, viol, ign = naive_run(init, inc, sal)
        got = {tuple(r_[k] for k in PRODUCT): r_["Qty"] for r_ in r["final"].collect()}
        assert got == final
        got_v = {(tuple(x[k] for k in PRODUCT), x["Date"]) for x in r["violations"].collect()}
        assert got_v == viol
        got_i = {(x["Date"], tuple(x[k] for k in PRODUCT), x["Qty"]) for x in r["ignored_sales"].collect()}
        assert got_i == ign


def test_pipeline_golden(spark):
    """Opening 100 / 50, receipts 20 / 10, sales 5 / 2 -> 115 and 58."""
    init = spark.createDataFrame([("WHISKY", "A", 750, 100), ("RUM", "B", 180, 50)], SCHEMA_INIT)
    inc = spark.createDataFrame([(D0, "WHISKY", "A", 750, 20), (D0, "RUM", "B", 180, 10)], SCHEMA_TX)
    sal = spark.createDataFrame([(D0, "WHISKY", "A", 750, 5), (D0, "RUM", "B", 180, 2)], SCHEMA_TX)
    r = inv.multi_day_inventory(init, inc, sal)
    got = {x["Brand"]: (x["Qty"], x["LookColumn"]) for x in r["final"].collect()}
    assert got == {"A": (115, "(WHISKY) - A - 750 ML"), "B": (58, "(RUM) - B - 180 ML")}
    assert r["violations"].isEmpty()


def naive_clamped(init, inc, sal):
    stock = {tuple(p): q for *p, q in init}
    days = sorted({d for d, *_ in inc} | {d for d, *_ in sal})
    for d in days:
        ch = defaultdict(int)
        for dd, *p, q in inc:
            if dd == d:
                ch[tuple(p)] += q
        for dd, *p, q in sal:
            if dd == d:
                ch[tuple(p)] -= q
        for p, c in ch.items():
            if p in stock:
                stock[p] = max(0, stock[p] + c)
            elif c > 0:
                stock[p] = c
    return stock


def test_net_change_clamp_closed_form_equals_loop(spark):
    rng = random.Random(11)
    for _ in range(10):
        init, inc, sal = random_case(rng)
        init = list({tuple(x[:3]): x for x in init}.values())
        bal, _ = inv.net_change_days(spark.createDataFrame(init, SCHEMA_INIT), spark.createDataFrame(inc, SCHEMA_TX),
                                     spark.createDataFrame(sal, SCHEMA_TX), on_negative="clamp")
        final = inv.final_balances(spark.createDataFrame(init, SCHEMA_INIT), bal, PRODUCT)
        got = {tuple(x[k] for k in PRODUCT): x["Qty"] for x in final.collect()}
        assert got == naive_clamped(init, inc, sal)


def test_catalogue_golden(spark):
    """As of 2026-04-07: 101 -> 0 (clipped), 102 -> 40, 103 -> 6."""
    cat = spark.createDataFrame(
        [(101, "Laptop", "Electronics", 800, 15, 10), (102, "Mouse", "Electronics", 20, 50, 20),
         (103, "Chair", "Furniture", 120, 8, 5)],
        "product_id int, product_name string, category string, price int, stock_quantity int, reorder_level int")
    d = dt.date(2026, 4, 7)
    sales = spark.createDataFrame([(1, 101, 1200, d), (2, 102, 5, d), (3, 103, 1, d), (4, 101, 2, d),
                                   (5, 102, 5, d), (6, 103, 1, d)],
                                  "sale_id int, product_id int, quantity_sold int, sale_date date")
    r = inv.catalogue_sales(cat, sales, "2026-04-07")
    got = {x["product_id"]: x["stock_quantity"] for x in r["inventory"].collect()}
    assert got == {101: 0, 102: 40, 103: 6}
    assert r["revenue"].first()["total_revenue"] == 1202 * 800 + 10 * 20 + 2 * 120
    assert {x["product_id"] for x in r["low_stock"].collect()} == {101}


def naive_admission(requests, current, incoming):
    avail = {}
    out = {}
    for row, d, *p, q in sorted(requests, key=lambda r: (r[1], r[2:5], r[0])):
        key = (d, tuple(p))
        if key not in avail:
            avail[key] = current.get(tuple(p), 0) + incoming.get(key, 0)
        if q is None or q <= 0:
            out[row] = ("failed", None, None)
        elif avail[key] >= q:
            out[row] = ("success", avail[key], avail[key] - q)
            avail[key] -= q
        else:
            out[row] = ("failed", None, None)
    return out


def test_sale_admission_equals_greedy_loop(spark):
    rng = random.Random(3)
    for _ in range(10):
        reqs = []
        for i in range(rng.randint(1, 40)):
            p = _prod(rng.randrange(3))
            q = rng.choice([None, 0, -1] + list(range(1, 12)))
            reqs.append((i, D0 + dt.timedelta(days=rng.randrange(2)), *p, q))
        current = {_prod(i): rng.randint(0, 15) for i in range(3) if rng.random() < 0.8}
        incoming = {(D0 + dt.timedelta(days=rng.randrange(2)), _prod(rng.randrange(3))): rng.randint(0, 5)
                    for _ in range(2)}
        rq = spark.createDataFrame(reqs, "row long, Date date, Brand_Category string, Brand string, Size_ML int, "
                                         "Qty int")
        cur = spark.createDataFrame([(*p, q) for p, q in current.items()], SCHEMA_INIT)
        inc = spark.createDataFrame([(d, *p, q) for (d, p), q in incoming.items()], SCHEMA_TX)
        got = {x["row"]: (x["status"], x["available_before"], x["remaining_after"])
               for x in inv.admit_sales(rq, cur, inc).collect()}
        assert got == naive_admission(reqs, current, incoming)


def test_end_of_day_single_date_and_gap(spark):
    prev = spark.createDataFrame([(D0, "C", "A", 750, 10), (D0, "C", "B", 750, 3)], SCHEMA_TX)
    inc = spark.createDataFrame([(D0 + dt.timedelta(days=1), "C", "A", 750, 5)], SCHEMA_TX)
    sal = spark.createDataFrame([(D0 + dt.timedelta(days=1), "C", "B", 750, 4),
                                 (D0 + dt.timedelta(days=3), "C", "A", 750, 1)], SCHEMA_TX)
    out, viol = inv.end_of_day(prev, inc, sal, D0 + dt.timedelta(days=1))
    got = {x["Brand"]: (x["Opening_Qty"], x["Closing_Qty"]) for x in out.collect()}
    assert got == {"A": (10, 15), "B": (3, -1)}
    assert [x["Brand"] for x in viol.collect()] == ["B"]
    # carry='last' reads the latest earlier snapshot, so a skipped day does not reset stock
    out2, _ = inv.end_of_day(prev, inc, sal, D0 + dt.timedelta(days=3), carry="last")
    assert {x["Brand"]: x["Closing_Qty"] for x in out2.collect()} == {"A": 9, "B": 3}
    out3, _ = inv.end_of_day(prev, inc, sal, D0 + dt.timedelta(days=3))
    assert {x["Brand"]: x["Closing_Qty"] for x in out3.collect()} == {"A": -1}


def test_sales_file_all_or_nothing(spark):
    inv_t = spark.createDataFrame([(D0, "C", "A", 750, 10)], SCHEMA_TX)
    ok = spark.createDataFrame([(D0, "C", "A", 750, 4), (D0, "C", "A", 750, 3)], SCHEMA_TX)
    new, problems = inv.apply_sales_file(inv_t, ok)
    assert problems.isEmpty() and new.first()["Qty"] == 3
    bad = spark.createDataFrame([(D0, "C", "A", 750, 4), (D0, "C", "Z", 750, 1)], SCHEMA_TX)
    new, problems = inv.apply_sales_file(inv_t, bad)
    assert new is None and [x["Status"] for x in problems.collect()] == ["not_found"]


def test_once_per_date_guard(spark):
    req = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "process_date string")
    log = spark.createDataFrame([("d1", "completed"), ("d2", "failed")], "process_date string, status string")
    assert sorted(x[0] for x in inv.once_per_date(req, log).collect()) == ["d2", "d3"]
    assert sorted(x[0] for x in inv.once_per_date(req, log, retry_failed=False).collect()) == ["d3"]


def naive_reject(init, inc, sal):
    stock = defaultdict(int)
    for *p, q in init:
        stock[tuple(p)] += q
    days = sorted({d for d, *_ in inc} | {d for d, *_ in sal})
    for d in days:
        ch = defaultdict(int)
        for dd, *p, q in inc:
            if dd == d:
                ch[tuple(p)] += q
        for dd, *p, q in sal:
            if dd == d:
                ch[tuple(p)] -= q
        for p, c in ch.items():
            if stock[p] + c >= 0:
                stock[p] += c
    return {p: q for p, q in stock.items()}


def test_net_change_reject_equals_loop(spark):
    rng = random.Random(5)
    for _ in range(6):
        init, inc, sal = random_case(rng)
        init = list({tuple(x[:3]): x for x in init}.values())
        bal, rejected = inv.net_change_days(spark.createDataFrame(init, SCHEMA_INIT),
                                            spark.createDataFrame(inc, SCHEMA_TX),
                                            spark.createDataFrame(sal, SCHEMA_TX), on_negative="reject")
        final = inv.final_balances(spark.createDataFrame(init, SCHEMA_INIT), bal, PRODUCT)
        got = {tuple(x[k] for k in PRODUCT): x["Qty"] for x in final.collect()}
        want = naive_reject(init, inc, sal)
        assert {p: q for p, q in got.items() if q or p in want} == {p: q for p, q in want.items() if q or p in got}
        assert all(x["Closing_Qty"] >= 0 for x in bal.collect())


def test_reject_folds_many_days_as_a_stream(spark):
    rng = random.Random(3)
    dates = [D0 + dt.timedelta(days=i) for i in range(3000)]
    brands = ["A", "B", None]
    inc = [(d, "C", b, 1, rng.randint(0, 6)) for d in [None, *dates] for b in brands]
    sal = [(d, "C", b, 1, rng.randint(0, 9)) for d in dates for b in brands if rng.random() < 0.8]
    init = [("C", "A", 1, 20), ("C", None, 1, 7), ("C", "still", 1, 5)]
    change = defaultdict(int)
    for sign, rows in ((1, inc), (-1, sal)):
        for d, _, b, _, q in rows:
            change[b, d] += sign * q
    stock, want = {"A": 20, None: 7}, {}
    for (b, d), c in sorted(change.items(), key=lambda x: (x[0][1] is not None, x[0][1] or D0)):
        old = stock.get(b, 0)
        ok = c >= 0 or old + c >= 0
        stock[b] = old + c if ok else old
        want[b, d] = (c, ok, old, stock[b])
    got, refused = inv.net_change_days(spark.createDataFrame(init, SCHEMA_INIT), spark.createDataFrame(inc, SCHEMA_TX),
                                       spark.createDataFrame(sal, SCHEMA_TX), on_negative="reject")
    rows = got.collect()
    assert len(rows) == len(want)
    assert {(x["Brand"], x["Date"]): (x["Change"], x["accepted"], x["Opening_Qty"], x["Closing_Qty"]) for x in rows} == want
    assert refused.count() == sum(not x[1] for x in want.values())
    # an array of days that grows by copies takes time with the square of their number
    assert "concat(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_multi_day_run_spreads_its_days_and_keeps_null_rules(spark):
    d = [D0 + dt.timedelta(days=i) for i in range(4)]
    init = [("C", "I", 1, 9)]
    inc = [(d[1], "C", None, 1, 5), (None, "C", "A", 1, 4), (d[2], "C", "A", 1, 2), (d[2], "C", "A", 1, 2), (d[2], "C", "A", 1, 3)]
    sal = [(d[2], "C", None, 1, 3), (d[1], "C", "A", 1, 1), (None, "C", "A", 1, 1), (None, "C", "I", 1, 2), (d[2], "C", "A", 1, 2),
           (d[2], "C", "A", 1, 2), (d[3], "C", "A", 1, None), (d[3], "C", "I", 1, 0), (d[3], "C", "no", 1, 1)]
    r = inv.multi_day_inventory(spark.createDataFrame(init, SCHEMA_INIT), spark.createDataFrame(inc, SCHEMA_TX),
                                spark.createDataFrame(sal, SCHEMA_TX))
    got = {(x["Brand"], x["Date"]): tuple(x)[4:] for x in r["balances"].collect()}
    assert got == {(None, d[1]): (0, 5, 0, 5), ("A", None): (0, 4, 0, 4), ("A", d[2]): (4, 5, 2, 7), ("A", d[3]): (7, 0, 0, 7),
                   ("I", None): (9, 0, 2, 7), ("I", d[3]): (7, 0, 0, 7)}
    assert {(x["Brand"], x["Date"]) for x in r["ignored_sales"].collect()} == {(None, d[2]), ("A", d[1]), ("no", d[3])}
    # merged by their bytes, all days would be held by one task
    assert r["balances"].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
