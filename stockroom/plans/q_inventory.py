"""Registered inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inventory as inv
from ..sinks.tables import upsert
from .registry import D, M, register, with_ctes

PRODUCT = ["Brand_Category", "Brand", "Size_ML"]
P = "Brand_Category, Brand, Size_ML"
# Fixed parameter: receipts before this date count as already loaded.
FILE_SPLIT = "1999-01-01"


def JP(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in PRODUCT)


def QP(a: str) -> str:
    return ", ".join(f"{a}.{k}" for k in PRODUCT)


def CP(a: str, b: str) -> str:
    return ", ".join(f"COALESCE({a}.{k}, {b}.{k}) AS {k}" for k in PRODUCT)


def W(part: str = "", order: str = "Date", frame: bool = True) -> str:
    part = part or P
    rows = " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if frame else ""
    return f"OVER (PARTITION BY {part} ORDER BY {order}{rows})"


def product_inventory(d):
    return d.monthly_stock().select(*PRODUCT, F.col("Qty").cast("bigint").alias("Qty"))


# -- joins -----------------------------------------------------------------------

@register("j05_inventory_plus_receipts", with_ctes(f"""
SELECT {CP('a', 'b')}, COALESCE(a.q, 0) + COALESCE(b.q, 0) AS Qty
FROM (SELECT {P}, CAST(SUM(Qty) AS BIGINT) AS q FROM monthly_stock GROUP BY {P}) a
FULL OUTER JOIN (SELECT {P}, CAST(SUM(Qty) AS BIGINT) AS q FROM incoming_stock GROUP BY {P}) b ON {JP('a', 'b')}""",
    "monthly_stock", "incoming_stock"))
def j05(d):
    """Opening stock FULL OUTER JOIN all receipts."""
    return inv.apply_receipts(d.monthly_stock(), d.incoming_stock())


J6_SQL = f"""
j6 AS (SELECT {QP('a')}, a.q AS Qty, COALESCE(b.s, 0) AS Sold_Qty
       FROM (SELECT {P}, CAST(SUM(Qty) AS BIGINT) AS q FROM monthly_stock GROUP BY {P}) a
       LEFT JOIN (SELECT {P}, CAST(SUM(Qty) AS BIGINT) AS s FROM daily_sales GROUP BY {P}) b ON {JP('a', 'b')})"""


def _with(sql_tail: str, ctes: str, *names: str) -> str:
    base = with_ctes("SELECT 1", *names)
    return base[: base.rindex("\n")] + "," + ctes + "\n" + sql_tail


@register("j06_inventory_minus_sales", _with(f"SELECT {P}, Qty - Sold_Qty AS Qty FROM j6", J6_SQL,
                                             "monthly_stock", "daily_sales"))
def j06(d):
    """Opening stock LEFT JOIN all sales, subtracted."""
    return inv.apply_sales(d.monthly_stock(), d.daily_sales())[0]


@register("j06_insufficient_stock", _with(f"SELECT {P}, Qty, Sold_Qty FROM j6 WHERE Sold_Qty > Qty", J6_SQL,
                                          "monthly_stock", "daily_sales"))
def j06i(d):
    """Products whose sales exceed the stock."""
    return inv.apply_sales(d.monthly_stock(), d.daily_sales())[1]


@register("j06_ignored_sales", with_ctes(f"""
SELECT {P}, CAST(SUM(Qty) AS BIGINT) AS Sold_Qty FROM daily_sales s
WHERE NOT EXISTS (SELECT 1 FROM monthly_stock m WHERE {JP('m', 's')}) GROUP BY {P}""",
    "daily_sales", "monthly_stock"))
def j06g(d):
    """Sales of products the inventory does not know (reported, not
    silently dropped)."""
    return inv.apply_sales(d.monthly_stock(), d.daily_sales())[2]


@register("j07_signed_movements", with_ctes(f"SELECT {P}, Date, Incoming_Qty, Sales_Qty, Change FROM moves",
                                            "moves"))
def j07(d):
    """Receipts and sales per product and date in one signed union."""
    return inv.signed_movements(d.incoming_stock(), d.daily_sales(), PRODUCT)


@register("j08_sale_value_report", with_ctes(f"""
SELECT s.product_id, c.product_name, s.quantity_sold, s.sale_date,
       {M('s.quantity_sold * c.price')} AS total_sale_value
FROM catalogue_sales s JOIN catalogue c ON s.product_id = c.product_id""", "catalogue_sales", "catalogue"))
def j08(d):
    """Sales INNER JOIN catalogue with the sale value."""
    out = inv.value_report(d.catalogue_sales(), d.catalogue())
    return out.select("product_id", "product_name", "quantity_sold", "sale_date", "total_sale_value")


@register("j09_rows_already_present", with_ctes(f"""
SELECT Date, {P}, Qty FROM daily_sales s WHERE EXISTS (SELECT 1 FROM incoming_stock i
  WHERE i.Date IS NOT DISTINCT FROM s.Date AND i.Brand_Category IS NOT DISTINCT FROM s.Brand_Category
    AND i.Brand IS NOT DISTINCT FROM s.Brand AND i.Size_ML IS NOT DISTINCT FROM s.Size_ML)""",
    "daily_sales", "incoming_stock"))
def j09(d):
    """Sales rows whose (date, product) also has receipts (semi join)."""
    return inv.existing_rows(d.daily_sales(), d.incoming_stock(), ["Date", *PRODUCT])[0]


@register("j09_rows_not_present", with_ctes(f"""
SELECT Date, {P}, Qty FROM daily_sales s WHERE NOT EXISTS (SELECT 1 FROM incoming_stock i
  WHERE i.Date IS NOT DISTINCT FROM s.Date AND i.Brand_Category IS NOT DISTINCT FROM s.Brand_Category
    AND i.Brand IS NOT DISTINCT FROM s.Brand AND i.Size_ML IS NOT DISTINCT FROM s.Size_ML)""",
    "daily_sales", "incoming_stock"))
def j09a(d):
    """Sales rows without receipts on that (date, product) (anti join)."""
    return inv.existing_rows(d.daily_sales(), d.incoming_stock(), ["Date", *PRODUCT])[1]


# -- I1: net daily change over every date ------------------------------------------------

I1_CLAMP = f"""
i1m AS (SELECT mv.*, op.b0, op.Brand IS NOT NULL AS in_inv FROM moves mv LEFT JOIN opening op ON {JP('mv', 'op')}),
i1c AS (SELECT *, MIN(CASE WHEN Change > 0 THEN Date END) OVER (PARTITION BY {P}) AS first_pos FROM i1m),
i1f AS (SELECT *, COALESCE(b0, 0) + CAST(SUM(Change) {W()} AS BIGINT) AS s FROM i1c WHERE in_inv OR Date >= first_pos),
i1g AS (SELECT *, CAST(s - LEAST(0, MIN(s) {W()}) AS BIGINT) AS Closing_Qty FROM i1f)"""


@register("i01_net_change_clamped", _with(f"""
SELECT {P}, Date, CAST(COALESCE(LAG(Closing_Qty) OVER (PARTITION BY {P} ORDER BY Date), COALESCE(b0, 0)) AS BIGINT)
       AS Opening_Qty, Incoming_Qty, Sales_Qty, Closing_Qty FROM i1g""", I1_CLAMP, "moves", "opening"))
def i01(d):
    """I1 variant a over every date: clamp at 0; unknown products enter on
    their first positive day."""
    return inv.net_change_days(d.monthly_stock(), d.incoming_stock(), d.daily_sales(), on_negative="clamp")[0]


@register("i01_net_change_violations", with_ctes(f"""
SELECT {P}, Date, Closing_Qty - Change AS Opening_Qty, Incoming_Qty, Sales_Qty, Closing_Qty FROM (
  SELECT mv.*, CAST(COALESCE(op.b0, 0) + SUM(mv.Change) {W(QP('mv'), 'mv.Date')} AS BIGINT) AS Closing_Qty
  FROM moves mv LEFT JOIN opening op ON {JP('mv', 'op')}) t WHERE Closing_Qty < 0""", "moves", "opening"))
def i01v(d):
    """I1 variant b over every date: the (product, date) rows that would
    make stock negative (the run fails if any exist)."""
    return inv.net_change_days(d.monthly_stock(), d.incoming_stock(), d.daily_sales(), on_negative="fail")[1]


_REJECT = with_ctes("", "moves", "opening").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ev AS (SELECT m.Brand_Category, m.Brand, m.Size_ML, m.Date, m.Change, COALESCE(o.b0, 0) AS b0,
              ROW_NUMBER() OVER (PARTITION BY m.Brand_Category, m.Brand, m.Size_ML ORDER BY m.Date) AS n
       FROM moves m LEFT JOIN opening o ON {JP('m', 'o')}),
run AS (
  SELECT Brand_Category, Brand, Size_ML, Date, Change, n, Change >= 0 OR b0 + Change >= 0 AS accepted, b0 AS Opening_Qty,
         CASE WHEN Change >= 0 OR b0 + Change >= 0 THEN b0 + Change ELSE b0 END AS Closing_Qty
  FROM ev WHERE n = 1
  UNION ALL
  SELECT e.Brand_Category, e.Brand, e.Size_ML, e.Date, e.Change, e.n, e.Change >= 0 OR r.Closing_Qty + e.Change >= 0,
         r.Closing_Qty,
         CASE WHEN e.Change >= 0 OR r.Closing_Qty + e.Change >= 0 THEN r.Closing_Qty + e.Change ELSE r.Closing_Qty END
  FROM run r JOIN ev e ON {JP('r', 'e')} AND e.n = r.n + 1)
SELECT Brand_Category, Brand, Size_ML, {D('Date')} AS Date, Change, accepted, Opening_Qty, Closing_Qty FROM run"""


@register("i01_net_change_rejected", _REJECT)
def i01r(d):
    """I1 / D4 'reject' over every date: a day's change that would make the
    stock negative is skipped (order dependent; a recursive query checks it)."""
    return inv.net_change_days(d.monthly_stock(), d.incoming_stock(), d.daily_sales(), on_negative="reject")[0]


# -- I2: end of day by date ---------------------------------------------------------

I2_SQL = f"""
eod_days AS (SELECT DISTINCT Date FROM moves),
eod_s0 AS (SELECT Date, SUM(CASE WHEN DATE_DIFF('day', prev, Date) = 1 THEN 0 ELSE 1 END)
                OVER (ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s0
           FROM (SELECT Date, LAG(Date) OVER (ORDER BY Date) AS prev FROM eod_days) t),
eod_seg AS (SELECT Date, CASE WHEN s0 = 1 AND DATE_DIFF('day', (SELECT MAX(Date) FROM monthly_stock),
                                                        (SELECT MIN(Date) FROM eod_days)) = 1 THEN 0 ELSE s0 END AS seg
            FROM eod_s0),
eod AS (SELECT mv.*, s.seg, CASE WHEN s.seg = 0 THEN COALESCE(op.b0, 0) ELSE 0 END AS b0
        FROM moves mv JOIN eod_seg s ON mv.Date = s.Date LEFT JOIN opening op ON {JP('mv', 'op')})"""


@register("i02_end_of_day_history", _with(f"""
SELECT {P}, Date, Closing_Qty - Change AS Opening_Qty, Incoming_Qty, Sales_Qty, Closing_Qty FROM (
  SELECT *, CAST(b0 + SUM(Change) {W(P + ', seg')} AS BIGINT) AS Closing_Qty FROM eod) t""",
    I2_SQL, "moves", "opening", "monthly_stock"))
def i02(d):
    """I2 for every movement date (calendar carry): opening, receipts,
    sales and closing per product and date."""
    return inv.end_of_day_history(d.monthly_stock(), d.incoming_stock(), d.daily_sales())


# -- I3 / I4 / I5 / W7: the multi-day run ----------------------------------------------------

I3_SQL = f"""
i3_init AS (SELECT {P}, CAST(SUM(Qty) AS BIGINT) AS Qty FROM (SELECT DISTINCT {P}, Qty FROM monthly_stock) t
            GROUP BY {P}),
i3_inc AS (SELECT {P}, Date, CAST(SUM(Qty) AS BIGINT) AS Qty
           FROM (SELECT DISTINCT {P}, Date, Qty FROM incoming_stock) t GROUP BY {P}, Date),
i3_sal AS (SELECT {P}, Date, CAST(SUM(Qty) AS BIGINT) AS Qty
           FROM (SELECT DISTINCT {P}, Date, Qty FROM daily_sales) t GROUP BY {P}, Date),
i3_first AS (SELECT {P}, MIN(Date) AS first_in FROM i3_inc GROUP BY {P}),
i3_s AS (SELECT s.*, (i.Brand IS NOT NULL) OR (f.first_in IS NOT NULL AND s.Date >= f.first_in) AS counts
         FROM i3_sal s LEFT JOIN i3_first f ON {JP('s', 'f')} LEFT JOIN i3_init i ON {JP('s', 'i')}),
i3_moves AS (SELECT {P}, Date, CAST(SUM(i) AS BIGINT) AS Incoming_Qty, CAST(SUM(o) AS BIGINT) AS Sales_Qty,
                    CAST(SUM(i) - SUM(o) AS BIGINT) AS Change, CAST(SUM(sr) AS BIGINT) AS Sales_Rows
             FROM (SELECT {P}, Date, Qty AS i, 0 AS o, 0 AS sr FROM i3_inc
                   UNION ALL SELECT {P}, Date, 0, Qty, 1 FROM i3_s WHERE counts) u GROUP BY {P}, Date),
i3_bal AS (SELECT m.*, CAST(COALESCE(i.Qty, 0) + SUM(m.Change) {W(QP('m'), 'm.Date')} AS BIGINT) AS Closing_Qty
           FROM i3_moves m LEFT JOIN i3_init i ON {JP('m', 'i')}),
i3_last AS (SELECT {P}, MAX_BY(Closing_Qty, Date) AS q FROM i3_bal GROUP BY {P}),
i3_final AS (SELECT {P}, Qty, CONCAT('(', Brand_Category, ') - ', Brand, ' - ', CAST(Size_ML AS VARCHAR), ' ML')
                AS LookColumn
             FROM (SELECT {CP('i', 'l')}, COALESCE(l.q, i.Qty) AS Qty
                   FROM i3_init i FULL OUTER JOIN i3_last l ON {JP('i', 'l')}) t)"""
I3_NAMES = ("monthly_stock", "incoming_stock", "daily_sales")


def _run(d):
    return inv.multi_day_inventory(d.monthly_stock(), d.incoming_stock(), d.daily_sales())


@register("i03_final_inventory", _with("SELECT * FROM i3_final", I3_SQL, *I3_NAMES))
def i03(d):
    """Final inventory after every day (receipts first, then sales)."""
    return _run(d)["final"]


@register("i03_violations", _with(f"""
SELECT {P}, Date, Closing_Qty - Change AS Opening_Qty, Incoming_Qty, Sales_Qty, Closing_Qty
FROM i3_bal WHERE Closing_Qty < 0 AND Sales_Rows > 0""", I3_SQL, *I3_NAMES))
def i03v(d):
    """Days on which sales exceed the stock on hand (non-empty = the
    run fails; the earliest is where the reference stops)."""
    return _run(d)["violations"]


@register("i03_ignored_sales", _with(f"SELECT {P}, Date, Qty FROM i3_s WHERE NOT counts", I3_SQL, *I3_NAMES))
def i03i(d):
    """Sales of products not yet known on that date (ignored)."""
    return _run(d)["ignored_sales"]


@register("w07_running_inventory", _with(f"""
SELECT {P}, Date, Closing_Qty - Change AS Opening_Qty, Incoming_Qty, Sales_Qty, Closing_Qty FROM i3_bal""",
    I3_SQL, *I3_NAMES))
def w07(d):
    """Running inventory per product and movement date."""
    return _run(d)["balances"]


@register("w07_product_date_grid", _with(f"""
SELECT {P}, Date, Qty, '(' || Brand_Category || ') - ' || Brand || ' - ' || CAST(Size_ML AS VARCHAR) || ' ML' AS LookColumn FROM (
  SELECT {P}, d.Date AS Date, v.Qty AS Qty FROM (
    SELECT {P}, valid_from, Qty, LEAD(valid_from) OVER (PARTITION BY {P} ORDER BY valid_from NULLS FIRST) AS valid_to FROM (
      SELECT {P}, Date AS valid_from, CAST(Closing_Qty AS BIGINT) AS Qty FROM i3_bal
      UNION ALL SELECT {P}, CAST(NULL AS DATE), CAST(SUM(Qty) AS BIGINT) FROM monthly_stock GROUP BY {P}) x) v
  JOIN (SELECT DISTINCT LAST_DAY(Date) AS Date FROM i3_bal) d
    ON (v.valid_from IS NULL OR d.Date >= v.valid_from) AND (v.valid_to IS NULL OR d.Date < v.valid_to)) g""",
    I3_SQL, *I3_NAMES))
def w07_grid(d):
    """The stock of every product at the end of every month, by one range join of intervals with dates."""
    balances = _run(d)["balances"]
    return inv.stock_on_dates(balances, balances.select(F.last_day("Date").alias("Date")), opening=d.monthly_stock())


@register("i04_daily_summary", _with("""
SELECT Date, CAST(SUM(i) AS BIGINT) AS Total_Incoming_Qty, CAST(SUM(o) AS BIGINT) AS Total_Sold_Qty
FROM (SELECT Date, Qty AS i, 0 AS o FROM i3_inc UNION ALL SELECT Date, 0, Qty FROM i3_sal) u GROUP BY Date""",
    I3_SQL, *I3_NAMES))
def i04(d):
    """I4: per date, total received and total sold."""
    return _run(d)["summary"]


@register("i05_snapshot_latest", _with(f"""
SELECT {P}, (SELECT MAX(Date) FROM i3_bal) AS Date, Qty, LookColumn FROM i3_final""", I3_SQL, *I3_NAMES))
def i05(d):
    """The snapshot (fixed column order) as of the last movement date."""
    r = _run(d)
    bal = r["balances"]
    init = d.monthly_stock()
    return inv.snapshot(bal, bal.select(F.max("Date")).scalar(), opening=init)


# -- date-keyed inventory ------------------------------------------------------------

I6_SQL = f"""
i6 AS (SELECT Date, {P}, CAST(SUM(i) AS BIGINT) AS Opening_Stock, CAST(SUM(o) AS BIGINT) AS Sold_Qty,
              CAST(GREATEST(SUM(i) - SUM(o), 0) AS BIGINT) AS Closing_Stock
       FROM (SELECT Date, {P}, Qty AS i, 0 AS o FROM stock_dated UNION ALL SELECT Date, {P}, 0, Qty FROM daily_sales) u
       GROUP BY Date, {P})"""


def _eod_latest(d, carry):
    snaps = inv.daily_inventory_table(d.date_keyed_stock(), d.daily_sales()).select(
        "Date", *PRODUCT, F.col("Closing_Stock").alias("Qty"))
    day = d.daily_sales().select(F.max("Date")).scalar()
    return inv.end_of_day(snaps, d.incoming_stock(), d.daily_sales(), day, carry=carry)[0]


def _eod_sql(prev_filter: str, prev_value: str) -> str:
    return _with(f"""
SELECT {CP('p', 'm')}, (SELECT MAX(Date) FROM daily_sales) AS Date, COALESCE(p.o, 0) AS Opening_Qty,
       COALESCE(m.i, 0) AS Incoming_Qty, COALESCE(m.s, 0) AS Sales_Qty,
       COALESCE(p.o, 0) + COALESCE(m.i, 0) - COALESCE(m.s, 0) AS Closing_Qty
FROM (SELECT {P}, CAST({prev_value} AS BIGINT) AS o FROM i6
      WHERE {prev_filter} GROUP BY {P}) p
FULL OUTER JOIN (SELECT {P}, CAST(SUM(i) AS BIGINT) AS i, CAST(SUM(o) AS BIGINT) AS s FROM (
        SELECT {P}, Qty AS i, 0 AS o FROM incoming_stock WHERE Date = (SELECT MAX(Date) FROM daily_sales)
        UNION ALL SELECT {P}, 0, Qty FROM daily_sales WHERE Date = (SELECT MAX(Date) FROM daily_sales)) u
      GROUP BY {P}) m ON {JP('p', 'm')}""", I6_SQL, "stock_dated", "daily_sales", "incoming_stock")


@register("i02_end_of_day_latest_calendar",
          _eod_sql("Date = (SELECT MAX(Date) FROM daily_sales) - INTERVAL 1 DAY", "SUM(Closing_Stock)"))
def i02c(d):
    """I2 for one target date (the latest sales date): opening = the
    closing snapshot of the previous calendar day."""
    return _eod_latest(d, "calendar")


@register("i02_end_of_day_latest_last",
          _eod_sql("Date < (SELECT MAX(Date) FROM daily_sales)", "MAX_BY(Closing_Stock, Date)"))
def i02l(d):
    """I2 for one target date with carry='last': opening = the latest
    earlier snapshot of each product (no reset after a missing day)."""
    return _eod_latest(d, "last")


@register("i06_daily_inventory", _with("SELECT * FROM i6", I6_SQL, "stock_dated", "daily_sales"))
def i06(d):
    """Opening, sold and closing (floored at 0) per date and product."""
    return inv.daily_inventory_table(d.date_keyed_stock(), d.daily_sales())


@register("i07_push_latest_closing", _with(f"""
SELECT {CP('o', 'n')}, CASE WHEN n.Brand IS NOT NULL THEN n.Qty ELSE o.Qty END AS Qty
FROM (SELECT {P}, CAST(Qty AS BIGINT) AS Qty FROM monthly_stock) o
FULL OUTER JOIN (SELECT {P}, Closing_Stock AS Qty FROM i6 WHERE Date = (SELECT MAX(Date) FROM i6)) n
  ON {JP('o', 'n')}""", I6_SQL, "stock_dated", "daily_sales", "monthly_stock"))
def i07(d):
    """The latest date's closing stock upserted (set) into the
    product-keyed inventory."""
    latest = inv.latest_closing(inv.daily_inventory_table(d.date_keyed_stock(), d.daily_sales()))
    return upsert(product_inventory(d), latest, PRODUCT, "set", stamps=False)


@register("i08_sales_file_check", with_ctes(f"""
SELECT s.*, c.Current_Qty,
       CASE WHEN c.Current_Qty IS NULL THEN 'not_found' WHEN c.Current_Qty < s.Sale_Qty THEN 'insufficient'
            ELSE 'ok' END AS Status
FROM (SELECT {P}, Date, CAST(SUM(Qty) AS BIGINT) AS Sale_Qty FROM daily_sales GROUP BY {P}, Date) s
LEFT JOIN (SELECT {P}, Date, CAST(SUM(Qty) AS BIGINT) AS Current_Qty FROM stock_dated GROUP BY {P}, Date) c
  ON {JP('s', 'c')} AND s.Date = c.Date""", "daily_sales", "stock_dated"))
def i08(d):
    """I8: every aggregated sale of the file classified against the
    date-keyed inventory (applied only when all are 'ok')."""
    return inv.check_sales_file(d.date_keyed_stock(), d.daily_sales())


# One step of the recursion admits or refuses the n-th row of every (product, date).
@register("i09_sale_admission", with_ctes(f"""
SELECT "row", Date, {P}, Qty, Available_Qty, status, reason, available_before, remaining_after FROM (
  WITH RECURSIVE req AS (
    SELECT CAST(l_shipdate AS DATE) AS Date, p_type AS Brand_Category, p_brand AS Brand, p_size AS Size_ML, CAST(l_quantity AS INT) AS Qty,
           ROW_NUMBER() OVER (PARTITION BY l_shipdate, p_type, p_brand, p_size ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity,
                              l_extendedprice, l_discount, l_tax) AS "row"
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F'),
  asked AS (
    SELECT r.*, CAST(COALESCE(op.b0, 0) + COALESCE(i.q, 0) AS BIGINT) AS Available_Qty FROM req r
    LEFT JOIN opening op ON {JP('r', 'op')}
    LEFT JOIN (SELECT {P}, Date, SUM(Qty) AS q FROM incoming_stock GROUP BY {P}, Date) i ON {JP('r', 'i')} AND r.Date = i.Date),
  run AS (
    SELECT *, Qty > 0 AND Qty <= Available_Qty AS ok, Available_Qty AS have FROM asked WHERE "row" = 1
    UNION ALL
    SELECT a.*, a.Qty > 0 AND a.Qty <= r.have - CASE WHEN r.ok THEN r.Qty ELSE 0 END, r.have - CASE WHEN r.ok THEN r.Qty ELSE 0 END
    FROM run r JOIN asked a ON {JP('a', 'r')} AND a.Date = r.Date AND a."row" = r."row" + 1)
  SELECT *, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status,
         CASE WHEN Qty <= 0 THEN 'quantity must be greater than 0' WHEN NOT ok THEN 'insufficient stock' END AS reason,
         CASE WHEN ok THEN have END AS available_before, CASE WHEN ok THEN have - Qty END AS remaining_after FROM run) x""",
    "opening", "incoming_stock"))
def i09(d):
    """Greedy per-row admission of the sales file in row order."""
    return inv.admit_sales(d.sales_requests(), d.monthly_stock(), d.incoming_stock())


@register("i10_available_for_sale", with_ctes(f"""
SELECT mv.{P.replace(', ', ', mv.')}, mv.Date, COALESCE(op.b0, 0) AS Current_Qty, mv.Incoming_Qty,
       mv.Sales_Qty AS Booked_Qty, COALESCE(op.b0, 0) + mv.Change AS Available_Qty
FROM moves mv LEFT JOIN opening op ON {JP('mv', 'op')}""", "moves", "opening"))
def i10(d):
    """Current + receipts of the day - already booked sales."""
    return inv.available_for_sale(d.monthly_stock(), d.incoming_stock(), d.daily_sales())


@register("i11_recompute_affected", with_ctes(f"""
SELECT Date, {P}, Qty FROM (
  SELECT Date, {P}, CAST(Qty AS BIGINT) AS Qty FROM monthly_stock c
  WHERE NOT EXISTS (SELECT 1 FROM incoming_stock f WHERE f.Date >= DATE '{FILE_SPLIT}' AND f.Qty > 0 AND f.Size_ML > 0
                    AND f.Date = c.Date AND {JP('f', 'c')})
  UNION ALL
  SELECT t.Date, {QP('t')}, CAST(COALESCE(m.q, 0) + COALESCE(r.q, 0) AS BIGINT)
  FROM (SELECT DISTINCT Date, {P} FROM incoming_stock WHERE Date >= DATE '{FILE_SPLIT}' AND Qty > 0 AND Size_ML > 0) t
  LEFT JOIN (SELECT Date, {P}, SUM(Qty) AS q FROM monthly_stock GROUP BY Date, {P}) m
    ON m.Date = t.Date AND {JP('m', 't')}
  LEFT JOIN (SELECT Date, {P}, SUM(Qty) AS q FROM (
               SELECT Date, {P}, Qty FROM incoming_stock WHERE Date < DATE '{FILE_SPLIT}'
               UNION ALL SELECT Date, {P}, Qty FROM incoming_stock
               WHERE Date >= DATE '{FILE_SPLIT}' AND Qty > 0 AND Size_ML > 0) x GROUP BY Date, {P}) r
    ON r.Date = t.Date AND {JP('r', 't')}) u""", "monthly_stock", "incoming_stock"))
def i11(d):
    """Receipts from the new file appended, current stock recomputed
    (opening + receipts) for the touched (date, product) keys only."""
    inc = d.incoming_stock()
    old = inc.filter(F.col("Date") < F.lit(FILE_SPLIT).cast("date"))
    new = inc.filter(F.col("Date") >= F.lit(FILE_SPLIT).cast("date"))
    return inv.recompute_affected(d.monthly_stock(), d.monthly_stock(), old, new)


@register("i12_increment_inventory", with_ctes(f"""
SELECT Date, {P}, CAST(SUM(Qty) AS BIGINT) AS Qty FROM (
  SELECT Date, {P}, Qty FROM monthly_stock UNION ALL SELECT Date, {P}, Qty FROM incoming_stock) u
GROUP BY Date, {P}""", "monthly_stock", "incoming_stock"))
def i12(d):
    """Receipts applied to the date-keyed inventory by increment."""
    keys = ["Date", *PRODUCT]
    return inv.increment(d.monthly_stock(), d.incoming_stock(), keys)


I13_SQL = """
i13_day AS (SELECT MAX(sale_date) AS d FROM catalogue_sales),
i13_today AS (SELECT * FROM catalogue_sales WHERE sale_date = (SELECT d FROM i13_day)),
i13_sold AS (SELECT product_id, SUM(quantity_sold) AS sold FROM i13_today GROUP BY product_id),
i13_inv AS (SELECT c.product_id, c.product_name, c.category, c.price,
                   CAST(GREATEST(c.stock_quantity - COALESCE(s.sold, 0), 0) AS BIGINT) AS stock_quantity,
                   c.reorder_level
            FROM catalogue c LEFT JOIN i13_sold s ON c.product_id = s.product_id),
i13_report AS (SELECT t.product_id, c.product_name, t.quantity_sold, t.quantity_sold * c.price AS total_sale_value
               FROM i13_today t JOIN catalogue c ON t.product_id = c.product_id)"""
I13_NAMES = ("catalogue", "catalogue_sales")


def _catalogue_run(d):
    cs = d.catalogue_sales()
    return inv.catalogue_sales(d.catalogue(), cs, cs.select(F.max("sale_date")).scalar())


@register("i13_catalogue_after_sales", _with(f"""
SELECT product_id, product_name, category, {M('price')} AS price, stock_quantity, reorder_level FROM i13_inv""",
    I13_SQL, *I13_NAMES))
def i13(d):
    """The latest day's sales applied to catalogue stock, clipped at 0."""
    return _catalogue_run(d)["inventory"]


@register("i13_sale_values", _with(f"""
SELECT product_id, product_name, quantity_sold, {M('total_sale_value')} AS total_sale_value FROM i13_report""",
    I13_SQL, *I13_NAMES))
def i13v(d):
    """The day's sales with their value."""
    return _catalogue_run(d)["report"]


@register("i13_revenue", _with(f"SELECT {M('COALESCE(SUM(total_sale_value), 0)')} AS total_revenue FROM i13_report",
                               I13_SQL, *I13_NAMES))
def i13r(d):
    """The day's revenue."""
    return _catalogue_run(d)["revenue"]


@register("i13_low_stock", _with(f"""
SELECT product_id, product_name, category, {M('price')} AS price, stock_quantity, reorder_level FROM i13_inv
WHERE stock_quantity <= reorder_level""", I13_SQL, *I13_NAMES))
def i13l(d):
    """Products at or below their reorder level after the day."""
    return _catalogue_run(d)["low_stock"]
