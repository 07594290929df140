"""Inventory operators.

The reference moves stock with day loops and per-row lookups. Here every
multi-day rule is a closed form over one table of daily movements:

* movements are aggregated per (product, date) first (partial aggregation,
  so a hot product costs one row per task and day in the shuffle);
* a window partitioned by product and ordered by date turns them into a
  running balance. Each window partition holds one product's days, bounded
  by the calendar, never by the number of sales rows;
* clamping at zero uses the reflected-walk identity
  ``B_n = S_n - min(0, min_{k<=n} S_k)`` (S = unclamped running sum from a
  non-negative start), so ``max(0, B_{n-1} + x_n)`` needs no loop either;
* "fail" policies return a violations DataFrame; the job layer checks
  ``isEmpty()`` before it writes anything.

Products are (Brand_Category, Brand, Size_ML) unless ``keys`` says otherwise.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import look_column
from .clean import merge_duplicates

PRODUCT = ["Brand_Category", "Brand", "Size_ML"]


class NegativeStockError(ValueError):
    """Raised by ``on_negative='fail'`` jobs; carries the violating rows."""

    def __init__(self, message: str, violations: DataFrame):
        super().__init__(message)
        self.violations = violations


def _qty_total(df: DataFrame, keys: list[str], value: str = "Qty", name: str = "Qty") -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name))


# ---------------------------------------------------------------------------
# joins of inventory with movements
# ---------------------------------------------------------------------------

def apply_receipts(inventory: DataFrame, incoming: DataFrame, keys: list[str] | None = None,
                   day=None, date_col: str = "Date") -> DataFrame:
    """FULL OUTER join of inventory and (one day's) receipts; a missing
    side counts 0; unknown products appear."""
    keys = keys or PRODUCT
    if day is not None:
        incoming = incoming.filter(F.col(date_col) == F.lit(day).cast("date"))
    rec = _qty_total(incoming, keys, name="_in")
    inv = _qty_total(inventory, keys, name="_old")
    out = inv.join(rec, keys, "full_outer")
    return out.select(*keys, (F.coalesce("_old", F.lit(0)) + F.coalesce("_in", F.lit(0))).alias("Qty"))


def apply_sales(inventory: DataFrame, sales: DataFrame, keys: list[str] | None = None, day=None,
                date_col: str = "Date") -> tuple[DataFrame, DataFrame, DataFrame]:
    """LEFT join of inventory and (one day's) sales, subtract.

    Returns ``(inventory_after, insufficient, ignored)``: rows where the sale
    exceeds stock, and sales of products the inventory does not know (which
    the reference silently drops)."""
    keys = keys or PRODUCT
    if day is not None:
        sales = sales.filter(F.col(date_col) == F.lit(day).cast("date"))
    sold = _qty_total(sales, keys, name="Sold_Qty")
    inv = _qty_total(inventory, keys)
    joined = inv.join(sold, keys, "left").withColumn("Sold_Qty", F.coalesce("Sold_Qty", F.lit(0)))
    insufficient = joined.filter(F.col("Sold_Qty") > F.col("Qty"))
    after = joined.select(*keys, (F.col("Qty") - F.col("Sold_Qty")).alias("Qty"))
    ignored = sold.join(inv, keys, "left_anti")
    return after, insufficient, ignored


def signed_movements(incoming: DataFrame | None, sales: DataFrame | None, keys: list[str],
                     date_col: str | None = "Date", value: str = "Qty", count_sales: bool = False) -> DataFrame:
    """Receipts +Qty and sales -Qty in one union, aggregated per
    (key, date) with the incoming and sold parts kept apart. One shuffle
    instead of two full outer joins. ``count_sales`` adds ``Sales_Rows``
    (a sale of quantity 0 still counts as a sale that day)."""
    by = keys + ([date_col] if date_col else [])
    parts = []
    if incoming is not None:
        parts.append(incoming.select(*by, F.col(value).cast("bigint").alias("_in"),
                                     F.lit(0).cast("bigint").alias("_out"), F.lit(0).alias("_is_sale")))
    if sales is not None:
        parts.append(sales.select(*by, F.lit(0).cast("bigint").alias("_in"),
                                  F.col(value).cast("bigint").alias("_out"), F.lit(1).alias("_is_sale")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    aggs = [F.coalesce(F.sum("_in"), F.lit(0)).alias("Incoming_Qty"),
            F.coalesce(F.sum("_out"), F.lit(0)).alias("Sales_Qty")]
    if count_sales:
        aggs.append(F.sum("_is_sale").cast("bigint").alias("Sales_Rows"))
    return u.groupBy(*by).agg(*aggs).withColumn("Change", F.col("Incoming_Qty") - F.col("Sales_Qty"))


def sorted_movements(incoming: DataFrame, sales: DataFrame, by: list[str], value: str = "Qty", distinct: bool = True) -> DataFrame:
    """``signed_movements``, of each side's distinct rows if ``distinct``, with ``Receipt_Rows`` and ``Sales_Rows`` (1 where a day has some, else 0).

    One sort per task finds repeats and adds the days up as a stream, where hash tables of rows, of either side's days and
    of their union would be held at once. The number of partitions is set: merged by their compressed bytes, as repeated
    names pack small, a few tasks would hold all rows."""
    u = incoming.select(*by, F.lit(0).alias("_is_sale"), value).unionByName(
        sales.select(*by, F.lit(1).alias("_is_sale"), value))
    day, row = Window.partitionBy(*by), F.struct("_is_sale", value)
    ordered = day.orderBy("_is_sale", value)
    u = _spread(u, by).select("*", F.row_number().over(ordered).alias("_nth"),
                              (~F.lag(row).over(ordered).eqNullSafe(row) if distinct else F.lit(True)).alias("_new"))

    def total(side: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_new") & (F.col("_is_sale") == side), F.col(value))).over(day).cast("bigint"), F.lit(0))

    u = u.select(*by, "_nth", total(0).alias("Incoming_Qty"), total(1).alias("Sales_Qty"),
                 (1 - F.min("_is_sale").over(day)).cast("bigint").alias("Receipt_Rows"),
                 F.max("_is_sale").over(day).cast("bigint").alias("Sales_Rows"))
    return u.where("_nth = 1").drop("_nth").withColumn("Change", F.col("Incoming_Qty") - F.col("Sales_Qty"))


def _spread(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` hashed by ``by`` into the session's number of shuffle partitions, which the adaptive plan does not merge."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def value_report(sales: DataFrame, catalogue: DataFrame, key: str = "product_id",
                 qty_col: str = "quantity_sold", price_col: str = "price") -> DataFrame:
    """INNER join of sales and catalogue with the sale value."""
    return (sales.join(catalogue, key, "inner")
            .withColumn("total_sale_value", F.col(qty_col) * F.col(price_col)))


def existing_rows(rows: DataFrame, table: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key exists in ``table`` (left semi) and rows whose key
    does not (left anti). Key equality is null-safe."""
    cond = [rows[k].eqNullSafe(table[k]) for k in keys]
    return rows.join(table.select(*keys), cond, "left_semi"), rows.join(table.select(*keys), cond, "left_anti")


# ---------------------------------------------------------------------------
# running balances
# ---------------------------------------------------------------------------

def running_balance(opening: DataFrame | None, moves: DataFrame, keys: list[str], date_col: str = "Date",
                    clamp: bool = False, start_col: str | None = None, extra: list[str] | None = None) -> DataFrame:
    """Balance per (key, date) after each day's movement.

    ``opening``: keys + ``Qty`` (start balance, 0 when absent). ``moves``:
    keys, date, ``Incoming_Qty``, ``Sales_Qty``, ``Change`` (from
    ``signed_movements``). ``start_col`` (optional boolean column of
    ``moves``) marks rows that count; rows before a key's first counted row
    are dropped. ``clamp`` floors the balance at 0 after every day.

    Output: keys, date, Opening_Qty, Incoming_Qty, Sales_Qty, Closing_Qty,
    plus ``Unclamped_Qty`` (the plain running sum, < 0 means a violation).
    """
    w = Window.partitionBy(*keys).orderBy(date_col)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = moves if start_col is None else moves.filter(F.col(start_col))
    if opening is not None:
        m = m.join(_qty_total(opening, keys, name="_b0"), keys, "left")
    else:
        m = m.withColumn("_b0", F.lit(0).cast("bigint"))
    m = m.withColumn("_b0", F.coalesce("_b0", F.lit(0).cast("bigint")))
    s = F.col("_b0") + F.sum("Change").over(upto)
    out = m.withColumn("Unclamped_Qty", s)
    if clamp:
        closing = F.col("Unclamped_Qty") - F.least(F.lit(0), F.min("Unclamped_Qty").over(upto))
    else:
        closing = F.col("Unclamped_Qty")
    out = out.withColumn("Closing_Qty", closing)
    prev = F.lag("Closing_Qty").over(w)
    out = out.withColumn("Opening_Qty", F.coalesce(prev, F.col("_b0")))
    return out.select(*keys, date_col, "Opening_Qty", "Incoming_Qty", "Sales_Qty", "Closing_Qty", "Unclamped_Qty",
                      *(extra or []))


def final_balances(opening: DataFrame | None, balances: DataFrame, keys: list[str], date_col: str = "Date",
                   value: str = "Closing_Qty") -> DataFrame:
    """Last balance per key; keys of ``opening`` without movements keep
    their opening quantity. ``max_by`` is a partial aggregation."""
    last = balances.groupBy(*keys).agg(F.max_by(value, date_col).alias("_last"),
                                       F.max(date_col).alias("Last_Date"))
    if opening is None:
        return last.select(*keys, F.col("_last").alias("Qty"), "Last_Date")
    op = _qty_total(opening, keys, name="_open")
    out = op.join(last, keys, "full_outer")
    return out.select(*keys, F.coalesce("_last", "_open").alias("Qty"), "Last_Date")


def net_change_days(inventory: DataFrame, incoming: DataFrame, sales: DataFrame, keys: list[str] | None = None,
                    on_negative: str = "clamp", date_col: str = "Date") -> tuple[DataFrame, DataFrame]:
    """I1 applied to every date in order, without a loop.

    ``reject``: a day's change that would make the stock negative is skipped
    (the stock stays); order dependent, so it runs as a fold over each
    product's days. ``clamp`` (variant a): an existing product becomes
    ``max(0, old + change)``;
    a product not yet in the inventory is inserted on the first day its net
    change is > 0 (earlier days are ignored). ``fail`` (variant b): balances
    are not floored; a product not yet present is inserted on its first
    movement day. Violations (variant b) are the rows whose balance would be
    negative.

    Returns ``(balances per product and movement day, violations)``.
    """
    keys = keys or PRODUCT
    moves = signed_movements(incoming, sales, keys, date_col, count_sales=True)
    known = _qty_total(inventory, keys, name="_known").withColumn("_in_inv", F.lit(True)).drop("_known")
    m = moves.join(known, keys, "left").withColumn("_in_inv", F.coalesce("_in_inv", F.lit(False)))
    if on_negative == "clamp":
        first_pos = F.min(F.when(F.col("Change") > 0, F.col(date_col))).over(Window.partitionBy(*keys))
        m = m.withColumn("_counts", F.col("_in_inv") | (F.col(date_col) >= first_pos))
        bal = running_balance(inventory, m, keys, date_col, clamp=True, start_col="_counts")
        return bal.drop("Unclamped_Qty"), bal.limit(0).drop("Unclamped_Qty")
    if on_negative == "fail":
        bal = running_balance(inventory, m, keys, date_col, clamp=False)
        return bal.drop("Unclamped_Qty"), bal.filter(F.col("Closing_Qty") < 0).drop("Unclamped_Qty")
    if on_negative == "reject":
        return _net_change_reject(inventory, moves, keys, date_col)

    raise ValueError("on_negative must be 'clamp', 'fail' or 'reject'")


def _net_change_reject(inventory: DataFrame, moves: DataFrame, keys: list[str], date_col: str):
    """D4 'reject' over every date: a product's opening stock and its days, in order, are folded as a stream of sorted
    rows, so a task holds one batch and the stock so far. Returns ``(balances with an accepted flag, rejected rows)``."""
    opening = _qty_total(inventory, keys, name="Change").withColumn("_opens", F.lit(True))
    rows = moves.select(*keys, date_col, F.col("Change").cast("long").alias("Change"), F.lit(False).alias("_opens")).unionByName(
        opening, allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_opens"), date_col))
    rows = _spread(rows, keys).select(*keys, date_col, "Change", "_opens", (nth == 1).alias("_first"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stock = 0
        for b in batches:
            accepted, before, after = [], [], []
            for change, opens, first in zip(*(b.column(c).to_pylist() for c in ("Change", "_opens", "_first"))):
                if first:
                    stock = 0
                ok = opens or change >= 0 or stock + change >= 0
                accepted.append(ok)
                before.append(stock)
                if ok:
                    stock += change
                after.append(stock)
            new = (pa.array(accepted, pa.bool_()), pa.array(before, pa.int64()), pa.array(after, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "accepted", "Opening_Qty", "Closing_Qty"])

    out = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType()),
                        T.StructField("Opening_Qty", T.LongType()), T.StructField("Closing_Qty", T.LongType())])
    res = rows.mapInArrow(fold, out).where("NOT _opens").drop("_opens", "_first")
    return res, res.filter(~F.col("accepted"))


def apply_net_change(inventory: DataFrame, incoming: DataFrame, sales: DataFrame, day,
                     keys: list[str] | None = None, on_negative: str = "clamp",
                     date_col: str = "Date") -> tuple[DataFrame, DataFrame]:
    """I1 for one date: ``new = old + incoming(day) - sales(day)`` on a
    product-keyed inventory. Returns ``(new inventory, violations)``."""
    keys = keys or PRODUCT
    d = F.lit(day).cast("date")
    ch = signed_movements(incoming.filter(F.col(date_col) == d), sales.filter(F.col(date_col) == d), keys, None)
    inv = _qty_total(inventory, keys, name="_old")
    j = inv.join(ch, keys, "full_outer")
    new = F.coalesce("_old", F.lit(0)) + F.coalesce("Change", F.lit(0))
    present = F.col("_old").isNotNull()
    if on_negative == "clamp":
        keep = present | (F.col("Change") > 0)
        out = j.filter(keep).select(*keys, F.when(present, F.greatest(new, F.lit(0))).otherwise(new).alias("Qty"))
        return out, out.limit(0)
    if on_negative == "fail":
        viol = j.filter(new < 0).select(*keys, F.col("_old").alias("Old_Qty"), "Change", new.alias("New_Qty"))
        return j.select(*keys, new.alias("Qty")), viol
    raise ValueError("on_negative must be 'clamp' or 'fail'")


def end_of_day(previous: DataFrame, incoming: DataFrame, sales: DataFrame, day, keys: list[str] | None = None,
               date_col: str = "Date", carry: str = "calendar") -> tuple[DataFrame, DataFrame]:
    """I2 for one target date on a date-keyed inventory:
    ``closing(d) = closing(prev) + incoming(d) - sales(d)`` over
    prev U incoming U sales keys.

    ``carry='calendar'``: prev is exactly ``d - 1`` (missing day -> opening 0,
    as the reference). ``carry='last'``: the latest earlier snapshot of each
    key (``max_by``). Returns ``(summary rows for d, violations)``.
    """
    keys = keys or PRODUCT
    d = day if isinstance(day, Column) else F.lit(day).cast("date")
    if carry == "calendar":
        prev = _qty_total(previous.filter(F.col(date_col) == F.date_sub(d, 1)), keys, name="Opening_Qty")
    elif carry == "last":
        prev = (previous.filter(F.col(date_col) < d).groupBy(*keys)
                .agg(F.max_by("Qty", date_col).cast("bigint").alias("Opening_Qty")))
    else:
        raise ValueError("carry must be 'calendar' or 'last'")
    ch = signed_movements(incoming.filter(F.col(date_col) == d), sales.filter(F.col(date_col) == d), keys, None)
    j = prev.join(ch, keys, "full_outer")
    out = j.select(*keys, d.alias(date_col), F.coalesce("Opening_Qty", F.lit(0)).alias("Opening_Qty"),
                   F.coalesce("Incoming_Qty", F.lit(0)).alias("Incoming_Qty"),
                   F.coalesce("Sales_Qty", F.lit(0)).alias("Sales_Qty"))
    out = out.withColumn("Closing_Qty", F.col("Opening_Qty") + F.col("Incoming_Qty") - F.col("Sales_Qty"))
    return out, out.filter(F.col("Closing_Qty") < 0)


def end_of_day_history(opening: DataFrame, incoming: DataFrame, sales: DataFrame, keys: list[str] | None = None,
                       date_col: str = "Date") -> DataFrame:
    """I2 run for every movement date in order (calendar carry), closed form.

    A run date that does not follow the previous run date by exactly one
    day starts a new segment: the reference reads an empty previous day and
    every product restarts at 0. Segments come from a window over distinct
    dates (one row per day). The opening snapshot counts only if it is dated
    the day before the first run date. Output: one row per product and
    movement date (Opening, Incoming, Sales, Closing)."""
    keys = keys or PRODUCT
    moves = signed_movements(incoming, sales, keys, date_col)
    days = moves.select(date_col).distinct()
    open_day = opening.select(F.max(date_col)).scalar()
    gap = F.when(F.datediff(F.col(date_col), F.lag(date_col).over(Window.orderBy(date_col))) == 1, 0).otherwise(1)
    first_has_opening = F.datediff(days.select(F.min(date_col)).scalar(), open_day) == 1
    seg = (days.withColumn("_gap", gap)
           .withColumn("_seg", F.sum("_gap").over(Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("_seg", F.when((F.col("_seg") == 1) & first_has_opening, F.lit(0)).otherwise(F.col("_seg")))
           .drop("_gap"))
    m = moves.join(seg, date_col)
    op = _qty_total(opening, keys, name="_b0").withColumn("_seg", F.lit(0).cast("bigint"))
    m = m.join(op, keys + ["_seg"], "left").withColumn("_b0", F.coalesce("_b0", F.lit(0).cast("bigint")))
    w = Window.partitionBy(*keys, "_seg").orderBy(date_col)
    closing = F.col("_b0") + F.sum("Change").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = m.withColumn("Closing_Qty", closing)
    out = out.withColumn("Opening_Qty", F.col("Closing_Qty") - F.col("Change"))
    return out.select(*keys, date_col, "Opening_Qty", "Incoming_Qty", "Sales_Qty", "Closing_Qty")


def multi_day_inventory(initial: DataFrame, incoming: DataFrame, sales: DataFrame, keys: list[str] | None = None,
                        date_col: str = "Date", dedupe: str = "exact_then_sum") -> dict[str, DataFrame]:
    """The reference's day loop in closed form.

    For each date (in order) receipts are added first - an unknown product
    becomes known, even with quantity 0 - then sales are subtracted; sales of
    products not yet known are ignored; a sale above stock fails the run.

    Closed form: ``first_seen`` = -inf for initial products, else the first
    receipt date; sales count only on dates >= first_seen; balance = running
    sum. Returns a dict of DataFrames:

    - ``balances``: per product and movement date (W7);
    - ``violations``: rows whose balance goes below 0 (non-empty = the run
      fails; the first by date is where the reference stops);
    - ``final``: final inventory with ``LookColumn`` (I3);
    - ``ignored_sales``: sales rows dropped because the product was unknown;
    - ``summary``: per date, total incoming and total sold (I4).
    """
    keys = keys or PRODUCT
    tx_keys = keys + [date_col]
    init = merge_duplicates(initial.select(*keys, "Qty"), keys, dedupe)
    inc = merge_duplicates(incoming.select(*tx_keys, "Qty"), tx_keys, dedupe)
    sal = merge_duplicates(sales.select(*tx_keys, "Qty"), tx_keys, dedupe)
    first_receipt = inc.groupBy(*keys).agg(F.min(date_col).alias("_first_in"))
    known = init.select(*keys).withColumn("_initial", F.lit(True))
    s = (sal.join(first_receipt, keys, "left").join(known, keys, "left")
         .withColumn("_counts", F.coalesce("_initial", F.lit(False))
                     | (F.col("_first_in").isNotNull() & (F.col(date_col) >= F.col("_first_in")))))
    ignored = s.filter(~F.col("_counts")).select(*tx_keys, "Qty")
    moves = _known_movements(known, incoming.select(*tx_keys, "Qty"), sales.select(*tx_keys, "Qty"), keys, date_col,
                             exact=dedupe == "exact_then_sum")
    bal = running_balance(init, moves, keys, date_col, extra=["Sales_Rows"])
    # a day fails when a sale exceeds the stock on hand after that day's receipts
    violations = bal.filter((F.col("Closing_Qty") < 0) & (F.col("Sales_Rows") > 0)).select(
        *keys, date_col, "Opening_Qty", "Incoming_Qty", "Sales_Qty",
        "Closing_Qty")
    final = final_balances(init, bal, keys, date_col).drop("Last_Date")
    if keys == PRODUCT:
        final = final.withColumn("LookColumn", look_column(*PRODUCT))
    summary = daily_summary(inc, sal, date_col)
    return {"balances": bal.drop("Unclamped_Qty", "Sales_Rows"), "violations": violations, "final": final,
            "ignored_sales": ignored, "summary": summary}


def _known_movements(known: DataFrame, incoming: DataFrame, sales: DataFrame, keys: list[str], date_col: str,
                     exact: bool) -> DataFrame:
    """Movements per (product, date) without the sales before a product is known: it is in ``known``, or had a dated
    receipt on that day or earlier, which a running count over its days tells. Null keys are never known."""
    moves = sorted_movements(incoming, sales, keys + [date_col], distinct=exact)
    moves = _spread(moves, keys).join(known, keys, "left")
    upto = Window.partitionBy(*keys).orderBy(date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    received = F.count(F.when(F.col("Receipt_Rows") > 0, F.col(date_col))).over(upto) > 0
    named = functools.reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    moves = moves.withColumn("_counts", F.coalesce("_initial", F.lit(False)) | (named & received))
    moves = moves.where((F.col("Receipt_Rows") > 0) | F.col("_counts"))
    for c in ("Sales_Qty", "Sales_Rows"):
        moves = moves.withColumn(c, F.when(F.col("_counts"), F.col(c)).otherwise(F.lit(0).cast("bigint")))
    return moves.select(*keys, date_col, "Incoming_Qty", "Sales_Qty", "Sales_Rows",
                        (F.col("Incoming_Qty") - F.col("Sales_Qty")).alias("Change"))


def daily_summary(incoming: DataFrame, sales: DataFrame, date_col: str = "Date") -> DataFrame:
    """I4: per date of either input, total incoming and total sold."""
    m = signed_movements(incoming, sales, [], date_col)
    return m.select(date_col, F.col("Incoming_Qty").alias("Total_Incoming_Qty"),
                    F.col("Sales_Qty").alias("Total_Sold_Qty"))


def snapshot(balances: DataFrame, day, keys: list[str] | None = None, date_col: str = "Date",
             opening: DataFrame | None = None) -> DataFrame:
    """The inventory as of ``day`` in the fixed snapshot shape
    (Brand_Category, Brand, Size_ML, Date, Qty, LookColumn): the latest
    balance on or before ``day`` per product (an as-of pick with ``max_by``),
    plus opening rows of products without movements by then."""
    keys = keys or PRODUCT
    d = day if isinstance(day, Column) else F.lit(day).cast("date")
    upto = balances.filter(F.col(date_col) <= d)
    qty = final_balances(opening, upto, keys, date_col).drop("Last_Date")
    out = qty.withColumn(date_col, d)
    if keys == PRODUCT:
        out = out.withColumn("LookColumn", look_column(*PRODUCT))
        return out.select(*PRODUCT, date_col, "Qty", "LookColumn")
    return out


def validity(balances: DataFrame, keys: list[str] | None = None, date_col: str = "Date", opening: DataFrame | None = None) -> DataFrame:
    """Intervals (keys, valid_from, valid_to, Qty): the stock of a product from one movement day until the next.

    ``valid_to`` is the day after the last valid one, null for the present. With ``opening`` each of its products has its
    opening stock before its first movement (``valid_from`` null)."""
    keys = keys or PRODUCT
    days = balances.select(*keys, F.col(date_col).alias("valid_from"), F.col("Closing_Qty").cast("bigint").alias("Qty"))
    if opening is not None:
        days = days.unionByName(_qty_total(opening, keys).select(*keys, F.lit(None).cast("date").alias("valid_from"), F.col("Qty").cast("bigint")))
    after = Window.partitionBy(*keys).orderBy(F.col("valid_from").asc_nulls_first())
    return days.withColumn("valid_to", F.lead("valid_from").over(after)).select(*keys, "valid_from", "valid_to", "Qty")


def stock_on_dates(balances: DataFrame, dates: DataFrame, keys: list[str] | None = None, date_col: str = "Date",
                   opening: DataFrame | None = None) -> DataFrame:
    """The stock of every product on every one of ``dates`` (a column ``date_col``), in one plan.

    A range join of the intervals of ``validity`` with the dates, made an equi-join by months: an interval takes part once
    for each month that it covers, which the calendar bounds, and a date in its own month. The months run from the first
    to the last of the dates, so intervals without end do not grow beyond them."""
    keys = keys or PRODUCT
    asked = dates.select(F.col(date_col).cast("date").alias("_day")).where("_day is not null").distinct().withColumn(
        "_month", F.trunc("_day", "month"))
    span = asked.agg(F.min("_month").alias("low"), F.max("_month").alias("high")).withColumn(
        "span", F.struct("low", "high")).select("span").scalar()
    spans = validity(balances, keys, date_col, opening).withColumn("_span", span)
    first = F.greatest(F.trunc(F.coalesce("valid_from", F.col("_span.low")), "month"), F.col("_span.low"))
    last = F.least(F.trunc(F.date_sub(F.coalesce("valid_to", F.date_add(F.last_day(F.col("_span.high")), 1)), 1), "month"), F.col("_span.high"))
    spans = spans.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    by_month = spans.withColumn("_month", F.explode(F.sequence("_first", "_last", F.expr("interval 1 month"))))
    valid = (F.col("valid_from").isNull() | (F.col("_day") >= F.col("valid_from"))) & (
        F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to")))
    out = by_month.join(asked, "_month").where(valid).select(*keys, F.col("_day").alias(date_col), "Qty")
    return out.withColumn("LookColumn", look_column(*PRODUCT)) if keys == PRODUCT else out


# ---------------------------------------------------------------------------
# date-keyed inventory operators
# ---------------------------------------------------------------------------

def daily_inventory_table(stock: DataFrame, sales: DataFrame, keys: list[str] | None = None,
                          date_col: str = "Date") -> DataFrame:
    """Per (date, product) over both inputs: opening = stock rows of that
    date, sold = sales of that date, closing = max(0, opening - sold)."""
    keys = keys or PRODUCT
    by = [date_col] + keys
    m = signed_movements(stock, sales, keys, date_col)
    return m.select(*by, F.col("Incoming_Qty").alias("Opening_Stock"), F.col("Sales_Qty").alias("Sold_Qty"),
                    F.greatest(F.col("Incoming_Qty") - F.col("Sales_Qty"), F.lit(0)).alias("Closing_Stock"))


def latest_closing(daily_inventory: DataFrame, day=None, keys: list[str] | None = None,
                   date_col: str = "Date") -> DataFrame:
    """Closing stock of one date (default: the latest) as product-keyed
    rows ready for an upsert (``sinks.tables.upsert(mode='set')``)."""
    keys = keys or PRODUCT
    pick = F.lit(day).cast("date") if day is not None else daily_inventory.select(F.max(date_col)).scalar()
    return (daily_inventory.filter(F.col(date_col) == pick)
            .select(*keys, F.col("Closing_Stock").cast("bigint").alias("Qty")))


def check_sales_file(inventory: DataFrame, sales: DataFrame, keys: list[str] | None = None,
                     date_col: str = "Date") -> DataFrame:
    """I8: classify each aggregated (date, product) sale of a file against a
    date-keyed inventory: ``not_found``, ``insufficient`` or ``ok``. The file
    may be applied only if no row is ``not_found`` / ``insufficient``."""
    keys = keys or PRODUCT
    by = keys + [date_col]
    sold = _qty_total(sales, by, name="Sale_Qty")
    inv = _qty_total(inventory, by, name="Current_Qty")
    j = sold.join(inv, by, "left")
    status = (F.when(F.col("Current_Qty").isNull(), "not_found")
              .when(F.col("Current_Qty") < F.col("Sale_Qty"), "insufficient").otherwise("ok"))
    return j.withColumn("Status", status)


def apply_sales_file(inventory: DataFrame, sales: DataFrame, keys: list[str] | None = None,
                     date_col: str = "Date") -> tuple[DataFrame | None, DataFrame]:
    """I8: all or nothing. Returns ``(new inventory or None, problems)``;
    the inventory is decremented (K2 with negative quantities) only when the
    problem list is empty."""
    keys = keys or PRODUCT
    by = keys + [date_col]
    checked = check_sales_file(inventory, sales, keys, date_col)
    problems = checked.filter(F.col("Status") != "ok")
    if not problems.isEmpty():
        return None, problems
    dec = checked.select(*by, (-F.col("Sale_Qty")).alias("Qty"))
    return increment(inventory, dec, by), problems


def increment(table: DataFrame, delta: DataFrame, keys: list[str], value: str = "Qty") -> DataFrame:
    """``Qty = old + new``, inserting absent keys; one union and a
    partial aggregation instead of a full outer join."""
    other = [c for c in table.columns if c not in keys and c != value]
    u = table.select(*keys, F.col(value).cast("bigint").alias(value)).unionByName(
        delta.select(*keys, F.col(value).cast("bigint").alias(value)))
    out = u.groupBy(*keys).agg(F.sum(value).cast("bigint").alias(value))
    if other:
        out = out.join(table.select(*keys, *other), keys, "left")
    return out


def available_for_sale(current: DataFrame, incoming: DataFrame, booked: DataFrame, keys: list[str] | None = None,
                       date_col: str = "Date") -> DataFrame:
    """Per (product, date) of receipts or booked sales:
    ``available = current(product) + incoming(date) - booked(date)``."""
    keys = keys or PRODUCT
    m = signed_movements(incoming, booked, keys, date_col)
    cur = _qty_total(current, keys, name="Current_Qty")
    j = m.join(cur, keys, "left").withColumn("Current_Qty", F.coalesce("Current_Qty", F.lit(0)))
    return j.select(*keys, date_col, "Current_Qty", "Incoming_Qty", F.col("Sales_Qty").alias("Booked_Qty"),
                    (F.col("Current_Qty") + F.col("Change")).alias("Available_Qty"))


def admit_sales(requests: DataFrame, current: DataFrame, incoming: DataFrame, booked: DataFrame | None = None,
                keys: list[str] | None = None, date_col: str = "Date", order_col: str = "row",
                qty_col: str = "Qty") -> DataFrame:
    """Greedy per-row admission in file order.

    A row is accepted when ``available - accepted so far >= qty`` (available
    as in I10); a rejected row consumes nothing; ``qty <= 0`` or an
    unparseable quantity fails only that row.

    Plan: a running sum per (product, date) accepts the whole prefix that
    fits (JVM window, sort based and spillable). After the first rejection
    the remainder is smaller than the rejected quantity, so only later rows
    with a quantity under that remainder can still be accepted; just those
    candidates are folded in order by a streaming ``mapInPandas`` over
    sorted partitions (one running number per group, no group is gathered).
    Output: every request row with ``status``, ``reason``,
    ``available_before`` and ``remaining_after``.
    """
    keys = keys or PRODUCT
    grp = keys + [date_col]
    booked = booked if booked is not None else incoming.limit(0)
    avail = available_for_sale(current, incoming, booked, keys, date_col).select(*grp, "Available_Qty")
    cur = _qty_total(current, keys, name="_cur")
    r = (requests.join(avail, grp, "left").join(cur, keys, "left")
         .withColumn("Available_Qty", F.coalesce("Available_Qty", F.coalesce("_cur", F.lit(0)))).drop("_cur"))
    valid = F.col(qty_col).isNotNull() & (F.col(qty_col) > 0)
    r = r.withColumn("_valid", valid)
    w = Window.partitionBy(*grp).orderBy(order_col)
    run = F.sum(F.when(F.col("_valid"), F.col(qty_col)).otherwise(0)).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("_cum", run)
    r = r.withColumn("_prefix", F.col("_valid") & (F.col("_cum") <= F.col("Available_Qty")))
    first_rej = F.min(F.when(F.col("_valid") & ~F.col("_prefix"), F.col(order_col))).over(Window.partitionBy(*grp))
    r = r.withColumn("_first_rej", first_rej)
    # remainder after the accepted prefix, available at the first rejection
    rem0 = F.max(F.when(F.col(order_col) == F.col("_first_rej"),
                        F.col("Available_Qty") - (F.col("_cum") - F.col(qty_col)))).over(Window.partitionBy(*grp))
    r = r.withColumn("_rem0", rem0)
    tail_candidate = (F.col("_valid") & F.col("_first_rej").isNotNull() & (F.col(order_col) > F.col("_first_rej"))
                      & (F.col(qty_col) <= F.col("_rem0")))
    # The tail is folded in order per (product, date) without gathering a
    # group: hash-partition by the group, sort inside partitions (external,
    # spills), and stream through the rows keeping one number per group.
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tail = (r.filter(tail_candidate)
            .select(*grp, F.col(order_col).cast("bigint").alias("_o"), F.col(qty_col).cast("bigint").alias("_q"),
                    F.col("_rem0").cast("bigint").alias("_rem0"))
            .repartition(n, *grp).sortWithinPartitions(*grp, "_o"))
    grp_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tail.schema.fields if f.name in grp)
    out_schema = f"{grp_schema}, _o bigint, _tail_before bigint"

    def fold(batches):
        import pandas as pd
        key, rem = None, 0
        for pdf in batches:
            keep, before = [], []
            # NULL keys arrive as NaN / None; make them compare equal
            keys = list(zip(*[pdf[c].astype(object).where(pdf[c].notna(), None) for c in grp]))
            for i, (k, q, r0) in enumerate(zip(keys, pdf["_q"].to_numpy(), pdf["_rem0"].to_numpy())):
                if k != key:
                    key, rem = k, int(r0)
                if q <= rem:
                    keep.append(i)
                    before.append(rem)
                    rem -= int(q)
            out = pdf.iloc[keep][[*grp, "_o"]].reset_index(drop=True)
            yield out.assign(_tail_before=pd.Series(before, dtype="int64"))

    accepted_tail = tail.mapInPandas(fold, out_schema)
    r = r.withColumn("_o", F.col(order_col).cast("bigint")).join(accepted_tail, [*grp, "_o"], "left")
    before = F.when(F.col("_prefix"), F.col("Available_Qty") - (F.col("_cum") - F.col(qty_col))) \
        .otherwise(F.col("_tail_before"))
    accepted = F.col("_prefix") | F.col("_tail_before").isNotNull()
    out = (r.withColumn("status", F.when(accepted, "success").otherwise("failed"))
           .withColumn("reason", F.when(~F.col("_valid"), "quantity must be greater than 0")
                       .when(~accepted, "insufficient stock"))
           .withColumn("available_before", F.when(accepted, before))
           .withColumn("remaining_after", F.when(accepted, before - F.col(qty_col))))
    return out.drop("_valid", "_cum", "_prefix", "_first_rej", "_rem0", "_o", "_tail_before")


def recompute_affected(current: DataFrame, monthly: DataFrame, incoming_all: DataFrame, file_rows: DataFrame,
                       keys: list[str] | None = None, date_col: str = "Date") -> DataFrame:
    """After appending ``file_rows`` to receipts, recompute
    ``current = monthly + incoming`` only for the (date, product) keys the
    file touches (left semi joins restrict both inputs), and upsert them
    into ``current``. Rows with Qty <= 0 or Size_ML <= 0 are not loaded."""
    keys = keys or PRODUCT
    by = keys + [date_col]
    rows = file_rows.filter((F.col("Qty") > 0) & (F.col("Size_ML") > 0))
    touched = rows.select(*by).distinct()
    receipts = incoming_all.select(*by, "Qty").unionByName(rows.select(*by, "Qty"))
    m = _qty_total(monthly.join(touched, by, "left_semi"), by, name="_m")
    i = _qty_total(receipts.join(touched, by, "left_semi"), by, name="_i")
    fresh = touched.join(m, by, "left").join(i, by, "left").select(
        *by, (F.coalesce("_m", F.lit(0)) + F.coalesce("_i", F.lit(0))).alias("Qty"))
    keep = current.select(*by, F.col("Qty").cast("bigint").alias("Qty")).join(touched, by, "left_anti")
    return keep.unionByName(fresh)


def catalogue_sales(catalogue: DataFrame, sales: DataFrame, as_of, key: str = "product_id",
                    date_col: str = "sale_date") -> dict[str, DataFrame]:
    """Apply one day's sales to catalogue stock (clipped at 0) and
    report sale values, revenue and low stock."""
    d = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    today = sales.filter(F.col(date_col) == d)
    sold = today.groupBy(key).agg(F.sum("quantity_sold").alias("_sold"))
    updated = (catalogue.join(sold, key, "left")
               .withColumn("stock_quantity",
                           F.greatest(F.col("stock_quantity") - F.coalesce("_sold", F.lit(0)), F.lit(0)))
               .drop("_sold"))
    report = value_report(today, catalogue, key).select(key, "product_name", "quantity_sold", "total_sale_value")
    revenue = report.agg(F.coalesce(F.sum("total_sale_value"), F.lit(0)).alias("total_revenue"))
    low = updated.filter(F.col("stock_quantity") <= F.col("reorder_level"))
    return {"inventory": updated, "report": report, "revenue": revenue, "low_stock": low}


def once_per_date(requested: DataFrame, log: DataFrame, date_col: str = "process_date",
                  retry_failed: bool = True) -> DataFrame:
    """Dates that may be processed: not in the log, or (by default)
    logged as ``failed`` (the reference kept failed dates blocked)."""
    blocking = log.filter(F.col("status") != "failed") if retry_failed else log
    return requested.join(blocking.select(date_col), date_col, "left_anti")
