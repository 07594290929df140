"""Real-time stock levels with rejects.

Two append-only sources (receipts and sales; R2: the file source only ever
sees inserts) are unioned with a kind tag and grouped by the stock key.
``applyInPandasWithState`` keeps one running quantity per key: a receipt
adds, a sale subtracts unless it would make the stock negative, in which
case it is rejected (and reported). Events with quantity <= 0 are skipped.
The order is defined as (event time, receipts before sales, event id); the reference ran
two unsynchronised threads and had no order at all. It holds inside a micro-batch, or, with a
``delay``, across micro-batches: ``ordered_inventory`` (``transformWithStateInPandas``)
keeps events in a list state until the watermark has passed them.

State lives in the checkpoint folder (shared storage on a cluster), so a
lost executor or a restarted query resumes from the last committed batch.
Each micro-batch holds a bounded slice of the input (``maxBytesPerTrigger``),
which bounds what one key's group holds in a task. Every micro-batch writes its own epoch folder and overwrites it when it
is replayed, so output and state stay in step across crashes.

``replay`` is the batch twin used to check the stream: it hash-partitions by
key, sorts inside partitions and folds with ``mapInPandas`` keeping only a
per-key running value, so no key's events are ever gathered into one
in-memory group.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path

OUT_SCHEMA = ("key long, event_id long, ts timestamp, kind string, qty long, accepted boolean, "
              "stock_before long, stock_after long")
STATE_SCHEMA = "qty long"
KIND_ORDER = {"receipt": 0, "sale": 1}


def movement_events(receipts: DataFrame, sales: DataFrame, key: str | list[str], qty: str, ts: str = "ts",
                    event_id: str = "event_id") -> DataFrame:
    """One event frame (batch or streaming) from the two sources. ``key`` is
    one column of any type, or several (Date, category, brand, size), whose
    struct is then the key."""
    def shape(df, kind):
        own = F.col(key) if isinstance(key, str) else F.struct(*key)
        return df.select(own.alias("key"), F.col(event_id).cast("long").alias("event_id"),
                         F.col(ts).cast("timestamp").alias("ts"), F.lit(kind).alias("kind"),
                         F.col(qty).cast("long").alias("qty"))
    return shape(receipts, "receipt").unionByName(shape(sales, "sale"))


def _apply(events: pd.DataFrame, stock: int) -> tuple[pd.DataFrame, int]:
    """Apply ordered events to one key's stock; returns output rows and the
    new stock. Only this small per-event step runs in Python."""
    events = events[events["qty"] > 0]
    order = events.assign(_order=events["kind"].map(KIND_ORDER)).sort_values(["ts", "_order", "event_id"])
    accepted, before, after = [], [], []
    for kind, q in zip(order["kind"].to_numpy(), order["qty"].to_numpy()):
        before.append(stock)
        if kind == "receipt":
            stock += int(q)
            accepted.append(True)
        elif stock >= q:
            stock -= int(q)
            accepted.append(True)
        else:
            accepted.append(False)
        after.append(stock)
    out = order.drop(columns="_order").assign(accepted=accepted, stock_before=before, stock_after=after)
    return out, stock


def _state_fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    stock = int(state.get[0]) if state.exists else 0
    batch = pd.concat(list(pdfs), ignore_index=True)
    out, stock = _apply(batch, stock)
    state.update((stock,))
    yield out[[*[c for c in out if c.startswith("_k")], "event_id", "ts", "kind", "qty", "accepted", "stock_before",
               "stock_after"]]


ORDERED_SCHEMA = OUT_SCHEMA + ", reason string"
PENDING = "us long, place int, event_id long, kind string, qty long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedStock(StatefulProcessor):
    """One key's stock, moved in event-time order whatever order events arrive in.

    Events wait in a list state until the watermark has passed them; an event-time timer then releases
    all that are due, in order. What waits is bounded by the watermark's delay. An event that
    arrives after the watermark has passed it is a reject with a reason and leaves the stock alone."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)
        self.stock = handle.getValueState("stock", STATE_SCHEMA)

    def _rows(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        columns = ["event_id", "us", "kind", "qty", "accepted", "stock_before", "stock_after", "reason"]
        if rows:
            out = pd.DataFrame(rows, columns=columns)
            out.insert(1, "ts", pd.to_datetime(out.pop("us"), unit="us"))
            for i, (name, value) in enumerate(zip(self.names, key)):
                out.insert(i, name, [value] * len(out))
            yield out

    def _quantity(self) -> int:
        return int(self.stock.get()[0]) if self.stock.exists() else 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        late, first = [], None
        for pdf in rows:
            new = list(zip(pdf["us"].tolist(), pdf["place"].tolist(), pdf["event_id"].tolist(), pdf["kind"].tolist(), pdf["qty"].tolist()))
            waiting = [x for x in new if x[0] > passed and x[4] > 0]
            if waiting:
                self.pending.appendList(waiting)
                first = min(w[0] for w in waiting) if first is None else min(first, min(w[0] for w in waiting))
            late += [x for x in new if x[0] <= passed and x[4] > 0]
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        if late:
            stock = self._quantity()
            yield from self._rows(key, [(i, us, kind, q, False, stock, stock, "late") for us, _, i, kind, q in sorted(late)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(x) for x in self.pending.get()]
        due = sorted(x for x in waiting if x[0] <= passed)
        if not due:
            return
        rest = [x for x in waiting if x[0] > passed]
        if rest:
            self.pending.put(rest)
            self.handle.registerTimer(-(-min(rest)[0] // 1000))
        else:
            self.pending.clear()
        stock, out = self._quantity(), []
        for us, _, event_id, kind, q in due:
            after = stock + q if kind == "receipt" else stock - q
            good = after >= 0
            out.append((event_id, us, kind, q, good, stock, after if good else stock, None if good else "insufficient stock"))
            stock = out[-1][6]
        self.stock.update((stock,))
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


TICK = "tick"  # an event that moves the watermark and nothing else


def ordered_inventory(events: DataFrame, delay: str) -> DataFrame:
    """R1 in event-time order across micro-batches: the stock per key with rejects and their reasons.

    ``delay`` is how long after the latest event an earlier one may still come. The outcomes are those of ``replay``
    on all events but the late ones. Rows of kind ``tick`` (with a null key) only move the watermark on."""
    marked = events.withWatermark("ts", delay)
    spread, types = _key_columns(marked)
    # Keys travel as text: pandas would turn a batch's whole numbers into fractions where one of them is null.
    schema = ORDERED_SCHEMA.replace("key long", ", ".join(f"{n} string" for n in types), 1)
    place = F.when(F.col("kind") == "receipt", KIND_ORDER["receipt"]).otherwise(KIND_ORDER["sale"])
    timed = spread.withColumn("us", F.unix_micros("ts")).withColumn("place", place).withColumn(
        "qty", F.when(F.col("kind") == TICK, 0).otherwise(F.col("qty")))
    # Spark would drop late rows before the processor sees them. The time it looks at is empty, which is never late;
    # the watermark is taken from the true one above, and the processor compares that itself.
    timed = timed.withColumn("ts", F.lit(None).cast("timestamp").alias("ts", metadata=marked.schema["ts"].metadata))
    texts = timed.withColumns({n: F.col(n).cast("string") for n in types})
    out = texts.groupBy(*types).transformWithStateInPandas(OrderedStock([*types]), schema, "append", "eventTime")
    return _with_key(out.withColumns({n: F.col(n).cast(t) for n, t in types.items()}), events, types)


def _with_key(out: DataFrame, events: DataFrame, types: dict[str, str]) -> DataFrame:
    kind = events.schema["key"].dataType
    names = [f.name for f in kind.fields] if hasattr(kind, "fields") else None
    key = F.struct(*[F.col(n).alias(o) for n, o in zip(types, names)]) if names else F.col("_k0")
    return out.select(key.alias("key"), *[c for c in out.columns if c not in types])


def _key_columns(events: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The key spread over plain columns ``_k0``, ``_k1``, ...: state and
    pandas groups take plain columns of any type. Also their types."""
    kind = events.schema["key"].dataType
    parts = {f"_k{i}": F.col("key")[f.name] for i, f in enumerate(kind.fields)} if hasattr(kind, "fields") else {
        "_k0": F.col("key")}
    spread = events.select(*[c.alias(n) for n, c in parts.items()], "event_id", "ts", "kind", "qty")
    return spread, {n: spread.schema[n].dataType.simpleString() for n in parts}


def realtime_inventory(events: DataFrame) -> DataFrame:
    """Per-key running stock with rejects (streaming or batch input)."""
    spread, types = _key_columns(events)
    schema = OUT_SCHEMA.replace("key long", ", ".join(f"{n} {t}" for n, t in types.items()), 1)
    out = spread.groupBy(*types).applyInPandasWithState(
        _state_fn, schema, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    return _with_key(out, events, types)


def replay(events: DataFrame, partitions: int | None = None, skip_non_positive: bool = True) -> DataFrame:
    """Batch replay of R1 in the same order, without holding any key's
    events in memory (sort inside hash partitions + streaming fold).
    Events with quantity <= 0 are skipped unless ``skip_non_positive`` is
    False (a zero receipt then passes through unchanged)."""
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # any key type works: the fold only hashes and compares keys
    schema = OUT_SCHEMA.replace("key long", f"key {events.schema['key'].dataType.simpleString()}", 1)
    kind_order = F.when(F.col("kind") == "receipt", 0).otherwise(1)
    kept = events.filter(F.col("qty") > 0) if skip_non_positive else events
    ordered = (kept.repartition(n, "key")
               .sortWithinPartitions("key", "ts", kind_order, "event_id"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, s, started = None, 0, False  # rows come key by key: one running value is enough
        for pdf in batches:
            acc, before, after = [], [], []
            for k, kind, q in zip(pdf["key"].to_numpy(), pdf["kind"].to_numpy(), pdf["qty"].to_numpy()):
                if not started or k != key:
                    key, s, started = k, 0, True
                before.append(s)
                if kind == "receipt":
                    s += int(q)
                    acc.append(True)
                elif s >= q:
                    s -= int(q)
                    acc.append(True)
                else:
                    acc.append(False)
                after.append(s)
            yield pdf.assign(accepted=acc, stock_before=before, stock_after=after)

    return ordered.mapInPandas(fold, schema)


def latest_per_key(batch: DataFrame) -> DataFrame:
    """The last stock value per key within one micro-batch."""
    kind_order = F.when(F.col("kind") == "receipt", 0).otherwise(1)
    return batch.groupBy("key").agg(
        F.max_by("stock_after", F.struct("ts", kind_order, "event_id")).alias("Qty"))


def _epochs(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Every event outcome that the job at ``path`` has written."""
    return _epochs(spark, path, "stock_events").drop("query", "epoch")


def read_stock(spark: SparkSession, path: str) -> DataFrame:
    """The current stock, the latest epoch's value of each key."""
    return _epochs(spark, path, "stock_changes").groupBy("key").agg(F.max_by("Qty", "epoch").alias("Qty"))


def write_epoch(batch: DataFrame, epoch: int, path: str, query: str) -> None:
    """Write one micro-batch: its event outcomes and the last stock of the
    keys it touched, each in a folder of its own epoch.

    The folder is overwritten, so a batch that is replayed after a crash
    writes the same rows again and nothing twice. Only changed keys are
    written, not the whole stock."""
    at = f"query={query}/epoch={epoch}"
    batch.write.mode("overwrite").parquet(f"{path}/stock_events/{at}")
    written = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/stock_events/{at}")
    latest_per_key(written).write.mode("overwrite").parquet(f"{path}/stock_changes/{at}")


def start(spark: SparkSession, receipts_path: str, sales_path: str, schema: str, key: str | list[str], qty: str,
          path: str, checkpoint: str, available_now: bool = True, max_bytes_per_trigger: int = 1 << 30,
          receipts_filter=None, sales_filter=None, prepare=None, delay: str | None = None, ticks_path: str | None = None,
          max_files_per_trigger: int | None = None):
    """Start the job: parquet file sources (a file or a folder of part files)
    -> state -> event outcomes and stock changes under ``path`` (R3).

    ``checkpoint`` belongs to ``path``: a restart with both goes on where the
    job stopped. Output is kept under the query id that the checkpoint holds,
    so another checkpoint can never overwrite its epochs.

    With ``delay`` events are applied in event-time order across micro-batches (``ordered_inventory``) and wait for
    the watermark. ``ticks_path`` is a folder of files with a ``ts`` column that move it on when no event does, so that a job
    can be run to its end."""
    def src(at, flt):
        s = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_trigger)
        if max_files_per_trigger:
            s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
        s = s.parquet(at)
        s = s.filter(flt) if flt is not None else s
        return prepare(s) if prepare is not None else s

    events = movement_events(src(receipts_path, receipts_filter), src(sales_path, sales_filter), key, qty)
    if delay is not None:
        if ticks_path:
            ticks = spark.readStream.schema("ts timestamp").parquet(ticks_path)
            no_key = F.lit(None).cast(events.schema["key"].dataType)
            events = events.unionByName(ticks.select("ts", F.lit(TICK).alias("kind"), no_key.alias("key"), F.lit(0).cast("long").alias("event_id"),
                                                     F.lit(0).cast("long").alias("qty")))
        out = ordered_inventory(events, delay)
    else:
        out = realtime_inventory(events)

    def sink(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_epoch(batch, epoch, path, query)

    w = out.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    if delay is None:
        return w.start()
    # list states and timers need this store; a query keeps the setting that it was started with
    name, spark_conf = "spark.sql.streaming.stateStore.providerClass", spark.conf
    before = spark_conf.get(name, None)
    spark_conf.set(name, ROCKSDB)
    try:
        return w.start()
    finally:
        spark_conf.set(name, before) if before else spark_conf.unset(name)


EVENTS_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def run_on_events(spark: SparkSession, sf_dir: str, delay: str | None = None) -> DataFrame:
    """Run the streaming job to completion over the ``events`` table
    (signups are receipts, purchases are sales, quantity = floor(value),
    key = user_id) and return every event outcome it wrote. With ``delay`` a last tick, a day
    and the delay after the latest event, releases all events that still wait."""
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    # a pattern, as the source takes a single file or a folder of part files by pattern only
    events = f"{sf_dir.rstrip('/')}/events.parque[t]"
    ticks = None
    if delay is not None:
        ticks = f"{base}/ticks"
        last = spark.read.schema(EVENTS_SCHEMA).parquet(events).agg(F.max("ts").alias("ts"))
        last.select((F.coalesce("ts", F.lit(dt.datetime(1970, 1, 2))) + F.expr(f"interval 1 day + interval {delay}")).alias("ts")).write.parquet(ticks)
    q = start(spark, events, events, EVENTS_SCHEMA, "user_id", "q", f"{base}/out", f"{base}/checkpoint",
              receipts_filter=F.col("event_type") == "signup", sales_filter=F.col("event_type") == "purchase",
              prepare=_events_with_qty, delay=delay, ticks_path=ticks)
    q.awaitTermination()
    return read_events(spark, f"{base}/out")


def _events_with_qty(df: DataFrame) -> DataFrame:
    return df.withColumn("q", F.floor("value").cast("long"))
