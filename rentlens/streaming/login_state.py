"""Per-key login state machines (T2 token bucket, T3 lockout) in two forms:

* batch twin — a key's events are cut where the state is known without looking back (a full bucket, a
  success after any lock has ended), so a key with a third of all events runs as many pieces; pieces are
  sorted by time and id, and ``mapInPandas`` walks the Arrow batches carrying the current piece's state.
* streaming — ``applyInPandasWithState`` over groups of users. Rows wait in the state until the watermark has passed
  them and are then applied in order of (time, id), so batches may overlap in time by the watermark's delay.
  Rows later than that get no verdict; ``reconcile`` finds the events without a verdict and computes
  their users anew with the batch twin.

Both forms share the step functions below. Event time comes from the row, not the wall clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens import constants as C
from rentlens.session import ship_package

# ------------------------------------------------------------- step functions ---


def bucket_step(state: tuple[float, int] | None, t: int, capacity: float, rate: float, cost: float):
    """One request at time ``t`` (integer microseconds, so elapsed time is exact).
    State (tokens, last_t); a new key starts full. The clock never runs back: a request from before
    ``last_t`` counts as made then.
    Returns (new_state, allowed, retry_after_s, tokens_after)."""
    tokens, last = (capacity, t) if state is None else state
    t = max(t, last)
    tokens = min(capacity, tokens + (t - last) / 1e6 * rate)
    if tokens >= cost:
        tokens -= cost
        return (tokens, t), True, 0.0, tokens
    return (tokens, t), False, (cost - tokens) / rate, tokens


def lockout_step(state: tuple[int, int | None] | None, t: int, success: bool,
                 max_attempts: int, lock_s: float):
    """One login attempt at ``t`` (integer microseconds). State (failures,
    locked_until in microseconds). While locked the attempt is denied and not
    counted; a failure that reaches ``max_attempts`` locks for ``lock_s``; success
    resets. The counter is not cleared when a lock expires, so the next failure
    locks again. Returns (new_state, outcome, failures, locked_until)."""
    failures, locked = (0, None) if state is None else state
    if locked is not None and t < locked:
        return (failures, locked), "locked", failures, locked
    if success:
        return (0, None), "ok", 0, None
    failures += 1
    if failures >= max_attempts:
        locked = t + int(round(lock_s * 1_000_000))
        return (failures, locked), "fail_locked", failures, locked
    return (failures, locked), "fail", failures, locked


# ------------------------------------------------------------------ schemas ---

THROTTLE_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("allowed", T.BooleanType()),
    T.StructField("retry_after_s", T.DoubleType()), T.StructField("tokens", T.DoubleType()),
])
LOCKOUT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("success", T.BooleanType()),
    T.StructField("outcome", T.StringType()), T.StructField("failures", T.IntegerType()),
    T.StructField("locked_until_s", T.DoubleType()),
])


def login_attempts(events: DataFrame, failure: str = "error", success: str = "signup") -> DataFrame:
    """Login attempts from the event log: ``failure`` events are failed attempts,
    ``success`` events successful ones."""
    return (events.filter(F.col("event_type").isin(failure, success))
            .select("event_id", "user_id", "ts", (F.col("event_type") == success).alias("success")))


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def _secs_or_none(us):
    return None if us is None else us / 1e6


#: Seconds of a key's events that one window looks at.
SPAN_S = 86_400


def _pieces(df: DataFrame, key: str, resets) -> DataFrame:
    """``df`` sorted within partitions by (key, piece, ts, event_id). A piece begins at a key's first event and at
    each event for which ``resets(seconds since the key's previous event)`` holds. Windows only span
    (key, ``SPAN_S`` seconds); one row per span says what its first event follows and which beginning comes before it."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    d = df.withColumns({"_t": t, "_span": F.floor(t / F.lit(SPAN_S * 1_000_000))})
    own = Window.partitionBy(key, "_span").orderBy("_t", "event_id")
    at = F.struct("_t", "event_id")
    d = d.withColumn("_lag", F.lag("_t").over(own))
    d = d.withColumn("_at", F.when(F.col("_lag").isNotNull() & resets((F.col("_t") - F.col("_lag")) / 1e6), at))
    # of each span: its first event with all its columns, its last time, its last beginning but for the first event's
    others = [c for c in df.columns if c not in (key, "event_id")]
    spans = d.groupBy(key, "_span").agg(F.min(F.struct("_t", "event_id", *others)).alias("_f"), F.max("_t").alias("_last"), F.max("_at").alias("_b"))
    earlier = Window.partitionBy(key).orderBy("_span")
    spans = spans.select(key, "_span", "_f.*", "_b", F.lag("_last").over(earlier).alias("_before"))
    spans = spans.withColumn("_first", F.when(F.col("_before").isNull() | resets((F.col("_t") - F.col("_before")) / 1e6), at))
    spans = spans.select(F.col(key).alias("_k"), F.col("_span").alias("_s"), "_first", F.max(F.coalesce("_b", "_first")).over(
        earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_since"))
    d = d.join(spans, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_span") == F.col("_s")), "left")
    d = d.withColumn("_at", F.coalesce("_at", F.when(F.col("_lag").isNull(), F.col("_first"))))
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_piece", F.coalesce(F.max("_at").over(upto), F.col("_since"))["event_id"])
    return d.select(*df.columns, "_piece", "_t").repartition(key, "_piece").sortWithinPartitions(key, "_piece", "_t", "event_id")


# ------------------------------------------------------------- batch twins ---

def throttle(events: DataFrame, capacity: float = C.BUCKET_CAPACITY, rate: float = C.BUCKET_RATE,
             cost: float = C.BUCKET_COST, key: str = "user_id") -> DataFrame:
    """T2 batch twin: allow/deny and retry-after for every event, per key, in time order. After
    ``capacity / rate`` seconds without events the bucket is full, as for a new key."""
    ship_package(events.sparkSession)
    src = _pieces(events.select("event_id", key, "ts"), key, lambda gap: gap >= capacity / rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, state = None, None
        for b in batches:
            allowed, retry, tokens = [], [], []
            for k, t in zip(zip(b[key].to_numpy(), b["_piece"].to_numpy()), b["_t"].to_numpy()):
                if k != cur:
                    cur, state = k, None
                state, ok, r, tok = bucket_step(state, int(t), capacity, rate, cost)
                allowed.append(ok); retry.append(r); tokens.append(tok)
            yield pd.DataFrame({"event_id": b["event_id"], "user_id": b[key], "ts": b["ts"],
                                "allowed": allowed, "retry_after_s": retry, "tokens": tokens})

    return src.mapInPandas(run, THROTTLE_SCHEMA)


def lockout(attempts: DataFrame, max_attempts: int = C.MAX_LOGIN_ATTEMPTS, lock_s: float = C.LOCK_SECONDS,
            key: str = "user_id") -> DataFrame:
    """T3 batch twin (lockout audit): outcome of every attempt, per key, in time order. A success ``lock_s`` seconds
    or more after the previous attempt meets no lock and leaves no failures, whatever came before."""
    ship_package(attempts.sparkSession)
    src = _pieces(attempts.select("event_id", key, "ts", "success"), key, lambda gap: F.col("success") & (gap >= lock_s))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, state = None, None
        for b in batches:
            outs, fails, locks = [], [], []
            for k, t, s in zip(zip(b[key].to_numpy(), b["_piece"].to_numpy()), b["_t"].to_numpy(), b["success"].to_numpy()):
                if k != cur:
                    cur, state = k, None
                state, o, f, lk = lockout_step(state, int(t), bool(s), max_attempts, lock_s)
                outs.append(o); fails.append(f); locks.append(_secs_or_none(lk))
            yield pd.DataFrame({"event_id": b["event_id"], "user_id": b[key], "ts": b["ts"],
                                "success": b["success"], "outcome": outs, "failures": fails,
                                "locked_until_s": pd.Series(locks, dtype="float64")})

    return src.mapInPandas(run, LOCKOUT_SCHEMA)


# ---------------------------------------------------------- streaming forms ---

def _stream_out_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([f if f.name != "ts" else T.StructField("ts", T.TimestampType()) for f in schema.fields])


#: Groups that the streams' users are dealt to by hash. A call for a group costs milliseconds whatever it holds, so
#: users share groups; the state of one group is its share of the users and of the rows that wait. More groups suit more
#: users. As with the number of shuffle partitions, a stream keeps the number it began with.
USER_GROUPS = 512
#: Stands for a null event id in a group's state.
NO_ID = -(1 << 63)


def _in_order(src: DataFrame, schema: T.StructType, carry_sql: list[str], apply, idle_ms, groups: int) -> DataFrame:
    """Runs ``apply(carry, micros, flag) -> (carry, output fields)`` over each user's rows (event_id, user_id, ts,
    flag) in order of (ts, event_id), each as soon as the watermark has passed it. ``carry`` is a tuple, or None
    for a user without state; ``idle_ms(carry)`` is the time from which it equals None (inf: never). ``carry_sql``:
    its fields. The state of a group holds its users' carries and the rows that wait, as arrays; null is a user in a
    group of its own."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    ship_package(src.sparkSession)
    n = len(carry_sql)
    fields = [f.name for f in schema.fields]

    def fn(key, pdfs, state):
        held = [list(c) for c in state.get] if state.exists else [[] for _ in range(n + 5)]
        carries = dict(zip(held[0], zip(*held[1:n + 1])))
        waiting = list(zip(*held[n + 1:]))
        now = state.getCurrentWatermarkMs()
        for p in pdfs:  # rows behind the watermark that Spark still lets through get no verdict either
            t = _micros(p["ts"])
            p, t = p[t > now * 1000], t[t > now * 1000]
            waiting += zip(p["user_id"].tolist(), t.tolist(), p["event_id"].tolist(), p["flag"].tolist())
        due = sorted(r for r in waiting if r[1] <= now * 1000)
        waiting = [r for r in waiting if r[1] > now * 1000]
        outs = []
        for user, t, _, flag in due:
            carry, out = apply(carries.get(user), t, flag)
            outs.append(out)
            if carry is None:
                carries.pop(user, None)
            else:
                carries[user] = carry
        wake = {user: idle_ms(c) for user, c in carries.items()}
        carries = {user: c for user, c in carries.items() if wake[user] > now}
        if carries or waiting:
            state.update((list(carries), *([list(c) for c in zip(*carries.values())] or [[]] * n),
                          *([list(c) for c in zip(*waiting)] or [[]] * 4)))
            first = min([-(-r[1] // 1000) for r in waiting] + [wake[user] for user in carries])
            if first != float("inf"):
                state.setTimeoutTimestamp(max(first, now + 1))
        elif state.exists:
            state.remove()
        if due:
            users, times, ids, _ = zip(*due)
            own = [pd.Series([None if e == NO_ID else e for e in ids], dtype="Int64" if NO_ID in ids else "int64"),
                   pd.Series([None] * len(users), dtype="object") if key[0] < 0 else pd.Series(users),
                   pd.to_datetime(pd.Series(times), unit="us")]
            own += [pd.Series(c, dtype="float64" if f.dataType == T.DoubleType() else None) for c, f in zip(zip(*outs), schema.fields[3:])]
            yield pd.DataFrame(dict(zip(fields, own)))

    user = F.col("user_id")
    group = F.when(user.isNull(), -1).otherwise(F.pmod(F.xxhash64(user), F.lit(groups)).cast("int"))
    dealt = src.select(group.alias("user_group"), F.coalesce(user, F.lit(0)).cast("long").alias("user_id"),
                       F.coalesce("event_id", F.lit(NO_ID)).alias("event_id"), "ts", "flag")
    kept = ["users array<long>", *carry_sql, "owners array<long>", "ts array<long>", "ids array<long>", "flags array<boolean>"]
    return dealt.groupBy("user_group").applyInPandasWithState(
        fn, _stream_out_schema(schema), ", ".join(kept), "append", GroupStateTimeout.EventTimeTimeout)


def throttle_stream(events: DataFrame, watermark: str, capacity: float = C.BUCKET_CAPACITY,
                    rate: float = C.BUCKET_RATE, cost: float = C.BUCKET_COST, groups: int = USER_GROUPS) -> DataFrame:
    """T2 on a stream whose rows are late by at most ``watermark``. A bucket that is full again is no state."""
    src = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
                        F.lit(True).alias("flag")).withWatermark("ts", watermark)

    def apply(carry, t, _):
        carry, ok, retry, tokens = bucket_step(carry, t, capacity, rate, cost)
        return (float(carry[0]), int(carry[1])), (ok, retry, tokens)
    return _in_order(src, THROTTLE_SCHEMA, ["tokens array<double>", "last array<long>"], apply,
                     lambda c: c[1] // 1000 + int(capacity / rate * 1000) + 1, groups)


def lockout_stream(attempts: DataFrame, watermark: str, max_attempts: int = C.MAX_LOGIN_ATTEMPTS,
                   lock_s: float = C.LOCK_SECONDS, groups: int = USER_GROUPS) -> DataFrame:
    """T3 on a stream whose rows are late by at most ``watermark``. Only a user without failures and lock has no
    state; failures are kept for ever, as they count until a success."""
    src = attempts.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
                          F.col("success").alias("flag")).withWatermark("ts", watermark)

    def apply(carry, t, success):
        carry, outcome, failures, locked = lockout_step(carry, t, success, max_attempts, lock_s)
        return (None if carry == (0, None) else carry), (success, outcome, failures, _secs_or_none(locked))
    return _in_order(src, LOCKOUT_SCHEMA, ["failures array<int>", "locked_until array<long>"], apply, lambda c: float("inf"), groups)


#: Sink rows with this id belong to a closing row.
CLOSING_ID = -1


def closing_row(events: DataFrame, watermark_s: int) -> DataFrame:
    """A row of no user so late that, landed last, the watermark passes every other row: all that wait get their
    verdicts from the stream. It waits for ever itself."""
    end = events.agg(F.max("ts").alias("ts")).where(F.col("ts").isNotNull())
    late = (F.col("ts").cast("timestamp") + F.make_interval(secs=F.lit(watermark_s + 2))).cast(events.schema["ts"].dataType)
    given = {"event_id": F.lit(CLOSING_ID), "ts": late}
    return end.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])


def late_events(events: DataFrame, sink: DataFrame) -> DataFrame:
    """Events without a verdict: they came later than the watermark allows."""
    return events.join(sink.select("event_id"), "event_id", "left_anti")


def reconcile(events: DataFrame, sink: DataFrame, twin) -> DataFrame:
    """The sink's verdicts, with those of every user who has an event without one (too late for the watermark, or
    still waiting for it when the stream has no closing row) computed anew from all events by the batch twin."""
    users = late_events(events, sink).select("user_id").distinct()
    again = twin(events.join(users, "user_id", "left_semi").select(*events.columns))
    return sink.join(users, "user_id", "left_anti").select(*sink.columns).unionByName(again)
