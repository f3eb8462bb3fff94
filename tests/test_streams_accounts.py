import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from rentlens import constants as C
from rentlens.operators import accounts as AC
from rentlens.sources import predlog as PL
from rentlens.streaming import login_state as LS
from rentlens.streaming import predlog_stream as PS
from tests import pymodel as PM

T0 = dt.datetime(2024, 1, 1)


def _events(seed=1, users=4, n=300, hot_share=0.4):
    random.seed(seed)
    rows, t = [], {u: 0.0 for u in range(users)}
    for i in range(n):
        u = 0 if random.random() < hot_share else random.randrange(users)
        t[u] += random.choice([0.2, 0.5, 1.0, 3.0, 30.0, 400.0, 1000.0])
        et = random.choice(["error", "error", "error", "signup", "view"])
        rows.append((i, T0 + dt.timedelta(seconds=t[u]), u, et))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(_events(), "event_id long, ts timestamp_ntz, user_id long, event_type string")


def _by_user(rows, pred=lambda r: True):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        if pred(r):
            out.setdefault(r[2], []).append(r)
    return out


def test_token_bucket_matches_model(spark, events):
    got = {r["event_id"]: (r["allowed"], r["retry_after_s"]) for r in LS.throttle(events).collect()}
    for u, rs in _by_user(_events()).items():
        secs = [(r[1] - T0) // dt.timedelta(microseconds=1) for r in rs]
        for r, (ok, retry) in zip(rs, PM.token_bucket(secs)):
            assert got[r[0]][0] == ok
            assert got[r[0]][1] == pytest.approx(retry, abs=1e-6)
    assert any(not a for a, _ in got.values())  # the hot user gets throttled


def test_lockout_matches_model(spark, events):
    att = LS.login_attempts(events)
    got = {r["event_id"]: r["outcome"] for r in LS.lockout(att).collect()}
    for u, rs in _by_user(_events(), lambda r: r[3] in ("error", "signup")).items():
        exp = PM.lockout([((r[1] - T0) // dt.timedelta(microseconds=1), r[3] == "signup") for r in rs])
        assert [got[r[0]] for r in rs] == exp
    assert "locked" in got.values() and "fail_locked" in got.values()


def _streamed(spark, batches, fn, name):
    """Runs the stream over one file per micro-batch; the sink, and the query."""
    base = tempfile.mkdtemp(prefix="rentlens-stream-")
    for rows in batches:
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string") \
            .coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = (fn(LS.login_attempts(stream)).writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz")), q


@pytest.mark.parametrize("form", ["throttle", "lockout"])
def test_overlapping_micro_batches_give_the_batch_verdicts(spark, form):
    """Rows come up to an hour late over six micro-batches; the stream itself judges most of them."""
    rows = [r for r in _events(seed=7, n=400) if r[3] in ("error", "signup")]
    rows.sort(key=lambda r: r[1])
    late = {r[0]: r[1] + dt.timedelta(seconds=(r[0] * 7919) % 3600) for r in rows}
    rows.sort(key=lambda r: late[r[0]])
    batches = [rows[i * len(rows) // 6:(i + 1) * len(rows) // 6] for i in range(6)]
    stream, twin = {"throttle": (LS.throttle_stream, LS.throttle), "lockout": (LS.lockout_stream, LS.lockout)}[form]
    sink, q = _streamed(spark, batches, lambda s: stream(s, "2 hours"), form)
    df = LS.login_attempts(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string"))
    exp = {r["event_id"]: tuple(r) for r in twin(df).collect()}
    got = {r["event_id"]: tuple(r) for r in sink.collect()}
    assert len(got) > 0.6 * len(exp) and got.items() <= exp.items()
    assert {r["event_id"]: tuple(r) for r in LS.reconcile(df, sink, twin).collect()} == exp
    if form == "throttle":
        assert all(0 <= r[5] <= C.BUCKET_CAPACITY for r in exp.values())


@pytest.mark.parametrize("form", ["throttle", "lockout"])
def test_users_share_groups_of_the_state(spark, form):
    """Sixty users, some without an id, in five groups: as many states, and the verdicts of each user alone."""
    rows = sorted((r for r in _events(seed=3, users=60, n=900, hot_share=0.1) if r[3] in ("error", "signup")), key=lambda r: r[1])
    rows = [(i, t, u + (1 << 40), kind) for i, t, u, kind in rows]
    unknown = 9 + (1 << 40)
    given = [(i, t, None if u == unknown else u, kind) for i, t, u, kind in rows]
    end = [(-1, T0 + dt.timedelta(days=30), 1 << 40, "signup")]
    stream, twin = {"throttle": (LS.throttle_stream, LS.throttle), "lockout": (LS.lockout_stream, LS.lockout)}[form]
    sink, q = _streamed(spark, [given[:400], given[400:], end], lambda s: stream(s, "1 hour", groups=5), form)
    assert max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) <= 6  # null has its own
    df = LS.login_attempts(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string"))
    exp = {(r[0], None if r[1] == unknown else r[1], *r[2:]) for r in twin(df).collect()}
    assert {tuple(r) for r in sink.collect()} == exp and len(exp) > 400


def test_clock_does_not_run_back():
    state = LS.bucket_step(None, 12 * 3600 * 10 ** 6, 10, 0.5, 1)[0]
    state, ok, retry, tokens = LS.bucket_step(state, 11 * 3600 * 10 ** 6, 10, 0.5, 1)
    assert ok and retry == 0 and tokens == 8 and state[1] == 12 * 3600 * 10 ** 6


def test_failures_before_a_long_pause_still_count(spark):
    month = dt.timedelta(days=40)
    rows = [(i, T0 + dt.timedelta(minutes=i), 1, "error") for i in range(C.MAX_LOGIN_ATTEMPTS - 1)]
    after = [(50, T0 + month, 1, "error"), (51, T0 + 2 * month, 2, "error"), (52, T0 + 3 * month, 2, "error")]
    sink, _ = _streamed(spark, [rows, after[:1], after[1:2], after[2:]], lambda s: LS.lockout_stream(s, "1 hour"), "pause")
    assert {r["event_id"]: r["outcome"] for r in sink.collect()}[50] == "fail_locked"


def test_hot_key_runs_in_pieces(spark):
    rows = [(i, T0 + dt.timedelta(seconds=30 * i), 1, "signup" if i % 50 == 49 else "error") for i in range(6000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    cut = LS._pieces(df.select("event_id", "user_id", "ts"), "user_id", lambda gap: gap >= 20)
    assert cut.select("_piece").distinct().count() == 6000  # the key of the shuffle


def test_prediction_log_stream(spark):
    base = tempfile.mkdtemp(prefix="rentlens-log-")
    scored = spark.createDataFrame(
        [("Mumbai", 2, 800, "Furnished", 32000.0, "High", 0.73456, 40.0),
         ("Delhi", 1, 400, "Unfurnished", 9000.0, "Low", 0.1, 22.5)],
        "city string, bhk int, size int, furnishing string, predicted_rent double, demand_risk string,"
        " risk_probability double, price_per_sqft double")
    rec = PS.checked_records(PL.prediction_records(scored, ["city", "bhk"], "2024-01-01 10:00:00"))
    PL.append(rec, f"{base}/landing")
    PL.append(rec, f"{base}/landing")  # a replayed batch: same ids
    schema = spark.read.parquet(f"{base}/landing").schema
    PS.run_to_table(PS.log_stream(spark, f"{base}/landing", schema), f"{base}/log", f"{base}/ck")
    log = spark.read.parquet(f"{base}/log")
    assert log.count() == 2  # de-duplicated by id
    assert PL.count(log).first()["prediction_count"] == 2
    r = PL.recent(log, 1).first()
    assert r["risk_probability"] in (0.735, 0.1)
    assert abs(sum(x * x for x in r["vector"]) - 1) < 1e-12
    view = PL.recent(log, 5).transform(lambda d: d.withColumn("password_hash", F.lit("x")))
    from rentlens.operators.filters import log_view
    v = log_view(view)
    assert "id" not in v.columns and "password_hash" not in v.columns
    assert v.first()["timestamp"] == "2024-01-01 10:00"


def test_registration_rules(spark):
    reqs = spark.createDataFrame([
        (1, "ab", "Name", "a@b.co", "Aa1!aaaa", "tenant"),
        (2, "bad-name", "Name", "a@b.co", "Aa1!aaaa", "tenant"),
        (3, "okname", "   ", "a@b.co", "Aa1!aaaa", "tenant"),
        (4, "okname", "Name", "not-an-email", "Aa1!aaaa", "tenant"),
        (5, "okname", "Name", "x@y.co", "weakpass", "tenant"),
        (6, "okname", "Name", "x@y.co", "Aa1!aaaa", "admin"),
        (7, "Taken", "Name", "n1@y.co", "Aa1!aaaa", "agent"),
        (8, "fresh", "Name", "OLD@x.co", "Aa1!aaaa", "agent"),
        (9, "newbie", "Name", "n9@y.co", "Aa1!aaaa", "TENANT"),
        (10, "NEWBIE", "Name", "n10@y.co", "Aa1!aaaa", "TENANT"),
        (11, "üser_ok", "Name", " N11@Y.CO ", "Aa1!aaaa", "TENANT"),
    ], "req_id long, username string, full_name string, email string, password string, role string")
    existing = spark.createDataFrame([("taken", "old@x.co")], "username string, email string")
    got = {r["req_id"]: r["error"] for r in AC.register_batch(reqs, existing).collect()}
    assert got[1] == C.MSG_USERNAME_SHORT and got[2] == C.MSG_USERNAME_CHARS
    assert got[3] == C.MSG_NAME_MISSING and got[4] == C.MSG_EMAIL and got[5] == C.MSG_PASSWORD
    assert got[6] == "Role 'ADMIN' is not available for self-registration."
    assert got[7] == C.MSG_USERNAME_TAKEN and got[8] == C.MSG_EMAIL_TAKEN
    assert got[9] is None and got[10] == C.MSG_USERNAME_TAKEN  # second request for the same name
    assert got[11] is None  # \\w is Unicode-aware, as in Python


REQ = "req_id long, username string, full_name string, email string, password string, role string"


@pytest.mark.parametrize("requests,refused", [
    # 1 is refused for an existing e-mail, so its name is free for 2; 3 comes third for that name
    ([(1, "xuser", "taken@a.co"), (2, "XUser", "new@a.co"), (3, "xuser", "c@a.co")], {1: "e", 3: "u"}),
    # 2 loses its e-mail to 1, so 3 may have 2's name, and 4 clashes with 3
    ([(1, "aaa", "m@a.co"), (2, "bbb", "m@a.co"), (3, "bbb", "n@a.co"), (4, "ccc", "n@a.co")], {2: "e", 4: "e"}),
    # a chain of three refusals that each free the next one
    ([(1, "aaa", "1@a.co"), (2, "aaa", "2@a.co"), (3, "ccc", "2@a.co"), (4, "ccc", "3@a.co"), (5, "eee", "3@a.co")],
     {2: "u", 4: "u"}),
    # refused for its e-mail for certain, but its name also goes to an earlier request that is decided later
    ([(1, "aaa", "1@a.co"), (2, "aaa", "2@a.co"), (3, "bbb", "2@a.co"), (4, "bbb", "1@a.co")], {2: "u", 4: "u"}),
    # an existing name wins over an existing e-mail
    ([(1, "OLD", "taken@a.co"), (2, "new", "TAKEN@a.co")], {1: "u", 2: "e"}),
])
def test_requests_are_decided_one_by_one(spark, requests, refused):
    rows = [(i, u, "Name", e, "Aa1!aaaa", "agent") for i, u, e in requests]
    existing = spark.createDataFrame([("old", "taken@a.co")], "username string, email string")
    said = {"u": C.MSG_USERNAME_TAKEN, "e": C.MSG_EMAIL_TAKEN}
    got = {r["req_id"]: r["error"] for r in AC.register_batch(spark.createDataFrame(rows[::-1], REQ), existing).collect()}
    assert got == {i: said.get(refused.get(i)) for i, _, _ in requests}


def test_entitlements_and_user_list(spark):
    acc = spark.createDataFrame([(1, "a", "A", "a@x.co", "SUPER_ADMIN"), (2, "b", "B", "b@x.co", "ANALYST"),
                                 (3, "c", "C", "c@x.co", "TENANT"), (4, "d", "D", "d@x.co", "GHOST")],
                                "user_id long, username string, full_name string, email string, role string")
    e = {r["user_id"]: r for r in AC.entitlements(acc).collect()}
    assert e[1]["permissions"] == 1023 and list(e[1]["pages"]) == ["Admin", "Spark", "Models"]
    assert list(e[2]["pages"]) == ["Predictor", "Similar", "Analytics", "Spark", "Models"]
    assert list(e[3]["pages"]) == ["Predictor"] and e[4]["permissions"] == 0 and list(e[4]["pages"]) == []
    assert e[2]["can_export_data"] and not e[3]["can_export_data"]
    audit = spark.createDataFrame([(10, 1, T0, 5, 1e9), (11, 1, T0 + dt.timedelta(seconds=5), 0, None),
                                   (12, 2, T0, 5, 2e9)],
                                  "event_id long, user_id long, ts timestamp_ntz, failures int, locked_until_s double")
    ul = {r["Username"]: r for r in AC.user_list(acc, audit).collect()}
    assert (ul["a"]["Failed"], ul["a"]["Locked"]) == (0, "No")
    assert (ul["b"]["Failed"], ul["b"]["Locked"]) == (5, "Yes")
    assert (ul["c"]["Failed"], ul["c"]["Locked"]) == (0, "No")


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(0.0, 50.0, allow_nan=False), st.booleans()),
                min_size=1, max_size=80))
def test_state_machine_properties(spark, steps):
    rows, t = [], {0: 0.0, 1: 0.0, 2: 0.0}
    for i, (u, gap, ok) in enumerate(steps):
        t[u] += gap
        rows.append((i, T0 + dt.timedelta(microseconds=int(t[u] * 1e6)), u, "signup" if ok else "error"))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    thr = {r["event_id"]: r for r in LS.throttle(df).collect()}
    assert all(0 <= r["tokens"] <= C.BUCKET_CAPACITY for r in thr.values())
    assert all((r["retry_after_s"] == 0) == r["allowed"] for r in thr.values())
    lock = {r["event_id"]: r["outcome"] for r in LS.lockout(LS.login_attempts(df)).collect()}
    for u, rs in _by_user(rows).items():
        secs = [(r[1] - T0) // dt.timedelta(microseconds=1) for r in rs]
        assert [thr[r[0]]["allowed"] for r in rs] == [a for a, _ in PM.token_bucket(secs)]
        assert [lock[r[0]] for r in rs] == PM.lockout([(s, r[3] == "signup") for s, r in zip(secs, rs)])


def test_late_rows_are_reconciled(spark):
    day = dt.timedelta(days=1)
    first = [(i, T0 + 10 * day + dt.timedelta(seconds=i), 1, "error") for i in range(20)]
    late = [(100 + i, T0 + day + dt.timedelta(seconds=i), 1, "error") for i in range(5)]
    sink, q = _streamed(spark, [first, late], lambda s: LS.lockout_stream(s, "1 hour"), "late")
    judged = {r["event_id"] for r in sink.collect()}
    assert not judged & {r[0] for r in late}  # 9 days behind the watermark
    df = LS.login_attempts(spark.createDataFrame(first + late, "event_id long, ts timestamp_ntz, user_id long, event_type string"))
    exp = {tuple(r) for r in LS.lockout(df).collect()}
    assert {tuple(r) for r in LS.reconcile(df, sink, LS.lockout).collect()} == exp and len(exp) == 25


GOOD = ("user_1", "Aa1!aaaa", "Name", "a@b.co", "tenant")


@pytest.mark.parametrize("change,said", [
    ({}, None), ({0: "  abc  "}, None), ({0: " ab "}, C.MSG_USERNAME_SHORT), ({0: None}, C.MSG_USERNAME_SHORT),
    ({0: "a b c"}, C.MSG_USERNAME_CHARS), ({0: "üser_ß9"}, None), ({0: "a-bc"}, C.MSG_USERNAME_CHARS),
    ({2: " \u00a0 "}, C.MSG_NAME_MISSING), ({2: None}, C.MSG_NAME_MISSING),
    ({3: "a@b"}, C.MSG_EMAIL), ({3: "a b@c.de"}, C.MSG_EMAIL), ({3: "a@@b.co"}, C.MSG_EMAIL), ({3: " A@B.CO "}, None), ({3: None}, C.MSG_EMAIL),
    ({1: "Aa1!aaa"}, C.MSG_PASSWORD), ({1: "aa1!aaaa"}, C.MSG_PASSWORD), ({1: "AA1!AAAA"}, C.MSG_PASSWORD),
    ({1: "Aaa!aaaa"}, C.MSG_PASSWORD), ({1: "Aa11aaaa"}, C.MSG_PASSWORD), ({1: None}, C.MSG_PASSWORD),
    ({4: "AGENT"}, None), ({4: "analyst"}, "Role 'ANALYST' is not available for self-registration."),
    ({4: None}, "Role 'NONE' is not available for self-registration."),
    ({0: "x", 3: "bad"}, C.MSG_USERNAME_SHORT), ({1: "weak", 4: "admin"}, C.MSG_PASSWORD)])
def test_validation_rules(spark, change, said):
    row = tuple(change.get(i, v) for i, v in enumerate(GOOD))
    df = spark.createDataFrame([row], "username string, password string, full_name string, email string, role string")
    assert df.select(AC.validation_error().alias("e")).first()["e"] == said


@pytest.mark.parametrize("rows", [50, 100_000])
def test_a_long_chain_of_requests_needs_few_jobs(spark, rows):
    """Each request shares its name with the one before or its e-mail with the one after: 4,000 depend on each other."""
    import random
    n = 4000
    order = list(range(n))
    if rows == 50:
        n = 600
        order = random.Random(3).sample(range(n), n)  # in any order
    data = [(order[i], f"user_{i // 2}", "Name", f"u{(i + 1) // 2}@x.co", "Aa1!aaaa", "tenant") for i in range(n)]
    existing = spark.createDataFrame([("someone", "s@x.co")], "username string, email string")
    reqs = spark.createDataFrame(data, "req_id long, username string, full_name string, email string, password string, role string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"chain-{rows}", "")
    got = {r["req_id"] for r in AC.register_batch(reqs, existing, task_rows=rows).filter("error IS NULL").collect()}
    jobs = len(tracker.getJobIdsForGroup(f"chain-{rows}"))
    spark.sparkContext.setJobGroup("", "")
    names, mails, want = set(), set(), set()
    for i, u, _, e, *_ in sorted(data):
        if u not in names and e not in mails:
            want.add(i); names.add(u); mails.add(e)
    assert got == want
    if rows > n:
        assert jobs < 40


def test_components_are_found_in_few_rounds(spark):
    import random
    n = 3000
    order = random.Random(5).sample(range(n), n)
    data = [(order[i], f"u{i // 2}", f"e{(i + 1) // 2}") for i in range(n)] + [(n + i, f"v{i // 10}", f"f{i}") for i in range(100)]
    left = spark.createDataFrame(data, "_id long, _u string, _e string")
    got = AC.conflict_components(left).groupBy("_c").count().collect()
    assert sorted((r["_c"], r["count"]) for r in got) == [(0, n)] + [(n + 10 * i, 10) for i in range(10)]


def test_streams_give_every_verdict_themselves(spark, sf_small):
    from rentlens.plans import catalog_ops as CO
    for build in (LS.throttle_stream, LS.lockout_stream):
        events, sink = CO._stream_sink(spark, sf_small, "verdicts", build)
        assert sink.count() == events.count() > 100 and LS.late_events(events, sink).isEmpty()


def test_records_later_than_the_watermark_are_appended_once(spark, sf_small):
    from rentlens.plans import catalog_ops as CO
    log, late = CO._late_log(spark, sf_small)
    n = CO._log_table(spark, sf_small).count()
    assert 0.01 * n < late.count() < 0.04 * n  # the stream has dropped them
    assert log.count() == n == log.select("id").distinct().count()
    kept = late.inputFiles()[0]
    assert kept and late.join(log, "id", "left_semi").count() == late.count()


def test_late_records_are_appended_only_once(spark, tmp_path):
    schema = "id string, timestamp timestamp, x int"
    rows = [(str(i), dt.datetime(2024, 1, 1, i), i) for i in range(6)]
    landing = spark.createDataFrame(rows + rows[:3], schema)
    log, late = f"{tmp_path}/log", f"{tmp_path}/late"
    landing.filter("id > '1'").dropDuplicates(["id"]).write.parquet(log)
    assert sorted(r["id"] for r in PS.append_late(landing, log, late).collect()) == ["0", "1"]
    assert PS.append_late(landing, log, late).count() == 0
    assert sorted(r["id"] for r in PS.read_log(spark, landing.schema, log, late).collect()) == list("012345")


def _landed(spark, base, *batches):
    """Lands batches of (id, hour, value), a file each."""
    for rows in batches:
        data = [(i, T0 + dt.timedelta(hours=h) if h is not None else None, x) for i, h, x in rows]
        spark.createDataFrame(data, "id string, timestamp timestamp, x int").coalesce(1).write.mode("append").parquet(f"{base}/landing")


def _run_log(spark, base, **kw):
    schema = "id string, timestamp timestamp, x int"
    PS.run_to_table(PS.log_stream(spark, f"{base}/landing", schema, **kw), f"{base}/log", f"{base}/ck")
    return sorted((r["id"] or "", r["x"]) for r in PS.read_log(spark, schema, f"{base}/log").collect())


def test_the_log_does_not_depend_on_the_number_of_micro_batches(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    batches = [[(f"k{i}", 100 - 10 * i, i), ("a", 50, 7), (f"n{i}", None, i)] for i in range(5)]  # ever older records

    def log(files):
        _landed(spark, f"{tmp_path}/{files}", *batches)
        return _run_log(spark, f"{tmp_path}/{files}", max_files_per_trigger=files)
    with ThreadPoolExecutor(2) as pool:
        one, all_at_once = pool.map(log, (1, 100))
    assert one == all_at_once == sorted([("a", 7)] + [(f"{k}{i}", i) for k in "kn" for i in range(5)])


def test_a_run_drops_what_is_late_and_what_landed_before(spark, tmp_path):
    base = str(tmp_path)
    _landed(spark, base, [("a", 10, 1), ("b", 11, 2), (None, 10, 3), ("timeless", None, 8)])
    assert _run_log(spark, base) == [("", 3), ("a", 1), ("b", 2), ("timeless", 8)]
    _landed(spark, base, [("late", 10, 4), ("c", 12, 5), ("a", 10, 1), ("b", 11, 2), (None, 12, 6), ("c", 12, 5), ("timeless", None, 8)])
    want = [("", 3), ("a", 1), ("b", 2), ("c", 5), ("timeless", 8)]
    assert _run_log(spark, base) == want == _run_log(spark, base)  # the second time nothing new has landed
    landing = spark.read.parquet(f"{base}/landing")
    for n in (1, 0):
        assert PS.append_late(landing, f"{base}/log", f"{base}/late").count() == n
    assert sorted((r["id"] or "", r["x"]) for r in PS.read_log(spark, landing.schema, f"{base}/log", f"{base}/late").collect()) == sorted([*want, ("late", 4)])


def test_records_that_land_once_are_not_shuffled(spark, tmp_path):
    _landed(spark, str(tmp_path), [("a", 1, 1)], [("b", 2, 2)])
    stream = PS.log_stream(spark, f"{tmp_path}/landing", "id string, timestamp timestamp, x int")
    assert "Deduplicate" not in stream._jdf.queryExecution().analyzed().toString() and "Join" not in stream._jdf.queryExecution().analyzed().toString()
