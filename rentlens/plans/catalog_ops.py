"""Registered queries for the prediction log (S3–S8, T1, P16), login state
machines (T2, T3) and account checks (P19–P21, J6). Accounts are derived from
the ``supplier`` (existing accounts) and ``customer`` (registration requests)
tables; login attempts and requests come from ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rentlens import constants as C
from rentlens.operators import accounts as AC
from rentlens.operators import filters as FL
from rentlens.operators import pricing as PR
from rentlens.operators import similarity as SIM
from rentlens.operators import stats as ST
from rentlens.functions.features import add_vectors
from rentlens.functions.text import py_round
from rentlens.plans.catalog import _DEMAND_CTE, clean, clean_shared, counts_shared, register, sql_round6, state_key
from rentlens.plans.catalog_scoring import _FLOOR_CTE, _PRICED_CTE, _unit
from rentlens.plans.oracle_sql import with_listings
from rentlens.session import ensure_checkpoint_dir
from rentlens.sources import listings as LI
from rentlens.sources import predlog as PL
from rentlens.sources import vector_store as VS
from rentlens.sources.listings import KEY_COLS
from rentlens.sources.tables import table
from rentlens.streaming import login_state as LS
from rentlens.streaming import predlog_stream as PS

# ----------------------------------------------------------- prediction log ---

_LOGS: dict = {}


def _request_time():
    """When a listing's prediction is taken to have been asked for: a minute per order, a second per line."""
    return F.timestamp_seconds(F.lit(1704067200) + F.col("l_orderkey") * 60 + F.col("l_linenumber"))


def _log_sql(tail: str) -> str:
    """The log in SQL: ``logged`` has the record's columns, time, id and vector components."""
    keys = ", ".join(f"CAST({k} AS VARCHAR)" for k in KEY_COLS)
    parts = [f"{_unit('city', C.CITIES)}", "least(b / 6.0, 1.0)", "least(z / 5000.0, 1.0)", "least(ba / 6.0, 1.0)",
             f"{_unit('furnishing', C.FURNISH)}", "1.0::DOUBLE / 3.0::DOUBLE", "least((z / b) / 2000.0, 1.0)", "least(ba / b, 1.0)",
             "0.5::DOUBLE", "0.5::DOUBLE", "least(ln(1 + z) / 10.0, 1.0)", "least((b * ba) / 36.0, 1.0)"]
    return with_listings(tail, _PRICED_CTE + f""",
{_DEMAND_CTE},
logged AS (SELECT NULL::VARCHAR AS user_id, p.city, p.bhk, p.size, p.furnishing, p.predicted_rent,
    CASE WHEN coalesce(h.demand_rate, 0) >= 0.5 THEN 'High' ELSE 'Low' END AS demand_risk,
    CAST(format('{{:.3f}}', coalesce(h.demand_rate, 0.0)) AS DOUBLE) AS risk_probability, p.price_per_sqft,
    make_timestamp((1704067200 + p.l_orderkey * 60 + p.l_linenumber) * 1000000) AS ts,
    sha256(concat_ws('|', {keys}, strftime(ts, '%Y-%m-%d %H:%M:%S.%f'))) AS id,
    greatest(CAST(p.bhk AS DOUBLE), 1.0) AS b, greatest(CAST(p.size AS DOUBLE), 1.0) AS z,
    greatest(CAST(p.bhk AS DOUBLE) - 1, 1.0) AS ba, [{', '.join(parts)}] AS c,
    sqrt(list_sum(list_transform(c, lambda x: x * x))) AS nrm
  FROM priced p LEFT JOIN (SELECT city AS hc, bhk AS hb, demand_rate FROM heat) h ON p.city = hc AND p.bhk = hb)""")


def _records(spark, sf):
    """Every listing priced (listed rent as the estimate, (city, bhk) demand rate as the risk probability)."""
    counts = counts_shared(spark, sf)
    priced = PR.rent_band(clean_shared(spark, sf), "rent", ST.city_medians(counts, weight="n")).join(
        ST.demand_heatmap(counts, weight="n"), ["city", "bhk"], "left")
    priced = priced.withColumn("risk_probability", F.coalesce(F.col("demand_rate"), F.lit(0.0))) \
                   .withColumn("demand_risk", F.when(F.col("risk_probability") >= 0.5, "High").otherwise("Low"))
    return PS.checked_records(PL.prediction_records(priced, KEY_COLS, _request_time()))


def _log_table(spark, sf):
    """S5 + T1: the records are appended to a landing folder and streamed into the log table. Folders live under the
    shared checkpoint dir."""
    key = state_key(spark, sf)
    if key not in _LOGS:
        base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/predlog-{uuid.uuid4().hex}"
        records = _records(spark, sf)
        PL.append(records, f"{base}/landing")
        PS.run_to_table(PS.log_stream(spark, f"{base}/landing", records.schema), f"{base}/log", f"{base}/_checkpoint")
        _LOGS[key] = f"{base}/log"
    return spark.read.parquet(_LOGS[key])


def _late_log(spark, sf):
    """T1 with records that come late: every 40th record lands after the stream has read all others, hours or days
    behind the watermark; some records land twice. Returns the log and the late records."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/predlog-late-{uuid.uuid4().hex}"
    turn = F.pmod(F.xxhash64("id"), F.lit(40))
    records = _records(spark, sf).withColumn("_turn", turn)
    schema = records.drop("_turn").schema
    for part in (records.filter("_turn > 0"), records.filter("_turn <= 1")):
        PL.append(part.drop("_turn"), f"{base}/landing")
        PS.run_to_table(PS.log_stream(spark, f"{base}/landing", schema), f"{base}/log", f"{base}/_checkpoint")
    late = PS.append_late(spark.read.schema(schema).parquet(f"{base}/landing"), f"{base}/log", f"{base}/late")
    return PS.read_log(spark, schema, f"{base}/log", f"{base}/late"), late


def _log_view(log):
    """The log with its vector as 12 columns, rounded as in listing_vectors."""
    return log.select(*[c for c in log.columns if c != "vector"], *[
        F.bround(F.col("vector")[i - 1], 6).alias(f"v{i:02d}") for i in range(1, 13)]).withColumn(
            "timestamp", F.col("timestamp").cast("timestamp_ntz"))


_WHOLE_LOG_SQL = _log_sql(
    "SELECT user_id, city, bhk, size, furnishing, predicted_rent, demand_risk, risk_probability, price_per_sqft, ts AS timestamp, id, "
    + ", ".join(f"round_even(c[{i}] / nrm, 6) AS v{i:02d}" for i in range(1, 13)) + " FROM logged")


@register("prediction_log", _WHOLE_LOG_SQL)
def q_prediction_log(spark, sf):
    """S5 + T1: the append-only log after the streaming append (every listing logged once)."""
    return _log_view(_log_table(spark, sf))


@register("prediction_log_late", _WHOLE_LOG_SQL)
def q_prediction_log_late(spark, sf):
    """The log when records come later than the watermark and some come twice: each is there once."""
    return _log_view(_late_log(spark, sf)[0])


@register("prediction_count", with_listings("SELECT count(*) AS prediction_count FROM listings"))
def q_prediction_count(spark, sf):
    """S7."""
    return PL.count(_log_table(spark, sf))


@register("store_health", with_listings(
    "SELECT 'table' AS status, count(*) AS listings_vectors, count(*) AS predictions_stored FROM listings"))
def q_store_health(spark, sf):
    """Vector-table and log counts."""
    vectors = SIM.listing_vector_table(clean(spark, sf))
    return PL.health(vectors, _log_table(spark, sf))


@register("recent_predictions", _log_sql(
    "SELECT user_id, city, bhk, size, furnishing, predicted_rent, demand_risk, risk_probability, price_per_sqft,"
    " strftime(ts, '%Y-%m-%d %H:%M') AS timestamp FROM logged ORDER BY ts DESC, id LIMIT 100"))
def q_recent_predictions(spark, sf):
    """S6 + P16: newest 100 log rows, display view (top-k is the feature)."""
    return FL.log_view(PL.recent(_log_table(spark, sf), 100).drop("vector"))


@register("listing_vector_table")
def q_listing_vector_table(spark, sf):
    """Id + unit vector + flattened metadata for every cleaned listing."""
    return SIM.listing_vector_table(clean(spark, sf))


_KEY_MD5 = "md5(concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in KEY_COLS) + "))"
_COMPONENTS = [_unit("city", C.CITIES), "least(bhk_c / 6.0, 1.0)", "least(size_c / 5000.0, 1.0)", "least(bath_c / 6.0, 1.0)",
               _unit("furnishing", C.FURNISH), "floor_ratio", "least((size_c / bhk_c) / 2000.0, 1.0)", "least(bath_c / bhk_c, 1.0)",
               _unit("area_type", C.AREA_TYPES), _unit("tenant", C.TENANTS), "least(ln(1 + size_c) / 10.0, 1.0)",
               "least((bhk_c * bath_c) / 36.0, 1.0)"]


def _store_batch(listings):
    """Listings as rows of the vector store: key, metadata, vector."""
    df = VS.with_listing_key(listings)
    return add_vectors(df, keep=["listing_key", *SIM.VECTOR_META])


@register("listing_vector_store", with_listings(
    f"SELECT listing_key, {', '.join(SIM.VECTOR_META)}, " + ", ".join(f"round_even(c[{i}] / nrm, 6) AS v{i:02d}" for i in range(1, 13))
    + f" FROM (SELECT *, {_KEY_MD5} AS listing_key, [{', '.join(_COMPONENTS)}] AS c,"
    " sqrt(list_sum(list_transform(c, lambda x: x * x))) AS nrm FROM flr)", _FLOOR_CTE))
def q_listing_vector_store(spark, sf):
    """Every listing's vector and metadata written to a versioned store and read through its manifest."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    batch = _store_batch(clean(spark, sf))
    VS.upsert(batch, root)
    rows = VS.read(spark, root, batch.schema)
    return rows.select("listing_key", *SIM.VECTOR_META, *[F.bround(F.col("vector")[i - 1], 6).alias(f"v{i:02d}") for i in range(1, 13)])


@register("vector_store_upserts", with_listings(
    f"SELECT {_KEY_MD5} AS listing_key, CASE WHEN l_orderkey % 10 = 5 THEN 'Pune' ELSE city END AS city, bhk,"
    " CASE WHEN l_orderkey % 10 >= 4 THEN rent + 500 ELSE rent END AS rent, 12 AS dims FROM listings"))
def q_vector_store_upserts(spark, sf):
    """Two batches that overlap are upserted: the second changes rents and moves listings to another city."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    df, turn = clean(spark, sf), F.col("l_orderkey") % 10
    changed = df.filter(turn >= 4).withColumns({"rent": F.col("rent") + 500, "city": F.when(turn == 5, "Pune").otherwise(F.col("city"))})
    for batch in (_store_batch(df.filter(turn < 7)), _store_batch(changed)):
        VS.upsert(batch, root)
    return VS.read(spark, root, batch.schema).select("listing_key", "city", "bhk", "rent", F.size("vector").alias("dims"))


_BAD_CSV = "l_orderkey % 997 = 5"


@register("csv_ingest_report", with_listings(
    f"SELECT count(*) FILTER (WHERE NOT {_BAD_CSV}) AS rows, count(*) FILTER (WHERE {_BAD_CSV}) AS rejects,"
    f" count(DISTINCT city) FILTER (WHERE NOT {_BAD_CSV}) AS cities,"
    f" (SELECT count(*) FROM listings WHERE NOT {_BAD_CSV}) AS clean_rows FROM listings_raw"))
def q_csv_ingest_report(spark, sf):
    """The listings as the application's CSV, some lines with a rent that is no number; the ingest report counts
    them as rejects."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    df = LI.listings_from_tables(spark, sf)
    back = {src: F.col(dst).cast("string") for src, dst in LI.CSV_RENAMES.items()}
    back["Rent"] = F.when(F.expr(_BAD_CSV), F.lit("n/a")).otherwise(back["Rent"])
    LI.export_csv(df.select([back.get(f.name, F.lit("")).alias(f.name) for f in LI.CSV_SCHEMA.fields]), path)
    return LI.checked_report(*LI.read_listings_checked(spark, path))


@register("listing_sample", with_listings(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, city, locality, bhk, size, bathroom, rent,"
    " furnishing, floor_txt, area_type, tenant, price_per_sqft FROM listings WHERE ('0x' || substr(md5(concat_ws('|', "
    + ", ".join(f"CAST({k} AS VARCHAR)" for k in KEY_COLS) + ")), 1, 8))::BIGINT < 429496729"))
def q_listing_sample(spark, sf):
    """S3, scalable form: a 10 % sample by a hash of the key (sampling is the feature)."""
    from rentlens.sources.listings import sample_by_key
    return sample_by_key(clean(spark, sf), 0.1)


# ------------------------------------------------------------ login streams ---

def _events(spark, sf):
    return table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")


_ATTEMPTS_CTE = """att AS (SELECT event_id, user_id, ts, event_type = 'signup' AS success,
  epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('error', 'signup'))"""


def _throttle_sql() -> str:
    cap, rate, cost = C.BUCKET_CAPACITY, C.BUCKET_RATE, C.BUCKET_COST
    refill = f"least({cap}::DOUBLE, p.tokens + (a.t - p.t) / 1000000.0::DOUBLE * {rate}::DOUBLE)"
    return f"""WITH RECURSIVE {_ATTEMPTS_CTE},
tb AS (
  SELECT user_id, rn, event_id, ts, t, {cap}::DOUBLE AS avail FROM att WHERE rn = 1
  UNION ALL
  SELECT a.user_id, a.rn, a.event_id, a.ts, a.t,
         {refill} AS avail
  FROM (SELECT user_id, rn, t, CASE WHEN avail >= {cost} THEN avail - {cost} ELSE avail END AS tokens FROM tb) p
  JOIN att a ON a.user_id = p.user_id AND a.rn = p.rn + 1)
SELECT event_id, user_id, ts, avail >= {cost} AS allowed,
  {sql_round6(f"CASE WHEN avail >= {cost} THEN 0.0 ELSE ({cost} - avail) / {rate} END")} AS retry_after_s,
  {sql_round6(f"CASE WHEN avail >= {cost} THEN avail - {cost} ELSE avail END")} AS tokens
FROM tb"""


def _lockout_cte() -> str:
    mx, lock = C.MAX_LOGIN_ATTEMPTS, int(round(C.LOCK_SECONDS * 1_000_000))
    return f"""lk AS (
  SELECT user_id, rn, event_id, ts, t, success,
    CASE WHEN success THEN 0 ELSE 1 END AS failures,
    CASE WHEN NOT success AND 1 >= {mx} THEN t + {lock} END AS locked_until_s,
    CASE WHEN success THEN 'ok' WHEN 1 >= {mx} THEN 'fail_locked' ELSE 'fail' END AS outcome
  FROM att WHERE rn = 1
  UNION ALL
  SELECT a.user_id, a.rn, a.event_id, a.ts, a.t, a.success,
    CASE WHEN p.locked_until_s IS NOT NULL AND a.t < p.locked_until_s THEN p.failures
         WHEN a.success THEN 0 ELSE p.failures + 1 END,
    CASE WHEN p.locked_until_s IS NOT NULL AND a.t < p.locked_until_s THEN p.locked_until_s
         WHEN a.success THEN NULL WHEN p.failures + 1 >= {mx} THEN a.t + {lock} ELSE p.locked_until_s END,
    CASE WHEN p.locked_until_s IS NOT NULL AND a.t < p.locked_until_s THEN 'locked'
         WHEN a.success THEN 'ok' WHEN p.failures + 1 >= {mx} THEN 'fail_locked' ELSE 'fail' END
  FROM lk p JOIN att a ON a.user_id = p.user_id AND a.rn = p.rn + 1)"""


def _lockout_sql() -> str:
    return f"""WITH RECURSIVE {_ATTEMPTS_CTE}, {_lockout_cte()}
SELECT event_id, user_id, ts, success, outcome, CAST(failures AS INTEGER) AS failures,
  locked_until_s / 1000000.0::DOUBLE AS locked_until_s FROM lk"""


@register("login_throttle", _throttle_sql())
def q_login_throttle(spark, sf):
    """T2 batch twin: token bucket per user over every login attempt (error/signup)."""
    out = LS.throttle(LS.login_attempts(_events(spark, sf)))
    return out.withColumns({"retry_after_s": py_round("retry_after_s", 6), "tokens": py_round("tokens", 6)})


@register("lockout_audit", _lockout_sql())
def q_lockout_audit(spark, sf):
    """T3 batch twin: lockout outcome of every login attempt."""
    return LS.lockout(LS.login_attempts(_events(spark, sf)))


# ----------------------------------------------------------------- accounts ---

ROLES_BY_NATION = ["SUPER_ADMIN", "ADMIN", "ANALYST", "AGENT", "TENANT"]
REQUEST_ROLES = ["tenant", "AGENT", "Analyst", "TENANT"]


def _accounts(spark, sf):
    s = table(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey")
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES_BY_NATION]), F.pmod("s_nationkey", F.lit(5)) + 1)
    return s.select(F.col("s_suppkey").alias("user_id"),
                    F.concat(F.lit("user_"), F.col("s_suppkey").cast("string")).alias("username"),
                    F.col("s_name").alias("full_name"),
                    F.concat(F.lit("user"), F.col("s_suppkey").cast("string"), F.lit("@supplier.example")).alias("email"),
                    role.alias("role"))


ACCOUNTS_SQL = """accounts AS (SELECT s_suppkey AS user_id, 'user_' || CAST(s_suppkey AS VARCHAR) AS username,
  s_name AS full_name, 'user' || CAST(s_suppkey AS VARCHAR) || '@supplier.example' AS email,
  ['SUPER_ADMIN', 'ADMIN', 'ANALYST', 'AGENT', 'TENANT'][s_nationkey % 5 + 1] AS role FROM supplier)"""


def _requests(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    ks = k.cast("string")
    seg = F.lower("c_mktsegment")
    return c.select(
        k.alias("req_id"),
        F.when(k % 11 == 0, F.lit("ab")).when(k % 13 == 0, F.concat(F.lit("user-"), ks))
        .when(k % 3 == 0, F.concat(F.lit("User_"), (k - k % 24 + 1_000_000).cast("string")))
        .otherwise(F.concat(F.lit("user_"), ks)).alias("username"),
        F.when(k % 17 == 0, F.lit("   ")).otherwise(F.col("c_name")).alias("full_name"),
        F.when(k % 19 == 0, F.concat(F.lit("user"), ks, F.lit("@example")))
        .when(k % 23 == 0, F.concat(F.lit("user"), (k % 100).cast("string"), F.lit("@supplier.example")))
        .when(k % 4 == 0, F.concat(F.lit("shared"), (k - k % 20).cast("string"), F.lit("@mail.example")))
        .otherwise(F.concat(F.lit("user"), ks, F.lit("@"), seg, F.lit(".example"))).alias("email"),
        F.when(k % 2 == 0, F.concat(F.lit("Aa1!"), seg)).otherwise(F.concat(seg, ks)).alias("password"),
        F.element_at(F.array(*[F.lit(r) for r in REQUEST_ROLES]), F.pmod("c_nationkey", F.lit(4)) + 1).alias("role"))


REQUESTS_SQL = """requests AS (SELECT c_custkey AS req_id,
  CASE WHEN c_custkey % 11 = 0 THEN 'ab' WHEN c_custkey % 13 = 0 THEN 'user-' || CAST(c_custkey AS VARCHAR)
       WHEN c_custkey % 3 = 0 THEN 'User_' || CAST(c_custkey - c_custkey % 24 + 1000000 AS VARCHAR)
       ELSE 'user_' || CAST(c_custkey AS VARCHAR) END AS username,
  CASE WHEN c_custkey % 17 = 0 THEN '   ' ELSE c_name END AS full_name,
  CASE WHEN c_custkey % 19 = 0 THEN 'user' || CAST(c_custkey AS VARCHAR) || '@example'
       WHEN c_custkey % 23 = 0 THEN 'user' || CAST(c_custkey % 100 AS VARCHAR) || '@supplier.example'
       WHEN c_custkey % 4 = 0 THEN 'shared' || CAST(c_custkey - c_custkey % 20 AS VARCHAR) || '@mail.example'
       ELSE 'user' || CAST(c_custkey AS VARCHAR) || '@' || lower(c_mktsegment) || '.example' END AS email,
  CASE WHEN c_custkey % 2 = 0 THEN 'Aa1!' || lower(c_mktsegment)
       ELSE lower(c_mktsegment) || CAST(c_custkey AS VARCHAR) END AS password,
  ['tenant', 'AGENT', 'Analyst', 'TENANT'][c_nationkey % 4 + 1] AS role FROM customer)"""


def _register_sql() -> str:
    pwd_ok = ("(length(password) >= 8 AND NOT contains(password, chr(10)) AND regexp_matches(password, '[A-Z]')"
              " AND regexp_matches(password, '[a-z]') AND regexp_matches(password, '[0-9]')"
              " AND regexp_matches(password, '[!@#$%^&*]'))")
    q = lambda s: s.replace("'", "''")
    return f"""WITH RECURSIVE {ACCOUNTS_SQL}, {REQUESTS_SQL},
v AS (SELECT *, lower(trim(username)) AS _u, lower(trim(email)) AS _e,
  CASE WHEN trim(username) IS NULL OR length(trim(username)) < 3 THEN '{q(C.MSG_USERNAME_SHORT)}'
       WHEN NOT regexp_full_match(trim(username), '\\w+') THEN '{q(C.MSG_USERNAME_CHARS)}'
       WHEN trim(full_name) IS NULL OR length(trim(full_name)) = 0 THEN '{q(C.MSG_NAME_MISSING)}'
       WHEN NOT coalesce(regexp_full_match(lower(trim(email)), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+'), false)
            THEN '{q(C.MSG_EMAIL)}'
       WHEN NOT coalesce({pwd_ok}, false) THEN '{q(C.MSG_PASSWORD)}'
       WHEN upper(role) NOT IN ('TENANT', 'AGENT') THEN 'Role ''' || upper(role) || ''' is not available for self-registration.'
  END AS _err FROM requests),
free AS (SELECT req_id, _u, _e, count(*) OVER (PARTITION BY _u) > 1 OR count(*) OVER (PARTITION BY _e) > 1 AS clash
  FROM v WHERE _err IS NULL AND _u NOT IN (SELECT lower(username) FROM accounts)
    AND _e NOT IN (SELECT lower(email) FROM accounts)),
queue AS (SELECT *, row_number() OVER (ORDER BY req_id) AS i FROM free WHERE clash),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS req_id, CAST('' AS VARCHAR) AS _u, CAST('' AS VARCHAR) AS _e,
    false AS ok, CAST([] AS VARCHAR[]) AS us, CAST([] AS VARCHAR[]) AS es
  UNION ALL
  SELECT i, req_id, _u, _e, ok, CASE WHEN ok THEN list_append(us, _u) ELSE us END, CASE WHEN ok THEN list_append(es, _e) ELSE es END
  FROM (SELECT q.i, q.req_id, q._u, q._e, w.us, w.es, NOT list_contains(w.us, q._u) AND NOT list_contains(w.es, q._e) AS ok
        FROM walk w JOIN queue q ON q.i = w.i + 1)),
acc AS (SELECT req_id, _u, _e FROM free WHERE NOT clash UNION ALL SELECT req_id, _u, _e FROM walk WHERE ok)
SELECT v.req_id, v.username, CASE
  WHEN _err IS NOT NULL THEN _err
  WHEN v._u IN (SELECT lower(username) FROM accounts) OR hu.req_id < v.req_id THEN '{q(C.MSG_USERNAME_TAKEN)}'
  WHEN v._e IN (SELECT lower(email) FROM accounts) OR he.req_id < v.req_id THEN '{q(C.MSG_EMAIL_TAKEN)}'
  END AS error
FROM v LEFT JOIN acc hu ON v._u = hu._u LEFT JOIN acc he ON v._e = he._e"""


@register("registration_checks", _register_sql())
def q_registration_checks(spark, sf):
    """P21 + J6: validation message (first failing rule) or duplicate message per request."""
    out = AC.register_batch(_requests(spark, sf), _accounts(spark, sf))
    return out.select("req_id", "username", "error")


def _entitlements_sql() -> str:
    masks = ", ".join(f"('{r}', {m})" for r, m in C.ROLE_MASKS.items())
    cans = ", ".join(f"(coalesce(m.permissions, 0) & {bit}) <> 0 AS can_{name.lower()}" for name, bit in C.PERM_BITS)
    bits = dict(C.PERM_BITS)
    pages = ", ".join(f"CASE WHEN (coalesce(m.permissions, 0) & {bits[perm]}) <> 0 THEN '{page}' END"
                      for page, perm in C.NAV_PAGES)
    admin = "[" + ", ".join(f"'{p}'" for p in C.ADMIN_PAGES) + "]"
    return f"""WITH {ACCOUNTS_SQL}, masks AS (SELECT * FROM (VALUES {masks}) t(role, permissions))
SELECT a.user_id, a.username, a.role, coalesce(m.permissions, 0) AS permissions, {cans},
  a.role IN ('SUPER_ADMIN', 'ADMIN') AS is_admin,
  array_to_string(CASE WHEN a.role IN ('SUPER_ADMIN', 'ADMIN') THEN {admin}
       ELSE list_filter([{pages}], lambda x: x IS NOT NULL) END, ' | ') AS pages
FROM accounts a LEFT JOIN masks m ON a.role = m.role"""


@register("role_entitlements", _entitlements_sql())
def q_role_entitlements(spark, sf):
    """P20: permission bits and page list per account."""
    e = AC.entitlements(_accounts(spark, sf))
    return e.select("user_id", "username", "role", "permissions",
                    *[f"can_{n.lower()}" for n, _ in C.PERM_BITS], "is_admin",
                    F.array_join("pages", " | ").alias("pages"))


def _user_list_sql() -> str:
    return f"""WITH RECURSIVE {_ATTEMPTS_CTE}, {_lockout_cte()}, {ACCOUNTS_SQL},
last AS (SELECT user_id, arg_max(failures, (ts, event_id)) AS failures,
                arg_max(locked_until_s, (ts, event_id)) AS locked_until_s,
                arg_max(locked_until_s IS NULL, (ts, event_id)) AS unlocked FROM lk GROUP BY user_id)
SELECT a.username AS "Username", a.full_name AS "Full Name", a.role AS "Role", a.email AS "Email",
  CAST(coalesce(l.failures, 0) AS INTEGER) AS "Failed",
  CASE WHEN l.user_id IS NOT NULL AND NOT l.unlocked THEN 'Yes' ELSE 'No' END AS "Locked"
FROM accounts a LEFT JOIN last l ON a.user_id = l.user_id"""


@register("user_list", _user_list_sql())
def q_user_list(spark, sf):
    """Account list with failed count and lock flag from the lockout audit."""
    audit = LS.lockout(LS.login_attempts(_events(spark, sf)))
    return AC.user_list(_accounts(spark, sf), audit)


# --------------------------------------------------------- streaming forms ---

SLICES, SLICE_FILES = 6, 4


def _stream_sink(spark, sf, name: str, build):
    """The login attempts land slice by slice, each in ``SLICE_FILES`` files, the slices overlapping in time by a third;
    a closing row lands last. The stream reads one slice per micro-batch with a watermark of half a slice. Returns the
    attempts and the verdicts the stream has written."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    events = LS.login_attempts(_events(spark, sf))
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    low, high = events.agg(F.min(t), F.max(t)).first()
    width = max(1.0, ((high or 0) - (low or 0)) / SLICES)
    early = F.when(F.col("event_id") % 3 == 0, F.lit(1 / 3)).otherwise(F.lit(0.0))
    sliced = events.withColumn("_slice", F.least(F.floor((t - (low or 0)) / width + early), F.lit(SLICES - 1)).cast("int"))
    sliced.repartition(SLICES * SLICE_FILES, "_slice", F.pmod(F.xxhash64("event_id"), F.lit(SLICE_FILES))) \
        .write.partitionBy("_slice").parquet(f"{base}/slices")  # the events are read once
    staged = spark.read.schema(sliced.schema).parquet(f"{base}/slices")
    delay = int(width / 2) + 1
    for i in range(SLICES):
        staged.filter(F.col("_slice") == i).drop("_slice").repartition(SLICE_FILES).write.mode("append").parquet(f"{base}/landing")
    LS.closing_row(events, delay).coalesce(1).write.mode("append").parquet(f"{base}/landing")
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", SLICE_FILES).parquet(f"{base}/landing")
    q = (build(src, f"{delay} seconds").writeStream.format("parquet")
         .outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return events, spark.read.parquet(f"{base}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _run_stream(spark, sf, name: str, build, twin):
    """The stream's verdicts; only users with events later than the watermark are computed anew."""
    return LS.reconcile(*_stream_sink(spark, sf, name, build), twin)


@register("login_throttle_stream", _throttle_sql())
def q_login_throttle_stream(spark, sf):
    """T2 as a Structured Streaming job over every login attempt, in overlapping micro-batches."""
    out = _run_stream(spark, sf, "throttle", LS.throttle_stream, LS.throttle)
    return out.withColumns({"retry_after_s": py_round("retry_after_s", 6), "tokens": py_round("tokens", 6)})


@register("lockout_audit_stream", _lockout_sql())
def q_lockout_audit_stream(spark, sf):
    """T3 as a Structured Streaming job over every login attempt, in overlapping micro-batches."""
    return _run_stream(spark, sf, "lockout", LS.lockout_stream, LS.lockout)
