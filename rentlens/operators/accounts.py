"""Account data checks as table operators.

* P21 registration validation: the first failing rule per request, as a
  data-quality column (``rlike``/``length``/``isin`` → one ``when`` chain).
* J6 duplicates: requests are decided as if they came one by one. Those that clash with
  an existing account go first, those that share neither name nor e-mail with another one are accepted. Of the
  rest, a few rounds accept each request that is the earliest undecided one for its name and for its e-mail and
  refuse what clashes with it (minima are grouped, so a hot name is reduced before it moves). What is left falls
  into components of requests that share names or e-mails, found in a logarithmic number of rounds; components of
  at most ``TASK_ROWS`` requests are each decided in one task, larger ones by further rounds.
* P20 entitlements: role → permission mask (fixed 5-row table, broadcast) and the
  page list the mask opens.
* P19 user list view, with failure count and lock flag from the lockout audit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens import constants as C
from rentlens.session import materialize, ship_package


def _java_unicode(pattern: str) -> str:
    """Python's ``\\w``/``\\d``/``\\s`` are Unicode-aware; Java's are ASCII unless
    UNICODE_CHARACTER_CLASS is on (inline flag ``(?U)``)."""
    return "(?U)" + pattern


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace, Unicode-aware."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def validation_error(username="username", full_name="full_name", email="email", password="password",
                     role="role") -> Column:
    """The first failing rule's message, or null when the request is valid.
    Inputs are trimmed (username, name, email), lower-cased (email) and
    upper-cased (role) first, as the reference does."""
    u = py_strip(F.col(username))
    n = py_strip(F.col(full_name))
    e = F.lower(py_strip(F.col(email)))
    r = F.upper(F.col(role))
    return (F.when(u.isNull() | (F.length(u) < 3), F.lit(C.MSG_USERNAME_SHORT))
            .when(~u.rlike(_java_unicode(C.USERNAME_RE)), F.lit(C.MSG_USERNAME_CHARS))
            .when(n.isNull() | (F.length(n) == 0), F.lit(C.MSG_NAME_MISSING))
            .when(~F.coalesce(e.rlike(_java_unicode(C.EMAIL_RE)), F.lit(False)), F.lit(C.MSG_EMAIL))
            .when(~F.coalesce(F.col(password).rlike(_java_unicode(C.PASSWORD_RE)), F.lit(False)),
                  F.lit(C.MSG_PASSWORD))
            .when(~F.coalesce(r.isin(C.SELF_REGISTER_ROLES), F.lit(False)),
                  F.concat(F.lit("Role '"), F.coalesce(r, F.lit("NONE")), F.lit("' is not available for self-registration."))))


#: Requests that one task decides, and rounds of minima before components are sought.
TASK_ROWS, FIRST_ROUNDS = 200_000, 2


def _in_turn(pdf):
    """The requests of one task that are accepted one by one, in the order of their ids."""
    names, mails, ok = set(), set(), []
    pdf = pdf.sort_values("_id")
    for u, e in zip(pdf["_u"], pdf["_e"]):
        ok.append(u not in names and e not in mails)
        if ok[-1]:
            names.add(u)
            mails.add(e)
    return pdf[ok][["_id", "_u", "_e"]]


def conflict_components(left: DataFrame) -> DataFrame:
    """``left`` (_id, _u, _e) with ``_c``, the least id of the requests linked to a request through names and e-mails.
    Each round a component takes the least label of those it shares a name or an e-mail with, as a whole, so at least
    half of the components with a neighbour of a lesser label vanish."""
    now = materialize(left.withColumn("_c", F.col("_id")))
    while True:
        least = (now.join(now.groupBy("_u").agg(F.min("_c").alias("_cu")), "_u").join(now.groupBy("_e").agg(F.min("_c").alias("_ce")), "_e")
                 .groupBy("_c").agg(F.min(F.least("_cu", "_ce")).alias("_to")))
        least = materialize(least)
        if least.filter("_to < _c").isEmpty():
            return now
        # labels may have moved on themselves: two steps down the chain of labels
        chain = least.alias("a").join(least.alias("b"), F.col("a._to") == F.col("b._c")).select(
            F.col("a._c").alias("_c"), F.col("b._to").alias("_to"))
        now = materialize(now.join(chain, "_c").select("_id", "_u", "_e", F.col("_to").alias("_c")))


def _round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requests that are the earliest for their name and their e-mail, and what is left when they are accepted."""
    now = materialize(left.join(left.groupBy("_u").agg(F.min("_id").alias("_fu")), "_u")
                      .join(left.groupBy("_e").agg(F.min("_id").alias("_fe")), "_e")
                      .filter((F.col("_id") == F.col("_fu")) & (F.col("_id") == F.col("_fe"))).select("_id", "_u", "_e"))
    return now, materialize(left.join(now.select("_u"), "_u", "left_anti").join(now.select("_e"), "_e", "left_anti"))


def accepted(left: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Of requests (_id, _u, _e) those accepted when they are decided in the order of ``_id``."""
    left = left.join(left.groupBy("_u").agg(F.count("_id").alias("_nu")), "_u").join(left.groupBy("_e").agg(F.count("_id").alias("_ne")), "_e")
    left = materialize(left)
    taken = left.filter("_nu = 1 AND _ne = 1").select("_id", "_u", "_e")
    left = left.filter("_nu > 1 OR _ne > 1").select("_id", "_u", "_e")
    schema = left.schema
    n, rounds = left.count(), 0
    while n > task_rows and rounds < FIRST_ROUNDS:
        now, left = _round(left)
        taken, n, rounds = taken.unionByName(now), left.count(), rounds + 1
    if n <= task_rows:
        return taken.unionByName(left.withColumn("_c", F.lit(0)).groupBy("_c").applyInPandas(_in_turn, schema)) if n else taken
    parts = conflict_components(left)
    sizes = parts.groupBy("_c").agg(F.count("_id").alias("_n"))
    sized = materialize(parts.join(sizes, "_c"))
    taken = taken.unionByName(sized.filter(F.col("_n") <= task_rows).select("_id", "_u", "_e", "_c").groupBy("_c").applyInPandas(_in_turn, schema))
    left = sized.filter(F.col("_n") > task_rows).select("_id", "_u", "_e")
    while not left.isEmpty():
        now, left = _round(left)
        taken = materialize(taken.unionByName(now))
    return taken


def register_batch(requests: DataFrame, existing: DataFrame, req_id: str = "req_id", task_rows: int = TASK_ROWS) -> DataFrame:
    """P21 + J6 over a batch of registration requests: adds ``error`` (null = accepted).

    Requests take effect in the order of ``req_id``, and only accepted ones hold their name and e-mail: a
    request that is refused for its e-mail leaves its name to the next one."""
    ship_package(requests.sparkSession)
    v = materialize(requests.withColumns({
        "_u": F.lower(py_strip(F.col("username"))), "_e": F.lower(py_strip(F.col("email"))),
        "_err": validation_error()}))
    old_u = existing.select(F.lower("username").alias("_u")).distinct()
    old_e = existing.select(F.lower("email").alias("_e")).distinct()
    left = (v.filter(F.col("_err").isNull()).select(F.col(req_id).alias("_id"), "_u", "_e")
            .join(old_u, "_u", "left_anti").join(old_e, "_e", "left_anti"))
    taken = materialize(accepted(left, task_rows))
    by_u = old_u.withColumn("_tu", F.lit(None).cast("long")).unionByName(taken.select("_u", F.col("_id").cast("long").alias("_tu")))
    by_e = old_e.withColumn("_te", F.lit(None).cast("long")).unionByName(taken.select("_e", F.col("_id").cast("long").alias("_te")))
    j = (v.join(by_u.withColumn("_hu", F.lit(True)), "_u", "left").join(by_e.withColumn("_he", F.lit(True)), "_e", "left"))

    def held(flag, holder):  # by an existing account (no id) or an accepted earlier request
        return F.col(flag).isNotNull() & (F.col(holder).isNull() | (F.col(holder) < F.col(req_id)))
    err = (F.when(F.col("_err").isNotNull(), F.col("_err")).when(held("_hu", "_tu"), F.lit(C.MSG_USERNAME_TAKEN))
           .when(held("_he", "_te"), F.lit(C.MSG_EMAIL_TAKEN)))
    return j.withColumn("error", err).drop("_u", "_e", "_err", "_tu", "_te", "_hu", "_he")


def role_masks(spark) -> DataFrame:
    return spark.createDataFrame(list(C.ROLE_MASKS.items()), "role string, permissions int")


def entitlements(accounts: DataFrame) -> DataFrame:
    """P20: permission mask per account, one boolean per permission bit, the
    page list and the admin flag."""
    j = accounts.join(F.broadcast(role_masks(accounts.sparkSession)), "role", "left")
    bits = dict(C.PERM_BITS)
    has = {name: (F.coalesce(F.col("permissions"), F.lit(0)).bitwiseAND(F.lit(bit)) != 0) for name, bit in C.PERM_BITS}
    pages = F.filter(F.array(*[F.when(has[perm], F.lit(page)) for page, perm in C.NAV_PAGES]), lambda x: x.isNotNull())
    is_admin = F.col("role").isin(C.ADMIN_ROLES)
    return j.select(*accounts.columns, F.coalesce("permissions", F.lit(0)).alias("permissions"),
                    *[has[name].alias(f"can_{name.lower()}") for name in bits],
                    is_admin.alias("is_admin"),
                    F.when(is_admin, F.array(*[F.lit(p) for p in C.ADMIN_PAGES])).otherwise(pages).alias("pages"))


def user_list(accounts: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """Username, name, role, email, failed count, locked Yes/No. With a
    lockout ``audit`` (T3 output), the state after each user's last attempt is
    used (``max_by`` per user: one partial-aggregated row per user)."""
    a = accounts
    if audit is not None:
        last = audit.groupBy("user_id").agg(
            F.max_by(F.struct("failures", "locked_until_s"), F.struct("ts", "event_id")).alias("_s"))
        a = a.join(last, "user_id", "left").withColumns({
            "failed_attempts": F.coalesce(F.col("_s.failures"), F.lit(0)),
            "locked_until_s": F.col("_s.locked_until_s")}).drop("_s")
    return a.select(F.col("username").alias("Username"), F.col("full_name").alias("Full Name"),
                    F.col("role").alias("Role"), F.col("email").alias("Email"),
                    F.coalesce(F.col("failed_attempts"), F.lit(0)).cast("int").alias("Failed"),
                    F.when(F.col("locked_until_s").isNotNull(), "Yes").otherwise("No").alias("Locked"))
