"""Payments and entitlements."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from correctionlab import schemas
from correctionlab.functions import fixed_values as V

ACCESS_KEY = ("user_id", "score_id", "feature")


def completions(bodies: DataFrame) -> DataFrame:
    """Completed checkouts that name both a user and a score, out of raw webhook bodies."""
    obj = F.col("event.data.object")
    return (
        bodies.withColumn("event", F.from_json("body", schemas.WEBHOOK_BODY))
        .where(F.col("event.type") == V.COMPLETED_EVENT)
        .select(
            "event_id", "ts",
            obj.id.alias("session_id"),
            obj.payment_intent.alias("payment_intent"),
            obj.metadata.user_id.alias("user_id"),
            obj.metadata.score_id.alias("score_id"),
        )
        .where((F.col("user_id") != "") & (F.col("score_id") != ""))
    )


def reconcile_payments(payments: DataFrame, completed: DataFrame) -> DataFrame:
    """Mark the payments whose session completed; a repeated event only moves the time."""
    last = completed.groupBy("session_id").agg(
        F.max(F.struct("ts", "event_id", "payment_intent")).alias("last")
    )
    hit = F.col("last").isNotNull()
    changed = {
        "status": F.when(hit, "completed").otherwise(F.col("status")),
        "payment_intent": F.when(hit, F.col("last.payment_intent")).otherwise(F.col("payment_intent")),
        "completed_at": F.when(hit, F.col("last.ts")).otherwise(F.col("completed_at")),
    }
    return payments.join(last, "session_id", "left").select(
        *[changed.get(c, F.col(c)).alias(c) for c in payments.columns]
    )


def grant_access(score_access: DataFrame, completed: DataFrame) -> DataFrame:
    """Grants after the events: unique per user, score and feature, existing rows first.

    A grant follows from the event alone, whether or not a payment row matches it.
    """
    new = (
        completed.withColumn("feature", F.lit(V.VISION_FEATURE))
        .groupBy(*ACCESS_KEY)
        .agg(F.min("ts").alias("granted_at"))
        .join(score_access, list(ACCESS_KEY), "left_anti")
        .withColumn("access_type", F.lit("payment"))
    )
    return score_access.unionByName(new.select(*score_access.columns))


def completed_sessions(completed: DataFrame) -> DataFrame:
    """One row a session: its last completion. As small as the events; nothing else is read."""
    return completed.groupBy("session_id").agg(
        F.max(F.struct("ts", "event_id", "payment_intent")).alias("last")
    ).select("session_id", "last.*")


def new_grants(completed: DataFrame) -> DataFrame:
    """One row a user, score and feature: the first completion."""
    return completed.withColumn("feature", F.lit(V.VISION_FEATURE)).groupBy(*ACCESS_KEY).agg(F.min("ts").alias("granted_at"))


def merge_completed(payments: DataFrame, sessions: DataFrame) -> DataFrame:
    """`reconcile_payments` by rows of `completed_sessions` from any number of batches.

    `completed_event` holds the event that settled a row, null for rows settled elsewhere, which any event replaces. The last event by
    (ts, event_id) holds, whether it comes with the others or after they were folded in.
    """
    last = sessions.groupBy("session_id").agg(F.max(F.struct("ts", "event_id", "payment_intent")).alias("last"))
    before = F.struct("completed_at", "completed_event")
    hit = F.col("last").isNotNull() & (
        F.col("completed_event").isNull() | (before < F.struct(F.col("last.ts").alias("completed_at"), F.col("last.event_id").alias("completed_event"))))
    changed = {
        "status": F.when(hit, "completed").otherwise(F.col("status")),
        "payment_intent": F.when(hit, F.col("last.payment_intent")).otherwise(F.col("payment_intent")),
        "completed_at": F.when(hit, F.col("last.ts")).otherwise(F.col("completed_at")),
        "completed_event": F.when(hit, F.col("last.event_id")).otherwise(F.col("completed_event")),
    }
    return payments.join(last, "session_id", "left").select(
        *[changed.get(c, F.col(c)).alias(c) for c in payments.columns]
    )


def merge_grants(score_access: DataFrame, grants: DataFrame) -> DataFrame:
    """`grant_access` by rows of `new_grants` from any number of batches; rows that are there stay as they are."""
    new = (
        grants.groupBy(*ACCESS_KEY).agg(F.min("granted_at").alias("granted_at"))
        .join(score_access, list(ACCESS_KEY), "left_anti").withColumn("access_type", F.lit("payment"))
    )
    return score_access.unionByName(new.select(*score_access.columns))


def has_access(
    requests: DataFrame, users: DataFrame, score_access: DataFrame, admins: Iterable[str],
    configured: bool = True,
) -> DataFrame:
    """Flag each request: administrators always, others by a grant once payments are configured."""
    admin_users = users.where(F.col("email").isin(*admins)).select(
        F.col("id").alias("user_id"), F.lit(True).alias("is_admin")
    )
    granted = score_access.select(*ACCESS_KEY).distinct().withColumn("granted", F.lit(True))
    admin = F.coalesce("is_admin", F.lit(False))
    paid = F.coalesce("granted", F.lit(False)) & F.lit(configured)
    return (
        requests.join(admin_users, "user_id", "left")
        .join(granted, list(ACCESS_KEY), "left")
        .select(*requests.columns, admin.alias("is_admin"), (admin | paid).alias("has_access"))
    )


def entitlements(
    requests: DataFrame, users: DataFrame, score_access: DataFrame, admins: Iterable[str]
) -> DataFrame:
    """Every effective (user, score, feature): grants, and whatever administrators ask for."""
    admin_users = users.where(F.col("email").isin(*admins)).select(F.col("id").alias("user_id"))
    asked = requests.join(admin_users, "user_id", "left_semi").select(*ACCESS_KEY)
    return score_access.select(*ACCESS_KEY).unionByName(asked).distinct()


def over_limit(requests: DataFrame, limit: int, window: str) -> DataFrame:
    """Clients with more requests in a fixed window than allowed. Works on streams with a watermark."""
    return (
        requests.groupBy(F.window("ts", window), "client")
        .agg(F.count(F.lit(1)).alias("requests"))
        .where(F.col("requests") > limit)
        .select(
            "client",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "requests",
        )
    )


def window_micros(window: str) -> int:
    """The length of a window such as "15 minutes"."""
    number, unit = window.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}[unit.rstrip("s")] * 1_000_000


def in_own_window(requests: DataFrame, limits: dict[str, tuple[int, str]]) -> DataFrame:
    """The requests whose action has a limit, with its allowed number, window_start and window_end.

    The window comes from its action's length by arithmetic, as `window` lays fixed windows: from the epoch, in UTC.
    """
    lengths = F.create_map(*[F.lit(x) for action, (_, w) in limits.items() for x in (action, window_micros(w))])
    allowed = F.create_map(*[F.lit(x) for action, (limit, _) in limits.items() for x in (action, limit)])
    zoned = dict(requests.dtypes)["ts"] == "timestamp"
    micros = F.unix_micros("ts") if zoned else F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    length = F.col("_length")
    return (
        requests.withColumn("_length", F.element_at(lengths, F.col("action"))).where(length.isNotNull() & F.col("ts").isNotNull())
        .withColumn("_past", F.pmod(micros, length))
        .withColumn("allowed", F.element_at(allowed, F.col("action")))
        .withColumn("window_start", F.expr("timestampadd(MICROSECOND, -_past, ts)"))
        .withColumn("window_end", F.expr("timestampadd(MICROSECOND, _length - _past, ts)"))
        .drop("_length", "_past")
    )


def over_request_limits(requests: DataFrame, limits: dict[str, tuple[int, str]] = V.REQUEST_LIMITS) -> DataFrame:
    """Clients over the limit of an action, for requests (client, ts, action): each action has its own limit and window.

    One scan and one shuffle for all actions; counts combine on the map side, so a busy client is one row a task and window.
    """
    return (
        in_own_window(requests, limits).groupBy("action", "client", "window_start", "window_end")
        .agg(F.count(F.lit(1)).alias("requests"), F.first("allowed").alias("allowed"))
        .where(F.col("requests") > F.col("allowed")).drop("allowed")
    )
