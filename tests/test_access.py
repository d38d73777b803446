import datetime as dt
import json

from correctionlab.operators import access as A


def body(kind="checkout.session.completed", session="cs_1", user="u", score="s"):
    meta = {k: v for k, v in (("user_id", user), ("score_id", score)) if v is not None}
    return json.dumps({"type": kind, "created": 5, "data": {"object": {
        "id": session, "payment_intent": f"pi_{session}", "metadata": meta}}})


def bodies(spark, *texts):
    return spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1, 0, i), t) for i, t in enumerate(texts)], "event_id bigint, ts timestamp, body string")


def grants(spark, *rows):
    return spark.createDataFrame([(u, s, f, "payment", None) for u, s, f in rows],
                                 "user_id string, score_id string, feature string, access_type string, granted_at timestamp")


def test_only_complete_events_count(spark):
    df = bodies(spark, body(), body("checkout.session.expired"), body(user=None), body(score=""), "{broken", "[]")
    assert [r.event_id for r in A.completions(df).collect()] == [0]


def test_payments_are_reconciled(spark):
    payments = spark.createDataFrame(
        [("p1", "cs_1", "pending", None, None), ("p2", "cs_2", "pending", None, None), ("p3", None, "pending", None, None)],
        "id string, session_id string, status string, payment_intent string, completed_at timestamp")
    done = A.completions(bodies(spark, body(), body(), body(session="cs_x")))
    got = {r.id: (r.status, r.payment_intent, r.completed_at) for r in A.reconcile_payments(payments, done).collect()}
    assert got == {"p1": ("completed", "pi_cs_1", dt.datetime(2024, 1, 1, 0, 1)), "p2": ("pending", None, None),
                   "p3": ("pending", None, None)}


def test_grants_are_unique_and_need_no_payment(spark):
    done = A.completions(bodies(spark, body(), body(), body(session="cs_x", user="v")))
    once = A.grant_access(grants(spark, ("u", "s", "vision_comparison")), done)
    assert sorted((r.user_id, r.score_id) for r in once.collect()) == [("u", "s"), ("v", "s")]
    assert A.grant_access(once, done).count() == 2


def test_access(spark):
    users = spark.createDataFrame([("a", "root@x.org", "user"), ("b", "b@x.org", "user")], "id string, email string, role string")
    asked = spark.createDataFrame([("a", "1", "vision_comparison"), ("b", "1", "vision_comparison"),
                                   ("b", "2", "vision_comparison"), ("c", "1", "other")],
                                  "user_id string, score_id string, feature string")
    given = grants(spark, ("b", "1", "vision_comparison"), ("c", "1", "vision_comparison"))
    def allowed(**kw):
        rows = A.has_access(asked, users, given, ["root@x.org"], **kw).where("has_access").collect()
        return sorted((r.user_id, r.score_id) for r in rows)
    assert allowed() == [("a", "1"), ("b", "1")]
    assert allowed(configured=False) == [("a", "1")]
    assert sorted(tuple(r)[:2] for r in A.entitlements(asked, users, given, ["root@x.org"]).collect()) == [
        ("a", "1"), ("b", "1"), ("c", "1")]


def test_limit_counts_inside_fixed_windows(spark):
    times = [0, 10, 59, 60, 61]
    df = spark.createDataFrame([("k", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for m in times], "client string, ts timestamp")
    (row,) = A.over_limit(df, 2, "1 hour").collect()
    assert row.requests == 3 and row.window_start == dt.datetime(2024, 1, 1)
