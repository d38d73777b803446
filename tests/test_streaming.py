"""Streams over several files in several micro-batches end where the batch operators end."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from correctionlab.operators import access as A
from correctionlab.operators import decisions as D
from correctionlab.operators import patterns as P
from correctionlab.operators import rules as R
from correctionlab.sources import ledgers, writers
from correctionlab.streaming import access as SA
from correctionlab.streaming import decisions as SD
from correctionlab.streaming import learning as SL

T0 = dt.datetime(2024, 1, 1)
LOG = "diff_id string, score_id string, decision string, edit_value string, kind string, ts timestamp, event_id bigint"


def as_stream(spark, df, path, files):
    """Write the rows as `files` files and read them one per micro-batch."""
    for i in range(files):
        df.where(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(str(path))
    schema = df.drop("_file").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def decisions_log(spark, seed, n=300):
    rnd = random.Random(seed)
    rows = [(f"d{rnd.randrange(40)}", "s", rnd.choice(["accept", "reject", "edit", "view"]), rnd.choice(["", "x", "y"]),
             rnd.choice(["single", "bulk"]), T0 + dt.timedelta(minutes=rnd.randrange(100)), i, rnd.randrange(3)) for i in range(n)]
    return spark.createDataFrame(rows, LOG + ", _file int")


def test_latest_decisions(spark, tmp_path):
    log = decisions_log(spark, 1)
    stream = as_stream(spark, log, tmp_path / "in", 3)
    SD.start_latest_decisions(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.diff_id: r.asDict(True) for r in SD.read_latest_decisions(spark, str(tmp_path / "out")).collect()}
    good, _ = D.validate_decisions(log)
    want = {r.diff_id: r.asDict(True) for r in D.latest_decisions(good).collect()}
    assert got == want and len(got) > 30
    assert sorted(writers.committed(spark, f"{tmp_path}/out/deltas")) == [1, 2, 3]
    assert SD.compact_decisions(spark, str(tmp_path / "out")) == 3
    assert {r.diff_id: r.asDict(True) for r in SD.read_latest_decisions(spark, str(tmp_path / "out")).collect()} == want


def test_learning_folds_batches_and_ignores_repeats(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(rnd.choice(["violin", "piano", "unknown"]), rnd.choice(["note", "slur"]),
             rnd.choice(["accept"] * 9 + ["reject", "edit", None]), i % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "instrument string, difference_type string, human_decision string, _file int")
    as_of = lambda _: F.lit(T0)
    root = str(tmp_path / "state")
    stream = as_stream(spark, df, tmp_path / "in", 4)
    SL.start_learning(stream, root, str(tmp_path / "cp"), as_of).awaitTermination()
    counts = {tuple(r)[:2]: tuple(r)[2:] for r in writers.read_snapshot(spark, f"{root}/counts").collect()}
    columns = ("instrument", "difference_type", "occurrence_count", "accepts", "rejects", "edits")
    want = {tuple(r)[:2]: tuple(r)[2:] for r in P.decision_counts(df).select(*columns).collect()}
    assert counts == want
    final = writers.latest_version(spark, f"{root}/rules")
    rules = {(r.instrument, r.difference_type): r.current_confirmations
             for r in writers.read_snapshot(spark, f"{root}/rules").where("is_active").collect()}
    good = {(r.instrument, r.difference_type): r.occurrence_count
            for r in P.correction_patterns(df).where("accept_rate >= 0.85").collect()}
    assert good.items() <= rules.items()
    # the same batch once more
    SL.learn_from_batch(root, as_of)(df.where("_file = 0"), final)
    assert {tuple(r)[:2]: tuple(r)[2:] for r in writers.read_snapshot(spark, f"{root}/counts").collect()} == want
    assert writers.latest_version(spark, f"{root}/counts") == final


def test_auto_accept(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(str(i), rnd.choice(["violin", "piano"]), rnd.choice(["note", "slur"]), rnd.random(), rnd.random(), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, instrument string, difference_type string, omr_confidence double, vision_confidence double, _file int")
    rules = spark.createDataFrame([("r1", "p", "violin", "note", 0.3, 0.3, True, T0), ("r0", "p", None, "note", 0.6, 0.6, True, T0)],
                                  "id string, pattern_id string, instrument string, difference_type string, min_omr_confidence double, "
                                  "min_vision_confidence double, is_active boolean, created_at timestamp")
    candidates = R.rule_candidates(rules, spark.createDataFrame([("p", None)], "id string, era string"))
    stream = as_stream(spark, df, tmp_path / "in", 2)
    SL.start_auto_accept(stream, candidates, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.auto_accept_rule_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: r.auto_accept_rule_id for r in R.auto_accept(df, candidates).collect()}
    assert set(got.values()) == {None, "r0", "r1"}


def test_settlement_with_repeated_webhooks(spark, tmp_path):
    def body(k):
        return json.dumps({"type": "checkout.session.completed", "data": {"object": {
            "id": f"cs_{k}", "payment_intent": f"pi_{k}", "metadata": {"user_id": f"u{k % 3}", "score_id": f"s{k % 5}"}}}})
    rows = [(k, T0 + dt.timedelta(minutes=k + 5 * again), body(k), (k + again) % 3) for k in range(30) for again in range(2)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, body string, _file int")
    payments = spark.createDataFrame([(f"p{k}", f"cs_{k}", "pending", None, None) for k in range(40)],
                                     "id string, session_id string, status string, payment_intent string, completed_at timestamp")
    grants = spark.createDataFrame([("u0", "s0", "vision_comparison", "payment", T0)],
                                   "user_id string, score_id string, feature string, access_type string, granted_at timestamp")
    root = str(tmp_path / "state")
    SA.start_books(payments, grants, root)
    SA.start_settlement(as_stream(spark, df, tmp_path / "in", 3), root, str(tmp_path / "cp")).awaitTermination()
    done = A.completions(df)
    key = lambda x: sorted((r.user_id, r.score_id) for r in x.collect())
    for _ in range(2):  # before and after folding
        paid = {r.id: (r.payment_intent, r.completed_at) for r in SA.payments_now(spark, root).where("status = 'completed'").collect()}
        want = A.reconcile_payments(payments, done).where("status = 'completed'").collect()
        assert paid == {r.id: (r.payment_intent, r.completed_at) for r in want} and len(paid) == 30
        assert key(SA.score_access_now(spark, root)) == key(A.grant_access(grants, done))
        SA.compact_books(spark, root)
    assert SA.payments_now(spark, root).columns == payments.columns
    # a completion from before those folded in changes nothing, a later one does
    late = [(100, T0 - dt.timedelta(days=1), body(1), 0), (101, T0 + dt.timedelta(days=1), body(2).replace("pi_2", "pi_x"), 0)]
    SA.settle_batch(root)(A.completions(spark.createDataFrame(late, df.schema)), 3)
    now = {r.id: r for r in SA.payments_now(spark, root).collect()}
    assert now["p1"].completed_at > T0 and now["p2"].payment_intent == "pi_x"


def test_a_settlement_batch_reads_no_table_and_writes_its_own_rows(spark, tmp_path):
    root = str(tmp_path / "state")
    payments = spark.range(5_000).selectExpr("concat('p', id) id", "concat('cs_', id) session_id", "'pending' status", "cast(null as string) payment_intent", "cast(null as timestamp) completed_at")
    grants = spark.createDataFrame([], "user_id string, score_id string, feature string, access_type string, granted_at timestamp")
    SA.start_books(payments, grants, root)
    events = spark.createDataFrame([(1, T0, "cs_7", "pi", "u", "s"), (2, T0, "cs_7", "pj", "u", "s"), (3, T0, "cs_9", "pk", "u", "s")],
                                   "event_id long, ts timestamp, session_id string, payment_intent string, user_id string, score_id string")
    (tmp_path / "state" / "payments" / "base").rename(tmp_path / "hidden")  # nothing to read there
    for _ in range(2):
        SA.settle_batch(root)(events, 0)
    (tmp_path / "hidden").rename(tmp_path / "state" / "payments" / "base")
    assert ledgers.deltas(spark, f"{root}/payments").count() == 2 and ledgers.deltas(spark, f"{root}/score_access").count() == 1
    assert SA.payments_now(spark, root).where("status = 'completed'").count() == 2
    assert {r.payment_intent for r in SA.payments_now(spark, root).where("status = 'completed'").collect()} == {"pj", "pk"}
    SA.compact_books(spark, root)
    ledgers.expire_ledger(spark, f"{root}/payments")
    assert list(writers.committed(spark, f"{root}/payments/base")) == [1]
    assert SA.payments_now(spark, root).where("status = 'completed'").count() == 2


def test_late_decisions_count_by_their_time_and_no_state_is_held(spark, tmp_path):
    def part(rows):
        full = [(d, "s", decision, None, "single", T0 + dt.timedelta(minutes=m), m) for d, decision, m in rows]
        spark.createDataFrame(full, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = SD.start_latest_decisions(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        run.awaitTermination()
        assert run.lastProgress["stateOperators"] == []

    part([(f"d{k}", "accept", k + 10) for k in range(20)])
    assert SD.compact_decisions(spark, str(tmp_path / "out")) == 1
    part([("d1", "reject", 1), ("d2", "reject", 90)])  # d1's is late, d2's is not
    assert ledgers.deltas(spark, str(tmp_path / "out"), after=1).count() == 2
    got = {r.diff_id: r.last.decision for r in SD.read_latest_decisions(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 20 and got["d1"] == "accept" and got["d2"] == "reject"


def test_rules_that_appear_while_diffs_wait(spark, tmp_path):
    diff = "id string, instrument string, difference_type string, omr_confidence double, vision_confidence double"
    rule = "id string, pattern_id string, instrument string, difference_type string, min_omr_confidence double, min_vision_confidence double, is_active boolean, created_at timestamp"
    none = spark.createDataFrame([("p", None)], "id string, era string")
    r1 = ("r1", "p", None, "note", 0.5, 0.5, True, T0)
    r2 = ("r2", "p", "piano", "slur", 0.5, 0.5, True, T0 + dt.timedelta(days=1))
    candidates = lambda *rules: R.rule_candidates(spark.createDataFrame(list(rules), rule), none)
    root = str(tmp_path / "state")

    def arrive(*rows):
        spark.createDataFrame(list(rows), diff).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(diff).parquet(str(tmp_path / "in"))
        SL.start_live_accept(stream, root, str(tmp_path / "cp")).awaitTermination()
        return {r.id: r.auto_accept_rule_id for r in SL.matches_now(spark, root).collect()}

    assert arrive(("a", "piano", "slur", 0.9, 0.9), ("b", "piano", "note", 0.9, 0.9)) == {"a": None, "b": None}
    SL.publish_rules(candidates(r1), root, 1)
    assert arrive(("c", "violin", "note", 0.9, 0.9)) == {"a": None, "b": "r1", "c": "r1"}
    SL.compact_matches(spark, root)
    SL.publish_rules(candidates(r1, r2), root, 2)
    final = arrive(("d", "piano", "slur", 0.1, 0.9), ("e", None, "slur", 0.9, 0.9))
    assert final == {"a": "r2", "b": "r1", "c": "r1", "d": None, "e": None}
    # the last batch once more, and one without rules that are new
    SL.match_batch(root)(spark.createDataFrame([("d", "piano", "slur", 0.1, 0.9)], diff), 2)
    SL.match_batch(root)(spark.createDataFrame([], diff), 3)
    assert {r.id: r.auto_accept_rule_id for r in SL.matches_now(spark, root).collect()} == final
    assert {r.id for r in SL.waiting_diffs(spark, root).collect()} == {"d", "e"}


def test_limits_come_out_once_their_window_is_closed(spark, tmp_path):
    minutes = [0, 1, 2, 61, 62, 63, 64, 125, 126, 127, 200]
    rows = [("k", T0 + dt.timedelta(minutes=m), 0 if m < 100 else 1 if m < 200 else 2) for m in minutes]
    df = spark.createDataFrame(rows, "client string, ts timestamp, _file int")
    SA.start_over_limit(as_stream(spark, df, tmp_path / "in", 3), 2, "1 hour", "10 minutes",
                        str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.window_start: r.requests for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {T0: 3, T0 + dt.timedelta(hours=1): 4, T0 + dt.timedelta(hours=2): 3}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.read_snapshot(spark, path) is None and writers.latest_version(spark, path) is None
    writers.write_snapshot(spark.range(3), path, 1)
    old = writers.read_snapshot(spark, path)
    writers.write_snapshot(old.union(spark.range(5)), path, 2)
    writers.write_snapshot(spark.range(100), path, 2)
    assert old.count() == 3 and writers.read_snapshot(spark, path).count() == 8
    assert writers.read_snapshot(spark, path, version=1).count() == 3
    assert writers.read_snapshot(spark, path, below=2).count() == 3
    assert writers.read_snapshot(spark, path, version=7) is None


@pytest.mark.parametrize("versions", [(0, 1)])
def test_learning_update_by_hand(spark, tmp_path, versions):
    from correctionlab.plans.learning import run_learning_update
    df = spark.createDataFrame([("violin", "note", "accept")] * 12, "instrument string, difference_type string, human_decision string")
    for version in versions:
        run_learning_update(spark, str(tmp_path), df, version, F.lit(T0))
    (rule,) = writers.read_snapshot(spark, f"{tmp_path}/rules").collect()
    assert rule.is_active and rule.current_confirmations == 12
    (pattern,) = writers.read_snapshot(spark, f"{tmp_path}/patterns").collect()
    assert pattern.pattern_description.startswith("Auto-accept note differences for violin")


def test_limits_of_all_actions_in_one_operator(spark, tmp_path):
    limits = {"a": (2, "1 hour"), "b": (1, "15 minutes"), "c": (3, "1 day")}
    rnd = random.Random(3)
    rows = sorted((rnd.randrange(60 * 60), rnd.choice(["x", "y"]), rnd.choice(["a", "b", "c", "other"])) for _ in range(300))
    schema = "client string, ts timestamp, action string"
    everything = [(c, T0 + dt.timedelta(minutes=m), a) for m, c, a in rows]
    got = []
    for lo in range(0, 300, 100):
        spark.createDataFrame(everything[lo:lo + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        SA.start_over_request_limits(stream, "1 hour", str(tmp_path / "out"), str(tmp_path / "cp"), limits).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("action", "client", "window_start", "window_end", "requests").collect()))
    batch = A.over_request_limits(spark.createDataFrame(everything, schema), limits).select("action", "client", "window_start", "window_end", "requests")
    closed = max(r[1] for r in everything) - dt.timedelta(hours=1)
    assert got == sorted(tuple(r) for r in batch.collect() if r.window_end <= closed) and len({r[0] for r in got}) == 3
    plain = [A.over_limit(spark.createDataFrame(everything, schema).where(F.col("action") == a), n, w).collect() for a, (n, w) in limits.items()]
    assert sorted((r.client, r.window_start, r.requests) for x in plain for r in x) == sorted((r.client, r.window_start, r.requests) for r in batch.collect())
