import datetime as dt
import random

from pyspark.sql import functions as F

from correctionlab import schemas
from correctionlab.operators import rules as R
from correctionlab.plans.sizing import broadcast_within

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
PATTERN = "id string, instrument string, difference_type string, era string, pattern_description string, " \
          "occurrence_count bigint, accept_count bigint"


def patterns(spark, *rows):
    return spark.createDataFrame([(i, inst, "note", None, f"text {i}", n, a) for i, inst, n, a in rows], PATTERN)


def rule(pattern_id, minimum=10, confirmations=10, active=True, **kw):
    row = dict(id=f"r-{pattern_id}", pattern_id=pattern_id, rule_description="old", instrument="violin",
               difference_type="note", min_omr_confidence=0.7, min_vision_confidence=0.7,
               min_confirmations=minimum, current_confirmations=confirmations, is_active=active, created_at=T0)
    row.update(kw)
    return row


def rule_table(spark, rows):
    names = schemas.RULES.fieldNames()
    return spark.createDataFrame([[r[n] for n in names] for r in rows], schemas.RULES)


def promoted(spark, pats, rows, **kw):
    return {r.pattern_id: r for r in R.promote_rules(pats, rule_table(spark, rows), F.lit(T1), **kw).collect()}


def test_new_rule_of_a_good_pattern(spark):
    got = promoted(spark, patterns(spark, ("p", "violin", 10, 8), ("few", "violin", 9, 9), ("bad", "violin", 20, 15)), [])
    assert set(got) == {"p"}
    new = got["p"]
    assert (new.min_omr_confidence, new.min_vision_confidence, new.min_confirmations) == (0.7, 0.7, 10)
    assert new.is_active and new.current_confirmations == 10 and new.rule_description == "text p"


def test_existing_rule_is_refreshed(spark):
    got = promoted(spark, patterns(spark, ("p", "violin", 40, 39)), [rule("p", minimum=50, confirmations=12)])
    assert got["p"].current_confirmations == 40 and not got["p"].is_active
    assert got["p"].rule_description == "old" and got["p"].created_at == T0


def test_rule_of_a_fallen_pattern_stays(spark):
    pats = patterns(spark, ("p", "violin", 40, 10))
    assert promoted(spark, pats, [rule("p")])["p"].is_active
    assert promoted(spark, pats, [rule("p")])["p"].current_confirmations == 10
    assert not promoted(spark, pats, [rule("p")], deactivate_below=True)["p"].is_active


def test_rule_without_pattern_stays(spark):
    assert promoted(spark, patterns(spark, ("q", "violin", 1, 1)), [rule("gone")])["gone"].is_active


def brute_force(diff, rules, eras):
    best = None
    for r in rules:
        era = eras.get(r["pattern_id"])
        if (r["is_active"] and r["difference_type"] == diff["difference_type"]
                and r["instrument"] in (None, diff["instrument"])
                and (diff["omr_confidence"] or 0.0) >= r["min_omr_confidence"]
                and (diff["vision_confidence"] or 0.0) >= r["min_vision_confidence"]
                and not (era and diff["era"] and era != diff["era"])):
            key = (r["created_at"], r["id"])
            best = min(best, key) if best else key
    return best and best[1]


def test_auto_accept_equals_brute_force(spark):
    rnd = random.Random(7)
    types, instruments, eras = ["note", "slur", "beam"], ["violin", "piano", "flute"], ["", "baroque", "romantic", None]
    rules, era_of = [], {}
    for k in range(60):
        pid = f"p{k % 40}"
        era_of[pid] = rnd.choice(eras)
        rules.append(rule(pid, id=f"r{k:03}", instrument=rnd.choice(instruments + [None]),
                          difference_type=rnd.choice(types), min_omr_confidence=rnd.choice([0.0, 0.5, 0.7]),
                          min_vision_confidence=rnd.choice([0.0, 0.5, 0.7]), is_active=rnd.random() < 0.7,
                          created_at=T0 + dt.timedelta(days=rnd.randrange(5))))
    pats = spark.createDataFrame(list(era_of.items()), "id string, era string")
    diffs = [
        dict(id=str(i), instrument=rnd.choice(instruments + ["oboe"]), difference_type=rnd.choice(types + ["clef"]),
             omr_confidence=rnd.choice([None, 0.2, 0.5, 0.7, 0.9]), vision_confidence=rnd.choice([None, 0.5, 0.69, 0.7]),
             era=rnd.choice(eras))
        for i in range(400)
    ]
    table = spark.createDataFrame(
        diffs, "id string, instrument string, difference_type string, omr_confidence double, vision_confidence double, era string")
    candidates = R.rule_candidates(rule_table(spark, rules), pats)
    want = {d["id"]: brute_force(d, rules, era_of) for d in diffs}
    assert len(set(want.values())) > 5
    for small in (True, False):
        side = broadcast_within(candidates) if small else candidates
        got = {r.id: r.auto_accept_rule_id for r in R.auto_accept(table, side).collect()}
        assert got == want


def test_large_candidate_tables_are_not_broadcast(spark):
    df = spark.range(50)
    assert "rightHint=(strategy=broadcast)" in joined_plan(df, broadcast_within(df, 50))
    assert "strategy=broadcast" not in joined_plan(df, broadcast_within(df, 49))


def joined_plan(left, right):
    return left.join(right, "id")._jdf.queryExecution().optimizedPlan().toString()


def test_details_list_active_rules(spark):
    got = R.rule_details(rule_table(spark, [rule("a"), rule("b", active=False)])).collect()
    assert [r.id for r in got] == ["r-a"] and got[0].description == "old" and got[0].confirmations == 10


def test_many_rules_of_a_key_come_down_to_a_front(spark):
    n = 100_000
    rules = spark.range(n).selectExpr(
        "concat('r', id) id", "concat('p', id % 3) pattern_id", "'violin' instrument", "'note' difference_type",
        "(id * 7919 % 1009) / 1009 min_omr_confidence", "(id * 104729 % 1013) / 1013 min_vision_confidence", "true is_active",
        "timestamp_seconds(id * 37 % 100003) created_at")
    eras = spark.createDataFrame([("p0", None), ("p1", "baroque"), ("p2", "")], "id string, era string")
    (row,) = R.rule_candidates(rules, eras).collect()
    front = []
    for r in sorted(rules.collect(), key=lambda r: (r.created_at, r.id)):
        era = "baroque" if r.pattern_id == "p1" else None
        if not any(o <= r.min_omr_confidence and v <= r.min_vision_confidence and e in (None, era) for _, o, v, e in front):
            front.append((r.id, r.min_omr_confidence, r.min_vision_confidence, era))
    assert [(c["first"].id, c.min_omr_confidence, c.min_vision_confidence, c.rule_era) for c in row.candidates] == front
    assert len(front) < 200


def test_the_front_picks_what_all_rules_would(spark):
    rnd = random.Random(12)
    rows = [rule(f"p{k}", id=f"r{k}", instrument=rnd.choice(["violin", None]), min_omr_confidence=rnd.choice([0.2, 0.4, 0.6, 0.8]),
                 min_vision_confidence=rnd.choice([0.1, 0.5, 0.9]), created_at=T0 + dt.timedelta(minutes=rnd.randrange(40))) for k in range(60)]
    eras = [(f"p{k}", rnd.choice([None, "", "baroque", "modern"])) for k in range(60)]
    diffs = [(str(k), rnd.choice(["violin", "piano"]), "note", rnd.random(), rnd.random(), rnd.choice([None, "baroque", "modern"])) for k in range(400)]
    candidates = R.rule_candidates(rule_table(spark, rows), spark.createDataFrame(eras, "id string, era string"))
    table = spark.createDataFrame(diffs, "id string, instrument string, difference_type string, omr_confidence double, vision_confidence double, era string")
    got = {r.id: r.auto_accept_rule_id for r in R.auto_accept(table, candidates).collect()}
    era_of = {p: e or None for p, e in eras}
    for i, instrument, _, omr, vision, era in diffs:
        fit = [(r["created_at"], r["id"]) for r in rows if r["instrument"] in (None, instrument) and omr >= r["min_omr_confidence"]
               and vision >= r["min_vision_confidence"] and (era_of[r["pattern_id"]] in (None, era) or era is None)]
        assert got[i] == (min(fit)[1] if fit else None)
