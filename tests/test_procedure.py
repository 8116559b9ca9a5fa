"""The procedure as a fold, and exact medians."""

import random
import statistics
from datetime import timedelta

from pyspark.sql import functions as F

from evidar.operators import procedure
from evidar.operators.quantiles import exact_median
from tests.test_sessions import T0

ACTION = "study_id string, arrival_ts timestamp, arrival_seq bigint, action string, reason string"


def replay(actions):
    """Plain stage machine of one study: places of the accepted steps."""
    names, stage, halted, taken = list(procedure.STEPS), 0, False, {}
    for ts, seq, action, reason in sorted(actions, key=lambda a: a[:2]):
        if not halted and stage < len(names) and action == names[stage]:
            taken[action] = (ts, seq)
            halted = action == "finish" and reason not in procedure.NORMAL
            stage += 1
    return taken


def test_fold_over_slices_equals_the_machine(spark, monkeypatch):
    rng = random.Random(9)
    names = [*procedure.STEPS, "bogus"]
    made = []
    for study, n in (("hot", 400), ("a", 30), ("b", 60), ("c", 3), ("none", 0)):
        for _ in range(n):
            made.append((study, T0 + timedelta(seconds=rng.randrange(50 if study == "hot" else 500)), len(made), rng.choice(names), rng.choice([*procedure.NORMAL, "technical_failure", None])))
    made.append(("odd", T0, 9_999, "bogus", None))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(made, ACTION)
        got = {r.study_id: r for r in procedure.accepted_steps(df).collect()}
        out = procedure.procedure_replay(df)
        assert out.count() == len(made) and set(out.columns) == {*df.columns, "outcome", "stage_after"}
        accepted = {(r.study_id, r.arrival_seq) for r in out.where("outcome = 'accepted'").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for study in ("hot", "a", "b", "c"):
        want = replay([m[1:] for m in made if m[0] == study])
        found = {name: got[study][name] for name in procedure.STEPS if got[study][name] is not None}
        assert {k: v.seq for k, v in found.items()} == {k: v[1] for k, v in want.items()}
        assert {s for k, s in accepted if k == study} == {v[1] for v in want.values()}


def test_medians(spark):
    rng = random.Random(4)
    groups = {"even": [1, 9], "one": [5], "ties": [3] * 500 + [4] * 3, "wide": [rng.randrange(-(10**9), 10**9) for _ in range(30_001)], "pair": [2, 2, 7, 9], "float": [0.5, 1.5, 4.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("null", None), ("one", None)]
    got = {r.g: r.median for r in exact_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got == {g: float(statistics.median(vs)) for g, vs in groups.items()}
    rough = exact_median(spark.createDataFrame(rows, "g string, v double").where("g = 'wide'").withColumn("v", F.col("v").cast("long")), ["g"], "v", accuracy=50)
    assert rough.first().median == statistics.median(groups["wide"])
