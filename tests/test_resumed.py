"""Streams with an initial state, stopped and resumed, against plain Python."""

import datetime
import random

from tracewell.streaming import leases

EVENT = "user_id long, event_id long, event_type string, ts timestamp"
COUNT = "project_id long, at long, facts long, hints long, pending long"
START = datetime.datetime(2024, 3, 1)


def test_streaks_begin_with_a_history(spark, tmp_path):
    rng = random.Random(9)
    events = [(rng.choice([1, 2, 2**60 + 1, None]), i, rng.choice(["error", "error", "purchase", "view", None]), START + datetime.timedelta(seconds=i // 3)) for i in range(400)] + [(1, 900, "error", None)]
    want, streak = set(), {}
    for user, id, kind, ts in events[:-1]:
        streak[user] = streak.get(user, 0) + 1 if kind == "error" else 0 if kind == "purchase" else streak.get(user, 0)
        if kind == "error" and streak[user] >= 3:
            want.add((user, id, streak[user], int(ts.replace(tzinfo=datetime.UTC).timestamp()) + 180))
    spark.createDataFrame(events[201:], EVENT).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
    before = spark.conf.get(leases.PROVIDER, None)
    got = leases.failure_pauses(stream, f"{tmp_path}/out", spark.createDataFrame(events[:201], EVENT))
    assert {tuple(r) for r in got.collect()} == {x for x in want if x[1] >= 201}
    assert spark.conf.get(leases.PROVIDER, None) == before


def reasons(rows):
    looked, out = {}, set()
    for project, at, *now in sorted(rows, key=lambda r: (r[1], r[0] or 0)):
        old = looked.get(project)
        why = ["initial"] if old is None else [f"{n}:{old[i]}->{now[i]}" for i, n in enumerate(["facts", "hints"]) if now[i] > old[i]] + ([f"pending:{old[2]}->0"] if old[2] > 0 and now[2] == 0 else [])
        if why:
            looked[project] = now
            out.add((project, at, ",".join(why), *now))
    return out


def test_reasons_of_a_stopped_and_resumed_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(p, at, rng.randint(0, 5), rng.randint(0, 3), rng.choice([0, 0, 1, 2])) for p in (1, 2**60 + 1, None) for at in range(60)]
    want = reasons(rows)
    parts = [[r for r in rows if lo <= r[1] < lo + 20] for lo in (0, 20, 40)]
    for i, part in enumerate(parts):
        spark.createDataFrame([*part, (1, None, 9, 9, 9)], COUNT).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        got = leases.change_reasons(spark.readStream.schema(COUNT).parquet(f"{tmp_path}/in"), f"{tmp_path}/out")
        assert {tuple(r) for r in got.collect()} == {x for x in want if x[1] < 20 * (i + 1)}
    spark.createDataFrame(parts[2], COUNT).write.parquet(f"{tmp_path}/late")
    last = {}
    for x in sorted((x for x in want if x[1] < 40), key=lambda x: x[1]):
        last[x[0]] = (x[0], *x[3:])
    looked = spark.createDataFrame([*last.values(), (77, 1, 1, 1)], "project_id long, facts long, hints long, pending long")
    got = leases.change_reasons(spark.readStream.schema(COUNT).parquet(f"{tmp_path}/late"), f"{tmp_path}/again", looked)
    assert {tuple(r) for r in got.collect()} == {x for x in want if x[1] >= 40}
