import random
from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from sparkloom.streaming import queries
from sparkloom.streaming.distinct import GRAINS, first_rows, pieces
from sparkloom.streaming.sessions import STORE, batch_sessions, joined, partial_sessions, sessions, to_table

SMALL = "/root/testdata/sf0.001"
EPOCH = datetime(2024, 1, 1)
START = (EPOCH - datetime(1970, 1, 1)) // timedelta(microseconds=1)
SCHEMA = "user long, ts timestamp_ntz, key string, late string"
GAP, DELAY = timedelta(seconds=60), timedelta(seconds=100)


def us(seconds):
    return START + round(seconds * 1_000_000)


def simulated(batches):
    """(closed, late, open) events of (user, seconds) batches, by plain lists; the watermark moves between batches."""
    gap, wm, most, state, closed, late = 60_000_000, 0, None, {}, [], []
    for batch in [*batches, []]:
        by_user = {}
        for user, at in batch:
            if user is not None and at is not None:
                by_user.setdefault(user, []).append(us(at))
        for user, times in by_user.items():
            open_ = state.get(user, [])
            runs = []
            for t in sorted([*times, *(t for s in open_ for t in s)]):
                if runs and t - runs[-1][-1] < gap:
                    runs[-1].append(t)
                else:
                    runs.append([t])
            was = {t for s in open_ for t in s}
            state[user] = [r for r in runs if r[-1] + gap > wm * 1000 or was & set(r)]
            late += [(user, len(r)) for r in runs if r not in state[user]]
        for user, own in state.items():
            closed += [(user, r[0], r[-1], len(r)) for r in own if r[-1] + gap <= wm * 1000]
            state[user] = [r for r in own if r[-1] + gap > wm * 1000]
        times = [us(t) for u, t in batch if t is not None and u is not None]
        most = max([*times, *([most] if most else [])], default=None)
        wm = most // 1000 - 100_000 if most else 0
    return sorted(closed), sorted(late), sum(len(r) for own in state.values() for r in own)


def put(spark, folder, k, rows):
    made = [(u, None if s is None else EPOCH + timedelta(seconds=s), "own", "own") for u, s in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{k:03}")


def run(spark, folder, path):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")
    return to_table(sessions(events, "user", "ts", GAP, DELAY), "sessions", path).collect()


def made_batches(seed, n, size):
    """Users of which one has a third of the events; some come far too late; some have no user or time; one is repeated."""
    r, out = random.Random(seed), []
    for k in range(n):
        at = lambda: k * 200 + r.uniform(0, 220) - (r.random() < 0.1) * 500
        rows = [(0 if r.random() < 0.34 else r.choice([1, 2, 3, None]), round(at(), 3) if r.random() > 0.03 else None) for _ in range(size)]
        out.append(rows + rows[:1])
    return out


def test_batches_out_of_order_and_a_restart(spark, tmp_path):
    batches = made_batches(3, 6, 25)
    for k, rows in enumerate(batches[:3]):
        put(spark, tmp_path / "in", k, rows)
    first = run(spark, tmp_path / "in", str(tmp_path / "out"))
    closed, late, _ = simulated(batches[:3])
    assert sorted((r.key, r.first_us, r.last_us, r.n_events) for r in first if not r.late) == closed
    for k, rows in enumerate(batches[3:], 3):
        put(spark, tmp_path / "in", k, rows)
    got = run(spark, tmp_path / "in", str(tmp_path / "out"))
    closed_n, late_n = sum(r.n_events for r in got if not r.late), sum(r.n_events for r in got if r.late)
    total = sum(u is not None and s is not None for b in batches for u, s in b)
    # a query that stops has let its last watermark close sessions, as a batch without rows does between
    want, late, open_ = simulated([*batches[:3], [], *batches[3:]])
    assert sorted((r.key, r.first_us, r.last_us, r.n_events) for r in got if not r.late) == want
    assert late_n == sum(n for _, n in late) > 0 and closed_n + late_n + open_ == total


def test_in_order_the_closed_sessions_equal_those_of_a_table(spark, tmp_path):
    r = random.Random(7)
    rows = sorted(((r.randint(0, 4), round(r.uniform(0, 5000), 6)) for _ in range(400)), key=lambda x: x[1])
    for k in range(4):
        put(spark, tmp_path / "in", k, rows[100 * k : 100 * k + 100])
    got = run(spark, tmp_path / "in", str(tmp_path / "out"))
    table = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in/b*")
    wm = max(us(s) for _, s in rows) // 1000 * 1000 - 100_000_000
    want = [tuple(x) for x in batch_sessions(table, "user", "ts", GAP).collect() if x.last_us + 60_000_000 <= wm]
    assert sorted((x.key, x.first_us, x.last_us, x.n_events) for x in got) == sorted(want) and not any(x.late for x in got)


def test_an_empty_stream(spark, tmp_path):
    put(spark, tmp_path / "in", 0, [])
    assert run(spark, tmp_path / "in", str(tmp_path / "out")) == []


def test_pieces_make_the_sessions_of_all_events():
    r = random.Random(1)
    for _ in range(100):
        at = [r.randint(0, 300) for _ in range(r.randint(1, 30))]
        whole, parts = partial_sessions(pd.DataFrame({"key": 1, "at": at}), 10), []
        r.shuffle(at)
        for lo in range(0, len(at), 7):
            p = partial_sessions(pd.DataFrame({"key": 1, "at": at[lo : lo + 7]}), 10)
            parts += list(p[["first_us", "last_us", "n_events"]].itertuples(index=False, name=None))
        assert joined(parts, 10) == list(whole[["first_us", "last_us", "n_events"]].itertuples(index=False, name=None))


HORIZON = timedelta(seconds=300)


def simulated_firsts(batches):
    """(kept, repeated, late) of (user, seconds) batches by plain lists, with the number of rows."""
    grain, wm, most, last, kept, repeated, late = 100_000_000 // GRAINS, 0, None, {}, [], 0, 0
    for batch in batches:
        rows = sorted(((us(at), user) for user, at in batch if at is not None), key=lambda x: x[0])
        fresh = [(at, user) for at, user in rows if (at // grain + 1) * grain > wm * 1000]
        late += len(rows) - len(fresh)
        for user in {u for _, u in fresh}:
            own = [at for at, u in fresh if u == user]
            if user not in last or -(-(last[user] + 300_000_000) // 1000) <= wm:
                kept.append((user, own[0]))
                repeated -= 1
            repeated += len(own)
            last[user] = max(own[-1], last.get(user, own[-1]))
        most = max([at for at, _ in rows] + ([most] if most else []), default=None)
        wm = most // 1000 - 100_000 if most else 0
    return sorted(kept, key=repr), repeated, late


def run_firsts(spark, folder, path):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")
    return to_table(first_rows(events, ["user"], "ts", DELAY, HORIZON, ["user", "ts", "key"]), "firsts", path).collect()


def test_first_rows_repeated_and_late_over_a_restart(spark, tmp_path):
    """Users 10 to 12 pause for longer than the horizon, so they are kept again; a null user is a key."""
    batches = [[*rows, *((10 + k % 3, k * 200 + s) for s in (0, 1))] for k, rows in enumerate(made_batches(5, 7, 25))]
    for k, rows in enumerate(batches[:3]):
        put(spark, tmp_path / "in", k, rows)
    run_firsts(spark, tmp_path / "in", str(tmp_path / "out"))
    for k, rows in enumerate(batches[3:], 3):
        put(spark, tmp_path / "in", k, rows)
    got = run_firsts(spark, tmp_path / "in", str(tmp_path / "out"))
    kept, repeated, late = simulated_firsts(batches)
    assert sorted(((r.key.user, r.at_us) for r in got if r.kept), key=repr) == kept and len({u for u, _ in kept}) < len(kept) and None in {u for u, _ in kept}
    assert sum(r.n_repeated for r in got) == repeated and sum(r.n_late for r in got) == late > 0
    assert len(kept) + repeated + late == sum(s is not None for b in batches for _, s in b)
    for r in got:
        assert (r.first is None) != r.kept
        if r.kept:  # microseconds and columns named like the result's come back whole
            assert r.first.user == r.key.user and r.first.key == "own" and (r.first.ts - datetime(1970, 1, 1)) // timedelta(microseconds=1) == r.at_us


def test_first_rows_of_an_empty_stream_and_of_a_bad_horizon(spark, tmp_path):
    put(spark, tmp_path / "in", 0, [(1, None), (None, None)])
    assert run_firsts(spark, tmp_path / "in", str(tmp_path / "out")) == []
    events = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/b*")
    with pytest.raises(ValueError):
        first_rows(events, ["user"], "ts", DELAY, timedelta(seconds=1), [])


def test_pieces_of_a_hot_key_are_few():
    at = list(range(0, 100_000, 7))
    got = pieces(pd.DataFrame({"key": "k", "at": at, "first": [str(x) for x in at]}), 10_000)
    assert len(got) == 10 and got["n"].sum() == len(at) and got["at"].tolist() == [min(x for x in at if x // 10_000 == g) for g in range(10)]


def shared_state(spark, path):
    """Values of state in the checkpoint."""
    was = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        return spark.read.format("statestore").option("stateVarName", "keys").load(f"{path}/checkpoint").count()
    finally:
        spark.conf.unset(STORE[0]) if was is None else spark.conf.set(STORE[0], was)


def test_first_rows_of_many_keys_share_calls_and_state(spark, tmp_path):
    r = random.Random(11)
    batches = [[(r.randrange(60), k * 250 + round(r.uniform(0, 240) - (r.random() < 0.1) * 500, 3)) for _ in range(150)] for k in range(4)]
    for k, rows in enumerate(batches):
        put(spark, tmp_path / "in", k, rows)
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b*")
    got = to_table(first_rows(events, ["user"], "ts", DELAY, HORIZON, ["user"], buckets=3), "firsts", str(tmp_path / "out")).collect()
    kept, repeated, late = simulated_firsts(batches)
    assert sorted(((x.key.user, x.at_us) for x in got if x.kept), key=repr) == kept and len(kept) > len({u for u, _ in kept}) > 50
    assert sum(x.n_repeated for x in got) == repeated and sum(x.n_late for x in got) == late > 0
    assert 0 < shared_state(spark, tmp_path / "out") <= 3


def test_sessions_of_many_keys_share_calls_and_state(spark, tmp_path):
    r = random.Random(13)
    batches = [[(r.randrange(60), k * 250 + round(r.uniform(0, 240) - (r.random() < 0.1) * 500, 3)) for _ in range(150)] for k in range(4)]
    for k, rows in enumerate(batches):
        put(spark, tmp_path / "in", k, rows)
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b*")
    got = to_table(sessions(events, "user", "ts", GAP, DELAY, buckets=3), "sessions", str(tmp_path / "out")).collect()
    closed, late, open_ = simulated(batches)
    assert sorted((x.key, x.first_us, x.last_us, x.n_events) for x in got if not x.late) == closed and len({x[0] for x in closed}) > 50
    assert sum(x.n_events for x in got if x.late) == sum(n for _, n in late) > 0 and open_ > 3
    assert 0 < shared_state(spark, tmp_path / "out") <= 3


def test_session_keys_of_other_types(spark, tmp_path):
    """Keys come back as they were, from the state too; 0.0 and -0.0 are one."""
    kinds = "d double, s string, t timestamp, c decimal(20,4), b binary"
    at = datetime(1899, 12, 31, 23, 59, 59, 123456)
    keys = [(0.0, 'a"\\\n\u2028', at, Decimal("-1234567890123456.0001"), b"\0\xff"), (-0.0, "", at, Decimal("0.0000"), b"")]
    for k, far in enumerate((0, 1000)):
        spark.createDataFrame([(*key, EPOCH + timedelta(seconds=far)) for key in keys], f"{kinds}, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in/b{k:03}")
    for name in "dstcb":
        events = spark.readStream.schema(f"{kinds}, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b*")
        got = to_table(sessions(events, name, "ts", GAP, DELAY, buckets=1), "sessions")
        want = batch_sessions(spark.read.parquet(f"{tmp_path}/in/b000"), name, "ts", GAP)
        assert dict(got.dtypes)["key"] == dict(want.dtypes)["key"]
        assert sorted(tuple(x)[:4] for x in got.collect()) == sorted(map(tuple, want.collect())) and not got.filter("late").count()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()) and got.count()
