import random
from datetime import datetime, timedelta

from twintable.operators.sessions import sessionize, visits_report
from twintable.streaming.sessions import IntervalState, stream_sessions

T0 = datetime(2026, 5, 1, 12)
SCHEMA = "event_id string, user_id string, event_timestamp timestamp_ntz, session_id string, user string, us int"


def row(i, user, minutes, us=0):
    return (i, user, None if minutes is None else T0 + timedelta(minutes=minutes, microseconds=us), "s", "clash", 1)


def visits(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((r.user_id, r.session_start[11:], r.session_end[11:], r.event_count) for r in visits_report(sessionize(df)).collect())


def test_gap_of_exactly_30_minutes_does_not_split(spark):
    got = visits(spark, [row("a", "u", 0), row("b", "u", 30), row("c", "u", 60, 1)])
    assert got == [("u", "12:00:00.000", "12:30:00.000", 2), ("u", "13:00:00.000", "13:00:00.000", 1)]


def test_redelivered_late_and_unusable_rows(spark):
    rows = [row("b", "u", 20), row("a", "u", 0), row("a", "u", 0), row("c", "", 1), row("d", None, 1), row("e", "u", None), row("f", "v", 5), row("g", "v", 5)]
    assert visits(spark, rows) == [("u", "12:00:00.000", "12:20:00.000", 2), ("v", "12:05:00.000", "12:05:00.000", 2)]


def test_null_event_ids_are_different_events(spark):
    assert visits(spark, [row(None, "u", 0), row(None, "u", 0)])[0][3] == 2


def test_empty(spark):
    assert visits(spark, []) == []


def test_hot_user_against_brute_force(spark):
    rnd = random.Random(3)
    times = sorted(rnd.randrange(0, 60 * 24 * 20) for _ in range(800))
    want, start, last, n = [], times[0], times[0], 0
    for t in times:
        if t - last > 30:
            want.append(n)
            n = 0
        n, last = n + 1, t
    want.append(n)
    rows = [row(str(i), "hot", t) for i, t in enumerate(times)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r.event_count for r in sessionize(df).orderBy("start_us").collect()]
    assert got == want


def stream(spark, folder, batches, **options):
    """Visits after each batch of rows, which come as files of a stream."""
    schema = spark.createDataFrame([], SCHEMA).schema
    (folder / "in").mkdir()
    out = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        state = stream_sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")), str(folder / "work"), **options)
        out.append(sorted(map(tuple, state.visits().collect())))
    return state, out


def test_stream_agrees_with_batch_late_and_redelivered_events_included(spark, tmp_path):
    rnd = random.Random(9)
    whole = [row(str(i), rnd.choice(["u", "v", "w"]), rnd.randrange(0, 60 * 48)) for i in range(150)]
    whole.sort(key=lambda r: (r[2], r[0]))
    for _ in range(25):  # some come much later than the watermark allows
        whole.append(whole.pop(rnd.randrange(100)))
    whole += rnd.sample(whole, 10) + [row(None, "u", 5), row(None, "u", 5), row("x", None, 5), row("y", "", 5), row("z", "u", None)]
    batches = [whole[i : i + 50] for i in range(0, len(whole), 50)]
    state, out = stream(spark, tmp_path, batches, lateness_minutes=60)
    for k, got in enumerate(out):
        df = spark.createDataFrame([r for b in batches[: k + 1] for r in b], SCHEMA)
        assert got == sorted(map(tuple, sessionize(df).collect()))
    assert state._read("taken").count() > 0 and state._read("closed").count() > 0


def test_stream_of_nothing_usable(spark, tmp_path):
    _, out = stream(spark, tmp_path, [[row("x", None, 5)], []])
    assert out == [[], []]


def test_batch_that_runs_again_changes_nothing(spark, tmp_path):
    state = IntervalState(spark, str(tmp_path), lateness_minutes=0)
    first = spark.createDataFrame([row("a", "u", 0), row("b", "u", 200)], SCHEMA)
    state.advance(first, 0)
    late = spark.createDataFrame([row("c", "u", 20), row("a", "u", 0), row(None, "u", 40)], SCHEMA)
    for _ in range(2):
        state.advance(late, 1)
        assert sorted(r.event_count for r in state.visits().collect()) == [1, 3]
