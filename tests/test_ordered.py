"""Values over a whole table in order, by spans, against one sort."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stratalog.operators import ordered as O

T0 = dt.datetime(2024, 3, 1)


def rows(n=300, seed=1):
    rnd = random.Random(seed)
    return [(i, None if rnd.random() < 0.03 else T0 + dt.timedelta(minutes=rnd.randrange(20_000)), rnd.choice(("a", "b", None)), rnd.choice((None, *range(9)))) for i in range(n)]


def test_ranks_neighbours_and_running_values_equal_one_sort(spark):
    data = rows()
    df = spark.createDataFrame(data, "i long, ts timestamp_ntz, g string, v long")
    order, span = [F.col("ts"), F.col("i")], O.hours(F.col("ts"), 7)
    for by in ((), ("g",)):
        out = O.row_numbers(df, span, order, "r", "n", by)
        out = O.previous(out, F.col("v"), span, order, "p", by)
        out = O.following(out, F.col("v"), span, order, "f", by)
        out = O.running(out, F.col("v"), span, order, "s", by=by)
        out = O.running(out, F.col("v"), span, order, "m", "max", own=False, by=by)
        got = {x.i: (x.r, x.n, x.p, x.f, x.s, x.m) for x in out.collect()}
        want = {}
        for g in ("a", "b", None) if by else ("all",):
            own = sorted((d for d in data if not by or d[2] == g), key=lambda d: (d[1] is not None, d[1] or T0, d[0]))
            total, most = None, None
            for k, (i, _, _, v) in enumerate(own):
                before = most
                total = total if v is None else v + (total or 0)
                most = most if v is None else v if most is None else max(v, most)
                want[i] = (k + 1, len(own), own[k - 1][3] if k else None, own[k + 1][3] if k + 1 < len(own) else None, total, before)
        assert got == want


def test_empty_table_and_scores(spark):
    df = spark.createDataFrame([], "ts timestamp_ntz, v long")
    assert O.row_numbers(df, O.hours(F.col("ts")), [F.col("ts")], "r", "n").count() == 0
    scores = spark.createDataFrame([(x,) for x in (0.0, 1.0, 0.5, -3.0, 7.0, None, float("nan"))], "s double")
    ranked = O.row_numbers(scores, O.slices(F.col("s")), [F.col("s")], "r").collect()
    assert [r.s for r in sorted(ranked, key=lambda r: r.r)][:6] == [None, -3.0, 0.0, 0.5, 1.0, 7.0]
