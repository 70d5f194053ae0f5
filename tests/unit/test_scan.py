"""Running values, windows and ranks on skewed domains: brute force, with cells so small that every carry counts."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import features, horizons, quantiles, spans
from strandline.operators.dominance import dual_clock_asof
from strandline.operators.pointers import reached
from strandline.operators.scan import CELL, Cells, scanned, with_predecessors


@pytest.fixture(scope="module")
def ticks():
    """One domain with nine tenths of all rows, bursts of equal times, times below 0, a domain of one row."""
    rng = random.Random(11)
    rows, key = [], 0
    for d, n in ((1, 900), (2, 99), (3, 1)):
        t = -500
        for _ in range(n):
            t += rng.choice([0, 0, 1, 1, 2, 3, 40])
            rows.append((d, t, key, rng.randint(-5, 9) if key % 13 else None))
            key += 1
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark, ticks):
    return spark.createDataFrame(ticks, "d long, t long, k long, v long")


def by_domain(ticks):
    out = {}
    for r in sorted(ticks):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize(("width", "most"), [(7, 4), (100, 3), (1_000_000, 10_000)])
def test_scan_equals_brute_force(frame, ticks, width, most):
    got = scanned(
        frame, ["d"], ["t", "k"], sums={"s": F.col("v")}, reach={"m": F.col("v")}, lags={"a": F.col("v")}, leads={"z": F.struct("t", "v")}, totals={"n": F.lit(1)}, width=width, most=most
    ).collect()
    assert len(got) == len(ticks)
    got = {r.k: r for r in got}
    for rows in by_domain(ticks).values():
        total, top = 0, None
        for i, (_, _, k, v) in enumerate(rows):
            total += v or 0
            assert (got[k].s, got[k].m, got[k].n) == (total, top, len(rows))
            assert got[k].a == (rows[i - 1][3] if i else None)
            assert (tuple(got[k].z) if got[k].z else None) == (rows[i + 1][1::2] if i + 1 < len(rows) else None)
            top = v if top is None else top if v is None else max(top, v)


def test_cells_keep_the_order_and_split_dense_ones(frame):
    cells = Cells(frame, ["d"], "t", 1000, 50).put(frame, "t")
    rows = cells.where("d = 1").select("t", CELL).orderBy("t").collect()
    assert [r[CELL] for r in rows] == sorted(r[CELL] for r in rows) and len({r[CELL] for r in rows}) > 20
    assert cells.groupBy("t", "d").agg(F.count_distinct(CELL).alias("n")).where("n > 1").isEmpty()


def test_no_window_spans_a_domain(frame):
    """Rows go to windows by domain and cell; by the domain alone only the cells' totals do."""
    plan = scanned(frame, ["d"], ["t", "k"], sums={"s": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert exchanges and all("_cell" in line or "_own" not in line for line in exchanges)


@pytest.mark.parametrize(("width", "most"), [(5, 3), (1_000_000, 10_000)])
def test_predecessors_and_autocorrelation(frame, ticks, width, most):
    got = {r.k: r.previous for r in with_predecessors(frame, ["d"], ["t", "k"], F.col("v"), 4, width=width, most=most).collect()}
    sums = {(r.d, r.lag): r for r in features.autocorrelation(frame.withColumn("b", F.abs(F.coalesce("v", F.lit(0))) % 2), ["d"], ["t", "k"], "b", 3, width).collect()}
    for d, rows in by_domain(ticks).items():
        for i, r in enumerate(rows):
            assert got[r[2]] == [x[3] for x in reversed(rows[max(0, i - 4) : i])]
        assert all(sums[d, lag].pairs == max(0, len(rows) - lag) for lag in (1, 2, 3))


def test_gaps_intervals_and_halves(frame, ticks):
    got = {r.k: r for r in spans.bad_gaps(frame, ["d"], "t", 10, ["k"], width=9).collect()}
    half = {r.k: r.half for r in horizons.halves(frame, ["d"], ["t", "k"], width=9).collect()}
    intervals = frame.select("d", F.col("t").alias("a"), (F.col("t") + F.abs(F.coalesce("v", F.lit(0))) * 3).alias("z"))
    merged = {(r.d, r.a, r.z) for r in spans.merged(intervals, ["d"], "a", "z", width=11).collect()}
    over = sorted((r.d, r.a, r.z, r.previous_end) for r in spans.overlaps(intervals, ["d"], "a", "z", width=11).collect())
    want, met = set(), []
    for d, rows in by_domain(ticks).items():
        bad = 0
        for i, r in enumerate(rows):
            step = r[1] - rows[i - 1][1] if i else None
            bad += step is not None and step > 10
            assert (got[r[2]].step, got[r[2]].bad_before) == (step, bad)
            assert half[r[2]] == ("EARLY" if i < len(rows) // 2 else "LATE")
        spans_ = sorted((r[1], r[1] + abs(r[3] or 0) * 3) for r in rows)
        met += [(d, *b, a[1]) for a, b in zip(spans_, spans_[1:], strict=False) if b[0] <= a[1]]
        at = None
        for a, z in spans_:
            if at is None or a > at[1]:
                if at:
                    want.add((d, *at))
                at = [a, z]
            at[1] = max(at[1], z)
        want.add((d, *at))
    assert merged == want and over == sorted(met)


def test_running_flow_of_one_domain(spark):
    rng = random.Random(3)
    rows = [("x", rng.randint(0, 300), rng.choice(["buy", "sell", "unknown"]), rng.randint(1, 9)) for _ in range(700)] + [("y", 5, "buy", 2)]
    flow = features.running_flow(spark.createDataFrame(rows, "dom string, us long, side string, size long"), ["dom"], width=13).collect()
    assert len(flow) == len({r[:2] for r in rows})
    for r in flow:
        assert [r.buy, r.sell, r.unknown] == [sum(s for d, u, k, s in rows if d == r.dom and u <= r.us and k == side) for side in ("buy", "sell", "unknown")]


def brute_greedy(rows, horizon, most):
    out, i = [], 0
    while i < len(rows):
        j = next((j for j in range(i + 1, len(rows)) if rows[j][1] >= rows[i][1] + horizon), None)
        if j is None:
            return [*out, (rows[i][0], rows[i][2], None, None)]
        out.append((rows[i][0], rows[i][2], rows[j][2], any(rows[x + 1][1] - rows[x][1] > most for x in range(i, j))))
        i = j + 1
    return out


def brute_touching(rows, horizon, tolerance):
    out, i = [], 0
    while i < len(rows) and rows[i][1] + horizon <= rows[-1][1]:
        j = next(j for j in range(i + 1, len(rows)) if rows[j][1] >= rows[i][1] + horizon)
        over = rows[j][1] - rows[i][1] - horizon > tolerance
        out.append((rows[i][0], rows[i][2], rows[j][2], over))
        i = i + 1 if over else j
    return out


@pytest.mark.parametrize("width", [3, 50, None])
def test_greedy_windows_equal_the_walk(frame, ticks, width):
    domains = by_domain(ticks)
    for horizon in (1, 25):
        a = horizons.greedy(frame, ["d"], "t", "k", horizon, 10, width=width, bucket=30).collect()
        assert sorted((r.d, r.entry_key, r.exit_key, r.has_gap) for r in a) == sorted(x for rows in domains.values() for x in brute_greedy(rows, horizon, 10))
    b = horizons.touching(frame, ["d"], "t", "k", 25, 4, width=width, bucket=30).collect()
    assert sorted((r.d, r.entry_key, r.exit_key, r.excluded) for r in b) == sorted(x for rows in domains.values() for x in brute_touching(rows, 25, 4))


def test_windows_of_days_and_of_an_empty_table(spark, frame):
    day = frame.withColumn("day", F.expr("t div 100"))
    rows = horizons.greedy(day, ["d", "day"], "t", "k", 30, 10, width=40, bucket=30).collect()
    at = {r.k: r.day for r in day.collect()}
    assert rows and all(at[r.entry_key] == r.day and (r.exit_key is None or at[r.exit_key] == r.day) for r in rows)
    none = spark.createDataFrame([], frame.schema)
    assert horizons.greedy(none, ["d"], "t", "k", 30, 10).count() == 0 and horizons.touching(none, ["d"], "t", "k", 30, 1).count() == 0


def test_pointers_with_several_levels(spark):
    rng = random.Random(5)
    n = 3000
    to = [rng.randint(i + 1, i + 40) for i in range(n)]
    rows = [("a", i, f"k{i}", to[i] if to[i] < n else None, f"k{to[i]}" if to[i] < n else None) for i in range(n)]
    df = spark.createDataFrame(rows, "d string, t long, k string, tt long, tk string")
    want, i = set(), 0
    while i < n:
        want.add(f"k{i}")
        i = to[i]
    for width, most in ((1, 100), (8, 100), (200, 16)):
        assert {r.k for r in reached(df, ["d"], "t", "k", "tt", "tk", width, most).collect()} == want


def test_walks_take_few_rows_at_a_time(spark, tmp_path, monkeypatch):
    """What Python holds at once does not grow with the table."""
    from strandline.operators import pointers

    steps_of, folder = pointers.steps_of, str(tmp_path)

    def counted(cells, key, groups):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(cells)))
        return steps_of(cells, key, groups)

    monkeypatch.setattr(pointers, "steps_of", counted)
    n, each = 300_000, 100
    k, last = F.col("id"), F.col("id") % each == each - 1
    rows = spark.range(n).select(F.expr(f"id div {each}").alias("d"), (k % each).alias("t"), k.alias("k"), F.when(~last, k % each + 1).alias("tt"), F.when(~last, k + 1).alias("tk"))
    assert reached(rows, ["d"], "t", "k", "tt", "tk", each).count() == n
    seen = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(seen) >= n and max(seen) < 1.5 * (1 << 15)


def test_walks_over_dense_rows_take_few_at_a_time(spark, tmp_path, monkeypatch):
    """All rows are pointed to from outside their cell; no task takes them together, however many cells a horizon has."""
    from strandline.operators import pointers

    steps_of, folder = pointers.steps_of, str(tmp_path)

    def counted(cells, key, groups):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(cells)))
        return steps_of(cells, key, groups)

    monkeypatch.setattr(pointers, "steps_of", counted)
    n, horizon, most = 120_000, 3_000, 1_000
    k, last = F.col("id"), F.col("id") >= n - horizon
    rows = spark.range(n).select(F.lit("a").alias("d"), k.alias("t"), k.alias("k"), F.when(~last, k + horizon).alias("tt"), F.when(~last, k + horizon).alias("tk"))
    assert sorted(r.k for r in reached(rows, ["d"], "t", "k", "tt", "tk", 64 * horizon, most).collect()) == list(range(0, n, horizon))
    seen = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(seen) >= n and max(seen) <= 24 * most


@pytest.mark.parametrize("most", [5, 40, 10_000])
def test_ranks_of_large_groups(spark, most):
    """Groups of many distinct values, of one value for nearly all rows, and of one row, through ever smaller ranges."""
    rng = random.Random(8)
    groups = {"wide": [rng.randint(-(10**12), 10**12) for _ in range(700)], "flat": [7] * 500 + [rng.randint(0, 20) for _ in range(60)], "one": [3], "two": [1, 2], "steep": [2**k for k in range(50)] * 3}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("null", None), ("flat", None)], "g string, v long")
    near = {r.g: r for r in quantiles.nearest_ranks(df, ["g"], "v", ["0.01", "0.5", "0.95", "1"], ["a", "b", "c", "d"], most).collect()}
    seven = {r.g: r for r in quantiles.type7(df, ["g"], "v", ["0.9"], ["q"], most).collect()}
    middle = {r.g: r.twice_median for r in quantiles.median(df, ["g"], "v", most=most).collect()}
    assert set(near) == set(groups)
    for g, vs in groups.items():
        s, n = sorted(vs), len(vs)
        assert (near[g].n, near[g].a, near[g].b, near[g].c, near[g].d) == (n, s[-(-n // 100) - 1], s[-(-n // 2) - 1], s[-(-n * 95 // 100) - 1], s[-1])
        k, f = divmod((n - 1) * 9, 10)
        assert seven[g].q == pytest.approx(s[k] + (s[min(k + 1, n - 1)] - s[k]) * f / 10)
        assert middle[g] == s[(n - 1) // 2] + s[n // 2]
    whole = sorted(v for vs in groups.values() for v in vs)
    assert quantiles.chronological_edge(df, "v", most).first().edge == whole[len(whole) // 2 - 1]
    assert quantiles.chronological_edge(df.where("g = 'one'"), "v").isEmpty()


@pytest.mark.parametrize(("width", "most", "lookback"), [(3, 4, None), (10, 1000, 60), (10**9, 1000, None)])
def test_two_clocks_equal_brute_force(spark, width, most, lookback):
    """Walls that run far back, equal clocks, a domain with nine tenths of all rows, cells of several levels."""
    rng = random.Random(6)
    domain = lambda: "big" if rng.random() < 0.9 else rng.choice(["small", "left"])
    right = [(k, domain().replace("left", "right"), m := rng.randint(-50, 900), m + rng.choice([0, 0, 5, 300, -40, 2000])) for k in range(300)] + [(900, "big", None, 5), (901, "big", 5, None)]
    left = [(k, domain(), m := rng.randint(-60, 1000), rng.choice([m, m, m - 700, m + 10])) for k in range(300)] + [(800, "big", None, 3), (801, "big", 3, None)]
    lf, rf = spark.createDataFrame(left, "l long, d string, m long, w long"), spark.createDataFrame(right, "r long, d string, rm long, rw long")
    rows = dual_clock_asof(lf, rf, ["d"], "m", "w", "rm", "rw", ["r", "rm"], ["r"], lookback, width=width, most=most).collect()
    assert len(rows) == len(left)
    got = {r.l: r.r_r for r in rows}
    for k, d, m, w in left:
        ok = [(rm, rw, r) for r, e, rm, rw in right if e == d and None not in (rm, rw, m, w) and rm <= m and rw <= w]
        best = max(ok, default=None)
        assert got[k] == (best[2] if best and (lookback is None or m - best[0] <= lookback) else None)
