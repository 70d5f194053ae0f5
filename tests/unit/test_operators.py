"""Cases that the tables do not hold."""

import gzip
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strandline.functions import prices, statistics, text
from strandline.operators import features, horizons, models, normalize, publish, quantiles, simulate, spans
from strandline.operators.asof import asof_join
from strandline.operators.dominance import dual_clock_asof
from strandline.sources import archives, rawlog


def test_asof_equals_brute_force(spark):
    rng = random.Random(4)
    left = [(k, rng.randint(0, 2), rng.randint(0, 60)) for k in range(60)]
    right = [(k, rng.randint(0, 2), rng.randint(0, 60)) for k in range(50)]
    lf, rf = spark.createDataFrame(left, "l long, d long, t long"), spark.createDataFrame(right, "r long, d long, u long")
    for forward in (False, True):
        for strict in (False, True):
            for bucket in (None, 7):
                got = {x.l: x.m_r for x in asof_join(lf, rf, ["d"], "t", "u", ["r"], ties=["r"], prefix="m_", bucket=bucket, forward=forward, strict=strict).collect()}
                assert len(got) == len(left)
                for k, d, t in left:
                    ok = [(u, r) for r, e, u in right if e == d and ((u > t or u == t and not strict) if forward else (u < t or u == t and not strict))]
                    want = (min(ok) if forward else max(ok))[1] if ok else None
                    assert got[k] == want, (forward, strict, bucket, k)


def test_dual_clock(spark):
    left = spark.createDataFrame([(1, "a", 100, 1000)], "l long, d string, m long, w long")
    # The same mono with a future wall clock is barred, and so is another domain; the best of the rest is found.
    right = spark.createDataFrame([(1, "a", 90, 900), (2, "a", 100, 1001), (3, "b", 99, 999), (4, "a", 101, 900), (5, "a", 89, 1000)], "r long, d string, rm long, rw long")
    got = dual_clock_asof(left, right, ["d"], "m", "w", "rm", "rw", ["r"], ["r"], 50).collect()
    assert [x.r_r for x in got] == [1]
    assert [x.r_r for x in dual_clock_asof(left, right, ["d"], "m", "w", "rm", "rw", ["r"], ["r"], 9).collect()] == [None]


def test_hand_checked_values(spark):
    # Buys of 10 and sells of 5 less 4 and 3 before the window: (6 - 2) / 8.
    trades = spark.createDataFrame([("d", 0, "buy", 4), ("d", 0, "sell", 3), ("d", 50, "buy", 6), ("d", 60, "sell", 2)], "dom string, us long, side string, size long")
    at = spark.createDataFrame([(1, "d", 60), (2, "d", 49), (3, "e", 60)], "k long, dom string, us long")
    got = {r.k: r.flow for r in features.trade_flow(at, trades, ["dom"], "k", "us", 20).collect()}
    assert got == {1: 0.5, 2: None, 3: None}
    row = spark.range(1).select(prices.imbalance(F.lit(2), F.lit(1)), prices.return_bps(F.lit(100), F.lit(101)), prices.imbalance(F.lit(0), F.lit(0))).first()
    assert row[0] == pytest.approx(1 / 3) and row[1] == 100 and row[2] is None


def test_horizon_rules(spark):
    ticks = spark.createDataFrame([("d", 10 * k, k) for k in range(11)], "d string, t long, k long")
    a = horizons.greedy(ticks, ["d"], "t", "k", 50, 15).orderBy("entry_time").collect()
    assert [(r.entry_key, r.exit_key) for r in a] == [(0, 5), (6, None)]
    b = horizons.touching(ticks, ["d"], "t", "k", 50, 1).orderBy("entry_time").collect()
    assert [(r.entry_key, r.exit_key, r.excluded) for r in b] == [(0, 5, False), (5, 10, False)]
    c = horizons.overlapping(ticks, ["d"], "t", "k", 50).collect()
    assert {r.k: r.exit_k for r in c} == {k: k + 5 if k < 6 else None for k in range(11)}
    gap = spark.createDataFrame([("d", t, k) for k, t in enumerate([0, 10, 40, 50, 60])], "d string, t long, k long")
    assert horizons.greedy(gap, ["d"], "t", "k", 50, 15).orderBy("entry_time").first().has_gap


def test_quantiles_of_small_groups(spark):
    rng = random.Random(9)
    groups = {g: [rng.randint(0, 9) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 20), ("d", 37))}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("e", None)], "g string, v long")
    near = {r.g: r for r in quantiles.nearest_ranks(df, ["g"], "v", ["0.95", "0.05", "1"], ["hi", "lo", "top"]).collect()}
    seven = {r.g: r.q for r in quantiles.type7(df, ["g"], "v", ["0.25"], ["q"]).collect()}
    middle = {r.g: r.median for r in quantiles.median(df, ["g"], "v").collect()}
    assert "e" not in near
    for g, vs in groups.items():
        s, n = sorted(vs), len(vs)
        rank = lambda p: s[int((Decimal(p) * n).to_integral_value(rounding="ROUND_CEILING")) - 1]  # noqa: E731, B023
        assert (near[g].hi, near[g].lo, near[g].top) == (rank("0.95"), rank("0.05"), s[-1])
        k, f = divmod((n - 1) * 0.25, 1)
        assert seven[g] == pytest.approx(s[int(k)] + (s[min(int(k) + 1, n - 1)] - s[int(k)]) * f)
        assert middle[g] == (s[(n - 1) // 2] + s[n // 2]) / 2


def test_intervals(spark):
    df = spark.createDataFrame([("x", 0, 5), ("x", 5, 7), ("x", 9, 12), ("x", 10, 11), ("y", 1, 2)], "g string, a long, z long")
    assert {(r.g, r.a, r.z) for r in spans.merged(df, ["g"], "a", "z").collect()} == {("x", 0, 7), ("x", 9, 12), ("y", 1, 2)}
    assert {(r.a, r.previous_end) for r in spans.overlaps(df, ["g"], "a", "z").collect()} == {(5, 5), (10, 12)}


def test_statistics_constants():
    assert statistics.dkw_count("0.95", "0.025") == 2952
    assert [statistics.power_count(a, z_alpha=1.959963984540054) for a in (0.55, 0.54)] == [783, 1225]
    assert statistics.upper_tail(3, 4) == Decimal(5) / 16 and statistics.upper_tail(0, 4) == 1
    assert statistics.grid_125(2, 100) == [2, 5, 10, 20, 50, 100] and statistics.next_125(20) == 50
    assert statistics.solve([[4, 2], [2, 3]], [8, 8]) == [1, 2] and statistics.solve([], []) == []
    with pytest.raises(ValueError):
        statistics.solve([[1, 2], [2, 1]], [1, 1])
    for k, n in ((1_010, 2_001), (900, 2_001), (2_001, 2_001), (0, 2_001), (2_002, 2_001)):
        exact = sum(statistics.math.comb(n, j) for j in range(k, n + 1)) / 2**n
        assert abs(float(statistics.upper_tail(k, n)) - exact) <= 1e-9 * exact
    assert 0.49 < statistics.upper_tail(5_000_001, 10_000_001) < 0.51
    assert statistics.buffered_count(783, "0.868") == 903


def test_simulator(spark):
    rows = [(1, 100, 101, 103, 104, [], "LONG"), (2, 100, 101, 103, 104, [], "SHORT"), (3, 100, 101, 103, 104, [], "ABSTAIN"), (4, 100, 101, None, None, ["MISSING_EXIT_QUOTE"], "LONG")]
    o = spark.createDataFrame(rows, "opportunity_id long, entry_bid long, entry_ask long, exit_bid long, exit_ask long, invalid_reasons array<string>, action string")
    led = {r.opportunity_id: r for r in simulate.run(o).collect()}
    assert [led[k].status for k in (1, 2, 3, 4)] == ["TRADED", "TRADED", "NO_TRADE", "INVALID"]
    assert (led[1].gross, led[2].gross, led[3].gross, led[4].gross) == (2, -4, 0, None)
    assert led[1].fee_micro == (101 + 103) * 450 and led[1].business_net_micro is None and led[3].business_net_micro == 0
    assert led[1].unknown_costs == ["FUNDING", "IMPACT", "SLIPPAGE"]
    known = simulate.run(o, simulate.Costs(450, 0, 0, 0))
    assert simulate.summary(known).first().business_net_micro == 2_000_000 - 204 * 450 - 4_000_000 - 204 * 450
    assert simulate.summary(simulate.run(o)).first().business_net_micro is None
    assert simulate.violations(simulate.run(o)).count() == 0 and simulate.repeated(o).count() == 0


def test_logistic_is_stationary(spark):
    rng = random.Random(2)
    rows = [(a := rng.gauss(0, 1), b := rng.gauss(5, 3), int(rng.random() < 1 / (1 + 2.7 ** -(a - 0.2 * b + 1)))) for _ in range(400)] + [(None, 1.0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    m = models.fit_logistic(df, ["a", "b"], "y")
    assert m.converged and m.iterations < 20
    p = df.dropna().select("y", m.probability().alias("p"), *[((F.col(f) - mu) / s).alias(f) for f, mu, s in zip(m.features, m.means, m.deviations, strict=True)])
    g = p.agg(F.sum(F.col("y") - F.col("p")), *[F.sum((F.col("y") - F.col("p")) * F.col(f)) for f in m.features]).first()
    assert abs(g[0]) < 1e-8 and all(abs(g[k + 1] - m.weights[k + 1]) < 1e-8 for k in range(2))


def test_gates():
    assert models.movement_gate(2.0, 1.0, 10, 10).status == "PASS" and models.movement_gate(1.0, 1.0, 10, 10).status == "FAIL"
    assert models.movement_gate(2.0, 1.0, 9, 10).status == "INCONCLUSIVE"
    good = {"evaluable": 800, "lower_bound": 0.6, "p_value": 0.001, "mean_net": 2.0}
    got = models.selection_gate({"a": good, "b": good | {"mean_net": -1.0, "p_value": 0.5}}, [0.5], 783, 0.025)
    assert got["a"].status == "PASS" and got["b"].codes == ("NOT_SIGNIFICANT", "NET_NOT_POSITIVE", "NOT_ABOVE_CONTROLS")
    assert {v.status for v in models.selection_gate({"a": good, "b": good | {"evaluable": 1}}, [], 783, 0.025).values()} == {"INCONCLUSIVE"}


def frame(source, seq, payload):
    return {"source_id": source, "recv_wall_ns": 10 + seq, "recv_mono_ns": 100 * seq, "host_id": "h", "boot_id": "b", "connection_id": "c", "ingest_seq": seq, "channel_hint": None, "capture_flags": ["LIVE_CAPTURE"], "schema_version": 1}, json.dumps(payload).encode()


def test_feed_payloads(spark):
    ok = {"coin": "X", "side": "A", "px": "100.5000", "sz": "2", "hash": "h", "time": 5, "tid": 7, "users": ["a", "b"]}
    payloads = [
        {"channel": "trades", "data": [ok, ok | {"side": "B", "tid": 8}]}, {"channel": "trades", "data": [ok, ok | {"px": "-1"}]}, {"channel": "trades", "data": []},
        {"channel": "bbo", "data": {"coin": "X", "time": 1, "bbo": [{"px": "1.0", "sz": "2", "n": 1}, None]}},
        {"channel": "l2Book", "data": {"coin": "X", "time": 1, "levels": [[{"px": "2", "sz": "1", "n": 1}, {"px": "1", "sz": "1", "n": 1}], [{"px": "3", "sz": "1", "n": 1}]]}},
        {"channel": "activeAssetCtx", "data": {"coin": "X", "ctx": {"funding": "0.0000100", "markPx": "1", "oraclePx": "2"}}},
        {"channel": "activeAssetCtx", "data": {"coin": "X", "ctx": {"funding": 0.1, "markPx": "1", "oraclePx": "2"}}},
        {"stream": "s", "data": {"e": "bookTicker", "s": "XY", "b": "1", "B": "2", "a": "3", "A": "4", "T": 9}},
        {"stream": "s", "data": {"e": "aggTrade", "s": "XY", "p": "1", "q": "2", "a": 3, "T": 9, "m": True}}, {"channel": "pong"}, {"channel": "subscriptionResponse"},
    ]
    df = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(payloads)] + [(99, "{no json"), (100, None)], "k long, payload string")
    out = {r.k: (r.outcome, r.error) for r in normalize.trade_frames(df).collect()}
    assert out[0] == ("EVENTS", None) and out[1] == ("ERROR", "BAD_PRICE") and out[2] == ("EMPTY", None) and out[99][0] == "NOT_APPLICABLE"
    assert [(r.price_exact, r.aggressor_side, r.trade_id) for r in normalize.trade_events(df, "k").orderBy("ordinal").collect()] == [("100.5000", "SELL", "5:X:7"), ("100.5000", "BUY", "5:X:8")]
    assert [(r.bid_exact, r.ask_exact) for r in normalize.bbo_events(df, "k").collect()] == [("1.0", None)]
    assert {(r.side, r.level, r.price_exact) for r in normalize.book_levels(df, "k").collect()} == {("BID", 0, "2"), ("BID", 1, "1"), ("ASK", 0, "3")}
    assert {(r.event_type, r.value_exact) for r in normalize.context_events(df, "k").collect()} == {("FUNDING_RATE", "0.0000100"), ("MARK_PRICE", "1"), ("ORACLE_PRICE", "2")}
    assert normalize.ticker_events(df, "k").first().bid_size_exact == "2" and normalize.aggregate_trades(df, "k").first().aggressor_side == "SELL"
    kinds = {r.k: r.c for r in df.select("k", normalize.classify(F.col("payload")).alias("c")).collect()}
    assert (kinds[0], kinds[7], kinds[9], kinds[10], kinds[99]) == ("MARKET", "MARKET", "PONG", "ACK", "MALFORMED")


def test_raw_log(spark, tmp_path):
    good = [rawlog.encode(*frame("a", k, {"n": k})) for k in range(3)]
    (tmp_path / "one.rawlog").write_bytes(b"".join(good))
    (tmp_path / "torn.rawlog").write_bytes(b"".join(good)[:-5])
    (tmp_path / "bad.rawlog").write_bytes(good[0] + good[1][:40] + b"\xff" + good[1][41:])
    got = {r.segment: r for r in rawlog.audit(rawlog.raw_frames(spark, str(tmp_path), audit=True)).collect()}
    assert {k: (r.valid_frames, r.tail_state) for k, r in got.items()} == {"one.rawlog": (3, "CLEAN"), "torn.rawlog": (2, "INCOMPLETE"), "bad.rawlog": (1, "CORRUPT")}
    with pytest.raises(Exception, match="record at byte"):
        rawlog.raw_frames(spark, str(tmp_path)).count()
    assert rawlog.recover(str(tmp_path / "torn.rawlog")) == "INCOMPLETE" and rawlog.recover(str(tmp_path / "torn.rawlog")) == "CLEAN"
    assert rawlog.recover(str(tmp_path / "bad.rawlog")) == "CORRUPT"
    (tmp_path / "bad.rawlog").unlink()
    frames = rawlog.raw_frames(spark, str(tmp_path))
    frames.drop("tail_state").withColumn("tail_state", F.lit("CLEAN")).write.format("rawlog").mode("append").save(str(tmp_path / "copy"))
    assert rawlog.raw_frames(spark, str(tmp_path / "copy")).count() == 5


def test_two_appends_keep_both_and_streams_read_each_once(spark, tmp_path):
    spark.dataSource.register(rawlog.RawLog)
    folder = str(tmp_path / "log")

    def append(k):
        (tmp_path / f"in{k}").mkdir()
        (tmp_path / f"in{k}" / "x.rawlog").write_bytes(rawlog.encode(*frame("a", k, {"n": k})))
        rawlog.raw_frames(spark, str(tmp_path / f"in{k}")).withColumn("tail_state", F.lit("CLEAN")).write.format("rawlog").mode("append").save(folder)

    def seen():
        query = spark.readStream.format("rawlog").load(folder).select("ingest_seq").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.ingest_seq for r in spark.read.schema("ingest_seq long").parquet(str(tmp_path / "out")).collect())

    append(1)
    append(2)
    assert sorted(r.ingest_seq for r in rawlog.raw_frames(spark, folder).collect()) == [1, 2] == seen()
    append(3)
    assert seen() == [1, 2, 3]
    assert len(rawlog.sealed(folder)) == 3 and not [p for p in (tmp_path / "log").iterdir() if p.name.endswith(".part")]


def test_archives(spark, tmp_path):
    lines = ["exchange,symbol,timestamp,local_timestamp,id,side,price,amount", "v,S,1704067200000000,1704067200000001,a,buy,100.5,2", "v,S,1704067200000000,1704067200000000,b,sell,101,0.1"]
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    rows = archives.read_archive(spark, str(tmp_path / "t.csv.gz"), "trades")
    assert [(r.source_row_number, r.trade_id, r.price) for r in rows.orderBy("source_row_number").collect()] == [(0, "a", Decimal("100.5")), (1, "b", Decimal(101))]
    s = archives.archive_stats(rows, "2024-01-01").first()
    assert (s.n, s.reversals, s.outside) == (2, 1, 0)
    archives.store_archive(rows, str(tmp_path / "lake"), "trades")
    assert archives.views(spark, str(tmp_path / "lake"))["v_trades"].count() == 2


def test_publication_is_write_once_and_independent_of_order(spark, tmp_path):
    a = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "k long, v string")
    root = f"file://{tmp_path}/out"
    first = publish.publish({"t": a}, {"t": ["k"]}, root)
    again = publish.publish({"t": a.repartition(7).orderBy(F.desc("k"))}, {"t": ["k"]}, root)
    other = publish.publish({"t": a.where("k > 0")}, {"t": ["k"]}, root)
    assert first == again != other
    back = publish.load_published(spark, f"{root}/{first['bundle_sha256']}", {"t": a.schema})
    assert back["t"].count() == 50


def test_texts(spark):
    df = spark.createDataFrame([(" Foo--Bar! ", "-0.00"), ("__a__", "1.500"), (None, "1e5")], "s string, d string")
    got = [(r[0], r[1]) for r in df.select(text.slug(F.col("s")), text.plain_decimal(F.col("d"))).collect()]
    assert got == [("foo_bar", "0.00"), ("a", "1.500"), (None, None)]


def test_capture_to_published_dataset(spark, tmp_path):
    """The canonical scenario: nine frames of two sources give eight events, two control frames and one error."""
    from strandline.operators import materialize

    trade = {"coin": "X", "side": "A", "px": "100.5000", "sz": "2", "hash": "h", "time": 5, "tid": 7, "users": ["a", "b"]}
    a = [
        {"channel": "bbo", "data": {"coin": "X", "time": 1, "bbo": [{"px": "1.0", "sz": "2", "n": 1}, {"px": "2", "sz": "1", "n": 1}]}},
        {"channel": "trades", "data": [trade]}, {"channel": "trades", "data": [trade]},
        {"channel": "activeAssetCtx", "data": {"coin": "X", "ctx": {"funding": "0.0000100", "markPx": "1", "oraclePx": "2"}}},
        {"channel": "subscriptionResponse"}, {"channel": "trades", "data": [trade | {"sz": 3, "side": "?"}]},
    ]
    b = [{"stream": "s", "data": {"e": "bookTicker", "s": "XY", "b": "1", "B": "2", "a": "3", "A": "4", "T": 9}}, {"stream": "s", "data": {"e": "aggTrade", "s": "XY", "p": "1", "q": "2", "a": 3, "T": 9, "m": True}}, {"result": None, "id": 1}]
    (tmp_path / "a.rawlog").write_bytes(b"".join(rawlog.encode(*frame("a", k, p)) for k, p in enumerate(a)))
    (tmp_path / "b.rawlog").write_bytes(b"".join(rawlog.encode(*frame("b", k, p)) for k, p in enumerate(b)))
    frames = rawlog.raw_frames(spark, str(tmp_path))
    got = {(r.what, r.name): r.n for r in materialize.report(materialize.normalized(frames)).collect()}
    assert {k[1]: n for k, n in got.items() if k[0] == "outcome"} == {"EVENTS": 6, "NOT_APPLICABLE": 2, "ERROR": 1}
    assert sum(n for k, n in got.items() if k[0] == "event_type") == 8 and sum(k[0] == "domain" for k in got) == 1
    root = f"file://{tmp_path}/out"
    one = materialize.publish_normalized(frames, root)
    assert len(one["tables"]) == 11 and one["tables"]["trades"]["rows"] == 2 and one["tables"]["events"]["rows"] == 8
    assert materialize.publish_normalized(frames.repartition(5), root) == one


def test_report_of_frames_counts_what_the_tables_hold(spark, tmp_path):
    """Odd frames: the header and the report agree with the typed tables."""
    from strandline.operators import materialize

    trade = {"coin": "X", "side": "A", "px": "100.5000", "sz": "2", "hash": "h", "time": 5, "tid": 7, "users": ["a", "b"]}
    side, level = {"px": "1.0", "sz": "2", "n": 1}, {"px": "1", "sz": "2", "n": 3}
    bbo = lambda *x: {"channel": "bbo", "data": {"coin": "X", "time": 1, "bbo": list(x)}}
    book = lambda *x: {"channel": "l2Book", "data": {"coin": "X", "time": 1, "levels": list(x)}}
    context = lambda **x: {"channel": "activeAssetCtx", "data": {"coin": "X", "ctx": {"funding": "1", "markPx": "2", "oraclePx": "3"} | x}}
    ticker = {"e": "bookTicker", "s": "XY", "b": "1", "B": "2", "a": "3", "A": "4", "T": 9}
    made = {"e": "aggTrade", "s": "XY", "p": "1", "q": "2", "a": 3, "T": 9, "m": True}
    payloads = [
        bbo(side, side), bbo(side), bbo(None, None), bbo(side, side, side), bbo(side | {"sz": "0"}, side), {"channel": "bbo"}, {"channel": "bbo", "data": None},
        book([level, level], [level]), book([], []), book([level], []), book([level]), book(None, [level]), book([None], None), {"channel": "l2Book", "data": []},
        {"channel": "trades", "data": [trade] * 3}, {"channel": "trades", "data": []}, {"channel": "trades", "data": [trade, trade | {"px": "-1"}]}, {"channel": "trades", "data": [None]}, {"channel": "trades"}, {"channel": "trades", "data": "x"},
        context(), context(funding="x"), context(markPx="", oraclePx="y"), context(markPx=2), {"channel": "activeAssetCtx", "data": {}}, {"channel": "subscriptionResponse"}, {"channel": "pong"}, {}, [], "x", None,
        {"stream": "s", "data": ticker}, {"stream": "s", "data": ticker | {"a": "0"}}, {"stream": "s", "data": made}, {"stream": "s", "data": made | {"m": 1}}, {"channel": "bbo", "data": ticker | {"bbo": [side, side]}},
    ]
    (tmp_path / "a.rawlog").write_bytes(b"".join(rawlog.encode(*frame("a", k, p)) for k, p in enumerate(payloads)))
    frames = rawlog.raw_frames(spark, str(tmp_path))
    tables = {name: df.cache() for name, df in materialize.normalized(frames).items()}
    kinds = {"bbo": "BBO", "trades": "TRADE", "funding_rates": "FUNDING_RATE", "mark_prices": "MARK_PRICE", "oracle_prices": "ORACLE_PRICE", "reference_bbo": "REFERENCE_BBO", "reference_trades": "REFERENCE_TRADE", "l2_snapshots": "L2_SNAPSHOT"}
    for name, kind in kinds.items():
        ids = sorted(r.event_id for r in tables[name].select("event_id").collect())
        assert ids and ids == sorted(r.event_id for r in tables["events"].where(F.col("event_type") == kind).collect()), name
    n = {r.frame_id: r.n_events for r in tables["frames"].collect()}
    assert len(n) == len(payloads) and sum(n.values()) == tables["events"].count() == sum(tables[name].count() for name in kinds)
    assert sorted(materialize.frames_report(frames).collect()) == sorted(materialize.report(tables).collect())


def test_normalized_report_decodes_its_raw_log_once(spark):
    from strandline.plans import lake

    plan = lake.normalized_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("BatchScan") == 1


def test_lifecycle_reasons(spark):
    from strandline.operators import lifecycle

    a = spark.createDataFrame([(1, "x", None), (2, "y", 5)], "k long, p string, q long")
    b = spark.createDataFrame([(1, "x", None), (2, "z", 6)], "k long, p string, q long")
    assert {(r.k, r.column) for r in lifecycle.mismatches(a, b, ["k"], ["p", "q"]).collect()} == {(2, "p"), (2, "q")}
    key = lambda *x: spark.createDataFrame([(v,) for v in x], "s string")
    assert [r.s for r in lifecycle.pending(key("a", "b", "c"), key("b"), key("c"), "s").collect()] == ["a"]
