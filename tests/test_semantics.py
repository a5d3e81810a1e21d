"""Results worked out by hand, and tests that the future changes nothing of the past."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import definitions
from tidewell.functions import rolling as R
from tidewell.operators import backtest, claims, eventstudy, filings, graph, indicators, ordered, patterns, portfolio, stats, text, vectors
from tidewell.sources.views import candles


def bars(spark, rows, symbol="s"):
    day = date(2024, 1, 1)
    data = [(symbol, day + timedelta(i), *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, time date, open double, high double, low double, close double, volume double")


def closes(spark, values):
    return bars(spark, [(v, v, v, v, 1000) for v in values])


@pytest.mark.parametrize(
    ("close", "held", "stop", "take", "want"),
    [
        ((100, 100, 90, 95, 99, 100, 101, 102), (0, 1, 1, 1, 1, 1, 1, 1), 0.05, None, (0, 1, 1, 0, 0, 0, 0, 0)),
        ((100, 100, 112, 113, 114, 110, 111, 112), (0, 1, 1, 1, 0, 0, 1, 1), None, 0.10, (0, 1, 1, 0, 0, 0, 1, 1)),
        ((100, 100, 90, 95), (0, 1, 1, 1), None, None, (0, 1, 1, 1)),
    ],
)
def test_stops(spark, close, held, stop, take, want):
    df = closes(spark, close)
    flags = spark.createDataFrame([(date(2024, 1, 1) + timedelta(i), float(h)) for i, h in enumerate(held)], "time date, held double")
    out = backtest.stops(df.join(flags, "time"), stop, take).orderBy("time").collect()
    assert tuple(int(r.held) for r in out) == want
    assert sum(r.stop_hit + r.take_hit for r in out) == int(bool(stop or take))


def test_costs_of_one_round_trip(spark):
    df = closes(spark, [100] * 6).withColumn("position", F.when(F.dayofmonth("time").between(2, 4), 1).otherwise(0))
    m = backtest.metrics(backtest.equity(backtest.held(df), 15)).first()
    assert m.cost == pytest.approx(0.30) and m.trades == 2 and m.gross_return == 0


@pytest.mark.parametrize(("path", "want"), [((99, 97.9), (2, "stop")), ((101, 103.1), (2, "take")), ((100,) * 24, (24, "time")), ((100,) * 5, (5, "end")), ((97.9, 103.1), (1, "stop"))])
def test_exits(spark, path, want):
    x = spark.createDataFrame([(100.0, 1.0, [float(p) for p in path])], "e double, a double, p array<double>").select(eventstudy.exits(F.col("e"), F.col("a"), F.col("p")).alias("x")).first().x
    assert (x.steps, x.reason) == want


def test_one_position_at_a_time(spark):
    rows = [("s", 300, 310), ("s", 305, 306), ("s", 430, 440), ("t", 1, 2)]
    out = eventstudy.one_at_a_time(spark.createDataFrame(rows, "symbol string, bar long, exit_bar long")).collect()
    assert sorted((r.symbol, r.bar) for r in out) == [("s", 300), ("s", 430), ("t", 1)]


def test_signals_and_gaps(spark):
    flat = [(100, 100, 100, 100, 1)] * 40
    rows = flat + [(101, 101, 101, 101, 1), (102, 102, 102, 102, 1), (103, 103, 103, 103, 1)] + [(90, 90, 90, 90, 1)] * 30 + [(120, 120, 120, 120, 1)]
    out = eventstudy.signals(bars(spark, rows).withColumn("atr14", F.lit(1.0)), 30).orderBy("bar").collect()
    assert [(r.bar, r.gap) for r in out] == [(40, 240), (73, 33)]


BASE = [(100, 101, 99, 100, 1000)] * 24


@pytest.mark.parametrize(("tail", "key"), [([(100, 100.5, 90, 99.5, 1000)], "hammer"), ([(100, 101, 97, 98, 1000), (97, 104, 96.5, 103, 1000)], "bullish_engulfing"), ([(100, 103, 97, 100.1, 1000)], "doji"), ([(100, 100, 96, 96.5, 1000), (96.5, 96.5, 92, 92.5, 1000), (92.5, 92.5, 88, 88.5, 1000)], "three_black_crows")])
def test_patterns(spark, tail, key):
    assert key in {r.pattern for r in patterns.candle_patterns(bars(spark, BASE + tail), 1).collect()}


def test_breakout_with_volume(spark):
    events = {r.key: r.confirmed for r in patterns.breakouts(bars(spark, [(100, 100, 100, 100, 1000)] * 300 + [(100, 130, 100, 128, 5000)])).collect()}
    assert events["breakout_20d"] and events["high_52w"]


def test_levels(spark):
    import math

    rows = [(100 + 10 * math.sin(i / 5), 100.5 + 10 * math.sin(i / 5), 99.5 + 10 * math.sin(i / 5), 100 + 10 * math.sin(i / 5), 1000) for i in range(120)]
    found = patterns.levels(bars(spark, rows)).collect()
    assert any(abs(r.price - 110.5) < 1 or abs(r.price - 89.5) < 1 for r in found if r.touches >= 2)
    assert all((r.type == "support") == (r.distance < 0) for r in found)


def test_rsi_variants_without_loss(spark):
    df = closes(spark, range(100, 140))
    last = lambda f: f(df).orderBy(F.desc("time")).first().rsi
    assert last(indicators.rsi) is None and last(indicators.rsi_wilder) is None
    assert last(indicators.rsi_seeded) == pytest.approx(100 - 100 / 101)


def test_ewm_equals_pandas_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = closes(spark, [(i * 37) % 91 + 1 for i in range(60)])
        got = [r.e for r in ordered.ewm(df, {"e": ("close", 0.2)}).orderBy("time").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = df.orderBy("time").toPandas()["close"].ewm(alpha=0.2, adjust=False).mean().tolist()
    assert got == pytest.approx(want)


def test_ewm_skips_leading_nulls(spark):
    df = closes(spark, [5, 7, 9]).withColumn("x", F.when(F.dayofmonth("time") > 1, F.col("close")))
    assert [r.e for r in ordered.ewm(df, {"e": ("x", 0.5)}).orderBy("time").collect()] == [None, 7.0, 8.0]


def test_folds_keep_a_key_in_one_task_above_a_union(spark):
    """Both sides are dealt by the key already, and are so uneven that adaptive execution merges their partitions apart."""
    settings = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        side = lambda at, text: spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(at).alias("at"), text.alias("text")).withColumn("n", F.count("*").over(Window.partitionBy("k")))
        wide = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.sha2(F.concat_ws(" ", "id", i), 256)), "")
        step = lambda state, row: ((state or 0) + 1, ((state or 0) + 1,))
        counted = ordered.fold(side(1, wide).union(side(2, F.lit(""))), ["k"], ["at"], "nth int", ordered.by_row(step, ["nth"]))
        assert counted.count() == 2000 and counted.where("nth <> at").count() == 0
        assert counted.columns == ["k", "at", "text", "n", "nth"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_future_changes_nothing(spark):
    """Cut or changed later bars leave every earlier value as it was."""
    df = candles(spark, "/root/testdata/sf0.001")
    cut = "time < DATE '1998-01-01'"
    changed = df.withColumn("close", F.when(F.expr(cut), F.col("close")).otherwise(F.col("close") * 3))

    def frame(x):
        x = indicators.bollinger(indicators.atr(indicators.macd(indicators.rsi_wilder(x))))
        x = x.withColumns({"z": R.zscore("close", 20), "k": R.rank("close", 10), "v": R.vwap(10)})
        return backtest.momentum(x)

    whole, part, other = (sorted(map(str, frame(x).where(cut).collect())) for x in (df, df.where(cut), changed))
    assert whole == part == other and whole


def test_auc_and_kappa(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, p double")
    assert stats.auc(df).first().auc == pytest.approx(0.75)
    assert stats.auc(df.where("y = 1")).first().auc is None
    same = spark.createDataFrame([(1, 1), (0, 0), (1, 1)], "a int, b int")
    assert stats.kappa(same, "a", "b").first().kappa == pytest.approx(1)


def test_upper_bound(spark):
    rows = spark.createDataFrame([(0, 100), (5, 5), (0, 0)], "h int, n int").select(stats.upper_bound(F.col("h"), F.col("n")).alias("b")).collect()
    assert 0.0295 < rows[0].b < 0.0300 and rows[1].b == 1.0 and rows[2].b is None


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(400).select((F.col("id") % 40).alias("k"), (F.col("id") % 2).cast("double").alias("x"))
    out = stats.bootstrap_mean(df, "k", None, "x", 200).first()
    assert out.low <= 0.5 <= out.high and out.reps == 200


def test_resamples_draw_exactly_as_many(spark):
    df = spark.createDataFrame([(f"k{i % 7}", f"u{i % 3}", float(i % 5)) for i in range(100)], "k string, u string, x double")
    per = stats.draws(df, "k", 50, 3).groupBy("rep").agg(F.sum("w").alias("w"), F.count("*").alias("units")).collect()
    assert len(per) == 50 and {r.w for r in per} == {7} and min(r.units for r in per) < 7
    assert sorted(map(str, stats.draws(df, "k", 5, 3).collect())) == sorted(map(str, stats.draws(df.repartition(9), "k", 5, 3).collect()))
    one = stats.bootstrap_mean(df, "k", "u", "x", 100).first()
    assert one.reps == 100 and one.low < 2.0 < one.high and stats.bootstrap_mean(df.limit(0), "k", "u", "x", 10).first().reps == 0


@pytest.mark.parametrize(("symbols", "days"), [(64, 256), (3, 5), (1, 1)])
def test_blocked_covariances(spark, symbols, days):
    """Blocks of any size give the pairwise covariances over common times."""
    rows = [(f"s{i}", t, ((i * 37 + t * t * 11) % 23 - 11) / 100 if (i + t) % 4 else None) for i in range(9) for t in range(20)]
    df = spark.createDataFrame(rows, "symbol string, time int, ret double")
    found = {(r.symbol, r.other): (r.cov, r.n) for r in portfolio.covariances(df, symbols, days).collect()}
    pairs = df.join(df.select("time", F.col("symbol").alias("other"), F.col("ret").alias("y")), "time").where("ret is not null and y is not null")
    want = pairs.groupBy("symbol", "other").agg(F.covar_samp("ret", "y").alias("cov"), F.count("*").alias("n")).collect()
    assert {(r.symbol, r.other): r.n for r in want} == {k: n for k, (_, n) in found.items()}
    assert all(found[r.symbol, r.other][0] == pytest.approx(r.cov, abs=1e-12) for r in want if r.n > 1)
    plan = portfolio.covariances(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5)] + [(i, i + 1) for i in range(20, 60)], "a long, b long")
    found = {r.node: r.component for r in stats.components(e).collect()}
    assert found[3] == 1 and found[9] == 8 and found[5] == 5 and all(found[i] == 20 for i in range(20, 61))


def test_capped_assignment():
    out = stats.capped_assignment([("a", 5), ("b", 5), ("c", 2)], {"dev": 6, "test": 6}, 3)
    assert sorted(out) == ["a", "b", "c"] and out == stats.capped_assignment([("a", 5), ("b", 5), ("c", 2)], {"dev": 6, "test": 6}, 3)


def test_buy_cap_and_cooldown(spark):
    cap = spark.range(1).select(portfolio.buy_cap(F.lit(50), F.lit(1e5), F.lit(2e6), F.lit(1e7), 30.0).alias("q")).first().q
    assert cap == 10
    t = datetime(2024, 1, 1)
    orders = spark.createDataFrame([("u", t, 1), ("u", t + timedelta(seconds=30), 2), ("u", t + timedelta(seconds=60), 3), ("v", t, 4)], "user string, ts timestamp_ntz, id long")
    assert sorted((r.id, r.taken) for r in portfolio.cooled(orders, ["user"], "ts", "id", 60).collect()) == [(1, True), (2, False), (3, True), (4, True)]


def test_fills(spark):
    rows = [("u", 1, "BUY", 10, 100), ("u", 2, "BUY", 10, 200), ("u", 3, "SELL", 5, 300), ("u", 4, "SELL", 99, 300), ("u", 5, "BUY", 1, 7)]
    out = portfolio.apply_fills(spark.createDataFrame(rows, "user string, n int, side string, qty long, price long"), ["user"], ["n"]).orderBy("n").collect()
    assert [(r.pos_qty, r.pos_avg) for r in out] == [(10, 100.0), (20, 150.0), (15, 150.0), (0, 0.0), (1, 7.0)]


def test_periods_to_come(spark):
    row = spark.createDataFrame([(date(2024, 1, 31),)], "d date").select(*[portfolio.next_period(F.col("d"), p).alias(p) for p in ("month", "quarter", "year")]).first()
    assert tuple(row) == (date(2024, 2, 1), date(2024, 4, 1), date(2025, 1, 1))


#: What is said, and (value, step, kind, digits) of its numbers worked out by hand.
SAID = {
    "1조 2,345억 원": [(1_234_500_000_000, 10**8, "abs", "")], "33.0%": [(33, "0.1", "pct", "33.0")], "3.5%p 또는 4퍼센트": [("3.5", "0.1", "pctp", "3.5"), (4, 1, "pct", "4")], "(1,234)": [(-1234, 1, "abs", "1234")],
    "3천500만": [(35_000_000, 10**4, "abs", "3500")], "3천5만, 3천50만, 2천만": [(30_050_000, 10**4, "abs", "3005"), (30_500_000, 10**4, "abs", "3050"), (20_000_000, 10**4, "abs", "2000")], "12": [(12, 1, "abs", "12")], "2025.12.31": [(2025, 1, "abs", "2025"), (12, 1, "abs", "12"), (31, 1, "abs", "31")],
    "1조, 3억": [(10**12, 10**12, "abs", "1"), (3 * 10**8, 10**8, "abs", "3")], "7조 1억 3만 5천": [(7_000_100_035_000, 1000, "abs", "")], "1억 2억": [(10**8, 10**8, "abs", "1"), (2 * 10**8, 10**8, "abs", "2")], "(5억)": [(5 * 10**8, 10**8, "abs", "5")], "없음": [], "": [],
}


def test_numbers(spark):
    rows = spark.createDataFrame([*SAID, None], "string").select("value", text.parse_numbers("value").alias("n")).collect()
    for r in rows:
        assert [tuple(x) for x in r.n] == [(Decimal(v), Decimal(s), k, g) for v, s, k, g in SAID.get(r.value, [])], r.value


def test_numbers_of_tables(spark):
    said = "앞 3억 [매출 표 | 단위 백만원] 1,006,771 그리고 5% [표] 7"
    found = spark.createDataFrame([(said,)], "t string").select(text.parse_passage_numbers("t").alias("n")).first().n
    head = [(3 * 10**8, "abs"), (1_006_771 * 10**6, "abs"), (5, "pct"), (1_006_771, "abs"), (5, "pct"), (1_006_771, "pct"), (5, "pct"), (7, "abs")]
    assert [(x.value, x.kind) for x in found] == head


def test_numbers_of_a_long_text(spark):
    n = spark.range(1).select(F.size(text.parse_numbers(F.repeat(F.lit("12억 3만 "), 20_000))).alias("n")).first().n
    assert n == 20_000


def test_sentences(spark):
    said = "- One is here. Two is there!\n2) Three? ok\nabc"
    df = spark.createDataFrame([(said,)], "t string")
    out = df.select(text.sentences(F.col("t")).alias("s"), text.spans(text.sentences(F.col("t")), F.col("t")).alias("p")).first()
    assert out.s == ["One is here.", "Two is there!", "Three?"]
    assert [said[p.start : p.end] for p in out.p] == out.s


@pytest.mark.parametrize(
    ("s", "c", "v", "ts", "tc", "want"),
    [
        ([0.95, 0.85, 0], [0, 0, 0.9], [False, True, True], 0.8, 0.8, ("contradicted", 2, 0.0)),
        ([0.95, 0.85, 0], [0, 0, 0.9], [True, True, True], 0.8, 0.8, ("supported", 0, 0.95)),
        ([0.9, 0.7, 0.1], [0.05, 0.1, 0.1], [False, True, True], 0.6, 0.8, ("supported", 1, 0.7)),
        ([0.9, 0.7, 0.1], [0.05, 0.1, 0.1], [False, False, False], 0.6, 0.8, ("no_evidence", None, 0.0)),
        ([0.7, 0.7], [0.1, 0.1], [True, True], 0.6, 0.8, ("supported", 1, 0.7)),
    ],
)
def test_decision(spark, s, c, v, ts, tc, want):
    df = spark.createDataFrame([([float(x) for x in s], [float(x) for x in c], v)], "s array<double>, c array<double>, v array<boolean>")
    assert tuple(df.select(text.decision(F.col("s"), F.col("c"), F.col("v"), F.lit(True), ts, tc).alias("d")).first().d) == want


@pytest.mark.parametrize(("said", "found"), [("a.b@c.co", True), ("010-1234-5678", True), ("900101-1234567", True), ("02-123-4567", False), ("1234567-1234567", False), ("20260101", False)])
def test_personal(spark, said, found):
    assert spark.createDataFrame([(said,)], "t string").select(text.has_personal(F.col("t")).alias("x")).first().x is found


def test_grid_spans():
    rows = filings.grid("<TABLE><TR><TD ROWSPAN=2>a</TD><TD COLSPAN='2'>b</TD></TR><TR><TD>c<TD>d</TR></TABLE>")
    assert rows == [["a", "b", "b"], ["a", "c", "d"]]
    assert filings.grid("") == []


def test_definitions():
    assert definitions.checksum({"a": 1, "b": ""}) == definitions.checksum({"b": None, "a": 1.0})
    for n in (0, 501, 1.5):
        with pytest.raises(ValueError):
            definitions.period(n)
    with pytest.raises(ValueError):
        R.shift("close", 0)


def test_search_and_paths(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    out = vectors.search(v, v.where("vec_id = 0"), 4).orderBy("place").collect()
    assert [r.vec_id for r in out] == [0, 1, 2, 3] and out[3].sim == 0
    blocks = vectors.search(v, v, 2, most_queries=1)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, vectors.search(v, v, 2).collect()))
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1)], "src long, dst long")
    p = {(r.node, r.target): r.path for r in graph.shortest_paths(e, spark.createDataFrame([(1,)], "node long")).collect()}
    assert p == {(1, 2): [1, 2], (1, 3): [1, 3]}


def test_simulation_without_risk(spark):
    out = portfolio.simulate(spark, 20, 60, 1000.0, 0.0, 0.08, 0.0, 1.0).first()
    assert out.p5 == pytest.approx(1000 * 1.08**5) and out.p95 == pytest.approx(out.p5) and out.chance == 1


def test_empty_inputs(spark):
    empty = closes(spark, [1]).where("close > 5")
    assert indicators.macd(empty).collect() == []
    assert patterns.candle_patterns(empty).collect() == []
    assert backtest.metrics(backtest.equity(backtest.held(empty.withColumn("position", F.lit(1))))).collect() == []


def test_warm_up_days():
    from tidewell.plans.backtests import warm_up_days

    assert warm_up_days("hold") == warm_up_days("instalments") == 0 and warm_up_days("momentum", 60) > 60


@pytest.mark.parametrize(
    ("said", "wanted"),
    [
        ("매출과 영업이익은 333.6조원, 43.6조원", [("revenue", 333_600 * 10**9, False), ("operating_income", 43_600 * 10**9, False)]),
        ("매출은 각각 1조, 2조 원", [("revenue", 10**12, False), ("revenue", 2 * 10**12, False)]), ("매출 5억 원에서 7억 원으로", [("revenue", 7 * 10**8, False)]),
        ("순이익은 3억 원 적자다", [("net_income", -3 * 10**8, False)]), ("매출액은 약 1,234억원 정도", [("revenue", 1234 * 10**8, True)]), ("영업이익률은 12.5%", [("operating_margin", Decimal("12.5"), False)]),
        ("영업이익률과 매출은 3억 원", [("revenue", 3 * 10**8, False)]), ("매출, 영업이익은 3억 원", []), ("2024년 매출", []), ("", []), (None, []),
    ],
)
def test_amount_claims(spark, said, wanted):
    found = spark.createDataFrame([(said,)], "t string").select(claims.amount_claims(F.col("t")).alias("c")).first().c
    assert [tuple(x) for x in found] == [(a, Decimal(v), p) for a, v, p in wanted]


def test_recall_by_search_equals_recall_by_lists(spark):
    """Claims of few and of very many bigrams, blanks, marks of four bytes, empty passages; jon10 takes bigrams once a line."""
    long = "".join(chr(0x4E00 + i) for i in range(text.SEARCHED + 40))
    rows = [(1, "a b c\U0001f600d", ["abc", "\U0001f600 d", "", "ABC", "b\tc"]), (2, long, [long[50:200], "x", ""]), (3, "", ["abc"]), (4, "aa aaa", [])]
    df = spark.createDataFrame(rows, "id int, q string, ps array<string>")
    plain = F.transform("ps", lambda t: text.recall(text.bigrams(F.col("q")), text.bigrams(t)))
    got = df.select(text.recalls(F.col("q"), F.col("ps")).alias("new"), plain.alias("old")).collect()
    assert all(r.new == r.old for r in got) and [x > 0 for x in got[0].new] == [True, True, False, False, True]
