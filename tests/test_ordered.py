"""Running totals and folds against plain loops, with one key holding most rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ledger, ordered, project, stats
from tidemark.operators.ordered import chunked_lists, neighbours, ordinal, running


@pytest.fixture(autouse=True, params=[1, 16], ids=["short ranges", "usual ranges"])
def per_range(request, monkeypatch):
    """Every test with cuts in the large keys only, and with as many cuts as the sample can give."""
    monkeypatch.setattr(ordered, "PER_RANGE", request.param)


START = datetime(2024, 1, 1)


def skewed(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(60), i, rng.randrange(-9, 9)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, id long, v long")


def compare(spark, df, value, **options):
    kind, column = value
    got = running(df, ["k"], ["t", "id"], {"x": (kind, column)}, **options)
    w = Window.partitionBy("k")
    end = 0 if options.get("inclusive", True) else -1
    if options.get("strict_on"):
        w = w.orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    elif options.get("descending"):
        w = w.orderBy(F.desc("t"), F.desc("id")).rowsBetween(Window.unboundedPreceding, end)
    else:
        w = w.orderBy("t", "id").rowsBetween(Window.unboundedPreceding, end)
    fn = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind]
    plain = fn(column).over(w)
    want = df.select("id", (F.coalesce(plain, F.lit(0)) if kind in ("sum", "count") else plain).alias("x"))
    assert sorted(map(tuple, got.select("id", "x").collect())) == sorted(map(tuple, want.collect()))


def test_running_agrees_with_a_window(spark):
    df = skewed(spark).cache()
    v = F.col("v")
    compare(spark, df, ("sum", v))
    compare(spark, df, ("sum", v), inclusive=False)
    compare(spark, df, ("count", F.lit(1)), descending=True)
    compare(spark, df, ("max", F.when(v > 5, F.struct("t", "id"))), inclusive=False)
    compare(spark, df, ("min", F.when(v > 5, F.struct("t", "id"))), inclusive=False, descending=True)
    compare(spark, df, ("max", F.when(v > 5, F.struct("t", "id"))), strict_on="t")


def test_neighbours(spark):
    df = skewed(spark)
    got = neighbours(df, ["k"], ["t", "id"], F.col("id"))
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.lag("id").over(w), F.lead("id").over(w))
    key = lambda rows: sorted(tuple(-1 if x is None else x for x in r) for r in rows)
    assert key(got.select("id", "previous", "next").collect()) == key(want.collect())


def test_ordinal_and_chunks(spark):
    df = skewed(spark)
    positions = ordinal(df, ["k"], ["t", "id"])
    counts = positions.groupBy("k").agg(F.count("*").alias("n"), F.max("position").alias("m"), F.countDistinct("position").alias("d"))
    assert all(r.n == r.m == r.d for r in counts.collect())
    lists = chunked_lists(df, ["k"], ["t", "id"], ["id"], 50).collect()
    assert all(len(r["items"]) <= 50 for r in lists)
    joined = defaultdict(list)
    for r in sorted(lists, key=lambda r: (r.k, r.chunk)):
        joined[r.k] += [i.id for i in r["items"]]
    want = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.k, r.t, r.id)):
        want[r.k].append(r.id)
    assert joined == want


def usage_rows(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows, at = [], START
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 30, 900, 4000, 20000]))
        rows.append((i, at, 1 if rng.random() < 0.7 else rng.randrange(2, 5), rng.randrange(1, 50), rng.choice("ab")))
    return rows, spark.createDataFrame(rows, "id long, ts timestamp, user_id long, cost long, model string")


def test_rolling_usage_is_the_sequential_fold(spark):
    rows, df = usage_rows(spark)
    got = {r.id: (r.anchor, r.rolling_usage) for r in ledger.rolling_usage(df, ["user_id"], 1).collect()}
    assert got == folded(rows)


def folded(rows):
    """Anchor and usage so far of each row, one after the other."""
    state, want = {}, {}
    epoch = datetime(1970, 1, 1)
    for i, at, user, cost, _ in rows:
        second = int((at - epoch).total_seconds())
        anchor, used = state.get(user, (None, 0))
        if anchor is None or anchor < second - 3600:
            anchor, used = second, 0
        state[user] = (anchor, used + cost)
        want[i] = state[user]
    return want


def test_anchors_of_a_key_without_gaps(spark):
    """Chains that run through many blocks: dense seconds, sparse ones, and gaps of exactly the window."""
    rng = random.Random(9)
    rows, at = [], START
    for i in range(4000):
        at += timedelta(seconds=rng.choice([1, 1, 2, 700, 3599, 3600] if i % 900 else [3601, 9000, 40000]))
        rows.append((i, at, "hot" if i % 3 else f"k{i % 7}", 1))
    df = spark.createDataFrame(rows, "id long, ts timestamp, user_id string, cost long")
    epoch = datetime(1970, 1, 1)
    state, want = {}, set()
    for _, at, user, _ in rows:
        second = int((at - epoch).total_seconds())
        if user not in state or state[user] < second - 3600:
            state[user] = second
            want.add((user, second))
    for slots in (4, 64):
        got = [tuple(r) for r in ledger.rolling_anchors(df, ["user_id"], 1, slots).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_trial_usage_with_three_limits(spark):
    rows, df = usage_rows(spark, seed=5)
    limits = {"a": 400, "b": 900, None: 100}
    models = ["a", "b", "c"]
    data = [(i, at, "hot" if user == 1 else f"ip{user}", models[(i * 7) % 3], cost) for i, at, user, cost, _ in rows]
    columns = "id long, ts timestamp, ip string, model string, input_tokens long"
    extra = {c: F.lit(0).cast("long") for c in ("output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens")}
    usage = spark.createDataFrame(data, columns).withColumns(extra)
    got = {r.ip: r.usage for r in ledger.trial_usage(usage, limits).collect()}
    want = defaultdict(int)
    for _, _, ip, model, tokens in data:
        want[ip] += tokens if want[ip] < limits.get(model, limits[None]) else 0
    assert got == dict(want)


def test_rate_limits_count_three_clock_hours(spark):
    rows, _ = usage_rows(spark, seed=7)
    data = [(i, at, f"ip{user}") for i, at, user, _, _ in rows]
    got = {r.id: r.prior for r in ledger.rate_limit_verdicts(spark.createDataFrame(data, "id long, ts timestamp, ip string"), 3).collect()}
    hour = lambda t: int((t - START).total_seconds() // 3600)
    want = {i: sum(1 for j, bt, b in data if b == a and j < i and hour(at) - 2 <= hour(bt) <= hour(at)) for i, at, a in data}
    assert got == want


def test_price_tiers(spark):
    usage = spark.createDataFrame(
        [(1, "m", 200_000, 10, 1, 0), (2, "m", 200_000, 10, 0, 1), (3, "m", 100, 10, 0, 0), (4, "x", 1, 1, 0, 0)],
        "id long, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_5m_tokens long",
    ).withColumns({"reasoning_tokens": F.lit(None).cast("long"), "cache_write_1h_tokens": F.lit(None).cast("long")})
    prices = spark.createDataFrame([("m", 3000, 15000, 300, 3750, 6000, 22500)], "model string, input long, output long, cache_read long, cache_write_5m long, tier_input long, tier_output long")
    nano = lambda rule: {r.id: r.cost_nano for r in ledger.price_usage(usage, prices, rule).collect()}
    gateway, session = nano("gateway"), nano("session")
    assert gateway == {1: 200_000 * 6000 + 10 * 22500, 2: 200_000 * 6000 + 10 * 22500, 3: 100 * 3000 + 10 * 15000, 4: None}
    assert session[1] == gateway[1]
    assert session[2] == 200_000 * 3000 + 10 * 15000 + 3750
    assert session[4] == 0


def test_grid_sums_to_the_grouped_total(spark):
    rows, df = usage_rows(spark)
    usage = df.withColumns({"enrichment": F.lit(None).cast("string"), "key_id": F.col("user_id")})
    grid = ledger.cost_grid(usage, "2024-01", ["a", "b"]).collect()
    assert len(grid) == 31
    total = sum(r.cost for r in ledger.cost_by_day(usage, "2024-01").withColumnRenamed("total_cost", "cost").collect())
    assert round(sum((r.a + r.b) * 1e8 for r in grid)) == total


def test_exact_median(spark):
    for values in ([5], [1, 9], [3, 3, 4, 10000], [7] * 10 + [8] * 9, list(range(0, 5000, 37))):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        ordered, n = sorted(values), len(values)
        want = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
        assert stats.exact_median(df, "v").first()["median"] == want


def test_cancel_reverts_is_the_sequential_fold(spark):
    rng = random.Random(11)
    titles = ["hot"] * 6 + ["a", "b"]
    commits = []
    for i in range(200):
        title = rng.choice(titles)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            title = f'Revert "{title}"'
        commits.append((i, title))
    seen = {}
    for i, title in commits:
        if title.startswith('Revert "'):
            original = title[8:-1]
            if original in seen:
                del seen[original]
            else:
                seen[title] = i
        else:
            wrapped = f'Revert "{title}"'
            if wrapped in seen:
                del seen[wrapped]
            else:
                seen[title] = i
    for size in (3, 256):
        got = project.cancel_reverts(spark.createDataFrame(commits, "seq long, title string"), size)
        assert sorted(r.seq for r in got.collect()) == sorted(seen.values())


def test_balances_beyond_bigint(spark):
    most = (1 << 63) - 1
    rows = [(1, START + timedelta(hours=i), i, most - 1) for i in range(3)]
    payments = spark.createDataFrame(rows, "workspace_id long, ts timestamp, id long, amount long")
    usage = spark.createDataFrame([], "workspace_id long, ts timestamp, id long, cost long, enrichment string")
    refunds = spark.createDataFrame([], "workspace_id long, refunded long, id long, amount long")
    billing = spark.createDataFrame([(1, 5, True), (2, 7, True)], "workspace_id long, balance long, reload boolean")
    history = ledger.balance_history(ledger.ledger_entries(payments, usage, refunds))
    assert sorted(int(r.balance) for r in history.collect()) == [(most - 1) * n for n in (1, 2, 3)]
    left = ledger.grant_and_reload(billing, payments, usage, refunds).collect()
    assert sorted((r.workspace_id, int(r.balance), r.needs_reload) for r in left) == [(1, 3 * (most - 1) + 5, False), (2, 7, True)]
