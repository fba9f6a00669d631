"""Known values of single operators."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from condist.functions import stats
from condist.functions.lookup import at_or_below, neighbours
from condist.operators import alerts, evidence, health, model, notify, recovery, samples, scoring, services, upsert, windows
from condist.plans import views
from condist.sources import metrics


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_count_samples(spark):
    df = spark.createDataFrame([(1, x) for x in (3.0, 2.0, 3.0, 2.0, 3.0, 1.0)], "k int, value double")
    assert rows(samples.count_samples(df, ["k"]), "v", "c") == [(1.0, 1), (2.0, 2), (3.0, 3)]
    assert samples.count_samples(df.limit(0), ["k"]).collect() == []


def test_merge_and_means(spark):
    df = spark.createDataFrame([(1, 1.0, 2), (1, 2.0, 3), (1, 2.0, 4), (1, 3.0, 1)], "k int, v double, c long")
    assert rows(samples.merge(df, ["k"]), "v", "c") == [(1.0, 2), (2.0, 7), (3.0, 1)]
    two = spark.createDataFrame([(1, 3.0, 1), (1, 5.0, 3), (2, 1.0, 0), (3, math.nan, 1), (4, math.inf, 2)], "k int, v double, c long")
    assert rows(samples.checked_mean(two, ["k"]), "k", "problem", "mean") == [(1, None, 4.5), (2, "zero count", None), (3, "value is not finite", None), (4, "value is not finite", None)]
    zero = spark.createDataFrame([(1, 2.0, 0)], "k int, v double, c long")
    assert zero.groupBy("k").agg(samples.weighted_mean().alias("m")).first().m == 0.0


def test_overflowing_counts_raise(spark):
    df = spark.createDataFrame([(1, 1.0, 2**63 - 1), (1, 1.0, 1)], "k int, v double, c long")
    with pytest.raises(Exception, match="(?i)overflow"):
        samples.merge(df, ["k"]).collect()


def test_interpolation(spark):
    knots = spark.createDataFrame([(1, 1.0, 0.1), (1, 2.0, 0.2), (1, 10.0, 1.0)], "k int, v double, p double")
    want = {-1.0: 0.0, 0.5: 0.0, 1.0: 0.1, 1.25: 0.125, 2.0: 0.2, 5.0: 0.5, 10.0: 1.0, 12.0: 1.0}
    probes = spark.createDataFrame([(1, v, i) for i, v in enumerate(want)], "k int, v double, n int")
    for part_rows in (1000, 3, 1):
        out = neighbours(probes, knots, ["k"], "v", "p", part_rows).withColumn("f", stats.linear(F.col("v")))
        assert {r.v: round(r.f, 12) for r in out.collect()} == want


def test_levels_are_clamped(spark):
    levels = spark.createDataFrame([(1, 10.0), (1, 20.0)], "k int, x double")
    chunks = spark.createDataFrame([(1, 5.0), (1, 10.0), (1, 15.0), (1, 99.0), (2, 1.0)], "k int, x double")
    assert rows(at_or_below(chunks, levels, ["k"], "x", "l"), "x", "l") == [(1.0, None), (10.0, 10.0), (15.0, 10.0), (5.0, 10.0), (99.0, 20.0)]


def plain_ks(pairs):
    """Statistic and p-value of (count, reference probability) in ascending order of the value."""
    n, cum, d = sum(c for c, _ in pairs), 0, 0.0
    for c, f in pairs:
        cum += c
        if c:
            d = max(d, abs(f - (cum - 1) / n), abs(cum / n - f))
    return d, d * math.sqrt(len(pairs))


def plain_p(z):
    if z < 0.2:
        return 1.0
    if z < 0.755:
        c = -(math.pi**2) / 8
        return 1 - 2.50662827 * sum(math.exp(k * c / z**2) for k in (1, 9, 25)) / z
    if z < 6.8116:
        return 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * z * z) for j in range(1, max(round(3 / z), 1) + 1))
    return 0.0


def test_ks_against_plain_code(spark):
    cases = {
        1: [(1, i / 10) for i in range(1, 11)],
        2: [(1, min(1.0, i / 10 + 0.3)) for i in range(1, 11)],
        3: [(3, 0.2), (0, 0.4), (5, 0.41), (1, 0.9)],
        4: [(1, 1.0)] * 47,
    }
    data = [(k, float(i), c, f) for k, pairs in cases.items() for i, (c, f) in enumerate(pairs)]
    out = {r.k: r for r in scoring.ks(spark.createDataFrame(data, "k int, v double, c long, f double"), ["k"]).collect()}
    for k, pairs in cases.items():
        d, z = plain_ks(pairs)
        assert abs(out[k].d - d) < 1e-12 and abs(out[k].z - z) < 1e-12 and abs(out[k].p - plain_p(z)) < 1e-12
        assert 0 <= out[k].d <= 1
    assert out[1].p > out[2].p and out[4].p < 0.01 <= out[1].p


def test_p_values_fall(spark):
    z = spark.range(0, 8000).select((F.col("id") / 1000).alias("z")).where("z > 0")
    ps = [r.p for r in z.orderBy("z").select(stats.kolmogorov_p(F.col("z")).alias("p")).collect()]
    assert all(0 <= b <= a + 1e-6 <= 1 + 1e-6 for a, b in zip(ps, ps[1:], strict=False))


def test_density_grid(spark):
    mass = spark.createDataFrame([(1, x, y, 1) for x in (10.0, 20.0) for y in (100.0, 200.0)], "m int, x double, v double, n long")
    got = {(r.row, r.col): r.mass for r in model.density_grid(mass, ["m"], 2, 2, log_y=True).collect()}
    top, low = 0.07322330470336313, 0.051776695296636865
    assert {k: round(x, 12) for k, x in got.items()} == {(0, 0): round(top, 12), (0, 1): round(top, 12), (1, 0): round(low, 12), (1, 1): round(low, 12)}
    with pytest.raises(ValueError):
        model.density_grid(mass, ["m"], 1, 2)


def test_joint_cdf_and_normalised_masses(spark):
    mass = spark.createDataFrame([(1, 1.0, 5.0, 1), (1, 2.0, 7.0, 3)], "m int, x double, v double, n long")
    assert rows(model.joint_cdf(mass, ["m"]), "x", "v", "h") == [(1.0, 5.0, 0.25), (1.0, 7.0, 0.25), (2.0, 5.0, 0.25), (2.0, 7.0, 1.0)]
    grid = spark.createDataFrame([(1, 0.0), (1, 0.25), (1, 1.0), (2, 0.0)], "m int, mass double")
    assert rows(model.normalised(grid, ["m"], 0.5), "m", "level") == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 0.0)]


def test_readiness(spark):
    c = spark.createDataFrame([(27359, 15), (27360, 15)], "eligible long, interval_s long")
    assert [(r.expected, r.ready) for r in model.ready_by_day(c).orderBy("eligible").collect()] == [(28800, False), (28800, True)]
    d = spark.createDataFrame([(4,), (10,), (12,)], "eligible long")
    assert [(r.coverage, r.ready) for r in model.ready_by_count(d).orderBy("eligible").collect()] == [(0.4, False), (1.0, True), (1.0, True)]


def test_eligibility(spark):
    data = [("baseline", None), ("good", False), ("bad", None), ("bad", False), ("bad", True), ("pending", True), ("failed", True)]
    df = spark.createDataFrame(data, "state string, review_override boolean")
    assert rows(df.where(model.eligible()), "state", "review_override") == [("bad", True), ("baseline", None), ("good", False)]


def test_windows(spark):
    r = spark.createDataFrame([("a", 0, 5_400_000_000)], "service string, start_us long, end_us long")
    assert rows(windows.plan(r, 3_600_000_000), "w_start", "w_end", "step_s") == [(0, 3_600_000_000, 3600.0), (3_600_000_000, 5_400_000_000, 1800.0)]
    t = spark.createDataFrame([(1, 12 * 3600 + 60, 60, 120)], "k int, at long, old_s long, new_s long")
    assert rows(windows.transitions(t), "w_start", "w_end") == [(43260, 43320)]
    e = spark.createDataFrame([(0,), (1,), (10,), (11,)], "us long")
    assert rows(windows.assign(e, 10), "us", "w") == [(0, 0), (1, 10), (10, 10), (11, 20)]


@settings(max_examples=40, deadline=None)
@given(at=st.integers(0, 500), old=st.integers(1, 90), new=st.integers(1, 90))
def test_transitions_tile(spark, at, old, new):
    t = spark.createDataFrame([(1, at, old, new)], "k int, at long, old_s long, new_s long")
    got = sorted((r.w_start, r.w_end) for r in windows.transitions(t).collect())
    end = -(-at // new) * new
    assert (got[0][0], got[-1][1]) == (at, end) if got else at == end
    assert all(a < b <= a + max(old, new) for a, b in got) and all(p[1] == q[0] for p, q in zip(got, got[1:], strict=False))


def test_histograms(spark):
    s = spark.createDataFrame([("a", 1, 1.0, 10), ("a", 2, 1.0, 13), ("a", 1, 2.0, 5), ("a", 3, 2.0, 9), ("a", 1, 5.0, 9), ("a", 2, 5.0, 4), ("a", 1, math.inf, 1), ("a", 2, math.inf, 8)], "series string, seq long, upper double, count long")
    assert rows(samples.histogram_increase(s, ["series"]), "upper", "increase") == [(1.0, 3)]
    b = spark.createDataFrame([("1", "2.5"), ("+Inf", "0.4")], "upper string, count string")
    assert rows(metrics.histogram_buckets(b.withColumn("upper", F.replace("upper", F.lit("+Inf"), F.lit("Infinity")))), "upper", "count") == [(1.0, 3), (math.inf, 0)]
    for bad in ("NaN", "-Infinity", "x"):
        with pytest.raises(Exception):
            metrics.histogram_buckets(spark.createDataFrame([(bad, "1")], "upper string, count string")).collect()


def test_range_responses(spark, tmp_path):
    body = {"status": "success", "data": {"resultType": "matrix", "result": [{"metric": {"a": "b"}, "values": [[60, "1.5"], [120.5, "2"], [180, "NaN"]]}]}}
    (tmp_path / "r.json").write_text(json.dumps(body))
    points = metrics.range_matrix(metrics.read_responses(spark, str(tmp_path)))
    kept = metrics.after_start(points.withColumn("start_s", F.lit(60)).withColumn("end_s", F.lit(180)))
    assert [(r.ts_s, str(r.value)) for r in kept.orderBy("ts_s").collect()] == [(120.5, "2.0"), (180.0, "nan")]
    assert metrics.finite_check(kept.withColumn("k", F.lit(1)), ["k"]).first().valid is False
    (tmp_path / "r.json").write_text(json.dumps({"data": {"resultType": "vector", "result": []}}))
    with pytest.raises(Exception, match="expected a matrix"):
        metrics.range_matrix(metrics.read_responses(spark, str(tmp_path))).collect()


def test_upserts(spark):
    w = spark.createDataFrame([(1, 1, 10, 1), (1, 2, 5, 2), (1, 1, 20, 3)], "k int, generation long, collected_at long, id long")
    chunk = upsert.chunk_upsert(w, ["k"])
    assert rows(chunk, "generation", "id") == [(2, 2)]
    verdicts = spark.createDataFrame([(1, 1, 30, 1, "bad"), (1, 2, 25, 2, "good"), (1, 2, 27, 3, "bad")], "k int, generation long, analysed_at long, id long, state string")
    assert rows(upsert.verdict_upsert(verdicts, chunk, ["k"]), "generation", "state") == [(2, "bad")]
    assert rows(upsert.verdict_upsert(verdicts.where("generation = 1"), chunk, ["k"]), "generation", "state") == [(2, "pending")]
    active = spark.createDataFrame([(1, 2)], "k int, generation long")
    r = spark.createDataFrame([(1, 2), (1, 1), (1, 0), (9, -1), (9, 5)], "k int, generation long")
    assert rows(upsert.generation_guard(r, active, "k"), "k", "generation") == [(1, 0), (1, 2), (9, -1)]


def test_versions(spark):
    data = [(1, end, i, b"x", 1, "") for i, end in enumerate([5, 5, 6, 7, 8, 9, 10, 11])] + [(1, 12, 99, b"", 0, "")]
    df = spark.createDataFrame(data, "k int, interval_end long, id long, body binary, bytes long, checksum string")
    good = df.withColumn("checksum", F.when(F.col("id") != 7, F.sha2("body", 256)).otherwise("broken"))
    kept = model.retained(model.versions(good, ["k"]), ["k"])
    assert rows(kept, "version") == [(3,), (4,), (5,), (6,), (7,)]
    assert model.current(kept, ["k"]).first().version == 6
    assert model.current(kept.withColumn("bytes", F.lit(5)), ["k"]).collect() == []


def test_delays(spark):
    c = lambda x: F.lit(x).cast("long")
    one = spark.range(1)
    pick = lambda e: one.select(e.alias("x")).first().x
    assert [pick(recovery.delay_s(c(a), c(s))) for a, s in ((12, 3600), (1, 60), (2, 60), (10, 60))] == [3600, 1, 2, 60]
    assert [pick(recovery.backoff_s(c(a), c(i))) for a, i in ((1, 60), (7, 60), (50, 9000))] == [1, 60, 3600]
    assert [pick(notify.retry_s(c(a))) for a in (1, 8, 9, 60)] == [2, 256, 300, 300]


def test_attempt_outcomes(spark):
    df = spark.createDataFrame([(10, 0, True), (200, 150, True), (200, 50, True), (200, 50, False)], "expires_us long, ready_us long, ok boolean")
    assert rows(recovery.classify(df, 100), "outcome", "wait_us", "state") == [("completed", 0, "recovered"), ("deferred", 50, "pending"), ("gap", 0, "expired"), ("retry", 0, "pending")]


def test_severity_and_redaction(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "n long")
    assert [r.s for r in df.orderBy("n").select(stats.severity(F.col("n")).alias("s")).collect()] == ["warning", "warning", "critical", "critical"]
    text = " GET https://me:pw@host/x?token=abc&a=1 password=hunter2\nAuthorization: Bearer zzz\nend "
    out = spark.createDataFrame([(text,), ("x" * 5000,)], "t string").select(alerts.redacted(F.col("t")).alias("t")).collect()
    assert out[0].t == "GET https://[redacted]@host/x?token=[redacted]&a=1 password=[redacted]\nAuthorization: [redacted]\nend"
    assert len(out[1].t) == 4000
    cut = spark.createDataFrame([("é" * 3,), ("\u2003aé",), ("😀😀",), (None,)], "t string").select(alerts.cut_bytes(F.col("t"), 5).alias("t")).collect()
    assert [r.t for r in cut] == ["éé", "\u2003a", "😀", None]
    assert spark.createDataFrame([("\u3000 a\u2003b\xa0",)], "t string").select(alerts.redacted(F.col("t")).alias("t")).first().t == "a\u2003b"


REDACTED = [
    ("GET https://ann:pw1@host.example/api?token=abc Authorization: Bearer xyz", "GET https://[redacted]@host.example/api?token=[redacted] Authorization: [redacted]"),
    ("Password=a=b&x=1", "Password=[redacted]&x=1"),
    ("mytoken=1;secret=2 z", "mytoken=[redacted] z"),
    ("token= next=1 a=token", "token= next=1 a=token"),
    ("token==v x=token=w", "token=[redacted] x=token=[redacted]"),
    ("AUTHORIZATION:\t abc def\nauthorization: \nrest", "AUTHORIZATION:\t [redacted]\nauthorization: \nrest"),
    ("İ authorization: x", "İ authorization: [redacted]"),
    ("a://b/c@d e://f@g@h i://j k@l ://@m", "a://b/c@d e://[redacted]@g@h i://j k@l ://@m"),
    ("secret=é\tsecret=\x0bq", "secret=[redacted]\tsecret=[redacted]"),
    ("", ""),
    (None, None),
]


def test_redaction_cases(spark):
    df = spark.createDataFrame(REDACTED, "t string, want string").select(alerts.redacted(F.col("t")).alias("got"), "want")
    assert [r.got for r in df.collect()] == [w for _, w in REDACTED]


def test_one_alert_that_does_not_end(spark):
    """Numbers and the first id are carried over stretches; no window holds the whole alert."""
    n = 20_000
    rows_ = spark.range(n).select(F.lit("s").alias("k"), (F.col("id") * 1000).alias("us"), "id", (F.col("id") % 2 == 0).alias("occurs"), F.lit(False).alias("ends"))
    out = alerts.occurrences(rows_, ["k"], stretch=1_000_000)
    got = out.agg(F.count("*"), F.max("n"), F.min("alert"), F.max("alert"), F.count_if(F.col("n") != F.col("id") / 2 + 1)).first()
    assert tuple(got) == (n // 2, n // 2, 0, 0, 0)
    partitioned = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in line and "windowspec" in line]
    assert partitioned and all("_s#" in line for line in partitioned)


def test_islands_partition_events(spark):
    seq = "b.bbg.gb.gbbbb"
    events = spark.createDataFrame([("s", i * 40 * 86_400_000_000, i, c == "b", c == "g", "r") for i, c in enumerate(seq)], "k string, us long, id long, occurs boolean, ends boolean, reason string")
    assert rows(alerts.conditions(events, ["k"]), "alert", "occurrences", "severity", "status") == [(0, 3, "critical", "resolved"), (10, 4, "critical", "firing"), (7, 1, "warning", "resolved")]
    life = alerts.lifecycle(events, ["k"])
    assert life.where("event = 'opened'").count() == 3 and life.where("event = 'escalated'").count() == 2 and life.where("event = 'resolved'").count() == 2
    plan = notify.plan(alerts.occurrences(events, ["k"]), alerts.conditions(events, ["k"]))
    assert rows(plan.where("alert = 0 and operation = 'resolved'"), "severity") == [("critical",), ("warning",), ("warning",)]


def test_reviews(spark):
    r = spark.createDataFrame([(1, 1, 0, True), (1, 2, 0, True), (1, 3, 0, False), (1, 4, 1, False)], "k int, n long, expected long, accept boolean")
    assert rows(alerts.review_fold(r, "k", ["n"]), "revision", "override", "applied", "conflicts") == [(2, False, 2, 1)]


def test_services(spark):
    r = spark.createDataFrame([(1, 1, "a", "n"), (1, 2, "a", "m"), (1, 3, "b", "m"), (1, 4, None, "m")], "k int, n int, url string, name string")
    assert [(x.material, x.generation) for x in services.generations(r, "k", ["n"], ["url"]).orderBy("n").collect()] == [(False, 1), (False, 1), (True, 2), (True, 3)]
    s = spark.createDataFrame([("Api",), ("web",)], "name string")
    assert rows(services.search(s, " AP "), "name") == [("Api",)] and services.search(s, "  ").count() == 2


def test_health(spark):
    log = [(1, 1, 1, "tracking_started"), (1, 2, 2, "collection_failed"), (1, 3, 3, "collection_backlog_recovered"), (2, 1, 4, "note"), (3, 1, 5, "collection_failed"), (3, 2, 6, "collection_succeeded")]
    out = health.service_health(spark.createDataFrame(log, "service int, us long, id long, kind string"))
    assert rows(out, "service", "state", "failing") == [(1, "degraded", True), (2, "pending", False), (3, "healthy", False)]


class Plain:
    """Monotone quintic pieces by plain code."""

    def __init__(self, xs, ys):
        n = len(xs)
        rise = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(n - 1)]
        m = [0.0] * n
        for i in range(1, n - 1):
            r = rise[i - 1]
            m[i - 1] = min(max(m[i - 1], 0.0), 2 * r) if r else 0.0
            m[i] = 2 * r - m[i - 1] if r else 0.0
        m[n - 1] = 0.0
        for i in range(n - 2, 0, -1):
            if rise[i]:
                m[i + 1] = min(max(m[i + 1], 0.0), 2 * rise[i])
                m[i] = min(m[i], 2 * rise[i] - m[i + 1])
        self.xs, self.rise, self.m = xs, rise, m

    def density(self, x):
        for i, r in enumerate(self.rise):
            if self.xs[i] <= x <= self.xs[i + 1]:
                if not r:
                    return 0.0
                t, a, b = (x - self.xs[i]) / (self.xs[i + 1] - self.xs[i]), self.m[i] / r, self.m[i + 1] / r
                return max(0.0, r * (5 * (6 - 3 * a - 3 * b) * t**4 + 4 * (-15 + 8 * a + 7 * b) * t**3 + 3 * (10 - 6 * a - 4 * b) * t**2 + a))
        return 0.0


@pytest.mark.parametrize("seed", range(4))
def test_density_against_plain_code(spark, seed):
    import random

    rng = random.Random(seed)
    xs = sorted(rng.sample(range(1, 60), 2 + 3 * seed))
    ys = sorted(rng.choice([0.0, 0.1, 0.35, 0.5, 0.8, 1.0]) for _ in xs)
    df = spark.createDataFrame([(1, float(x), y) for x, y in zip(xs, ys, strict=True)], "k int, v double, p double")
    pieces = evidence.pieces(df, ["k"])
    bounds = spark.createDataFrame([(1, 0.5, 70.0)], "k int, lo double, hi double")
    plain = Plain([float(x) for x in xs], ys)
    for r in evidence.sampled_density(pieces, bounds, ["k"], 50).collect():
        assert abs(r.density - plain.density(r.x)) < 1e-9


@pytest.mark.parametrize("size", [2, 3, 256])
def test_slopes_by_blocks(spark, size):
    """Scans over blocks of two and three pieces, several levels deep, give the slopes of plain loops, for each of many functions."""
    import random

    rng = random.Random(size)
    want, data = {}, []
    for k in range(12):
        n = rng.choice([2, 3, 4, 5, 9, 30])
        xs = sorted(rng.sample(range(1, 100), n))
        ys = sorted(rng.choice([0.0, 0.1, 0.35, 0.36, 0.5, 0.8, 1.0]) for _ in xs)
        data += [(k, float(x), y) for x, y in zip(xs, ys, strict=True)]
        plain = Plain(xs, ys)
        want |= {(k, i): (float(xs[i]), float(xs[i + 1]), r, plain.m[i] / r if r else None, plain.m[i + 1] / r if r else None) for i, r in enumerate(plain.rise)}
    data += [(99, 1.0, 1.0)]  # one point has no piece
    rng.shuffle(data)
    out = evidence.pieces(spark.createDataFrame(data, "k int, v double, p double"), ["k"], size)
    got = {(r.k, r.i): (r.x1, r.x2, r.rise, r.m0, r.m1) for r in out.collect()}
    assert set(got) == set(want)
    for at, row in want.items():
        assert all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip(got[at], row, strict=True)), (at, got[at], row)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_density_of_a_short_cdf(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 1.0), (1, 2.0, 1.0)], "k int, v double, p double")
    got = evidence.pieces(df, ["k"]).withColumn("x", F.col("x1") + 0.5).withColumn("d", evidence.density(F.col("x")))
    assert [(r.i, r.d > 0) for r in got.orderBy("i").collect()] == [(0, True), (1, False)]
    b = spark.createDataFrame([(1, 1.0, 100.0), (2, 0.0, 5.0)], "k int, lo double, hi double")
    assert [round(r.x, 9) for r in evidence.log_samples(b, 4).orderBy("step").collect()] == [1.0, round(10**0.5, 9), 10.0, round(1000**0.5, 9), 100.0]


def test_density_from_zero(spark):
    """A function that starts at 0 has its ends, and points without a place between them."""
    df = spark.createDataFrame([(1, 0.0, 0.2), (1, 1.0, 0.6), (1, 2.0, 1.0)], "k int, v double, p double")
    bounds = spark.createDataFrame([(1, 0.0, 2.0)], "k int, lo double, hi double")
    got = evidence.sampled_density(evidence.pieces(df, ["k"]), bounds, ["k"], 4).orderBy("step").collect()
    assert [(r.step, str(r.x), round(r.density, 9)) for r in got] == [(0, "0.0", 0.0), (1, "nan", 0.0), (2, "nan", 0.0), (3, "nan", 0.0), (4, "2.0", 0.0)]


def test_stale_alerts(spark):
    rows_ = [(1, 1, "firing", "delivered", "warning", 0), (1, 2, "firing", "delivered", "critical", 1), (2, 1, "firing", "pending", "warning", 0), (3, 1, "firing", "missed", "warning", 5), (4, 1, "firing", "delivered", "warning", 10**10)]
    df = spark.createDataFrame(rows_, "alert long, n int, operation string, state string, severity string, us long")
    firing = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "alert long")
    assert rows(notify.stale(df, firing, 10**10, ["n"]), "alert", "severity") == [(1, "critical"), (3, "warning")]
    bodies = df.withColumn("payload", F.concat("alert", F.lit("/"), "n"))
    assert rows(notify.stale(bodies, firing, 10**10, ["n"], also=["payload"]), "alert", "payload") == [(1, "1/2"), (3, "3/1")]


def test_closings_end_every_condition_of_their_service(spark):
    keys = ["kind", "service", "key"]
    hits = [("anomaly", "a", "1", 1, 1), ("anomaly", "a", "1", 9, 5), ("anomaly", "a", "2", 2, 2), ("collection", "a", "", 3, 3), ("collection", "b", "", 4, 4)]
    events = spark.createDataFrame([(*h, True, False, None) for h in hits], "kind string, service string, key string, us long, id long, occurs boolean, ends boolean, reason string")
    closings = spark.createDataFrame([("a", 5, 100, "service_removed"), ("c", 5, 101, "service_removed")], "service string, us long, id long, reason string")
    out = alerts.conditions(alerts.with_closings(events, closings, keys), keys)
    got = {(r.kind, r.service, r.key, r.alert): (r.status, r.reason) for r in out.collect()}
    ended = ("resolved", "service_removed")
    assert got == {("anomaly", "a", "1", 1): ended, ("anomaly", "a", "1", 5): ("firing", None), ("anomaly", "a", "2", 2): ended, ("collection", "a", "", 3): ended, ("collection", "b", "", 4): ("firing", None)}
    assert alerts.with_closings(events.limit(0), closings, keys).count() == 0


def test_model_status(spark):
    ready = model.ready_by_count(spark.createDataFrame([("a", 4), ("b", 12)], "service string, eligible long")).withColumn("required", F.lit(10))
    built = spark.createDataFrame([("b", 5), ("b", 7), ("c", 9)], "service string, us long")
    got = rows(model.status(ready, built, ["service"]), "service", "state", "progress", "required", "eligible", "built_at")
    assert got == [("a", "learning", 0.4, 10, 4, None), ("b", "ready", 1.0, 10, 12, 7)]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert views.MODEL == ["service"]
    found = e.queries()
    assert set(e.oracle_sql()) <= set(found) and len(found) > 85
    assert e.entry(spark).count() > 0


def test_missing_chunks_raise(spark):
    chunks = spark.createDataFrame([(1, "x")], "k int, body string")
    assert upsert.read_chunks(chunks, spark.createDataFrame([(1,)], "k int"), ["k"]).first().body == "x"
    with pytest.raises(Exception, match="no chunk of 2"):
        upsert.read_chunks(chunks, spark.createDataFrame([(2,)], "k int"), ["k"]).collect()


def test_many_probes_of_one_key(spark):
    knots = spark.range(200).select(F.lit(1).alias("k"), (F.col("id") * 1.0).alias("v"), (F.col("id") / 199).alias("p"))
    probes = spark.range(40_000).select(F.lit(1).alias("k"), (F.pmod("id", F.lit(19_900)) / 100).alias("v"))
    out = neighbours(probes, knots, ["k"], "v", "p").select(F.max(F.abs(stats.linear(F.col("v")) - F.col("v") / 199)).alias("d"), F.count("*").alias("n")).first()
    assert out.n == 40_000 and out.d < 1e-12


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 1.5, -1.5, 1e-300, 8.0, 1e9, 2.0 ** (7.63 / 16), -(2.0 ** (7.63 / 16))]), min_size=1, max_size=12), st.lists(st.integers(-7, 7), min_size=12, max_size=12))
def test_near_values_against_plain_code(spark, bases, steps):
    values = sorted({float(b + k * math.ulp(b)) for b, k in zip(bases, steps, strict=False)})
    want, start = {}, None
    for i, x in enumerate(values):
        ulp = 4.9e-324 if x == 0 else 2.0 ** (math.floor(math.log2(abs(x))) - 52)
        start = x if i == 0 or x - values[i - 1] > 5 * ulp else start
        want[x] = start
    df = spark.createDataFrame([(1, x, 1) for x in values], "k int, v double, n long")
    assert {r.v: r.least for r in model.near_least(df, ["k"])[0].collect()} == want
