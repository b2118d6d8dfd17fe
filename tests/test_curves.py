import random

import pytest

from shotlake.operators import curves as op
from shotlake.operators import fits


def probes(spark, curves):
    return spark.createDataFrame([(k, 0, x, s) for k, pts in curves.items() for x, s in pts],
                                 "job_id string, shot_idx int, x int, score double")


A = [(20, 90.0), (24, 85.0), (28, 80.0), (32, 70.0)]
B = [(20, 90.0), (24, 85.0), (28, 80.0)]


def test_inversion(spark):
    x = lambda pts, t, *a: op.invert_curve(probes(spark, {"a": pts}), t, *a).first().x
    assert x(A, 75) == 30.0 and abs(x(A, 78) - 28.8) < 1e-9 and x(A[::-1], 75) == 30.0
    assert x(B, 95) == 20 and x(B, 65) == 28 and x([(30, 80.0)], 75) == 30
    assert x(A, 75, 1.5) == 31.5 and x(A, 75, 9.0, 20, 32) == 32 and x(B, 95, 0.0, 26, 44) == 26
    assert op.invert_curve(probes(spark, {"a": [(20, None)]}), 75).first().x is None


def test_interpolation_and_brackets(spark):
    p = probes(spark, {"a": [(20, 95.0), (26, 86.0), (32, 77.0)]})
    want = spark.createDataFrame([("a", 0, x) for x in (26.0, 29.0, 10.0, 60.0)] + [("b", 0, 5.0)], "job_id string, shot_idx int, x double")
    got = {(r.job_id, r.x): r.predicted for r in op.interpolate_curve(p, want).collect()}
    assert got == {("a", 26.0): 86, ("a", 29.0): 81.5, ("a", 10.0): 95, ("a", 60.0): 77, ("b", 5.0): None}
    q = probes(spark, {"a": [(20, 95.0), (32, 84.0), (44, 70.0)]})
    span = lambda t: tuple(op.bracket(q, t).first()[2:])
    assert span(90) == (20, 32) and span(75) == (32, 44) and span(99) == (None, None) and span(60) == (None, None)
    assert op.crossing(q, 99).first().x_star is None


def test_envelope(spark):
    cases = {"a": [22, 31, 22], "b": [20, 30, 40, 50, 60], "c": [31, 22, 31], "d": [50, 24, 25, 27], "e": [30, 18, 30]}
    rows = [(k, i, float(x), False) for k, xs in cases.items() for i, x in enumerate(xs)] + [("f", i, float(x), i == 1) for i, x in enumerate([30, 18, 30])]
    df = spark.createDataFrame(rows, "job_id string, shot_idx long, x double, pinned boolean")
    got = {}
    for r in op.smooth_lower_envelope(df, 4).orderBy("job_id", "shot_idx").collect():
        got.setdefault(r.job_id, []).append(r.smoothed)
    assert got == {"a": [22, 26, 22], "b": [20, 24, 28, 32, 36], "c": [26, 22, 26], "d": [28, 24, 25, 27], "e": [22, 18, 22], "f": [30, 18, 30]}
    assert [r.smoothed for r in op.smooth_lower_envelope(df, 0).filter("job_id = 'a'").orderBy("shot_idx").collect()] == [22, 31, 22]


def run_search(spark, score, target, width, grid=(20, 26, 32, 38, 44)):
    done, pts = [], {}
    while True:
        p = spark.createDataFrame([("a", 0, x, s) for x, s in pts.items()] or [("a", 0, 0, None)], "job_id string, shot_idx int, x int, score double")
        r = op.next_probe(p, grid, target, width).first()
        if r.next_x is None:
            return done
        pts[r.next_x] = score(r.next_x)
        done.append(r.next_x)


def test_search(spark):
    curve = lambda x: 95 - 1.5 * (x - 20)
    assert run_search(spark, curve, 75.0, 6) == [20, 32, 44, 38]
    assert run_search(spark, curve, 99.0, 6) == [20, 32, 44]
    assert len(run_search(spark, curve, 75.0, 1)) <= 5
    assert run_search(spark, curve, 75.0, 0) == [20, 26, 32, 38, 44]


def test_seeded_search(spark):
    seeds = spark.createDataFrame([("a", 0, 12.0, 5), ("b", 0, 61.0, 5), ("c", 0, 30.0, 5)], "job_id string, shot_idx int, seed double, step int")
    grid = list(range(20, 45))
    none = probes(spark, {"z": [(20, 1.0)]})
    first = {r.job_id: r.next_x for r in op.next_probe_seeded(none, seeds, grid, 75.0).collect()}
    assert first == {"a": 20, "b": 44, "c": 25}
    given = probes(spark, {"a": [(20, 60.0)], "b": [(44, 90.0)], "c": [(25, 80.0), (35, 70.0)]})
    after = {r.job_id: (r.next_x, r.done) for r in op.next_probe_seeded(given, seeds, grid, 75.0).collect()}
    assert after == {"a": (None, "bound"), "b": (None, "bound"), "c": (None, "enclosed")}


def test_verification(spark):
    rows = lambda d: spark.createDataFrame([("a", 0, 30.0, 76.0, d)], "job_id string, shot_idx int, x double, predicted double, delivered double")
    told = lambda d: op.verification_report(rows(d), 75).first()
    assert told(79.0).verdict == "under-reports" and told(69.0).verdict == "misalignment" and told(60.0).below_target == 1


def pairs(spark, rows):
    return spark.createDataFrame([("a", i, *map(float, r)) for i, r in enumerate(rows)], "job_id string, seq long, q double, log_bpf double, x_star double")


def test_line_fit(spark):
    p = pairs(spark, [(q, 0, 2 * q - 14) for q in range(18, 26)] + [(24.79, 0, 36.14)])
    fit = fits.theil_sen(p).first()
    assert abs(fit.a - 2) < 0.05 and abs(fit.b + 14) < 1
    good = fits.gated_map_fit(pairs(spark, [(q, 0, 2 * q - 14) for q in range(18, 26)])).first()
    assert good.refused is None and (good.q_lo, good.q_hi) == (18, 25)
    assert fits.gated_map_fit(pairs(spark, [(1, 0, 2), (2, 0, 4)])).first().refused == "too few pairs"


def test_plane_fit(spark):
    rng = random.Random(6)
    rows = [(q, lb, 1.5 * q + 4 * lb - 10) for q, lb in ((rng.uniform(15, 30), rng.uniform(3, 7)) for _ in range(40))]
    fit = fits.ols_trimmed(pairs(spark, rows))
    assert fit.first().sd < 0.01
    row = spark.createDataFrame([("a", 22.0, 5.0), ("a", 60.0, 5.0)], "job_id string, q double, log_bpf double")
    assert sorted(round(r.seed, 3) for r in fits.predict_setting(row, fit, 18, 50).collect()) == [43.0, 50.0]
    freak = fits.ols_trimmed(pairs(spark, rows + [(20.0, 5.0, 400.0)])).first()
    assert freak.sd < 1 and freak.n == 40
    assert fits.ols_trimmed(pairs(spark, rows[:11])).count() == 0


def brute_correction(obs):
    f = 1.0
    for p, o in obs:
        if p > 0 and o > 0:
            r = o / p
            f = r * 1.05 if r > f else f + 0.25 * (r - f)
            f = min(3.0, max(0.3, f))
    return f


def test_trackers(spark):
    rng = random.Random(7)
    runs = {"a": [(4, 6)] + [(4, 2)] * 41, "b": [(4.0, rng.choice([0.1, 1, 2, 3.9, 4.1, 6, 30, 0])) for _ in range(150)],
            "c": [(1, 0.01)] * 40, "d": [(1.0, 1 + rng.random()) for _ in range(100)]}
    df = spark.createDataFrame([(k, i, float(p), float(o)) for k, l in runs.items() for i, (p, o) in enumerate(l)],
                               "job_id string, seq long, predicted double, observed double")
    got = {r.job_id: r.factor for r in fits.correction_factor(df, chunk=8).collect()}
    assert got == pytest.approx({k: brute_correction(l) for k, l in runs.items()}, abs=1e-9)
    held = df.withColumnRenamed("predicted", "booked").withColumnRenamed("observed", "measured")
    want = {}
    for k, l in runs.items():
        worst, ratio = 0.0, 1.0
        for b, m in l:
            if b > 0 and m > 0:
                worst = max(min(4.0, m / b), worst * 0.98)
                ratio = min(4.0, max(0.5, ratio + (worst - ratio) / 20))
        want[k] = ratio
    assert {r.job_id: r.ratio for r in fits.decayed_peak_ratio(held, chunk=8).collect()} == pytest.approx(want, abs=1e-9)


def test_metric_is_part_of_a_curve(spark):
    """Probes of two metrics on one shot are two curves, each with its own target."""
    rows = [("j", 0, x, m, s) for m, points in (("vmaf", [(20, 95.0), (30, 85.0)]), ("xpsnr", [(20, 45.0), (30, 35.0)]), (None, [(20, 9.0), (30, 1.0)])) for x, s in points]
    probes = spark.createDataFrame(rows, "job_id string, shot_idx int, x int, metric string, score double")
    got = {r.metric: r.x for r in op.invert_curve(probes, {"vmaf": 90.0, "xpsnr": 36.0}).collect()}
    assert got == {"vmaf": pytest.approx(25.0), "xpsnr": pytest.approx(29.0), None: None}
    assert {r.metric: r.x_star for r in op.crossing(probes, {"vmaf": 90.0, "xpsnr": 99.0}).collect()} == {"vmaf": pytest.approx(25.0), "xpsnr": None, None: None}
    assert {r.metric: r.lo for r in op.bracket(probes, 40.0).collect()} == {"vmaf": None, "xpsnr": 20.0, None: None}
    wanted = spark.createDataFrame([("j", 0, 25.0, "vmaf"), ("j", 0, 25.0, "xpsnr")], "job_id string, shot_idx int, x double, metric string")
    assert {r.metric: r.predicted for r in op.interpolate_curve(probes, wanted).collect()} == {"vmaf": 90.0, "xpsnr": 40.0}
    with pytest.raises(ValueError):
        op.invert_curve(probes.drop("metric"), {"vmaf": 90.0})
