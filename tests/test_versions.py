"""Models in versions: the mass kept by differences equals one built anew, and each chunk meets the version in force."""

import random

import pytest
from pyspark.sql import functions as F

from condist.functions.shared import shared_folder
from condist.operators import model, scoring, versions

DAYS = 10
ENDS = [2 * DAYS, 4 * DAYS, 6 * DAYS, 8 * DAYS, 10 * DAYS]


@pytest.fixture(scope="module")
def learned(spark):
    """Two services with a chunk at every time; one changes its configuration; its chunks around the change are superseded."""
    draw = random.Random(9)
    samples, chunks, reviews = [], [], []
    for service in ("a", "b"):
        for w in range(1, ENDS[-1] + 1):
            generation = 2 if service == "b" and w > 46 else 1
            chunks.append((service, 1, w, float(w % 3), generation))
            shift = 80 if w % 9 == 0 else 0
            values = {}
            for _ in range(12):
                v = float(draw.randint(0, 30) + shift)
                values[v] = values.get(v, 0) + 1
            # near values that are one in every model
            samples += [(service, 1, w, v * (1 + (w % 2) * 2.0**-52), c) for v, c in values.items()]
            if w % 4 == 0:
                reviews.append((service, 1, w, w + 15, True))
            if w % 12 == 0:
                reviews.append((service, 1, w, w + 35, False))
    services = [("a", 1, 0), ("b", 1, 0), ("b", 2, 45)]
    frames = (
        spark.createDataFrame(chunks, "service string, indicator int, w long, x double, generation long"),
        spark.createDataFrame(samples, "service string, indicator int, w long, v double, c long"),
        spark.createDataFrame(services, "service string, generation long, since_us long"),
        spark.createDataFrame(reviews, "service string, indicator int, w long, us long, accept boolean"),
    )
    root = shared_folder(spark, "versions")
    versions.learn(spark, root, 0, ENDS, *frames, lambda counts: model.ready_by_count(counts, 10))
    return root, frames


def verdicts(spark, root, last):
    return versions.read(spark, root, "verdicts", versions.VERDICTS, range(1, last + 1))


def test_mass_by_differences_equals_a_rebuilt_one(spark, learned):
    root, (_, samples, services, reviews) = learned
    for k, end in enumerate(ENDS, 1):
        state = verdicts(spark, root, k).join(versions.decided(reviews, end, "review_override"), versions.CHUNK, "left").where(model.eligible())
        entries = state.join(versions.active_at(services, end), ["service", "generation"], "left_semi").withColumn("sign", F.lit(1).cast("long"))
        want = sorted(map(tuple, versions.pairs(entries.select(*versions.MODEL, "w", "x", "sign"), samples).select("service", "indicator", "generation", "x", "v", "n").collect()))
        assert sorted(map(tuple, versions.read(spark, root, "mass", versions.MASS, [k]).drop("step").collect())) == want and want
        counts = {(r.service, r.generation): r.n for r in entries.groupBy("service", "generation").agg(F.count("*").alias("n")).collect()}
        assert {(r.service, r.generation): r.eligible for r in versions.read(spark, root, "counts", versions.COUNTS, [k]).collect()} == counts


def test_reviews_move_chunks(spark, learned):
    """Some bad chunks were accepted, and some of these taken back in a later step."""
    root, (_, _, _, reviews) = learned
    bad = verdicts(spark, root, len(ENDS)).where("state = 'bad'")
    moved = bad.join(reviews.where("us <= 100"), versions.CHUNK)
    assert bad.count() > 5 and moved.where("accept").count() > 0 and moved.where("not accept").count() > 0


def test_versions_and_their_chunks(spark, learned):
    root, (chunks, samples, _, _) = learned
    manifest = versions.read(spark, root, "manifest", versions.MANIFEST, range(1, 6))
    got = sorted((r.service, r.generation, r.version, r.interval_end) for r in manifest.collect())
    assert got == [("a", 1, k, e) for k, e in enumerate(ENDS, 1)] + [("b", 1, 1, 20), ("b", 1, 2, 40), ("b", 2, 1, 60), ("b", 2, 2, 80), ("b", 2, 3, 100)]
    rows = verdicts(spark, root, 5).collect()
    # the chunk of generation 1 that ends when generation 2 is active is not scored
    assert {r.w for r in rows if r.service == "b"} == set(range(1, 101)) - {45, 46}
    for r in rows:
        published = [(v, e) for s, g, v, e in got if s == r.service and g == r.generation and e < r.w]
        assert r.version == max((v for v, _ in published), default=None)
        assert (r.state == "baseline") == (not published)
    # a chunk's verdict is that of its version's model alone
    force = manifest.where("service = 'a' and version = 2").select(*versions.MODEL, "version", "step")
    mass = versions.model_of(spark, root, force)
    mine = chunks.where("service = 'a' and w > 40 and w <= 60")
    want = scoring.analyse(mine, samples.join(mine.select(*versions.CHUNK, "generation"), versions.CHUNK), mass.drop("version"), versions.MODEL)
    assert sorted((r.w, r.state, round(r.p, 12)) for r in want.collect()) == sorted((r.w, r.state, round(r.p, 12)) for r in rows if r.service == "a" and 40 < r.w <= 60)
    # near values are one
    assert mass.select("v").distinct().count() < samples.select("v").distinct().count()


def test_a_repeated_step_changes_nothing(spark, learned):
    root, frames = learned
    before = {n: sorted(map(tuple, versions.read(spark, root, n, s, [3]).collect()), key=str) for n, s in (("mass", versions.MASS), ("manifest", versions.MANIFEST))}
    versions.advance(spark, root, 3, ENDS[1], ENDS[2], *frames, lambda counts: model.ready_by_count(counts, 10))
    for n, s in (("mass", versions.MASS), ("manifest", versions.MANIFEST)):
        assert sorted(map(tuple, versions.read(spark, root, n, s, [3]).collect()), key=str) == before[n]


def test_broken_bodies_fall_back(spark, learned):
    root, _ = learned
    manifest = versions.read(spark, root, "manifest", versions.MANIFEST, range(1, 6))
    broken = manifest.withColumn("checksum", F.when(F.expr("service = 'a' and version >= 4"), "x").otherwise(F.col("checksum")))
    got = {(r.service, r.generation): r.version for r in versions.in_force(versions.intact(spark, root, broken)).collect()}
    assert got == {("a", 1): 3, ("b", 1): 2, ("b", 2): 3}
    assert versions.intact(spark, root, manifest, keep=2).where("service = 'a'").count() == 2


def test_lookups_of_many_rows_are_bounded_once(spark, monkeypatch):
    """Beyond the rows of a part, lookups get the rows of the largest level as their bound, and verdicts stay the same."""
    samples = spark.createDataFrame([("a", w, float(v), 1) for w in range(1, 7) for v in range(10)], "service string, w long, v double, c long")
    chunks = spark.createDataFrame([("a", w, float(w)) for w in range(1, 7)], "service string, w long, x double")
    mass = spark.createDataFrame([("a", float(x), float(v), 1) for x in (1, 2, 3) for v in range(0, 12, x)], "service string, x double, v double, n long")
    plain = sorted(map(tuple, scoring.analyse(chunks, samples, mass, ["service"]).collect()))
    bounds, inner = [], scoring.neighbours
    monkeypatch.setattr(scoring, "neighbours", lambda *a, known=None, **k: bounds.append(known) or inner(*a, known=known, **k))
    monkeypatch.setattr(scoring, "PART_ROWS", 20)
    assert sorted(map(tuple, scoring.analyse(chunks, samples, mass, ["service"]).collect())) == plain
    # level 3 has four points, and the samples of four chunks
    assert bounds == [44] and len(plain) == 6
