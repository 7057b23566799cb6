import pytest
from pyspark.sql import functions as F

from tablewright.operators import noise
from tablewright.operators.compare import changed_cells
from tablewright.operators.noise import NoiseSettings
from tablewright.plans import sweep


@pytest.fixture(scope="module")
def people(spark):
    k = F.col("id")
    return spark.range(400).select(
        k.alias("row_id"), F.when(k % 9 != 0, F.concat(F.lit("Name"), k.cast("string"))).alias("name"),
        F.when(k % 5 == 0, "brca1").otherwise("x").alias("gene"), (k % 30).cast("int").alias("age"), (k / 7).alias("score"))


def test_no_noise_is_identity(people):
    out = noise.inject(people, NoiseSettings(0.0))
    assert changed_cells(people, out).count() == 0
    assert noise.noise_log(people, NoiseSettings(0.0)).count() == 0


def test_full_noise_touches_every_cell(people):
    assert noise.noise_log(people, NoiseSettings(1.0)).count() == 1600


def test_log_explains_every_change_and_no_other(people):
    settings = NoiseSettings(0.3, seed=4)
    changes = {(r.row_id, r.column): (r.before, r.after) for r in changed_cells(people, noise.inject(people, settings)).collect()}
    log = {(r.row_id, r.column): r for r in noise.noise_log(people, settings).collect()}
    assert changes.keys() <= log.keys()
    for key, r in log.items():
        assert changes.get(key, (r.original, r.original)) == (r.original, r.modified)
    assert 0.25 < len(log) / 1600 < 0.35
    assert {r.noise_type for r in log.values()} == set(noise.KINDS)


def test_partitioning_and_seed(people):
    settings = NoiseSettings(0.2, seed=1)
    one = noise.inject(people.repartition(1), settings)
    for n in (4, 17):
        assert noise.inject(people.repartition(n), settings).exceptAll(one).count() == 0
    assert noise.inject(people, NoiseSettings(0.2, seed=2)).exceptAll(one).count() > 0


def test_eligible_columns_share_the_noise():
    columns = ["a", "b", "c", "d"]
    assert NoiseSettings(0.1).chances(columns) == {c: 0.1 for c in columns}
    assert NoiseSettings(0.1, "targeted", targets=["a", "zz"]).chances(columns) == {"a": 0.4}
    assert NoiseSettings(0.1, "targeted").chances(columns) == {}
    weighted = NoiseSettings(0.1, "weighted", weights={"a": 5.0}).chances(columns)
    assert weighted["a"] == pytest.approx(0.25) and sum(weighted.values()) == pytest.approx(0.4)
    with pytest.raises(ValueError):
        NoiseSettings(kinds=["other"])


def test_nothing_eligible(people):
    settings = NoiseSettings(0.5, "targeted", targets=["nope"])
    assert noise.inject(people, settings).exceptAll(people).count() == 0
    assert noise.noise_log(people, settings).count() == 0


def test_semantic_rules(people):
    log = noise.noise_log(people, NoiseSettings(1.0, kinds=["semantic"])).collect()
    for r in log:
        if r.original is None:
            assert r.modification == "skipped_nan" and r.modified is None
        elif r.column == "gene" and r.original == "brca1":
            assert r.modified in noise.SYMBOL_CONFUSIONS["BRCA1"]
        elif r.column == "age":
            assert int(r.modified) - int(r.original) in noise.DRIFTS
        elif r.column == "score" and float(r.original):
            assert abs(float(r.modified) / float(r.original) - 1) <= 0.1 + 1e-12
        elif r.column == "name":
            assert r.modification in ("case_swap", "truncated") or r.modified[1:] == r.original


def test_typo_rules(people):
    for r in noise.noise_log(people, NoiseSettings(1.0, kinds=["typo"])).collect():
        note = r.modification
        if r.original is None or len(r.original) < 2:
            assert note in ("skipped_nan", "too_short") and r.modified == r.original
        elif note.startswith("swapped"):
            at = int(note.split()[-1])
            o = r.original
            assert r.modified == o[:at] + o[at + 1] + o[at] + o[at + 2:]
        elif note.startswith("deleted"):
            at = int(note.split()[-1])
            assert r.modified == r.original[:at] + r.original[at + 1:]
        elif note.startswith("inserted"):
            at = int(note.split()[-1])
            assert r.modified == r.original[:at] + note[10] + r.original[at:]
        elif note.startswith("adjacent"):
            assert len(r.modified) == len(r.original)
            assert sum(a != b for a, b in zip(r.modified, r.original)) == 1
        else:
            assert note == "no_adjacent_found" and r.modified == r.original


def test_variations_and_grid(people):
    settings = NoiseSettings(0.1, seed=3)
    ratios = noise.variation_ratios(settings, 4)
    assert all(0.05 <= r <= 0.15 for _, r in ratios)
    out = noise.noisy_variations(people, settings, 4)
    assert out.groupBy("variant").count().where("count = 400").count() == 4
    assert [p for _, _, p in noise.sweep_grid(1, 10, 3, 1)] == [1, 4, 7, 10]


def test_sweep_stores_pending_entries(spark, people):
    from tablewright.operators.library import FixLibrary
    from tablewright.session import scratch_path

    store = FixLibrary(spark, scratch_path(spark, "sweep-library"))
    grid = noise.sweep_grid(10, 30, 10, 2)
    sweep.noise_sweep(people, grid, NoiseSettings(seed=9), store)
    rows = store.read().collect()
    assert len(rows) == 6 and {r.status for r in rows} == {"PENDING"} and len({r.id for r in rows}) == 6
    assert {r.error_type for r in rows} == {"noise_typo_10%", "noise_typo_20%", "noise_typo_30%"}
    assert all(len(r.vector) == 1000 for r in rows)


@pytest.mark.parametrize("settings", [
    NoiseSettings(ratio=0.1, seed=3), NoiseSettings(ratio=0.25, mode="targeted", targets=["b"], seed=1), NoiseSettings(ratio=0.3, mode="weighted", weights={"a": 0.0, "b": 5.0}, seed=2),
    NoiseSettings(ratio=1.0), NoiseSettings(ratio=0.0), NoiseSettings(ratio=0.5, mode="targeted", targets=["none"])])
def test_exact_amount(spark, settings):
    from tablewright.operators import exact_noise

    df = spark.createDataFrame([(i, f"text {i}", i, float(i), None) for i in range(301)], "row_id long, a string, b long, c double, d string").repartition(3)
    log = exact_noise.exact_log(df, settings)
    may = {"uniform": "abcd", "targeted": [t for t in settings.targets if t in "abcd"], "weighted": "bcd"}[settings.mode]
    want = min(int(round(settings.ratio * 301 * 4, 6)), 301 * len(may))
    cells = {(r.row_id, r.column) for r in log.collect()}
    assert log.count() == len(cells) == want and {c for _, c in cells} <= set(may)
    assert cells == {(r.row_id, r.column) for r in exact_noise.exact_log(df.repartition(5), settings).collect()}
    noisy = {r.row_id: r for r in exact_noise.inject_exact(df, settings).collect()}
    for r in df.collect():
        for c in "abcd":
            assert (r["row_id"], c) in cells or noisy[r["row_id"]][c] == (r[c] if c not in may or r[c] is None else str(r[c]))
    if settings.mode == "weighted" and want:
        counts = [sum(c == x for _, c in cells) for x in "bcd"]
        assert counts[0] > 2.5 * counts[1] and counts[0] > 2.5 * counts[2]


def test_exact_choice_is_the_least_priorities(spark):
    from pyspark.sql import functions as F

    from tablewright.operators import exact_noise

    df = spark.range(500).select(F.col("id").alias("row_id"), F.lit("x").alias("a"), F.lit("y").alias("b"))
    for ratio in (0.001, 0.013, 0.5):
        log = exact_noise.exact_log(df, NoiseSettings(ratio=ratio, seed=9))
        ranked = df.select(F.concat_ws("|", F.lit("9"), "row_id").alias("p"), "row_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("column")).orderBy(
            exact_noise.priority(F.col("p"), F.col("column"), F.lit(1.0))).limit(int(ratio * 1000))
        assert {(r.row_id, r.column) for r in log.collect()} == {(r.row_id, r["column"]) for r in ranked.collect()}
    import pytest as _pytest

    twice = df.unionByName(df)
    with _pytest.raises(ValueError):
        exact_noise.choose(twice, NoiseSettings(ratio=0.0005, seed=9))
