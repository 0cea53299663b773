"""Effect chains: the whole tables of effects and named chains, and steps that are built or refused."""

import math

import pytest
from pyspark.sql import functions as F

from mosaique.operators import batch
from mosaique.plans import chain


def specs_of(spark, rows):
    return chain.normalize_effect_specs(spark.createDataFrame(rows, "spec_id int, name string, values map<string, int>"), spark)


def test_all_effects_have_their_own_defaults_and_limits(spark):
    effects = sorted({row[0] for row in chain.PARAMETERS})
    assert len(effects) == 28 and len(chain.PARAMETERS) == len({row[:2] for row in chain.PARAMETERS})
    found = {r.name: r for r in specs_of(spark, [(k, name, {}) for k, name in enumerate(effects)]).collect()}
    for effect, key, low, high, default in chain.PARAMETERS:
        assert found[effect][key] == default and low <= default <= high
    assert (found["Frosted Glass"].softness, found["ASCII Art"].edge, found["Thermal Map"].angle) == (38, 76, 58)
    aliased = {r.spec_id: r.name for r in specs_of(spark, list((k, a, {}) for k, (a, _) in enumerate(chain.ALIASES))).collect()}
    assert set(aliased.values()) <= set(effects)


def test_ranges_of_all_effects_are_checked(spark):
    effects = sorted({row[0] for row in chain.PARAMETERS})
    table = specs_of(spark, [(k, name, {"size": 1000}) for k, name in enumerate([*effects, "Sepia"])])
    assert sorted(r.name for r in chain.check_spec_ranges(table, spark).filter("key = 'size'").collect()) == effects
    assert [r.name for r in chain.unknown_effects(table, spark).collect()] == ["Sepia"]


def test_named_chains(spark):
    table = chain.chain_table(spark)
    assert table.select("chain").distinct().count() == 19
    assert chain.check_spec_ranges(table.select("chain", "position", "name", *chain.KEYS), spark).filter(F.col("key").isin("amount", "size")).count() == 0
    asked = spark.createDataFrame([(1, "Digital scramble"), (2, "ASCII mask")], "id int, chain string")
    found = sorted((r.id, r.position, r.name, r.phase) for r in batch.preset_lookup(asked, table, "chain").collect())
    assert found == [(1, 0, "Encrypted Tiles", 0), (1, 1, "Glitch Blocks", 0), (1, 2, "CRT Distortion", 0), (2, 0, "Privacy Blur", 0), (2, 1, "ASCII Art", 0)]
    assert [s["name"] for s in chain.preset_specs("Maximum privacy")] == ["Privacy Blur", "Noise Redaction", "Marker Scribble"]
    with pytest.raises(KeyError):
        chain.preset_specs("no such chain")


def picture(spark, width=12, height=12):
    luma = (F.col("x") * 37 + F.col("y") * 59) % 256
    rows = spark.range(width * height).select(F.lit(1).alias("image_id"), (F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    return rows.withColumn("luma", luma.cast("int"))


def shown(df):
    return {(r.x, r.y): r.luma for r in df.collect()}


def spec_of(name, **values):
    return {"name": name} | {k: 0 for k in chain.KEYS} | {k: d for e, k, _, _, d in chain.PARAMETERS if e == name} | values


def test_redactions_hide_everything(spark):
    for name, color in (("Black Redaction", 0), ("White Redaction", 255)):
        assert set(shown(chain.run_chain(picture(spark), [spec_of(name)], 12, 12)).values()) == {color}
    half = shown(chain.run_chain(picture(spark), [spec_of("Black Redaction", amount=50)], 12, 12))
    assert half == {at: v // 2 for at, v in shown(picture(spark)).items()}


def test_every_other_effect_is_built_or_refused(spark):
    for name in sorted({row[0] for row in chain.PARAMETERS} - set(chain.STEPS)) + ["Sepia"]:
        with pytest.raises(NotImplementedError, match=name):
            chain.run_chain(picture(spark), [spec_of(name)], 12, 12)
    for spec in (spec_of("Encrypted Tiles"), spec_of("Encrypted Tiles", size=5, detail=0, angle=0)):
        with pytest.raises(NotImplementedError):
            chain.run_chain(picture(spark), [spec], 12, 12)


def blurred(values, radius):
    """Along one axis, by brute force."""
    reach = -int(-3 * radius // 1)
    weights = {d: math.exp(-d * d / (2 * radius * radius)) for d in range(-reach, reach + 1)}
    return [sum(w * values[min(max(k + d, 0), len(values) - 1)] for d, w in weights.items()) / sum(weights.values()) for k in range(len(values))]


@pytest.mark.parametrize("size", [1, 2, 12])
def test_blur_has_the_whole_radius(spark, size):
    old = shown(picture(spark))
    rows = [blurred([old[x, y] for x in range(12)], size) for y in range(12)]
    columns = [blurred([rows[y][x] for y in range(12)], size) for x in range(12)]
    new = shown(chain.run_chain(picture(spark), [spec_of("Soft Blur", size=size, softness=0)], 12, 12))
    assert new == {(x, y): math.floor(round(columns[x][y], 6)) for x, y in old}
    assert len(set(new.values())) > 1


def test_mosaic_has_a_grid_and_a_blur(spark):
    old = shown(picture(spark))
    plain = shown(chain.run_chain(picture(spark), [spec_of("Mosaic", size=4, softness=0, detail=0)], 12, 12))
    assert plain == {(x, y): sum(old[i, j] for i in range(x // 4 * 4, x // 4 * 4 + 4) for j in range(y // 4 * 4, y // 4 * 4 + 4)) // 16 for x, y in old}
    grid = shown(chain.run_chain(picture(spark), [spec_of("Mosaic", size=4, softness=0, detail=50, angle=2)], 12, 12))
    dark = {at for at in grid if grid[at] != plain[at]}
    assert dark == {(x, y) for x, y in old if x in (4, 5, 8, 9) or y in (4, 5, 8, 9)}
    assert all(grid[at] == round(plain[at] * 160 / 255) for at in dark)
    rows = [blurred([old[x, y] for x in range(12)], 3) for y in range(12)]
    columns = [[math.floor(round(v, 6)) for v in blurred([rows[y][x] for y in range(12)], 3)] for x in range(12)]
    soft = shown(chain.run_chain(picture(spark), [spec_of("Mosaic", size=4, softness=36, detail=0)], 12, 12))
    assert soft == {(x, y): sum(columns[i][j] for i in range(x // 4 * 4, x // 4 * 4 + 4) for j in range(y // 4 * 4, y // 4 * 4 + 4)) // 16 for x, y in old}


def test_pixelate_has_soft_edges_and_downsampling_ramps(spark):
    flat = picture(spark).withColumn("luma", F.when(F.col("x") < 4, 0).when(F.col("x") < 8, 100).otherwise(200))
    soft = shown(chain.run_chain(flat, [spec_of("Pixelate", size=4, softness=100)], 12, 12))
    ramp = [0, 0, 12, 37, 62, 87, 112, 137, 162, 187, 200, 200]
    step = [x // 4 * 100 for x in range(12)]
    assert [soft[x, 5] for x in range(12)] == [math.floor(round(a + (b - a) * 0.8, 6)) for a, b in zip(step, ramp)]
    grid = shown(chain.run_chain(flat, [spec_of("Pixelate", size=4, angle=40)], 12, 12))
    assert grid[8, 5] == round(200 * 195 / 255) and grid[9, 5] == 200 and grid[9, 4] == grid[8, 5]
    deep = shown(chain.run_chain(flat, [spec_of("Privacy Blur", size=0, softness=30, detail=0)], 12, 12))
    assert len(set(deep.values())) > 3


def test_wave_barcode_and_tiles(spark):
    old = shown(picture(spark))
    wave = shown(chain.run_chain(picture(spark), [spec_of("Wave Scramble", size=8, softness=4, detail=1)], 12, 12))
    moved = [round(4 * math.sin(2 * math.pi * y / 8)) for y in range(12)]
    assert wave == {(x, y): old[min(11, max(0, x - moved[y])), y] for x, y in old}
    bars = shown(chain.run_chain(picture(spark), [spec_of("Barcode Redaction", size=3)], 12, 12))
    assert set(bars.values()) == {10, 247} and all(bars[x, y] == bars[x, 0] for x, y in bars)
    tiles = shown(chain.run_chain(picture(spark), [spec_of("Encrypted Tiles", size=4, detail=0, angle=0)], 12, 12))
    assert tiles != old and set(tiles.values()) <= set(old.values())


def test_grain_and_whole_chains(spark):
    white = shown(chain.run_chain(picture(spark), chain.preset_specs("Whiteout"), 12, 12))
    assert len(set(white.values())) > 1 and min(white.values()) >= 250
    plain, grained = (shown(chain.run_chain(picture(spark), [spec_of("Soft Blur", size=2, softness=0, detail=d)], 12, 12)) for d in (0, 100))
    assert plain != grained and max(abs(plain[at] - grained[at]) for at in plain) < 60
    old, new = shown(picture(spark)), shown(chain.run_chain(picture(spark), chain.preset_specs("Face anonymizer"), 12, 12))
    assert len(new) == len(old) and max(new.values()) - min(new.values()) < max(old.values()) - min(old.values())
