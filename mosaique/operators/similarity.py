"""Near-duplicate rasters: fingerprints, similar pairs, groups, and which copy to keep."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from mosaique.functions import scalars as S
from mosaique.operators import metric, raster as R
from mosaique.operators.graph import connected_components
from mosaique.operators.scan import numbered, scan
from mosaique.session import materialize

THRESHOLD = 88
#: Rows that a hash may become for its bands.
MAX_KEYS = 100
#: What testing a pair costs where writing, moving and sorting a row costs 1.
PAIR_COST = 0.02


class Layout(NamedTuple):
    """Bits of the two hashes, and the largest distance of two histograms."""

    a_bits: int = 64
    d_bits: int = 64
    l1: float = 6.0


#: Whole rasters: 8 x 8 and 9 x 8 grey means, three channels of 8 bins. Ready-made 8 x 8 arrays: 56 bits of difference, one channel.
WHOLE, ARRAYS = Layout(), Layout(64, 56, 2.0)


def average_hash(luma: Column) -> Column:
    """Bit k is set where pixel k is at least the mean (compared in integers)."""
    total = F.aggregate(luma, F.lit(0).cast("long"), lambda s, v: s + v)
    return S.pack_bits(F.transform(luma, lambda v: v * F.size(luma) >= total))


def difference_hash(luma: Column, width: int = 8) -> Column:
    """For each row, bits where a pixel is brighter than the one to its left."""
    right = F.filter(F.sequence(F.lit(0), F.size(luma) - 1), lambda k: k % width != 0)
    return S.pack_bits(F.transform(right, lambda k: F.get(luma, k) > F.get(luma, k - 1)))


def channel_histogram(luma: Column, bins: int = 8) -> Column:
    """Shares of equal bins over 0..255."""
    size = 256 // bins
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(luma, lambda v: F.floor(v / size) == b)) / F.size(luma))


def sharpness(luma: Column, width: int = 8, height: int = 8) -> Column:
    """Population variance of the four-neighbour Laplacian over the interior."""
    inner = F.transform(F.sequence(F.lit(0), F.lit((width - 2) * (height - 2) - 1)), lambda k: (F.floor(k / (width - 2)) + 1) * width + k % (width - 2) + 1)
    at = lambda k: F.get(luma, k.cast("int"))
    lap = F.transform(inner, lambda k: 4 * at(k) - at(k - 1) - at(k + 1) - at(k - width) - at(k + width))
    n = (width - 2) * (height - 2)
    total = F.aggregate(lap, F.lit(0).cast("long"), lambda s, v: s + v)
    squares = F.aggregate(lap, F.lit(0).cast("long"), lambda s, v: s + v * v)
    return (squares * n - total * total) / float(n * n)


def fingerprints(rasters: DataFrame) -> DataFrame:
    """All columns of `rasters` (which has luma), with a_hash, d_hash, color_hist and sharpness in place of luma."""
    return rasters.select(
        *[c for c in rasters.columns if c != "luma"],
        average_hash(F.col("luma")).alias("a_hash"), difference_hash(F.col("luma")).alias("d_hash"),
        channel_histogram(F.col("luma")).alias("color_hist"), sharpness(F.col("luma")).alias("sharpness"),
    )


def raster_fingerprints(pixels: DataFrame, id_col: str = "image_id") -> DataFrame:
    """image_id, width, height, a_hash, d_hash, color_hist (24) and sharpness of pixel rows (image_id, x, y, r, g, b) of any size.

    Grey values are averaged over the cells of an 8 x 8 and a 9 x 8 grid by the area that a pixel shares with a cell, in
    integers: all cells of a grid have the same area, so sums compare as means do. Each task adds up what it has
    before the shuffle; what is gathered per image are its 136 cells and 24 bins.
    """
    size = pixels.groupBy(id_col).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    sized = pixels.join(size.hint("merge"), id_col).withColumn("luma", S.luma(F.col("r"), F.col("g"), F.col("b")))

    def share(at: str, length: str, cells: int) -> Column:
        """Cells that a pixel touches along one axis, with the length it shares with each (in parts of 1/cells)."""
        p, n = F.col(at).cast("long"), F.col(length).cast("long")
        first, last = F.floor(p * cells / n), F.floor(((p + 1) * cells - 1) / n)
        return F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("cell"), (F.least((p + 1) * cells, (k + 1) * n) - F.greatest(p * cells, k * n)).alias("part")))

    def grid(across: int) -> DataFrame:
        cells = sized.select(id_col, "luma", F.explode(share("x", "width", across)).alias("cx"), share("y", "height", 8).alias("ys"))
        cells = cells.select(id_col, "luma", "cx", F.explode("ys").alias("cy"))
        return cells.groupBy(id_col, (F.col("cy.cell") * across + F.col("cx.cell")).cast("int").alias("cell")).agg(F.sum(F.col("luma") * F.col("cx.part") * F.col("cy.part")).alias("total"))

    def gathered(table: DataFrame, key: str, value: str, to: str) -> DataFrame:
        return table.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda c: c[value]).alias(to))

    binned = pixels.select(id_col, F.explode(F.array(*[(F.floor(F.col(c) / 32) + 8 * k).cast("int") for k, c in enumerate("rgb")])).alias("bin"))
    counts = binned.groupBy(id_col, "bin").agg(F.count("*").alias("n"))
    hist = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    out = size
    for part in (gathered(grid(8), "cell", "total", "a"), gathered(grid(9), "cell", "total", "d"), hist, R.sharpness(sized.select(id_col, "x", "y", "luma"))):
        out = out.join(part.hint("merge"), id_col, "left")
    area = F.col("width").cast("long") * F.col("height")
    share_of = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda b: F.coalesce(F.try_element_at("bins", b), F.lit(0)) / area)
    return out.select(id_col, "width", "height", average_hash(F.col("a")).alias("a_hash"), difference_hash(F.col("d"), 9).alias("d_hash"), share_of.alias("color_hist"), F.coalesce("sharpness", F.lit(0.0)).alias("sharpness"))


def exact_fingerprint_dedup(fp: DataFrame, key: list[str], id_col: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(one row per key: that of the smallest id; copies as src, dst star links). The second keeps copies off the pair join."""
    least = fp.groupBy(*key).agg(F.min(id_col).alias("_rep"))
    tied = fp.join(least.hint("merge"), key)
    return tied.filter(F.col(id_col) == F.col("_rep")).drop("_rep"), tied.filter(F.col(id_col) != F.col("_rep")).select(F.col("_rep").alias("src"), F.col(id_col).alias("dst"))


def _scored(pairs: DataFrame, threshold: float, id_col: str, layout: Layout) -> DataFrame:
    """Pairs of ids with ha, hd and l1: exact score, then the threshold."""
    score = S.visual_score(F.col("ha"), F.col("hd"), F.col("l1"), *layout)
    return pairs.select(F.col(f"l_{id_col}").alias("src"), F.col(f"r_{id_col}").alias("dst"), score.alias("score")).filter(F.col("score") >= threshold)


def _sides(fp: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    columns = [id_col, "a_hash", "d_hash", "color_hist"]
    return fp.select([F.col(c).alias(f"l_{c}") for c in columns]), fp.select([F.col(c).alias(f"r_{c}") for c in columns])


def _distances(pairs: DataFrame, threshold: int, layout: Layout) -> DataFrame:
    pairs = pairs.withColumn("ha", S.hamming(F.col("l_a_hash"), F.col("r_a_hash"))).withColumn("hd", S.hamming(F.col("l_d_hash"), F.col("r_d_hash")))
    return pairs.filter(S.within_hash_bound(F.col("ha"), F.col("hd"), threshold, layout.a_bits, layout.d_bits))


def similar_pairs_exact(fp: DataFrame, threshold: int = THRESHOLD, blocks: int | None = None, id_col: str = "image_id", layout: Layout = ARRAYS) -> DataFrame:
    """src < dst, score of every pair at the threshold or more.

    The square of all pairs is cut into tiles of bounded size, half of which (and the diagonal) hold each pair once; rows are shuffled to
    their tiles, and a task compares the arrays of a tile. Each row goes to about `blocks` tiles.
    """
    return _scored(metric.all_pairs(fp, threshold, id_col, tuple(layout), blocks), threshold, id_col, layout)


class Bands(NamedTuple):
    """One hash cut into `count` bands: similar pairs agree in one of them up to left + right flipped bits."""

    hash: str
    bits: int
    count: int
    left: int
    right: int


def _ball(bits: int, radius: int) -> int:
    return sum(math.comb(bits, k) for k in range(radius + 1))


def _bands(name: str, bits: int, distance: int, rows: int) -> tuple[Bands, float]:
    """The cheapest bands that lose no pair within a distance, and what they cost a row of a table of so many.

    Of m bands one differs in at most r bits if m (r + 1) > distance; both sides flip up to half of r. A row costs what it
    writes, and PAIR_COST for each row that it is likely to meet.
    """
    best = None
    for r in range(3):
        m = distance // (r + 1) + 1
        width = bits // m
        left, right = (r + 1) // 2, r // 2
        wide = -(-bits // m)
        if width and m * _ball(wide, left) <= MAX_KEYS:
            share = min(1.0, m * _ball(width, r) / 2.0**width)
            cost = m * (_ball(wide, left) + _ball(wide, right)) + PAIR_COST * rows * share
            if best is None or cost < best[1]:
                best = Bands(name, bits, m, left, right), cost
    return best or (Bands(name, bits, 1, 0, 0), 2 + PAIR_COST * rows)


def band_plan(threshold: int, layout: Layout = ARRAYS, rows: int = 1_000_000) -> list[Bands]:
    """Bands that lose no pair at the threshold, or nothing if meeting every row once is cheaper.

    The score bounds a weighted sum of both distances. Pairs that differ in at most k bits of the mean hash meet in its
    bands; the others use up so much of the bound that few bits are left for the difference hash. k is where the two
    together cost least, rows and meetings counted.
    """
    wa, wd, room = S.WEIGHT_A * layout.d_bits, S.WEIGHT_D * layout.a_bits, layout.a_bits * layout.d_bits * (100 - threshold)
    best: tuple[float, list[Bands]] = (8 + 0.5 * PAIR_COST * rows, [])
    for k in range(-1, room // wa + 1):
        left = room - wa * (k + 1)
        parts = ([_bands("a_hash", layout.a_bits, k, rows)] if k >= 0 else []) + ([_bands("d_hash", layout.d_bits, left // wd, rows)] if left >= 0 else [])
        cost = sum(one for _, one in parts)
        if cost < best[0]:
            best = cost, [bands for bands, _ in parts]
    return best[1]


def similar_pairs_metric(fp: DataFrame, threshold: float = 72, id_col: str = "image_id", layout: Layout = ARRAYS, pivots: int | None = None) -> DataFrame:
    """The same pairs as `similar_pairs_exact`, from cells around pivots and the triangle inequality."""
    return _scored(metric.candidate_pairs(fp, threshold, id_col, tuple(layout), pivots), threshold, id_col, layout)


def candidate_pairs_banded(fp: DataFrame, threshold: int = THRESHOLD, id_col: str = "image_id", layout: Layout = ARRAYS) -> DataFrame:
    """The same pairs as `similar_pairs_exact`, from an equi-join on bands of the hashes.

    Only ids and hashes go into the bands; histograms are joined to the pairs that both hashes leave. The join reads
    plain shuffles, so that Spark can split a value of a band that very many rows share. Thresholds at which bands select too little
    take the metric join.
    """
    plan = band_plan(threshold, layout, fp.count())
    if not plan:
        return similar_pairs_metric(fp, threshold, id_col, layout)
    left, right = (side.drop(f"{p}_color_hist") for p, side in zip("lr", _sides(fp, id_col), strict=True))

    def keys(prefix: str, side: str) -> Column:
        out = []
        for at, bands in enumerate(plan):
            value = F.col(f"{prefix}_{bands.hash}")
            cuts = [round(k * bands.bits / bands.count) for k in range(bands.count + 1)]
            for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
                part = value if high - low == 64 else F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))
                flips = [part.bitwiseXOR(F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")) for bit in range(high - low)] if getattr(bands, side) else []
                out += [F.struct(F.lit(100 * at + k).alias("band"), v.alias("value")) for v in [part, *flips]]
        return F.array(*out)

    probe = left.withColumn("key", F.explode(keys("l", "left"))).select("*", "key.band", "key.value").drop("key")
    build = right.withColumn("key", F.explode(keys("r", "right"))).select("*", "key.band", "key.value").drop("key")
    met = probe.hint("merge").join(build, ["band", "value"]).filter(F.col(f"l_{id_col}") < F.col(f"r_{id_col}"))
    # A pair may meet in several bands; the score is computed once per pair.
    close = _distances(met, threshold, layout).select(f"l_{id_col}", f"r_{id_col}", "ha", "hd").distinct()
    for p in "lr":
        close = close.join(fp.select(F.col(id_col).alias(f"{p}_{id_col}"), F.col("color_hist").alias(f"{p}_color_hist")).hint("merge"), f"{p}_{id_col}")
    return _scored(close.withColumn("l1", S.hist_l1(F.col("l_color_hist"), F.col("r_color_hist"))), threshold, id_col, layout)


def members(fp: DataFrame, pairs: DataFrame, copies: DataFrame | None = None, id_col: str = "image_id") -> DataFrame:
    """group (smallest id) and the columns of `fp` for every row that has a similar one."""
    links = pairs.select("src", "dst")
    if copies is not None:
        links = links.unionByName(copies)
    found = connected_components(links).withColumnRenamed("vertex", id_col).withColumnRenamed("component", "group_key")
    return fp.join(found.hint("merge"), id_col)


def pick_anchor(table: DataFrame, id_col: str = "image_id") -> DataFrame:
    """group_key, anchor (id, hashes and histogram): most pixels, then bytes, then sharpness, then first path."""
    pixels = F.col("width").cast("long") * F.col("height")
    order = F.struct((-pixels).alias("p"), (-F.col("size_bytes")).alias("b"), (-F.col("sharpness")).alias("s"), "path", F.col(id_col).alias("id"))
    return table.groupBy("group_key").agg(F.min_by(F.struct(F.col(id_col).alias("id"), "path", "a_hash", "d_hash", "color_hist"), order).alias("anchor"))


def score_to_anchor(table: DataFrame, anchors: DataFrame, id_col: str = "image_id", layout: Layout = ARRAYS) -> DataFrame:
    """Members with score_to_anchor; it may be under the threshold, since groups are transitive."""
    joined = table.join(anchors.hint("merge"), "group_key")
    a = F.col("anchor")
    score = S.visual_score(S.hamming(F.col("a_hash"), a["a_hash"]), S.hamming(F.col("d_hash"), a["d_hash"]), S.hist_l1(F.col("color_hist"), a["color_hist"]), *layout)
    return joined.withColumn("score_to_anchor", F.when(F.col(id_col) == a["id"], 100.0).otherwise(score)).withColumn("anchor_id", a["id"]).withColumn("anchor_path", a["path"]).drop("anchor")


def group_summary(table: DataFrame) -> DataFrame:
    """group_key, n_members, total_bytes, min_score, anchor_path per group."""
    return table.groupBy("group_key").agg(F.count("*").alias("n_members"), F.sum("size_bytes").alias("total_bytes"), F.min("score_to_anchor").alias("min_score"), F.min("anchor_path").alias("anchor_path"))


def number_groups(groups: DataFrame) -> DataFrame:
    """Groups with group_no from 1: most members first, then most bytes, then anchor path."""
    return numbered(groups, [F.desc("n_members"), F.desc("total_bytes"), F.lower("anchor_path"), "group_key"], "group_no")


def order_members(table: DataFrame) -> DataFrame:
    """Members with member_no from 1: best score, then most pixels, then path."""
    order = [F.desc("score_to_anchor"), F.desc(F.col("width").cast("long") * F.col("height")), F.lower("path"), "image_id"]
    return scan(table, ["group_key"], order, number="member_no")


def _keep_orders() -> dict[str, list[tuple[Column, bool]]]:
    """Sort columns of the keep rules, each with whether it falls."""
    pixels, size, sharpness = F.col("width").cast("long") * F.col("height"), F.col("size_bytes"), F.col("sharpness")
    return {
        "resolution": [(pixels, True), (size, True), (sharpness, True)],
        "sharpest": [(sharpness, True), (pixels, True)],
        "newest": [(F.col("mtime"), True)],
        "oldest": [(F.col("mtime"), False)],
        "largest": [(size, True)],
        "smallest": [(size, False)],
        "shortest": [(F.length("path"), False)],
    }


def keep_rules() -> dict[str, list[Column]]:
    """Sort orders of the keep rules; ties keep the first member."""
    return {rule: [c.desc() if falls else c.asc() for c, falls in order] for rule, order in _keep_orders().items()}


def best_by_rules(table: DataFrame, id_col: str = "image_id") -> DataFrame:
    """rule and id: what each keep rule keeps of every group of ordered members, by one aggregate for all rules."""

    def place(order: list[tuple[Column, bool]]) -> Column:
        # Structs compare field by field, nulls first: a falling column is the rising one of negatives, NaN before and nulls behind them.
        keys = [F.struct(F.when(c.isNull(), 1).when(F.isnan(c), -1).otherwise(0), -c) if falls else F.struct(c) for c, falls in order]
        return F.struct(*keys, "member_no")

    orders = _keep_orders()
    best = table.groupBy("group_key").agg(*[F.min_by(id_col, place(order)).alias(rule) for rule, order in orders.items()])
    return best.select(F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias(id_col)) for rule in orders])))


def keep_best(table: DataFrame, rule: str = "resolution") -> DataFrame:
    """Ordered members with `best`: the one that the rule keeps."""
    place = scan(table, ["group_key"], [*keep_rules()[rule], "member_no"], number="_keep_no")
    return place.withColumn("best", F.col("_keep_no") == 1).drop("_keep_no")


def check_except_best(table: DataFrame, rule: str = "resolution") -> DataFrame:
    """Members with `checked`: all but the one to keep."""
    kept = keep_best(table, rule)
    return kept.withColumn("checked", ~F.col("best")).drop("best")


def checked_summary(table: DataFrame) -> DataFrame:
    """n_checked and n_members over all groups."""
    return table.agg(F.count_if("checked").alias("n_checked"), F.count("*").alias("n_members"))


def drop_removed(table: DataFrame, removed: DataFrame) -> DataFrame:
    """Members without the removed paths: groups under two go, the others are numbered anew in their order, anchors are picked anew, scores stay."""
    left = table.join(removed.select("path").distinct().hint("merge"), "path", "left_anti")
    several = left.groupBy("group_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("group_key")
    left = left.drop("anchor_id", "anchor_path").join(several.hint("merge"), "group_key", "left_semi")
    anchors = pick_anchor(left).select("group_key", F.col("anchor.id").alias("anchor_id"), F.col("anchor.path").alias("anchor_path"))
    order = left.select("group_key", F.col("group_no").alias("_old")).distinct()
    numbers = numbered(order, ["_old", "group_key"], "group_no").select("group_key", "group_no")
    return left.drop("group_no").join(anchors.hint("merge"), "group_key").join(numbers.hint("merge"), "group_key")


def manifest(table: DataFrame) -> DataFrame:
    """The eleven columns of the review file; `table` has group_no and checked."""
    return table.select(
        F.col("group_no").alias("group"), "checked", "score_to_anchor", "path", "anchor_path", "width", "height",
        F.format_string("%.3f", S.megapixels(F.col("width"), F.col("height"))).alias("megapixels"), "size_bytes", "mtime",
        F.format_string("%.2f", "sharpness").alias("sharpness"),
    )


def write_manifest_csv(table: DataFrame, path: str) -> None:
    """The review file as CSV with a header; readers see all of it or nothing."""
    manifest(table).orderBy("group", "path").write.mode("overwrite").option("header", True).csv(path)


def ordered_groups(fp: DataFrame, threshold: int = THRESHOLD, banded: bool = True, layout: Layout = ARRAYS) -> DataFrame:
    """From fingerprints to ordered members: group_no, member_no, score_to_anchor and anchor."""
    fp = materialize(fp, "fingerprints")
    distinct, copies = exact_fingerprint_dedup(fp, ["a_hash", "d_hash", "color_hist"])
    pairs = (candidate_pairs_banded if banded else similar_pairs_exact)(distinct, threshold, layout=layout)
    table = materialize(members(fp, pairs, copies), "members")
    scored = materialize(score_to_anchor(table, pick_anchor(table), layout=layout), "scored")
    numbered = number_groups(group_summary(scored)).select("group_key", "group_no", "n_members", "total_bytes", "min_score")
    return order_members(scored.join(numbered.hint("merge"), "group_key"))


def similar_groups(fp: DataFrame, threshold: int = THRESHOLD, banded: bool = True, rule: str = "resolution", layout: Layout = ARRAYS) -> DataFrame:
    """Ordered members with `checked`: all but the one that the rule keeps of each group."""
    return check_except_best(ordered_groups(fp, threshold, banded, layout), rule)
