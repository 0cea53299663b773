"""Preparing a batch over a media catalogue: sizes, checks, estimates, names, queues, summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mosaique.functions import scalars as S
from mosaique.operators.scan import numbered, scan
from mosaique.session import materialize

#: Suffixes of supported media, output formats and their suffixes.
SUPPORTED = ["png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff", "gif", "jfif", "mp4", "webm"]
FORMAT_SUFFIX = {"PNG": ".png", "JPEG": ".jpg", "WebP": ".webp", "TIFF": ".tiff", "GIF": ".gif", "MP4": ".mp4", "WebM": ".webm"}
MIB = 1024**2
MAX_PIXELS = 300_000_000

#: Settings of a batch job and what they are unless chosen.
DEFAULTS: dict[str, object] = {
    "mode": "Scale factor", "scale_factor": 2.0, "target_width": 1920, "target_height": 1080, "output_format": "PNG", "skip_if_larger": False,
    "max_workers": 4, "animation_fps": 0, "video_bitrate_kbps": 0, "gif_colors": 256, "tile_size": 0, "ai_preview_max_side": 800,
    "finishing": False, "watermark": False, "preserve_transparency": True,
}


def with_settings(df: DataFrame, settings: Mapping[str, object] | None = None) -> DataFrame:
    """Settings as constant columns s_*, so that they may also come from a table."""
    return df.withColumns({f"s_{k}": F.lit(v) for k, v in (DEFAULTS | dict(settings or {})).items()})


def with_output_size(df: DataFrame) -> DataFrame:
    """out_width and out_height: the target, or the source times the factor, rounded half to even, at least 1."""
    def side(source: str, target: str) -> Column:
        return F.greatest(F.lit(1), F.when(F.col("s_mode") == "Target size", F.col(target)).otherwise(F.bround(F.col(source) * F.col("s_scale_factor"))).cast("long"))
    return df.withColumn("out_width", side("width", "s_target_width")).withColumn("out_height", side("height", "s_target_height"))


def filter_already_large(df: DataFrame) -> DataFrame:
    """Drops rows that are at least the target on both sides, where the settings ask for it."""
    large = (F.col("width") >= F.col("out_width")) & (F.col("height") >= F.col("out_height"))
    return df.filter(~(F.col("s_skip_if_larger") & large))


def validate_rows(df: DataFrame) -> DataFrame:
    """reasons: what is wrong with each row and its settings; empty when nothing is."""
    s = {k: F.col(f"s_{k}") for k in DEFAULTS}
    scaled_w = F.when(s["mode"] == "Target size", s["target_width"]).otherwise(F.bround(F.col("width") * s["scale_factor"])).cast("long")
    scaled_h = F.when(s["mode"] == "Target size", s["target_height"]).otherwise(F.bround(F.col("height") * s["scale_factor"])).cast("long")
    checks = {
        "unknown size mode": ~s["mode"].isin("Scale factor", "Target size"),
        "scale factor not positive": (s["mode"] == "Scale factor") & (s["scale_factor"] <= 0),
        "target not positive": (s["mode"] == "Target size") & ((s["target_width"] <= 0) | (s["target_height"] <= 0)),
        "unsupported output format": ~s["output_format"].isin(*FORMAT_SUFFIX),
        "workers not in 1..50": ~s["max_workers"].between(1, 50),
        "fps not in 0..120": ~s["animation_fps"].between(0, 120),
        "bitrate not in 0..50000": ~s["video_bitrate_kbps"].between(0, 50_000),
        "colors not in 2..256": ~s["gif_colors"].between(2, 256),
        "tile not 0 or 64..4096": ~((s["tile_size"] == 0) | s["tile_size"].between(64, 4096)),
        "preview not in 256..1600": ~s["ai_preview_max_side"].between(256, 1600),
        "output over 300 megapixels": scaled_w * scaled_h > MAX_PIXELS,
    }
    listed = F.array(*[F.when(bad, F.lit(reason)) for reason, bad in checks.items()])
    return df.withColumn("reasons", F.filter(listed, lambda r: r.isNotNull()))


def is_animated() -> Column:
    return (F.col("ext").isin("mp4", "webm")) | ((F.col("ext") == "gif") & (F.col("n_frames") > 1))


def with_working_set(df: DataFrame) -> DataFrame:
    """working_set: bytes at the peak of one file; needs out_width and out_height."""
    animated = is_animated()
    alpha = animated | F.col("s_watermark") | (F.col("has_alpha") & F.col("s_preserve_transparency"))
    channels = F.when(alpha, 4).otherwise(3).cast("long")
    source = F.col("width").cast("long") * F.col("height") * channels
    target = F.col("out_width") * F.col("out_height") * channels
    copies = F.lit(1.55) + F.when(F.col("s_finishing"), 0.85).otherwise(0.0) + F.when(F.col("s_watermark"), 0.75).otherwise(0.0) + F.when(F.col("s_output_format").isin("PNG", "TIFF"), 0.35).otherwise(0.0)
    still = F.greatest(F.lit(8 * MIB), source + F.floor(target * copies))
    moving = F.greatest(F.lit(128 * MIB), F.floor((target * F.col("n_frames") + F.greatest(source, target) * 3) * 1.2))
    readable = (F.col("width") > 0) & (F.col("height") > 0)
    return df.withColumn("working_set", F.when(~F.coalesce(readable, F.lit(False)), 256 * MIB).when(animated, moving).otherwise(still).cast("long"))


def with_output_name(df: DataFrame) -> DataFrame:
    """out_name: stem_upscaled with the format's suffix; moving pictures keep to .gif, .mp4 or .webm."""
    suffix = F.lit(".png")
    for name, value in FORMAT_SUFFIX.items():
        suffix = F.when(F.col("s_output_format") == name, value).otherwise(suffix)
    suffix = F.when(is_animated() & ~suffix.isin(".gif", ".mp4", ".webm"), ".gif").otherwise(suffix)
    return df.withColumn("out_name", F.concat(S.path_stem(F.col("path")), F.lit("_upscaled"), suffix))


def logo_size(base_width: Column, logo_width: Column, logo_height: Column, scale: float) -> Column:
    """struct(w, h) of a logo that is a share of the picture's width."""
    w = F.greatest(F.lit(1), F.bround(base_width * scale)).cast("long")
    return F.struct(w.alias("w"), F.greatest(F.lit(1), F.bround(logo_height * w / logo_width)).cast("long").alias("h"))


def route_media(df: DataFrame) -> DataFrame:
    """route: animated, still, or error (a still can't become a video)."""
    still_to_video = ~is_animated() & F.col("s_output_format").isin("MP4", "WebM")
    return df.withColumn("route", F.when(is_animated(), "animated").when(still_to_video, "error").otherwise("still"))


def metadata_whitelist(metadata: Column, output_format: Column | None = None) -> Column:
    """Only the colour profile and resolution stay; GIF keeps neither profile."""
    kept = F.map_filter(metadata, lambda k, v: k.isin("icc_profile", "dpi"))
    return kept if output_format is None else F.when(output_format == "GIF", F.map_filter(kept, lambda k, v: k == "dpi")).otherwise(kept)


def expire_transfers(df: DataFrame, ts: str, now: Column, days: int = 7) -> DataFrame:
    """Rows older than some days."""
    return df.filter(F.col(ts).cast("timestamp") < now - F.expr(f"interval {days} days"))


def probe_sample(queue: DataFrame, position: str = "position", n: int = 32, small: int = 128) -> DataFrame:
    """At most 4 n rows with `sample_pos`: all of a small queue, else the first, the last, the first animated and every so-many-th, each once in that order.

    `position` numbers the queue from 0. The size is counted first, so that no window spans the table.
    """
    total = queue.count()
    if total <= small:
        return queue.withColumn("sample_pos", F.col(position))
    stride = max(1, total // n)
    animated = queue.filter(F.col("ext").isin("gif", "mp4", "webm")).orderBy(position).limit(n)
    picks = [(0, queue.filter(F.col(position) < n)), (1, queue.filter(F.col(position) >= total - n)), (2, animated),
             (3, queue.filter((F.col(position) % stride == 0) & (F.col(position) < stride * n)))]
    found = None
    for k, part in picks:
        part = part.withColumn("_pick", F.lit(k))
        found = part if found is None else found.unionByName(part)
    once = found.withColumn("_rn", F.row_number().over(Window.partitionBy(position).orderBy("_pick"))).filter("_rn = 1")
    return once.withColumn("sample_pos", F.row_number().over(Window.orderBy("_pick", position)) - 1).drop("_pick", "_rn")  # at most 4 n rows


def footprint_summary(sample: DataFrame) -> DataFrame:
    """estimated (largest working set) and contains_animation of a probe sample."""
    return sample.agg(F.coalesce(F.max("working_set"), F.lit(256 * MIB)).alias("estimated"), F.coalesce(F.bool_or(is_animated()), F.lit(False)).alias("contains_animation"))


def run_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of outcomes, status and percent per run; `results` has outcome: ok, error, cancelled, pending or fatal (the run itself broke)."""
    counts = results.groupBy(*keys).agg(
        F.count_if(F.col("outcome") == "ok").alias("outputs"), F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome") == "cancelled").alias("cancelled"), F.count("*").alias("total"), F.count_if(F.col("outcome") == "fatal").alias("_fatal"),
    )
    status = F.when(F.col("_fatal") > 0, "Failed").when(F.col("cancelled") > 0, "Cancelled").when(F.col("errors") == 0, "Completed").otherwise("Completed with errors")
    done = F.col("outputs") + F.col("errors")
    return counts.withColumn("status", status).withColumn("percent", F.when(F.col("total") == 0, 0).otherwise(F.floor(100 * done / F.col("total"))).cast("int")).drop("_fatal")


def retry_set(failed: DataFrame, files: DataFrame) -> DataFrame:
    """Failed paths that still exist, each once."""
    return failed.select("path").distinct().join(files.select("path").hint("merge"), "path", "left_semi")


def append_new(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """path and position of the queue with the new paths of `incoming` after it, in their order, each once."""
    fresh = incoming.groupBy("path").agg(F.min("position").alias("position")).join(queue.select("path").hint("merge"), "path", "left_anti")
    start = queue.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("start"))
    return queue.select("path", "position").unionByName(_dense(fresh, start))


def _dense(fresh: DataFrame, start: DataFrame) -> DataFrame:
    """path and position from `start` on, in the order of position: counted per range partition, so no window spans the table."""
    placed = numbered(fresh, ["position", "path"], "_at")
    # One row.
    return placed.join(F.broadcast(start)).select("path", (F.col("start") + F.col("_at") - 1).alias("position"))


def orphans(meta: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata rows without a data file of the same stem."""
    stems = files.select(S.path_stem(F.col("path")).alias("_stem")).distinct()
    return meta.join(stems.hint("merge"), S.path_stem(F.col("path")) == F.col("_stem"), "left_anti")


def expand_roots(roots: DataFrame) -> DataFrame:
    """path and position of several listings (root_pos, path): each path once, at its first place; ., .. and // are resolved."""
    clean = roots.withColumn("path", S.normal_path(F.col("path")))
    first = clean.groupBy("path").agg(F.min(F.struct("root_pos", F.lower("path").alias("l"))).alias("at"))
    return first.select("path", F.col("at.root_pos").alias("root_pos"))


def scan_catalog(df: DataFrame) -> DataFrame:
    """Rows whose suffix is supported."""
    return df.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUPPORTED))


def catalog_columns(df: DataFrame) -> DataFrame:
    """width and height as displayed: orientations 5 to 8 swap them."""
    turned = F.col("orientation").isin(5, 6, 7, 8)
    return df.withColumns({"width": F.when(turned, F.col("height")).otherwise(F.col("width")), "height": F.when(turned, F.col("width")).otherwise(F.col("height"))})


def split_bad_records(df: DataFrame, bad: Column, message: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, path and message of the others)."""
    wrong = F.coalesce(bad, F.lit(True))
    return df.filter(~wrong), df.filter(wrong).select("path", F.concat_ws(": ", "path", message).alias("message"))


def collision_free_names(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """final_name for every row of `plan` (folder, name, position): name, name (2), name (3)... free of `existing` and of earlier rows.

    The rows that want one name are numbered, the taken numbers are removed from 1, 2, 3..., and the k-th row gets
    the k-th free number, by one running count over both in order. A number may make a name that another row wants as it is; such rows go into another
    round, against all names given so far. Rounds end when every row has a name.
    """
    split = [F.regexp_replace("name", r"(?<=.)\.[^.]+$", "").alias("stem"), F.regexp_extract("name", r"^.+(\.[^.]+)$", 1).alias("suffix")]
    todo = materialize(plan.select("folder", "name", "position", *split), "todo")
    taken = materialize(existing.select("folder", "name").distinct(), "taken")
    done = None
    while True:
        wanted = todo.select("folder", "stem", "suffix").distinct()
        parts = taken.select("folder", F.col("name").alias("taken_name"), F.regexp_replace("name", r"(?<=.)\.[^.]+$", "").alias("full"), F.regexp_extract("name", r"^.+(\.[^.]+)$", 1).alias("suffix"))
        number = F.regexp_extract("full", r" \((\d{1,9})\)$", 1)
        plain = parts.select("folder", F.col("full").alias("stem"), "suffix", F.lit(1).alias("slot"))
        numbered = parts.filter(number != "").select("folder", F.regexp_replace("full", r" \(\d{1,9}\)$", "").alias("stem"), "suffix", number.cast("int").alias("slot")).filter("slot >= 2")
        used = plain.unionByName(numbered).join(wanted.hint("merge"), ["folder", "stem", "suffix"], "left_semi").distinct()
        # Slot s has s - (used slots up to s) free ones below it; the used ones, sorted, say how far each rank moves.
        key = ["folder", "stem", "suffix"]
        steps = scan(used, key, ["slot"], number="_no").select(*key, (F.col("slot") - F.col("_no")).cast("long").alias("_at"), F.lit(1).alias("_moves"))
        ranked = scan(todo, key, ["position"], number="rank")
        # Ranks and used slots in one order: a rank moves by the used slots that have fewer free ones below them.
        both = ranked.withColumns({"_at": F.col("rank").cast("long"), "_moves": F.lit(0)}).unionByName(steps, allowMissingColumns=True)
        # Rows to name add 0, so that the sum up to a row is the sum before it.
        named = scan(both, key, ["_at", "_moves"], sums={"moved": F.col("_moves")}).filter("_moves = 0")
        slot = F.col("rank") + F.col("moved")
        given = F.when(slot == 1, F.concat("stem", "suffix")).otherwise(F.concat(F.col("stem"), F.lit(" ("), slot.cast("string"), F.lit(")"), F.col("suffix")))
        named = named.withColumn("final_name", given)
        # Of rows with one result the first wins. Those of one name have different numbers, so that few rows meet here.
        first = Window.partitionBy("folder", "final_name").orderBy(F.col("final_name") != F.col("name"), "position")
        named = materialize(named.withColumn("wins", F.row_number().over(first) == 1).select("folder", "name", "position", "stem", "suffix", "final_name", "wins"), "named")
        fixed = named.filter("wins").select("folder", "name", "position", "final_name")
        done = fixed if done is None else done.unionByName(fixed)
        todo = named.filter("not wins").select("folder", "name", "position", "stem", "suffix")
        if todo.isEmpty():
            return done
        taken = materialize(taken.unionByName(fixed.select("folder", F.col("final_name").alias("name"))).distinct(), "taken")
        todo, done = materialize(todo, "todo"), materialize(done, "done")


#: Finishing presets (sharpen, denoise, contrast, brightness, saturation) and edge presets (feather, padding).
QUALITY_PRESETS = [
    ("Clean Photo", 0.15, 0.0, 1.02, 1.0, 1.0),
    ("Crisp Illustration", 0.45, 0.0, 1.08, 1.0, 1.06),
    ("Soft Portrait", 0.05, 0.35, 0.98, 1.02, 0.96),
    ("Maximum Detail", 0.75, 0.0, 1.12, 1.0, 1.03),
]
EDGE_PRESETS = [("Hard edge", 0, 0), ("Soft transition", 16, 8), ("Seamless blend", 32, 16)]


def quality_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUALITY_PRESETS, "quality_preset string, sharpen double, denoise double, contrast double, brightness double, saturation double")


def edge_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGE_PRESETS, "edge_preset string, feather int, padding int")


def preset_lookup(df: DataFrame, presets: DataFrame, on: str) -> DataFrame:
    """Rows with the parameters of their preset; unknown names have none. Presets are a handful of rows."""
    return df.join(F.broadcast(presets), on, "left")
