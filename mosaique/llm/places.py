"""Rows of stored tables by their place (file and number in it), so that long texts are chosen in the scan and never shuffled.

The places that are asked for become bitmaps of 32,768 rows (4 KB, Spark's own bitmap functions), one per file and
range of rows that has any. They are broadcast in slices of whole files, at most `SLICE` bitmaps (32 MB) and those of one file each;
a slice reads its own files only. A table of one slice (some 268 million rows where all ranges have some) is read in the plan that
asks; the slices of a larger one are written one after another, so that no more than one is in memory. Texts are
read once in any case, and there is no size from which they are sorted or sent.

Cases: an empty set of places leaves all rows or none, null places can't occur, repeated rows have places of their
own, an empty table has no files and gives an empty result, columns may have any names (they go by position meanwhile).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mosaique.session import materialize

#: Bitmaps that are broadcast at a time.
SLICE = 8_192
#: Rows of a bitmap, as Spark's functions fix them.
BITS = 32_768


def stored(docs: DataFrame) -> DataFrame:
    """A copy of `docs` in files, since rows have places only where they are read from files as they are."""
    return materialize(docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))]), "docs").toDF(*docs.columns)


def with_places(docs: DataFrame) -> DataFrame:
    """The columns of a stored table as _c0, _c1 and so on, and _file and _row."""
    place = docs.metadataColumn("_metadata")
    plain = docs.select("*", place["file_path"], place["row_index"])
    return plain.toDF(*[f"_c{k}" for k in range(len(docs.columns))], "_file", "_row")


def _bit(bitmap: str, position: Column) -> Column:
    """The bit of a bitmap at a position, 0 or 1."""
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(position, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(position, F.lit(8)))), F.lit(2)).cast("int")


def at_places(docs: DataFrame, places: DataFrame, inside: bool) -> DataFrame:
    """The rows of a stored table at the places (_file, _row), or all others; with the columns of `with_places`."""
    range_, position = F.shiftright("_row", 15).cast("long"), F.pmod("_row", F.lit(BITS))
    maps = places.groupBy("_file", range_.alias("_range")).agg(F.bitmap_construct_agg(position).alias("_bitmap"))
    maps = materialize(maps, "bitmaps")
    # One row a file, which the driver lists in any case.
    sizes = sorted((r["_file"], r["n"]) for r in maps.groupBy("_file").agg(F.count("*").alias("n")).collect())
    bounds: list[str] = []
    filled = 0
    for file, n in sizes:
        if filled and filled + n > SLICE:
            bounds.append(file)
            filled = 0
        filled += n
    rows = with_places(docs)
    names = rows.columns
    maps = maps.withColumnsRenamed({"_file": "_in", "_range": "_of"})

    def chosen(low: str | None, high: str | None) -> DataFrame:
        within = lambda name: reduce(lambda a, b: a & b, [F.col(name) >= low] * (low is not None) + [F.col(name) < high] * (high is not None), F.lit(True))
        mine, theirs = rows.filter(within("_file")), maps.filter(within("_in")).hint("broadcast")
        asked = _bit("_bitmap", position.cast("int")) == 1
        on = (F.col("_file") == F.col("_in")) & (range_ == F.col("_of"))
        if inside:
            return mine.join(theirs, on).filter(asked).select(names)
        return mine.join(theirs, on, "left").filter(F.col("_bitmap").isNull() | ~asked).select(names)

    if not bounds:
        return chosen(None, None)
    ends = [None, *bounds, None]
    return reduce(DataFrame.unionByName, [materialize(chosen(low, high), "slice") for low, high in zip(ends, ends[1:])])
