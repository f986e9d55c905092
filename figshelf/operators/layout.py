"""Regions on pages: flipped to the page's origin, and placed in reading order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figshelf.functions.geometry import flatten_chars, rect_distance
from figshelf.sources.storage import stored

RECT = ("x1", "y1", "x2", "y2")
CHAR = ("cx1", "cy1", "cx2", "cy2")


def flip_regions(figures: DataFrame, doc_pages: DataFrame, per_page_height: bool = False) -> DataFrame:
    """Regions measured from the top turned to ones measured from the bottom.

    The height is that of the document's page 0 (per_page_height: of the region's own page). Regions of
    documents without that page stay, with no y1 and y2: unplaced() counts them.
    """
    heights = doc_pages.select("attachment_id", F.col("page").alias("__page"), F.col("vy2").alias("__height"))
    own = F.col("page") if per_page_height else F.lit(0)
    joined = figures.join(heights.withColumnRenamed("attachment_id", "__id"), (figures["attachment_id"] == F.col("__id")) & (own == F.col("__page")), "left")
    flipped = joined.withColumns({"y1": F.col("__height") - F.col("y2"), "y2": F.col("__height") - F.col("y1")})
    return flipped.drop("__id", "__page", "__height")


def unplaced(flipped: DataFrame) -> DataFrame:
    """(attachment_id, n_regions, n_unplaced): how many regions of each document have no place, for want of the page."""
    return flipped.groupBy("attachment_id").agg(F.count(F.lit(1)).alias("n_regions"), F.count_if(F.col("y1").isNull()).alias("n_unplaced"))


#: Characters in a row, in reading order, that share a box.
BOX = 64
SENT = 250_000  # regions, or boxes for them, of some 80 bytes each that are broadcast: 20 MB
DISTANCES = 1_000_000  # that a task holds at once
OUTER = ("ox1", "oy1", "ox2", "oy2")


def _dist(region: tuple, char: tuple):
    return rect_distance(tuple(map(F.col, char)), tuple(map(F.col, region)))


def _no_number(*values: Column) -> Column:
    """Whether one of the values is null or NaN, which counts as no gap: nothing is known of a box about it."""
    total = sum(values[1:], values[0])
    return total.isNull() | F.isnan(total)


def char_boxes(chars: DataFrame, box: int = BOX) -> DataFrame:
    """(attachment_id, page, box, OUTER, odd): the rectangle about each `box` characters in a row; odd where a number is missing."""
    odd = F.bool_or(_no_number(*map(F.col, CHAR)))
    return chars.groupBy("attachment_id", "page", F.floor(F.col("char_offset") / box).alias("box")).agg(
        F.min("cx1").alias("ox1"), F.min("cy1").alias("oy1"), F.max("cx2").alias("ox2"), F.max("cy2").alias("oy2"), odd.alias("odd")
    )


def _least(rows: DataFrame) -> DataFrame:
    """(figure_id, least, offset) of rows (figure_id, d, char_offset): the least distance, and the first character that has it."""
    return rows.groupBy("figure_id").agg(F.min(F.struct("d", "char_offset")).alias("__m")).select("figure_id", F.col("__m.d").alias("least"), F.col("__m.char_offset").alias("offset"))


def _low() -> Column:
    """The least that a region can be from the characters in a box."""
    return F.when(F.col("odd"), 0.0).otherwise(_dist(RECT, OUTER))


def _searched(regions: DataFrame, chars: DataFrame, box: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(figure_id, least, offset), and the boxes and characters that distances were worked out to."""
    if regions.limit(SENT + 1).count() > SENT:
        return _searched_many(regions, chars, box)
    page, keys = ["attachment_id", "page"], ["attachment_id", "page", "box"]
    places = regions.select("figure_id", *page, *RECT)
    letters = chars.select(*page, F.floor(F.col("char_offset") / box).alias("box"), "char_offset", *CHAR)
    pairs = places.join(char_boxes(chars, box), page).withColumn("low", _low())
    by_low = Window.partitionBy("figure_id").orderBy("low", "box")
    ranked = pairs.select("figure_id", *keys, "low", *RECT).withColumn("first", F.row_number().over(by_low) == 1)
    ranked = stored(ranked, "boxes")  # small, as a box is; characters are read again rather than shuffled
    tried = lambda of, sent: (F.broadcast(of) if sent else of).join(letters, keys).select("figure_id", "box", _dist(RECT, CHAR).alias("d"), "char_offset")
    near = tried(ranked.where("first"), True)
    found = stored(_least(near).join(ranked.where("first").select("figure_id", F.col("box").alias("best")), "figure_id"), "found")
    # a box that comes later cannot win by a tie
    open_ = (F.col("low") < F.col("least")) | ((F.col("low") == F.col("least")) & (F.col("box") < F.col("best")))
    rest = stored(ranked.where("NOT first").join(found.select("figure_id", "least", "best"), "figure_id").where(open_), "rest")
    more = tried(rest, rest.limit(SENT + 1).count() <= SENT)
    both = found.select("figure_id", F.col("least").alias("d"), F.col("offset").alias("char_offset")).unionByName(more.select("figure_id", "d", "char_offset"))
    return _least(both), pairs, near.unionByName(more)


def _searched_many(regions: DataFrame, chars: DataFrame, box: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for more regions than can be sent to all tasks: they are hashed by page, a partition at a time, and boxes and characters stream by them.

    Nothing is broadcast, and nothing that has a row for a character or a pair is sorted or shuffled, if characters are dealt by attachment_id and page (else they are
    shuffled as they are). Distances are summed up first (a number, which is hashed), and the first character that has the least one is looked for then.
    """
    page, figure = ["attachment_id", "page"], ["attachment_id", "page", "figure_id", *RECT]
    letters, boxes = chars.select(*page, "char_offset", *CHAR), char_boxes(chars, box)
    meet = lambda many, few: many.join(few.hint("shuffle_hash"), page)
    # the characters of a box by their offsets: an equal number of the box would be another key to shuffle by
    inside = (F.col("char_offset") >= F.col("box") * box) & (F.col("char_offset") < (F.col("box") + 1) * box)
    tried = lambda of: meet(letters, of).where(inside).withColumn("d", _dist(RECT, CHAR))
    pairs = meet(boxes, regions.select(*figure)).withColumn("low", _low())
    first = pairs.groupBy(*figure).agg(F.min(F.struct("low", "box")).alias("__m")).select(*figure, "__m.low", "__m.box")
    first = stored(first, "boxes")
    near = tried(first)
    found = stored(near.groupBy(*figure, "low", "box").agg(F.min("d").alias("least")), "found")
    # a box that comes later cannot win by a tie
    open_ = (F.col("low") < F.col("least")) | ((F.col("low") == F.col("least")) & (F.col("box") < F.col("best")))
    rest = meet(boxes, found.select(*figure, "least", F.col("box").alias("best"))).withColumn("low", _low()).where((F.col("box") != F.col("best")) & open_)
    rest = stored(rest.select(*figure, "low", "box", "least"), "rest")
    more = tried(rest)
    nearer = more.groupBy(*page, "figure_id").agg(F.min("d").alias("nearer"))
    nearer = found.select("figure_id", "least").unionByName(nearer.select("figure_id", F.col("nearer").alias("least"))).groupBy("figure_id").agg(F.min("least").alias("least"))
    left = found.unionByName(rest).drop("least").join(nearer.hint("merge"), "figure_id").where("low <= least")
    last = tried(left)
    made = last.where("d = least").groupBy(*page, "figure_id").agg(F.min("least").alias("least"), F.min("char_offset").alias("offset"))
    columns = ["figure_id", "d", "char_offset"]
    return made.select("figure_id", "least", "offset"), pairs, near.select(*columns).unionByName(more.select(*columns)).unionByName(last.select(*columns))


def nearest_char(regions: DataFrame, chars: DataFrame, box: int = BOX) -> DataFrame:
    """(figure_id, offset): of each region the offset of the nearest character of its page; ties to the first.

    chars has a row for each character. A region on a page without characters has offset 0; a missing number is no
    gap in its direction. Branch and bound: distances to the boxes about
    characters in a row bound those to the characters; the characters of each region's nearest box are tried, then those of boxes that are
    nearer than what that gives. Boxes are made where the characters are. Up to SENT regions (counted) and boxes to look into are sent to all tasks, and
    characters stay where they are; more of them meet the characters by a join, for which these are shuffled (not if they are dealt by attachment_id and page).
    """
    found, _, _ = _searched(regions, chars, box)
    return regions.select("figure_id").join(found.hint("merge"), "figure_id", "left").select("figure_id", F.coalesce("offset", F.lit(0)).alias("offset"))


def search_work(regions: DataFrame, chars: DataFrame, box: int = BOX) -> DataFrame:
    """One row (n_pairs, n_boxes, n_chars): pairs of regions and characters of their pages, and the distances that nearest_char works out to boxes and to characters."""
    _, boxes, letters = _searched(regions, chars, box)
    page = ["attachment_id", "page"]
    pairs = regions.groupBy(*page).agg(F.count(F.lit(1)).alias("a")).join(chars.groupBy(*page).agg(F.count(F.lit(1)).alias("b")), page).select((F.col("a") * F.col("b")).alias("n_pairs"))
    counts = [pairs, boxes.select(F.lit(1).alias("n_boxes")), letters.select(F.lit(1).alias("n_chars"))]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), counts).agg(*(F.sum(c).alias(c) for c in ("n_pairs", "n_boxes", "n_chars")))


def _boxed(chars: Column, first: Column) -> Column:
    """A box (OUTER, odd, first, chars) about characters that are structs of CHAR, in a row from the offset `first` on."""
    pick = lambda x: F.transform(chars, lambda c: c[x])
    odd = F.exists(chars, lambda c: _no_number(*(c[x] for x in CHAR)))
    hull = [F.array_min(pick("cx1")), F.array_min(pick("cy1")), F.array_max(pick("cx2")), F.array_max(pick("cy2"))]
    return F.struct(*(x.alias(n) for x, n in zip(hull, OUTER)), odd.alias("odd"), first.cast("int").alias("first"), chars.alias("chars"))


def _by_name(chars: Column) -> Column:
    """Characters that hold an array rect as structs of CHAR."""
    return F.transform(chars, lambda c: F.struct(*(F.get(c["rect"], F.lit(k)).alias(x) for k, x in enumerate(CHAR))))


def boxed_pages(pages: DataFrame, box: int = BOX) -> DataFrame:
    """(attachment_id, page, boxes) of pages that have one row each: the boxes of their characters, in reading order.

    pages have `chars`, an array of structs of CHAR, which is boxed by `box` in a row; or `paragraphs`, the nested text of a page
    (schema.PAGE_TEXT), whose lines are the boxes. A table of boxed pages can be written once and searched by every run.
    """
    if "boxes" in pages.columns:
        return pages
    if "paragraphs" in pages.columns:
        lines = F.transform(F.flatten(F.transform("paragraphs", lambda p: p["lines"])), lambda x: F.flatten(F.transform(x["words"], lambda w: w["chars"])))
        # where each line begins: the number of characters before it
        starts = F.aggregate(lines, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.size(x))))
        rows = pages.select("attachment_id", "page", lines.alias("__lines"), starts.alias("__starts"))
        cut = F.transform("__lines", lambda x, i: _boxed(_by_name(x), F.get("__starts", i)))
    else:
        rows = pages.select("attachment_id", "page", "chars")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("chars") / box).cast("int") - 1, F.lit(0))), lambda i: _boxed(F.slice("chars", i * box + 1, F.lit(box)), i * box))
    return rows.select("attachment_id", "page", cut.alias("boxes"))


def _characters(pages: DataFrame) -> Column:
    """The characters of a page in reading order, from whichever form the page has: structs of CHAR, or of an array rect."""
    if "boxes" in pages.columns:
        return F.flatten(F.transform("boxes", lambda b: b["chars"]))
    return flatten_chars(F.col("paragraphs")) if "paragraphs" in pages.columns else F.col("chars")


def _sides(structs: pa.Array) -> list[np.ndarray]:
    """The four numbers of each character or region, NaN where one is missing."""
    if structs.type.get_field_index("rect") < 0:
        names = CHAR if structs.type.get_field_index(CHAR[0]) >= 0 else RECT
        return [pc.struct_field(structs, x).cast("double").to_numpy(zero_copy_only=False) for x in names]
    rects = pc.struct_field(structs, "rect")
    sizes = pc.fill_null(pc.list_value_length(rects), 0).to_numpy()
    values = np.append(rects.values.cast("double").to_numpy(zero_copy_only=False), np.nan)
    begins = rects.offsets.to_numpy()[:-1]
    return [values[np.where(sizes > k, begins + k, len(values) - 1)] for k in range(4)]


def _bounds(lists: pa.Array) -> np.ndarray:
    """Where each list begins in what they flatten to, and the end."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])


def _first_nearest(region: list[np.ndarray], char: list[np.ndarray]) -> np.ndarray:
    """For each region the place of the first character than which none is nearer, by geometry.rect_distance: a number that is missing is no gap."""
    with np.errstate(invalid="ignore"):
        gap = lambda k: np.fmax(np.fmax(char[k] - region[k + 2][:, None], region[k][:, None] - char[k + 2]), 0.0)
        dx, dy = gap(0), gap(1)
    return np.sqrt(dx * dx + dy * dy).argmin(axis=1)


def _search_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(figure_id, offset) for pages with (regions, characters): DISTANCES distances at once at most, or those of one region."""
    for batch in batches:
        regions, chars = batch.columns
        r_at, c_at, of = _bounds(regions), _bounds(chars), regions.flatten()
        region, char, offsets = _sides(of), _sides(chars.flatten()), np.zeros(len(of), dtype=np.int32)
        for r, r_end, c, c_end in zip(r_at, r_at[1:], c_at, c_at[1:]):
            if c < c_end:
                here, step = [x[c:c_end] for x in char], max(1, DISTANCES // (c_end - c))
                for k in range(r, r_end, step):
                    offsets[k : min(k + step, r_end)] = _first_nearest([x[k : min(k + step, r_end)] for x in region], here)
        yield pa.RecordBatch.from_arrays([pc.struct_field(of, "figure_id"), pa.array(offsets)], ["figure_id", "offset"])


def nearest_char_by_page(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """The same from pages that have one row each: flat characters, nested text or boxes, as boxed_pages takes or gives them.

    A page's regions meet its characters in one row, and numpy works out their distances, all of them: that takes less than to choose among boxes.
    Up to SENT regions (counted) are sent to all tasks and pages stay where they are; more of them are hashed a partition at a time, and pages stream by them
    without being sorted, shuffled once at most (not if they are dealt by attachment_id and page).
    """
    keys = ["attachment_id", "page"]
    here = regions.groupBy(*keys).agg(F.collect_list(F.struct("figure_id", *RECT)).alias("__regions"))
    rows, kind = pages.select(*keys, _characters(pages).alias("__chars")), regions.schema["figure_id"].dataType.simpleString()
    search = lambda df: df.select("__regions", "__chars").mapInArrow(_search_pages, f"figure_id {kind}, offset int")
    if regions.limit(SENT + 1).count() > SENT:
        return search(rows.join(here.hint("shuffle_hash"), keys, "right"))
    without = regions.join(pages.select(*keys), keys, "left_anti").select("figure_id", F.lit(0).alias("offset"))
    return search(rows.join(F.broadcast(here), keys)).unionByName(without)


def _padded(number, width: int):
    """Digits padded with zeros; a longer number keeps its leading digits."""
    return F.lpad(number.cast("string"), width, "0")


def sort_keys(regions: DataFrame, offsets: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """(figure_id, sort_key): page, nearest character and distance from the page's top, each padded."""
    pages = doc_pages.select("attachment_id", "page", (F.col("vy2") - F.col("vy1")).alias("__tall"))
    rows = regions.select("figure_id", "attachment_id", "page", "y2").join(pages, ["attachment_id", "page"], "left").join(offsets, "figure_id", "left")
    there = F.col("__tall").isNotNull()
    top = F.when(there, F.floor(F.greatest(F.col("__tall") - F.col("y2"), F.lit(0.0)))).otherwise(0)
    offset = F.when(there, F.coalesce("offset", F.lit(0))).otherwise(0)
    return rows.select("figure_id", F.concat_ws("|", _padded(F.col("page"), 5), _padded(offset, 6), _padded(top, 5)).alias("sort_key"))


def reading_order_key(regions: DataFrame, chars: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """Sort keys from characters in long form."""
    return sort_keys(regions, nearest_char(regions, chars), doc_pages)


def reading_order_key_by_page(regions: DataFrame, pages: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """Sort keys from pages in one row each: with their characters, their nested text or their boxes."""
    return sort_keys(regions, nearest_char_by_page(regions, pages), doc_pages)
