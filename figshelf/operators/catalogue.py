"""The catalogue of figures and annotations: upkeep, selection, search and order.

Functions return a new table; nothing is written over its input. The three `save_` functions commit one to a table of versions: the
versions before stay as they were, and of two changes that meet one raises Conflict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figshelf.functions import captions
from figshelf.functions.ranking import search_score
from figshelf.sources.snapshots import SnapshotTable


def append_figures(catalogue: DataFrame, new: DataFrame) -> DataFrame:
    return catalogue.unionByName(new)


def update_captions(catalogue: DataFrame, edits: DataFrame, by: tuple[str, ...] = ("figure_id",)) -> DataFrame:
    """edits: (*by, caption), one a figure; a null caption in an edit clears the caption. by: the columns that tell figures apart."""
    new = edits.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("caption").alias("__caption"), F.lit(True).alias("__hit"))
    rows = catalogue.join(new, [catalogue[c] == new[f"__{c}"] for c in by], "left")
    return rows.withColumn("caption", F.when(F.col("__hit"), F.col("__caption")).otherwise(F.col("caption"))).drop("__caption", "__hit", *(f"__{c}" for c in by))


def remove_figures(catalogue: DataFrame, keys: DataFrame, by: tuple[str, ...] = ("figure_id",)) -> DataFrame:
    return catalogue.join(keys.select(*by), list(by), "left_anti")


def save_appended(table: SnapshotTable, new: DataFrame) -> int:
    """Commit figures to be added; the version that has them. The files that are there stay."""
    return table.append(new)


def save_captions(table: SnapshotTable, edits: DataFrame, by: tuple[str, ...] = ("figure_id",)) -> int:
    """Commit new captions by figure_id, the table's key, or by more columns; only files that can hold one of the figures are written anew."""
    return table.change(edits, lambda rows: update_captions(rows, edits, by), "update")


def save_removed(table: SnapshotTable, keys: DataFrame, by: tuple[str, ...] = ("figure_id",)) -> int:
    """Commit the removal of figures by figure_id, the table's key, or by more columns; only files that can hold one of them are written anew."""
    return table.change(keys, lambda rows: remove_figures(rows, keys, by), "remove")


def clear_figure_annotations(annotations: DataFrame) -> DataFrame:
    """All but the figure annotations."""
    return annotations.where(~captions.is_figure_first_tag(F.col("annotation_type"), F.col("tags")))


def order_by_page(figures: DataFrame) -> DataFrame:
    """Each document's figures by page, ties in order of figure_id, with their rank from 1."""
    by_page = Window.partitionBy("attachment_id").orderBy("page", "figure_id")
    return figures.withColumn("rank", F.row_number().over(by_page))


def search_captions(figures: DataFrame, keyword: str) -> DataFrame:
    """Figures whose caption matches a regular expression (Java's), whatever the case; an empty one keeps all."""
    return figures.where(F.col("caption").rlike(f"(?i){keyword}")) if keyword else figures


def ranked_search(figures: DataFrame, query: str, k: int, by: str = "caption", key: str = "figure_id") -> DataFrame:
    """The k best figures for a token search, with their scores."""
    scored = figures.withColumn("score", search_score(F.col(by), query)).where(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), key).limit(k)


def select_figures(annotations: DataFrame) -> DataFrame:
    """The images that any tag names a figure or table."""
    return annotations.where((F.col("annotation_type") == "image") & captions.is_figure_any_tag(F.col("tags")))


def gallery_index(annotations: DataFrame, tag: str) -> DataFrame:
    """(attachment_id, gallery_index): the 0-based place of the first figure with this first tag; -1 if there is none."""
    place = F.row_number().over(Window.partitionBy("attachment_id").orderBy("annotation_id")) - 1
    figures = select_figures(annotations).withColumn("__place", place)
    hit = F.min(F.when(F.get("tags", F.lit(0)) == tag, F.col("__place")))
    return figures.groupBy("attachment_id").agg(F.coalesce(hit, F.lit(-1)).alias("gallery_index"))


def apply_view(annotations: DataFrame, figure_view: bool, filter_active: bool) -> DataFrame:
    """annotations with `hidden` as the view sets it."""
    return annotations.withColumn("hidden", captions.hidden_in_view(F.col("tags"), F.col("hidden"), figure_view, F.lit(filter_active)))


def documents_with_figures(annotations: DataFrame) -> DataFrame:
    """(attachment_id, has_figures)."""
    return annotations.groupBy("attachment_id").agg(F.bool_or(captions.is_figure_any_tag(F.col("tags"))).alias("has_figures"))


def missing_images(annotations: DataFrame, cache: DataFrame) -> DataFrame:
    """Image annotations without a rendered image."""
    return annotations.where("annotation_type = 'image'").join(cache.select("annotation_id"), "annotation_id", "left_anti")


def attachments_to_render(annotations: DataFrame, cache: DataFrame) -> DataFrame:
    """(attachment_id): the attachments with a missing image, each once: the work that a renderer has to do."""
    return missing_images(annotations, cache).select("attachment_id").distinct()
