"""Annotations grouped into notes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figshelf.functions.citations import encode_citations
from figshelf.operators.ordered import AT, PART, has_large, keyed, running_sum, same_rows, sorted_ranges, with_before
from figshelf.sources.storage import stored

#: Citations of a note that are gone through in order; rounds over notes with more.
FOLD, ROUNDS = 100_000, 40


def resolve_parents(lines: DataFrame, attachments: DataFrame, items: DataFrame) -> DataFrame:
    """lines with their attachment's title, its top item and that item's title (null where there is none).

    Spark broadcasts either table by its measured size, if that is under the session's threshold.
    """
    files = attachments.select("attachment_id", F.col("file_name").alias("attachment_title"), F.col("parent_item_id").alias("item_id"))
    titles = items.select("item_id", F.col("title").alias("item_title"))
    return lines.join(files, "attachment_id", "left").join(titles, "item_id", "left")


def _marked(lines: DataFrame, large: bool | None) -> DataFrame:
    """lines, each with what the line before it in its note has; in ranges of (note_id, seq) if notes are large."""
    columns = [c for c in ("attachment_id", "item_id") if c in lines.columns]
    if has_large(lines, ["note_id"]) if large is None else large:
        lines = sorted_ranges(lines, ["note_id"], ["seq"])
    return with_before(lines, ["note_id"], ["seq"], columns)


def _new_run() -> Column:
    return F.col("__first") | ~F.col("__before_attachment_id").eqNullSafe(F.col("attachment_id"))


def _change() -> Column:
    return ~F.col("__first") & ~F.col("__before_item_id").eqNullSafe(F.col("item_id"))


def _numbered(marked: DataFrame) -> DataFrame:
    return running_sum(marked, ["note_id"], ["seq"], _new_run().cast("long"), "run_no")


def _unmarked(rows: DataFrame) -> DataFrame:
    return rows.drop(PART, AT, "__first", "__before_attachment_id", "__before_item_id")


def _changes(marked: DataFrame) -> DataFrame:
    return marked.groupBy("note_id").agg(F.bool_or(_change()).alias("spans_items"))


def group_runs(lines: DataFrame, large: bool | None = None) -> DataFrame:
    """lines with run_no from 1: annotations of one attachment in a row; a later return begins a new run.

    A large note's lines go over any number of tasks (see ordered). large: whether there are such notes, if that is known.
    """
    return _unmarked(_numbered(_marked(lines, large)))


def spans_items(lines: DataFrame, large: bool | None = None) -> DataFrame:
    """(note_id, spans_items): whether the top item changes between neighbours."""
    return _changes(_marked(lines, large))


def runs_and_spans(lines: DataFrame, large: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """group_runs and spans_items of the same lines, which are sorted once."""
    marked = _marked(lines, large)
    return _unmarked(_numbered(marked)), _changes(marked)


def _paragraph() -> Column:
    """An annotation's line of text; none without a key."""
    return F.concat(F.lit("<p>"), F.coalesce("comment", F.lit("")), F.lit(" ["), F.col("key"), F.lit("]</p>\n"))


def runs(lines: DataFrame) -> DataFrame:
    """One row a run: (note_id, run_no, attachment_id, item_id, both titles, n_lines, body). lines: group_runs of resolve_parents.

    body: a line of text for each annotation, its comment and key, in order.
    """
    line = F.struct("seq", _paragraph().alias("p"))
    return lines.groupBy("note_id", "run_no").agg(
        F.first("attachment_id").alias("attachment_id"), F.first("item_id").alias("item_id"), F.first("attachment_title").alias("attachment_title"), F.first("item_title").alias("item_title"),
        F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["p"]), "").alias("body"),
    )


def _item_heading() -> Column:
    """Of a group, or of the line that begins it, with that before it."""
    other = F.when(F.col("__first"), F.col("item_id").isNotNull()).otherwise(~F.col("__before_item_id").eqNullSafe(F.col("item_id")))
    return F.when(F.col("spans_items") & (F.coalesce("item_title", F.lit("")) != "") & other, F.col("item_title"))


def _attachment_heading() -> Column:
    return F.when(F.col("item_id").isNull() | F.coalesce("__several", F.lit(False)), F.col("attachment_title"))


def headings(groups: DataFrame, spans: DataFrame, large: bool | None = None) -> DataFrame:
    """groups with item_heading and attachment_heading: shown where they say something new.

    An item's title heads a group if the note spans items, it is not empty and the group before is of
    another item. An attachment's title heads a group without an item, or of an item with more than one group.
    """
    if has_large(groups, ["note_id"]) if large is None else large:
        groups = sorted_ranges(groups, ["note_id"], ["run_no"])
    seen = with_before(groups, ["note_id"], ["run_no"], ["item_id"])
    several = seen.where("item_id IS NOT NULL").groupBy("note_id", "item_id").agg((F.count(F.lit(1)) > 1).alias("__several"))
    rows = _unmarked(seen.join(spans, "note_id").join(several, ["note_id", "item_id"], "left").withColumn("item_heading", _item_heading()))
    return rows.withColumn("attachment_heading", _attachment_heading()).select(*(c for c in groups.columns if c not in (PART, AT)), "spans_items", "item_heading", "attachment_heading")


def _with_note(marked: DataFrame) -> DataFrame:
    """marked, with spans_items, __several (whether the line's item has more than one run in its note) and __place (order in the note).

    By windows over notes in one task each; of ranges, by sums of each note and item.
    """
    marked = marked.withColumns({"__new": _new_run(), "__change": _change()})
    note, place = Window.partitionBy("note_id"), ["note_id", "item_id"]
    if PART not in marked.columns:
        in_order = marked.withColumn("__place", F.row_number().over(note.orderBy(F.col("seq").asc_nulls_first())))
        spans = in_order.withColumn("spans_items", F.bool_or("__change").over(note))
        return spans.withColumn("__several", F.sum(F.col("__new").cast("long")).over(Window.partitionBy(*place)) > 1)
    sums = marked.groupBy(*place).agg((F.sum(F.col("__new").cast("long")) > 1).alias("__several"), F.bool_or("__change").alias("__changes"))
    sums = keyed(sums.select(*place, "__several", F.bool_or("__changes").over(note).alias("spans_items")), place)
    return marked.withColumn("__place", F.struct(PART, AT)).join(sums, same_rows(marked, sums, place))


def bodies(lines: DataFrame, large: bool | None = None) -> DataFrame:
    """(note_id, body): each note's runs with their headings, a line of text for each annotation and an empty line after each run. lines: resolve_parents.

    The text is that of headings(runs(...)), but a heading goes with the line that begins its run, so that lines are sorted once and put together once.
    """
    rows = _with_note(_marked(lines.where("note_id IS NOT NULL"), large))
    tagged = lambda tag, text: F.coalesce(F.when(F.col("__new"), F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>\n"))), F.lit(""))
    gap = F.when(F.col("__new") & ~F.col("__first"), "\n").otherwise("")
    piece = F.concat(gap, tagged("h2", _item_heading()), tagged("h3", _attachment_heading()), F.coalesce(_paragraph(), F.lit("")))
    in_order = F.sort_array(F.collect_list(F.struct("__place", piece.alias("p"))))
    return rows.groupBy("note_id").agg(F.concat(F.array_join(F.transform(in_order, lambda x: x["p"]), ""), F.lit("\n")).alias("body"))


def note_bodies(lines: DataFrame, attachments: DataFrame, items: DataFrame) -> DataFrame:
    """(note_id, body): bodies of ordered lines as create_notes takes them, without citations and version."""
    return bodies(_resolved(lines, attachments, items))


def _resolved(lines: DataFrame, attachments: DataFrame, items: DataFrame) -> DataFrame:
    """resolve_parents as a written table: sizes of notes are counted, ranges sampled and lines sorted from it, and joins are made once."""
    return stored(resolve_parents(lines, attachments, items), "note-lines")


def note_schema_version(lines: DataFrame) -> DataFrame:
    """(note_id, schema_version): 10 if a line is an underline, else 9."""
    return lines.groupBy("note_id").agg(F.when(F.bool_or(F.col("annotation_type") == "underline"), 10).otherwise(9).alias("schema_version"))


def first_citations(citations: DataFrame) -> DataFrame:
    """(note_id, seq, uris): of the citations of a note with the same URIs the first, as later ones are never kept.

    Citations that name no URI are never rejected and all stay.
    """
    names = F.coalesce(F.exists("uris", lambda u: u.isNotNull()), F.lit(False))
    least = F.when(~F.bool_or(F.col("seq").isNull()), F.min("seq"))  # null comes first; the least of structs would sort all citations
    first = citations.where(names).groupBy("note_id", "uris").agg(least.alias("seq")).select("note_id", "seq", "uris")
    return first.unionByName(citations.where(~names).select("note_id", "seq", "uris"))


def kept_citations(citations: DataFrame, fold: int = FOLD) -> DataFrame:
    """(note_id, seq, uris): in order of seq, the citations that share no URI with one kept before.

    Notes of up to `fold` different citations are gone through in order, a row at a time beside the set of URIs taken. Larger ones go in rounds,
    over any number of tasks: an open citation that is the first of its note on each of its URIs is kept, and every open citation with one of these URIs
    closes; what is left open goes on. Rounds end when no note has more than `fold` open citations, or after ROUNDS (of a chain, in which each citation
    shares a URI with the next, a round settles two).
    """
    rows = first_citations(citations)
    named = rows.where(F.exists("uris", lambda u: u.isNotNull()))
    kept = [rows.where(~F.coalesce(F.exists("uris", lambda u: u.isNotNull()), F.lit(False)))]
    large = named.groupBy("note_id").count().where(F.col("count") > fold).select("note_id")
    if not large.isEmpty():
        large = keyed(stored(large, "large-notes"), ["note_id"])
        named = stored(named, "citations")
        open_ = named.join(large, same_rows(named, large, ["note_id"]), "left_semi")
        named = named.join(large, same_rows(named, large, ["note_id"]), "left_anti")
        for _ in range(ROUNDS):
            winners, open_ = _round(open_)
            kept.append(winners)
            if open_.groupBy("note_id").count().where(F.col("count") > fold).isEmpty():
                break
        named = named.unionByName(open_)
    return reduce(DataFrame.unionByName, kept, _folded(named))


def _round(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The citations that come first on all their URIs, and those that share none of these URIs."""
    row, place = ["note_id", "seq", "uris"], ["note_id", "__uri"]
    each = open_.withColumn("__uri", F.explode(F.array_distinct(F.filter("uris", lambda u: u.isNotNull()))))
    first = keyed(each.groupBy(*place).agg(F.min(F.struct("seq", "uris")).alias("__min")), place)
    wins = each.join(first, same_rows(each, first, place)).groupBy(*row).agg(F.bool_and(F.struct("seq", "uris").eqNullSafe(F.col("__min"))).alias("__wins"))
    winners = stored(wins.where("__wins").select(*row), "kept-citations")
    taken = keyed(winners.select("note_id", F.explode("uris").alias("__uri")).where("__uri IS NOT NULL"), place)
    closed = keyed(each.join(taken, same_rows(each, taken, place), "left_semi").select(*row).distinct(), row)
    return winners, stored(open_.join(closed, same_rows(open_, closed, row), "left_anti"), "open-citations")


def _folded(citations: DataFrame) -> DataFrame:
    """Notes in order, beside the set of URIs that the current one has taken."""
    note, seq, uris = (f.dataType.simpleString() for f in citations.select("note_id", "seq", "uris").schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, taken = None, set()
        for batch in batches:
            keep = []
            for n, names in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n != current:
                    current, taken = n, set()
                names = {x for x in names if x is not None}
                keep.append(taken.isdisjoint(names))
                if keep[-1]:
                    taken |= names
            yield batch.filter(pa.array(keep, pa.bool_()))

    in_order = citations.select("note_id", "seq", "uris").repartition("note_id").sortWithinPartitions("note_id", "seq", "uris")
    return in_order.mapInArrow(fold, f"note_id {note}, seq {seq}, uris {uris}")


def dedupe_citations(citations: DataFrame) -> DataFrame:
    """(note_id, items): the kept citations of each note, in order."""
    return kept_citations(citations).groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("seq", "uris"))).alias("items"))


def note_html(groups: DataFrame, citations: DataFrame, versions: DataFrame, title: str = "图表") -> DataFrame:
    """(note_id, html): title, headings and bodies inside one div with citations and version.

    groups: from headings(). citations: from dedupe_citations(); a note without them has an empty list.
    """
    h2 = F.when(F.col("item_heading").isNotNull(), F.concat(F.lit("<h2>"), "item_heading", F.lit("</h2>\n"))).otherwise("")
    h3 = F.when(F.col("attachment_heading").isNotNull(), F.concat(F.lit("<h3>"), "attachment_heading", F.lit("</h3>\n"))).otherwise("")
    part = F.struct("run_no", F.concat(h2, h3, F.col("body"), F.lit("\n")).alias("p"))
    made = groups.groupBy("note_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["p"]), "").alias("body"))
    return _html(made, citations, versions, title)


def _html(bodies: DataFrame, citations: DataFrame, versions: DataFrame, title: str) -> DataFrame:
    coded = citations.select("note_id", encode_citations(F.transform("items", lambda x: F.struct(x["uris"].alias("uris")))).alias("coded"))
    rows = bodies.join(versions, "note_id").join(coded, "note_id", "left")
    html = F.concat(F.lit('<div data-citation-items="'), F.coalesce("coded", F.lit("%5B%5D")), F.lit('" data-schema-version="'), F.col("schema_version").cast("string"), F.lit(f'"><h1>{title}</h1>\n'), "body", F.lit("</div>"))
    return rows.select("note_id", html.alias("html"))


def note_places(lines: DataFrame, wishes: DataFrame) -> DataFrame:
    """(note_id, library_id, parent_id, collection_id): where each note goes.

    lines: (note_id, seq, library_id, ...); the library is that of a note's first annotation. wishes: (note_id,
    parent_id, collection_id); a note with a parent goes under it and into no collection.
    """
    library = lines.groupBy("note_id").agg(F.min_by("library_id", "seq").alias("library_id"))
    return library.join(wishes.select("note_id", "parent_id", "collection_id"), "note_id", "left").select(
        "note_id", "library_id", "parent_id", F.when(F.col("parent_id").isNull(), F.col("collection_id")).alias("collection_id")
    )


def create_notes(lines: DataFrame, attachments: DataFrame, items: DataFrame, citations: DataFrame, title: str = "图表", wishes: DataFrame | None = None) -> DataFrame:
    """Notes from ordered lines (note_id, seq, annotation_id, attachment_id, annotation_type, comment, key). No lines are an error.

    With wishes (see note_places) each note has its place, and lines a library_id.
    """
    resolved = _resolved(lines, attachments, items)
    if resolved.isEmpty():
        raise ValueError("no annotations")
    made = _html(bodies(resolved), dedupe_citations(citations), note_schema_version(resolved), title)
    return made if wishes is None else made.join(note_places(resolved, wishes), "note_id")
