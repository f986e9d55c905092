"""Hand-written cases of the column functions and sources."""

import hashlib
import json
import math
import os
import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from figshelf.functions import captions, extra, ranking
from figshelf.functions.citations import encode_citations
from figshelf.functions.geometry import bbox, bbox_paths, bbox_rects, rect_distance
from figshelf.operators import annotate, catalogue, layout, notes
from figshelf.sources import results
from figshelf.sources.images import ImageStore
from figshelf.streaming.annotate import annotate_stream


def one(spark, column, **values):
    df = spark.range(1)
    for name, v in values.items():
        df = df.withColumn(name, v if not isinstance(v, (str, int, float)) else F.lit(v))
    return df.select(column).first()[0]


def by_sides(a, b):
    dx, dy = max(a[0] - b[2], b[0] - a[2], 0), max(a[1] - b[3], b[1] - a[3], 0)
    return math.hypot(dx, dy)


def test_rect_distance(spark):
    base = (10.0, 10.0, 20.0, 20.0)
    cases = [(0, 12, 5, 15), (25, 12, 30, 15), (12, 0, 15, 5), (12, 25, 15, 30), (0, 0, 5, 5), (25, 0, 30, 5), (0, 25, 5, 30), (25, 25, 30, 30), (15, 15, 30, 30), (20, 20, 25, 25)]
    rng = random.Random(1)
    for _ in range(50):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        cases.append((x, y, x + rng.uniform(0, 30), y + rng.uniform(0, 30)))
    rows = spark.createDataFrame([tuple(map(float, c)) for c in cases], "p double, q double, r double, s double")
    got = [r[0] for r in rows.select(rect_distance(tuple(map(F.lit, base)), tuple(map(F.col, "pqrs")))).collect()]
    assert got == pytest.approx([by_sides(base, c) for c in cases])
    assert got[8] == got[9] == 0
    assert one(spark, rect_distance(tuple(F.lit(float("nan")) for _ in range(4)), tuple(map(F.lit, base)))) == 0


def test_boxes(spark):
    rects, nxt = F.array(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), F.array(*map(F.lit, (0.0, 5.0, 2.0, 9.0)))), F.array(F.array(*map(F.lit, (7.0, 7.0, 8.0, 8.0))))
    assert one(spark, bbox_rects(rects, nxt, F.lit(3))) == [0, 2, 3, 9]
    assert one(spark, bbox_rects(rects, nxt, F.lit(3), F.lit(4))) == [7, 7, 8, 8]
    assert one(spark, bbox_rects(rects, nxt, F.lit(3), F.lit(3))) == [0, 2, 3, 9]
    paths = F.array(F.array(*map(F.lit, (5.0, 1.0, 2.0, 8.0, -99.0))), F.array(*map(F.lit, (3.0, 0.0))))
    assert one(spark, bbox_paths(paths)) == [2, 0, 5, 8]
    position = F.struct(F.lit(None).cast("array<array<double>>").alias("rects"), F.lit(None).cast("array<array<double>>").alias("nextPageRects"), F.lit(0).alias("pageIndex"), paths.alias("paths"))
    assert one(spark, bbox(position)) == [2, 0, 5, 8]


def test_captions(spark):
    assert one(spark, captions.short_caption(F.lit("x" * 30))) == "x" * 30
    assert one(spark, captions.short_caption(F.lit("x" * 31))) == "x" * 30 + "..."
    assert one(spark, captions.caption_number(F.lit("Fig. 12: of 3"))) == "12"
    assert one(spark, captions.caption_number(F.lit("none"))) == "0"
    assert [one(spark, captions.classify_caption(F.lit(c))) for c in ("see FIGure", "图 1", "Tab. 1")] == ["Figure", "Figure", "Table"]
    assert one(spark, captions.default_caption(F.lit(""))) == "Untitled Figure/Table"
    assert one(spark, captions.figure_tag(F.lit("Figure"), F.lit("3"))) == "Figure 3"
    assert one(spark, captions.page_label(F.lit(0))) == "1"
    none, two = F.array().cast("array<string>"), F.array(F.lit("todo"), F.lit("Figure 1"))
    assert not one(spark, captions.is_figure_first_tag(F.lit("image"), none))
    assert one(spark, captions.is_figure_any_tag(two)) and not one(spark, captions.is_figure_first_tag(F.lit("image"), two))
    assert not one(spark, captions.filter_active(none, none, none, F.lit("")))
    assert one(spark, captions.filter_active(none, none, two, F.lit("")))


def test_extra(spark):
    text = "A: 1\nfree\nB: x: y\nA: 2\n: no key\nB:z"
    assert one(spark, extra.parse_extra(F.lit(text))) == {"A": "2", "B": "x: y", "__nonStandard__": "free\n: no key\nB:z"}
    assert list(one(spark, extra.parse_extra(F.lit(text)))) == ["A", "B", "__nonStandard__"]
    assert one(spark, extra.get_extra(F.lit(text), "B")) == "x: y" and one(spark, extra.get_extra(F.lit(text), "C")) is None
    assert one(spark, extra.set_extra(F.lit("x\nA: 1"), "B", F.lit("2"))) == "x\nA: 1\nB: 2"
    assert one(spark, extra.set_extra(F.lit(""), "B", F.lit("2"))) == "B: 2"


def test_citations(spark):
    rows = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b", "c"]), (1, 3, ["c", "d"])], "note_id long, seq long, uris array<string>")
    kept = notes.dedupe_citations(rows).first()["items"]
    assert [x["seq"] for x in kept] == [1, 3]
    text = "a b!'()~*-_.\"é"
    made = one(spark, encode_citations(F.array(F.struct(F.lit(text).alias("t")))))
    assert made == urllib.parse.quote(json.dumps([{"t": text}], separators=(",", ":"), ensure_ascii=False), safe="!'()~*-_.")


def test_disjoint_property(spark):
    rng = random.Random(2)
    rows = [(n, i, [f"u{rng.randrange(12)}" for _ in range(rng.randint(1, 3))]) for n in range(40) for i in range(15)]
    df = spark.createDataFrame(rows, "note_id long, seq long, uris array<string>")
    for note in notes.dedupe_citations(df).collect():
        kept, held = [x["seq"] for x in note["items"]], set()
        for _, seq, uris in (r for r in rows if r[0] == note["note_id"]):
            assert (seq in kept) == (not held & set(uris))
            held |= set(uris) if seq in kept else set()


def test_repeated_citations_are_not_collected(spark):
    lists = [["a", "b"], ["b", "c"], ["c", None], [], None, [None]]
    rows = [(1, i, lists[i % 6]) for i in range(600)] + [(2, 5, ["a"]), (2, None, ["a"])]
    df = spark.createDataFrame(rows, "note_id long, seq long, uris array<string>").repartition(3)
    assert notes.first_citations(df).count() == 3 + 300 + 1
    got = {r["note_id"]: [x["seq"] for x in r["items"]] for r in notes.dedupe_citations(df).collect()}
    assert got == {1: [i for i in range(600) if i in (0, 2) or i % 6 > 2], 2: [None]}


def test_nearest_and_sort_key(spark):
    pages = spark.createDataFrame([(1, 0, 0.0, 0.0, 600.0, 800.0), (1, 123456, 0.0, 0.0, 600.0, 800.0)], "attachment_id long, page int, vx1 double, vy1 double, vx2 double, vy2 double")
    regions = spark.createDataFrame(
        [(1, 10, 0, 100.0, 100.0, 200.0, 200.0), (1, 11, 7, 100.0, 100.0, 200.0, 200.0), (1, 12, 123456, 0.0, 0.0, 1.0, 900.0)],
        "attachment_id long, figure_id long, page int, x1 double, y1 double, x2 double, y2 double",
    )
    chars = spark.createDataFrame(
        [(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 90.0, 100.0, 95.0, 110.0), (1, 0, 2, 205.0, 100.0, 210.0, 110.0), (1, 123456, 1234567, 0.0, 0.0, 1.0, 1.0)],
        "attachment_id long, page int, char_offset int, cx1 double, cy1 double, cx2 double, cy2 double",
    )
    keys = {r["figure_id"]: r["sort_key"] for r in layout.reading_order_key(regions, chars, pages).collect()}
    # two characters at one distance: the first; a page that is not there: zeros; long numbers: leading digits; above the top: 0
    assert keys == {10: "00000|000001|00600", 11: "00007|000000|00000", 12: "12345|123456|00000"}
    by_page = chars.where("page = 0").groupBy("attachment_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("char_offset", "cx1", "cy1", "cx2", "cy2"))), lambda c: F.struct(c["cx1"].alias("cx1"), c["cy1"].alias("cy1"), c["cx2"].alias("cx2"), c["cy2"].alias("cy2"))).alias("chars"))
    assert {r[0]: r[1] for r in layout.nearest_char_by_page(regions, by_page).collect()} == {10: 1, 11: 0, 12: 0}  # pages without characters: 0
    assert {r[0]: r[1] for r in layout.nearest_char(regions, chars.where("page = 0")).collect()} == {10: 1, 11: 0, 12: 0}
    plan = layout.nearest_char_by_page(regions, by_page)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_flip_and_back(spark):
    pages = spark.createDataFrame([(1, 0, 0.0, 0.0, 600.0, 800.0), (1, 1, 0.0, 0.0, 600.0, 500.0)], "attachment_id long, page int, vx1 double, vy1 double, vx2 double, vy2 double")
    figures = spark.createDataFrame([(1, 5, "Figure", "2", 1, "Fig. 2: x", 1.0, 10.0, 30.0, 40.0)], "attachment_id long, figure_id long, fig_type string, name string, page int, caption string, x1 double, y1 double, x2 double, y2 double")
    flipped = layout.flip_regions(figures, pages)
    assert flipped.select("y1", "y2").first() == (760.0, 790.0)
    assert layout.flip_regions(figures, pages, per_page_height=True).select("y1", "y2").first() == (460.0, 490.0)
    made = annotate.build_annotations(flipped, flipped.select("figure_id", F.lit("k").alias("sort_key")), F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    row = made.first()
    assert row["key"] == made.first()["key"] and len(row["key"]) == 8 and set(row["key"]) <= set(annotate.ALPHABET)
    assert row["date_created"] == "2024-01-02T03:04:05.000Z" and row["tags"] == ["Figure 2"] and row["page_label"] == "2"
    back = annotate.annotations_to_figures(made, pages).first()
    assert (back["x1"], back["y1"], back["x2"], back["y2"], back["name"], back["fig_type"], back["page"]) == (1.0, 10.0, 30.0, 40.0, "2", "Figure", 1)


def test_figures_without_their_page_stay(spark):
    pages = spark.createDataFrame([(1, 0, 0.0, 0.0, 600.0, 800.0)], "attachment_id long, page int, vx1 double, vy1 double, vx2 double, vy2 double")
    figures = spark.createDataFrame([(a, a, "Figure", "2", 0, "c", 1.0, 10.0, 30.0, 40.0) for a in (1, 2)], "attachment_id long, figure_id long, fig_type string, name string, page int, caption string, x1 double, y1 double, x2 double, y2 double")
    flipped = layout.flip_regions(figures, pages)
    assert {r["figure_id"]: (r["x1"], r["y1"], r["y2"]) for r in flipped.collect()} == {1: (1.0, 760.0, 790.0), 2: (1.0, None, None)}
    assert {tuple(r) for r in layout.unplaced(flipped).collect()} == {(1, 1, 0), (2, 1, 1)}
    chars = spark.createDataFrame([], "attachment_id long, page int, chars array<struct<cx1:double,cy1:double,cx2:double,cy2:double>>")
    made = annotate.build_annotations(flipped, layout.reading_order_key_by_page(flipped, chars, pages), F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    assert {r["annotation_id"]: r["sort_index"] for r in made.collect()} == {1: "00000|000000|00010", 2: "00000|000000|00000"}
    assert {r["annotation_id"]: r["y2"] for r in annotate.annotations_to_figures(made, pages).collect()} == {1: 40.0, 2: None}


def test_work_and_places(spark):
    marks = spark.createDataFrame([(1, 7, "image"), (2, 7, "image"), (3, 8, "image"), (4, 9, "highlight")], "annotation_id long, attachment_id long, annotation_type string")
    cache = spark.createDataFrame([(3,)], "annotation_id long")
    assert [r[0] for r in catalogue.attachments_to_render(marks, cache).collect()] == [7]
    lines = spark.createDataFrame([(1, 5, 50), (1, 2, 20), (2, 1, 10), (3, 1, None)], "note_id long, seq long, library_id int")
    wishes = spark.createDataFrame([(1, 4, "c"), (2, None, "c")], "note_id long, parent_id int, collection_id string")
    assert {tuple(r) for r in notes.note_places(lines, wishes).collect()} == {(1, 20, 4, None), (2, 10, None, "c"), (3, None, None, None)}


def test_note_headings(spark):
    lines = spark.createDataFrame([(1, i, 100 + i, a, "image", "c", "k") for i, a in enumerate((1, 1, 2, 1))], "note_id long, seq long, annotation_id long, attachment_id long, annotation_type string, comment string, key string")
    files = spark.createDataFrame([(1, "P.pdf", 9), (2, "Q.pdf", 9)], "attachment_id long, file_name string, parent_item_id int")
    items = spark.createDataFrame([(9, "Item")], "item_id int, title string")
    resolved = notes.resolve_parents(lines, files, items)
    groups = notes.headings(notes.runs(notes.group_runs(resolved)), notes.spans_items(resolved)).orderBy("run_no").collect()
    assert [g["attachment_heading"] for g in groups] == ["P.pdf", "Q.pdf", "P.pdf"] and {g["item_heading"] for g in groups} == {None}
    none = spark.createDataFrame([], "note_id long, seq long, uris array<string>")
    html = notes.create_notes(lines, files, items, none).first()["html"]
    assert html.startswith('<div data-citation-items="%5B%5D" data-schema-version="9"><h1>') and html.count("<h3>") == 3
    with pytest.raises(ValueError):
        notes.create_notes(lines.limit(0), files, items, none)


def pieces(query):
    """The query cut at white space, with the marks that stand alone by themselves."""
    out = [""]
    for ch in query.lower():
        if ch.isspace():
            out.append("")
        elif ch in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~" or "\u4e00" <= ch <= "\u9fff":
            out += [ch, ""]
        else:
            out[-1] += ch
    return [x for x in out if x]


def placings(text, parts, begin=0):
    """Every way to find all parts in order."""
    if not parts:
        return [[]]
    return [[at, *rest] for at in range(begin, len(text)) if text.startswith(parts[0], at) for rest in placings(text, parts[1:], at + len(parts[0]))]


def score(text, query):
    """The best-placed finding is the earliest; None without one."""
    for parts, words in ((pieces(query), True), (list(query.lower()), False)):
        if found := placings(text.lower(), parts):
            break
    else:
        return None
    at = min(found)
    covered = {k for p, part in zip(at, parts) for k in range(p, p + len(part))}
    islands = [k for k in covered if k - 1 not in covered]
    kind = lambda c: "mark" if pieces(c) and not c.isalnum() or "\u4e00" <= c <= "\u9fff" else "space" if c.isspace() else "capital" if c.isupper() else "small" if c.islower() else "other"
    inside = [p for p in at if p and words and (kind(text[p - 1]), kind(text[p])) in {("capital", "capital"), ("capital", "small"), ("small", "small"), ("other", "small")}]
    return -(len(islands) - 1) - len(inside) / 10 - (max(covered) + 1 - min(covered) + 1 - len(query)) / 100 - min(covered) / 1000 - len(text) / 10000


def test_extra_with_many_keys(spark):
    lines = [f"k{i % 7000}: {i}" for i in range(10_000)] + ["free"]
    got = one(spark, extra.parse_extra(F.lit("\n".join(lines))))
    in_order = one(spark, F.map_keys(extra.parse_extra(F.lit("\n".join(lines)))))
    assert in_order == [f"k{i}" for i in range(7000)] + ["__nonStandard__"]
    assert got["k0"] == "7000" and got["k2999"] == "9999" and got["k3000"] == "3000" and got["__nonStandard__"] == "free"


def test_ranked_search(spark):
    texts = ["Figure 1: urgent", "configure one", "FIG fig", "a 图表 b", "table 1", "prefix fig-1", "", "f i g", "aFIg", "1fig", "figure fig 1x", "XFIG-11"]
    rows = spark.createDataFrame(list(enumerate(texts)), "figure_id long, caption string")
    for query in ("fig 1", "图", "FIG", "e o", "-1", "fgr", "gi", "tb 1", "  fig"):
        got = {r["figure_id"]: r["score"] for r in catalogue.ranked_search(rows, query, 20).collect()}
        want = {i: s for i, t in enumerate(texts) if (s := score(t, query)) is not None}
        assert got == pytest.approx(want), query
    assert {r["figure_id"] for r in catalogue.ranked_search(rows, "fgr", 20).collect()} == {0, 1, 10}  # no word, but its letters in order
    assert catalogue.ranked_search(rows, "", 3).count() == 3


def figure(caption, page=0):
    return {"caption": caption, "name": "1", "page": page, "renderURL": "u", "regionBoundary": {"y1": 2.0, "x1": 1.0, "y2": 4.0, "x2": 3.0}, "figType": "Figure"}


def test_result_files(spark, tmp_path):
    text = json.dumps([figure("图 1: 中文"), figure("b", 1)], ensure_ascii=False)
    (tmp_path / "AAA.json").write_bytes(text.encode())
    (tmp_path / "BBB.json").write_bytes(text.encode("gbk"))
    (tmp_path / "CCC.json").write_text("[]")
    rows = results.read_figures(spark, f"file://{tmp_path}").collect()
    assert sorted((r["file_name"], r["figure_index"], r["caption"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows) == [(f, i, c, 1.0, 2.0, 3.0, 4.0) for f in ("AAA.json", "BBB.json") for i, c in enumerate(("图 1: 中文", "b"))]
    files = spark.createDataFrame([("AAA-2.json",), ("AAA.json",), ("BBB.json",), ("CCC.json",)], "file_name string")
    owners = spark.createDataFrame([(1, "AAA"), (2, "CCC"), (3, "ZZ"), (4, None)], "attachment_id long, attachment_key string")
    assert {r["attachment_id"]: r["file_found"] for r in results.match_results(owners, files).collect()} == {1: "AAA-2.json", 2: "CCC.json", 3: None, 4: None}
    figures = spark.createDataFrame([(1,), (1,)], "attachment_id long")
    assert {r[0]: (r[1], r[2]) for r in results.extraction_outcome(owners, files, figures).collect()} == {1: ("parsed", 2), 2: ("empty", 0), 3: ("not_found", 0), 4: ("not_found", 0)}
    assert results.pending_attachments(owners, files, force=True).count() == 4


def test_keys_of_many_lengths_are_all_matched(spark):
    keys = [(n, f"{n:03}" + "k" * (n - 3)) for n in range(3, 304)]
    owners = spark.createDataFrame(keys, "attachment_id long, attachment_key string")
    files = spark.createDataFrame([(f"{k}{end}",) for _, k in keys for end in (".json", "-2.json")], "file_name string")
    assert {r["attachment_id"]: r["file_found"] for r in results.match_results(owners, files).collect()} == {n: f"{k}-2.json" for n, k in keys}
    assert results.pending_attachments(owners, files).count() == 0


def test_keys_and_names_sorted_together(spark):
    """Keys inside each other, repeated, empty, null, before and after all names, over several ranges."""
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("ab图-K1") for _ in range(rng.randint(1, 12))) + ".json" for _ in range(400)})
    keys = [n[: rng.randint(1, len(n))] for n in names] + ["K1", "K12", "", None, "!", "\U0001f600", "a" * 5000, "K1"]
    owners = spark.createDataFrame([(i, k, i) for i, k in enumerate(keys)], "attachment_id long, attachment_key string, word long")
    files = spark.createDataFrame([(n,) for n in [*names, None, names[0]]], "file_name string")
    want = {i: min((n for n in names if k is not None and n.startswith(k)), default=None) for i, k in enumerate(keys)}
    assert {r["attachment_id"]: r["file_found"] for r in results.match_results(owners, files).collect()} == want
    assert {r["file_found"] for r in results.match_results(owners, files.where("false")).collect()} == {None}
    plan = results._first_by_order(owners, files)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row a beginning
    few = owners.where("attachment_key IN ('K1', 'K12', '') OR attachment_key IS NULL")
    by_order = {r["__key"]: r["file_found"] for r in results._first_by_order(few, files).collect()}
    assert by_order == {r["attachment_key"]: r["file_found"] for r in results.match_results(few, files).where("file_found IS NOT NULL").collect()}


def test_decoding_stays_in_the_jvm_for_utf8(spark):
    text = "图 1: 中文"
    rows = spark.createDataFrame([("a", bytearray(text.encode())), ("b", bytearray(text.encode("gbk"))), ("c", None), ("d", bytearray(b"")), ("e", bytearray("\ufffd".encode())), ("f", bytearray(b"\xff\xff"))], "path string, content binary")
    want = {k: None if c is None else results.decode_text(bytes(c)) for k, c in rows.collect()}
    assert {r["path"]: r["text"] for r in results.decode_with_fallback(rows).collect()} == want and want["b"] == text


def test_saved_annotations_once_each(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, f"k{i % 7}", "x") for i in range(70)], "attachment_id long, key string, comment string")
    out = f"file://{tmp_path}/saved"
    for part in (rows.where("attachment_id < 3"), rows, rows):
        results.write_annotations(part, out)
    assert results.saved_annotations(spark, out).count() == 35
    assert {r[0] for r in results.saved_annotations(spark, out, rows.where("attachment_id = 2")).select("attachment_id").distinct().collect()} >= {2}


def test_folders_by_their_names_in_spark():
    from figshelf.sources.storage import open_folder, pyarrow_uri

    assert [pyarrow_uri(x) for x in ("s3a://bucket/a", "hdfs://host/a", "file:/a b")] == ["s3://bucket/a", "hdfs://host/a", "file:///a b"]
    for uri in ("file:///a/b/", "file:/a/b"):
        system, path = open_folder(uri)
        assert system.type_name == "local" and path == "/a/b"


def test_images(spark):
    figures = spark.createDataFrame([(1, "data:image/png;base64,AA"), (2, "u"), (3, "u"), (4, "gone"), (5, None)], "figure_id long, render_url string")
    images = spark.createDataFrame([("u", bytearray(b"png"))], "path string, content binary")
    assert {r["figure_id"]: r["image"] for r in results.attach_images(figures, images).collect()} == {1: "data:image/png;base64,AA", 2: "data:image/png;base64,cG5n", 3: "data:image/png;base64,cG5n", 4: None, 5: None}


def test_stored_images(spark, tmp_path):
    store = ImageStore(spark, f"file://{tmp_path}/store")
    figures = spark.createDataFrame([(1, "data:image/png;base64,AA"), (2, "u"), (3, "v"), (4, "gone"), (5, None), (6, "empty"), (7, "null")], "figure_id long, render_url string")
    images = spark.createDataFrame([("u", bytearray(b"png")), ("v", bytearray(b"png")), ("empty", bytearray(b"")), ("null", None), ("unused", bytearray(b"x"))], "path string, content binary")
    same = {r["figure_id"]: r["image"] for r in results.attach_images(figures, images).collect()}
    for _ in range(2):  # the second time all images are there
        rows = results.attach_stored_images(figures, images, store)
        assert rows.columns == [*figures.columns, "image_digest", "image"]
        assert {r["figure_id"]: r["image"] for r in rows.collect()} == same
    files = [f for f in (tmp_path / "store").rglob("*") if f.is_file() and not f.name.endswith(".crc")]
    assert len(files) == 3 and all(hashlib.sha256(f.read_bytes()).hexdigest() == f.stem for f in files)
    lost = store.get(spark.createDataFrame([("ab" * 32,), (None,)], "digest string")).collect()
    assert [tuple(r) for r in lost] == [("ab" * 32, None)]
    assert store.put(images.where("false")).count() == 0


def test_an_image_is_not_shuffled_to_be_stored(spark, tmp_path):
    """A megabyte that 200 paths share: one file, and only names and digests in the written table."""
    images = spark.range(200).select(F.concat(F.lit("p"), "id").alias("path"), F.encode(F.repeat(F.lit("x"), 1_000_000), "UTF-8").alias("content"))
    store = ImageStore(spark, f"file://{tmp_path}/store")
    names = store.put(images)
    assert names.select("digest").distinct().count() == 1 and names.count() == 200
    assert sum(f.stat().st_size for f in (tmp_path / "store").rglob("*.png")) == 1_000_000
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in names.inputFiles()) < 100_000


def test_stream_takes_up_new_files_and_replays_nothing(spark, tmp_path):
    owners = spark.createDataFrame([(1, "AAA"), (2, "BBB")], "attachment_id long, attachment_key string")
    pages = spark.createDataFrame([(i, 0, 0.0, 0.0, 600.0, 800.0) for i in (1, 2)], "attachment_id long, page int, vx1 double, vy1 double, vx2 double, vy2 double")
    chars = spark.createDataFrame([(1, 0, [(0.0, 0.0, 1.0, 1.0)])], "attachment_id long, page int, chars array<struct<cx1:double,cy1:double,cx2:double,cy2:double>>")
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    run = lambda state: annotate_stream(spark, f"file://{src}", out, f"file://{tmp_path}/{state}", owners, chars, pages, "2024-01-01 00:00:00").awaitTermination()
    (src / "AAA.json").write_text(json.dumps([figure("a"), figure("b")]))
    run("s1")
    assert results.saved_annotations(spark, out).count() == 2
    (src / "BBB.json").write_text(json.dumps([figure("c")]))
    run("s1")
    assert results.saved_annotations(spark, out).count() == 3
    run("s2")  # a lost checkpoint: all files again, and the same keys
    assert results.saved_annotations(spark, out).count() == 3


def test_a_batch_of_the_stream_makes_only_its_own_pages(spark, tmp_path):
    """Of 3,000 pages the two that the batch's figures are on, and sizes of pages likewise, are worked out."""
    owners = spark.createDataFrame([(1, "AAA"), (2, "BBB")], "attachment_id long, attachment_key string")
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return float(x)

    chars = spark.range(3000).select(F.col("id").alias("attachment_id"), F.lit(0).alias("page"), F.array(F.struct(counted("id").alias("cx1"), F.lit(0.0).alias("cy1"), F.lit(1.0).alias("cx2"), F.lit(1.0).alias("cy2"))).alias("chars"))
    sizes = spark.range(3000).selectExpr("id AS attachment_id", "0 AS page", "0.0D AS vx1", "0.0D AS vy1", "600.0D AS vx2", "800.0D AS vy2")
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    for name in ("AAA", "BBB"):
        (src / f"{name}.json").write_text(json.dumps([figure("a"), figure("b")]))
    annotate_stream(spark, f"file://{src}", out, f"file://{tmp_path}/state", owners, chars, sizes, "2024-01-01 00:00:00").awaitTermination()
    assert results.saved_annotations(spark, out).count() == 4 and 0 < made.value < 10


def test_stream_saves_one_file_of_an_attachment(spark, tmp_path):
    owners = spark.createDataFrame([(1, "AAA"), (2, "BBB")], "attachment_id long, attachment_key string")
    pages = spark.createDataFrame([(i, 0, 0.0, 0.0, 600.0, 800.0) for i in (1, 2)], "attachment_id long, page int, vx1 double, vy1 double, vx2 double, vy2 double")
    chars = spark.createDataFrame([(1, 0, [(0.0, 0.0, 1.0, 1.0)])], "attachment_id long, page int, chars array<struct<cx1:double,cy1:double,cx2:double,cy2:double>>")
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    run = lambda state: annotate_stream(spark, f"file://{src}", out, f"file://{tmp_path}/{state}", owners, chars, pages, "2024-01-01 00:00:00").awaitTermination()
    saved = lambda: sorted(r["comment"] for r in results.saved_annotations(spark, out).collect())
    (src / "AAA.json").write_text(json.dumps([figure("a"), figure("b")]))
    run("s1")
    (src / "AAA-copy.json").write_text(json.dumps([figure("copy")]))
    (src / "BBB.json").write_text(json.dumps([figure("c")]))
    run("s1")
    assert saved() == ["a", "b", "c"]
    run("s2")  # a lost checkpoint: both files in one batch, and still those of the first
    assert saved() == ["a", "b", "c"]


def test_column_functions_run_without_python(spark):
    df = spark.createDataFrame([("A: 1", "Fig. 1", ["Figure 1"])], "extra string, caption string, tags array<string>")
    plan = df.select(extra.set_extra(F.col("extra"), "B", F.lit("2")), captions.short_caption(F.col("caption")), captions.is_figure_any_tag(F.col("tags")), ranking.search_score(F.col("caption"), "fig 1"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_extra_is_parsed_once_for_each_pair_set(spark):
    """Setting two pairs, one on top of the other, splits two texts: not each of them again wherever the result is named."""
    df = spark.createDataFrame([("a: 1\nfree",), (None,), ("",)], "extra string")
    two = df.select(extra.set_extra(extra.set_extra(F.col("extra"), "a", F.lit("2")), "b", F.lit("3")).alias("x"))
    assert two._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert [r["x"] for r in two.collect()] == ["free\na: 2\nb: 3", "b: 3", "a: 2\nb: 3"]


def test_result_files_are_not_listed_by_the_driver(spark, tmp_path):
    """Names are rows of a table; the same files, in folders below and with odd names, as Spark's own reader finds."""
    for name in ("AAA.json", "a b,%20é#?.json", "s u%20b/deep/B.json", "sub/C.JSON", ".hidden.json", "_x.json", "_x=1.json", ".dir/D.json", "E.txt", "empty.json"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"" if "empty" in name else name.encode())
    (tmp_path / "in" / "hollow.json").mkdir()
    got = results.result_files(spark, f"file://{tmp_path}/in").select("path", "content")
    want = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(f"file://{tmp_path}/in").select("path", "content")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
    assert "in/AAA.json" not in "".join(got.inputFiles()) and results.result_files(spark, f"{tmp_path}/in/AAA.json").count() == 1


def test_small_result_files_share_tasks(spark, tmp_path):
    """600 small files are a task for each core, not one for every 32."""
    for k in range(600):
        (tmp_path / f"K{k:07}.json").write_text("[]")
    files = results.result_files(spark, f"file://{tmp_path}")
    assert files.rdd.getNumPartitions() <= 10 and files.count() == 600
