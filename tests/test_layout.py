"""The nearest character by branch and bound, against a scan of all characters in order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from figshelf.operators import layout
from figshelf.plans.catalogue_queries import flipped
from figshelf.plans.fixtures import view

NAN, INF = float("nan"), float("inf")
CHAR = "attachment_id long, page int, char_offset int, cx1 double, cy1 double, cx2 double, cy2 double"
REGION = "figure_id long, attachment_id long, page int, x1 double, y1 double, x2 double, y2 double"


def gap(p, q):
    return max(*(0.0 if math.isnan(v) else v for v in (p, q)), 0.0)


def first_nearest(region, chars):
    """The first character, in order, than which none is nearer; 0 if there is none."""
    best, at = None, 0
    for k, c in enumerate(chars):
        c, r = ([NAN if v is None else v for v in x] for x in (c, region))
        dx, dy = gap(c[0] - r[2], r[0] - c[2]), gap(c[1] - r[3], r[1] - c[3])
        d = math.sqrt(dx * dx + dy * dy)
        if best is None or d < best:
            best, at = d, k
    return at


def pages(rng):
    """Pages of lines; of characters that all are equally far; of one character; of numbers that are none."""
    lines = [(36.0 + k % 30 * 9, 700.0 - k // 30 * 14, 44.0 + k % 30 * 9, 710.0 - k // 30 * 14) for k in range(700)]
    spots = [(x := rng.randrange(0, 40) * 10.0, y := rng.randrange(0, 40) * 10.0, x + 5, y + 5) for _ in range(500)]
    same = [(100.0, 100.0, 105.0, 105.0)] * 300
    ring = [(300 + 100 * math.cos(k), 300 + 100 * math.sin(k), 300 + 100 * math.cos(k), 300 + 100 * math.sin(k)) for k in range(200)]
    odd = [tuple(NAN if rng.random() < 0.05 else None if rng.random() < 0.05 else INF if rng.random() < 0.02 else v for v in c) for c in spots]
    turned = [(c[2], c[3], c[0], c[1]) for c in spots]
    return [lines, spots, same, ring, odd, turned, [(5.0, 5.0, 6.0, 6.0)], [(None, 1.0, 2.0, 3.0)] * 70, [(NAN, NAN, NAN, NAN)] * 3 + lines[:100], []]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    all_ = pages(rng)
    regions = []
    for p in range(len(all_) + 1):
        for _ in range(25):
            x, y = rng.randrange(-20, 60) * 10.0, rng.randrange(-20, 80) * 10.0
            regions.append((len(regions), p % 3, p, x, y, x + rng.randrange(0, 20) * 10, y + rng.randrange(0, 20) * 10))
        regions += [(len(regions), p % 3, p, NAN, 10.0, 20.0, 30.0), (len(regions) + 1, p % 3, p, None, 10.0, 20.0, 30.0), (len(regions) + 2, p % 3, p, -INF, -INF, INF, INF)]
    want = {r[0]: first_nearest(r[3:], all_[r[2]]) if r[2] < len(all_) else 0 for r in regions}
    chars = spark.createDataFrame([(p % 3, p, k, *c) for p, cs in enumerate(all_) for k, c in enumerate(cs)], CHAR).repartition(6)
    return spark.createDataFrame(regions, REGION), chars, all_, want


@pytest.mark.parametrize("box, sent", [(1, 10**6), (7, 0), (64, 10**6), (64, 0), (64, 400), (10_000, 0)])
def test_long_form(made, box, sent, monkeypatch):
    monkeypatch.setattr(layout, "SENT", sent)
    regions, chars, _, want = made
    assert {r["figure_id"]: r["offset"] for r in layout.nearest_char(regions, chars, box).collect()} == want


@pytest.mark.parametrize("box", [1, 64, None])
def test_in_row(made, spark, box):
    regions, _, all_, want = made
    rows = spark.createDataFrame([(p % 3, p, cs) for p, cs in enumerate(all_)], "attachment_id long, page int, chars array<struct<cx1:double,cy1:double,cx2:double,cy2:double>>")
    assert {r["figure_id"]: r["offset"] for r in layout.nearest_char_by_page(regions, layout.boxed_pages(rows, box) if box else rows).collect()} == want


def test_nested_text(made, spark, tmp_path):
    """Paragraphs of two lines, lines of one to three words of 0 to 9 characters; boxes can be stored."""
    regions, _, all_, want = made
    rng, rows = random.Random(4), []
    for p, cs in enumerate(all_):
        words, k = [], 0
        while k < len(cs) or not words:
            n = rng.randrange(0, 10)
            words.append(([([*c],) for c in cs[k : k + n]],))
            k += n
        lines = []
        while words:
            n = rng.randrange(1, 4)
            lines.append((words[:n],))
            words = words[n:]
        rows.append((p % 3, p, [(lines[k : k + 2],) for k in range(0, len(lines), 2)]))
    text = spark.createDataFrame(rows, "attachment_id long, page int, paragraphs array<struct<lines:array<struct<words:array<struct<chars:array<struct<rect:array<double>>>>>>>>>")
    layout.boxed_pages(text).write.parquet(f"file://{tmp_path}/boxes")
    for pages_ in (text, spark.read.parquet(f"file://{tmp_path}/boxes")):
        assert {r["figure_id"]: r["offset"] for r in layout.nearest_char_by_page(regions, pages_).collect()} == want


def test_few_distances(spark):
    """On the given tables less than a tenth of the pairs."""
    work = layout.search_work(flipped(spark, "/root/testdata/sf0.01"), view(spark, "/root/testdata/sf0.01", "chars")).first()
    assert 0 < work["n_boxes"] + work["n_chars"] < work["n_pairs"] / 10


def test_characters_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Characters whose boxes are looked for twice come from one shuffle; boxes are summed before theirs."""
    monkeypatch.setattr(layout, "SENT", 0)
    sf_dir = "/root/testdata/sf0.001"
    view(spark, sf_dir, "chars").write.parquet(f"file://{tmp_path}/chars")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = layout.nearest_char(flipped(spark, sf_dir), spark.read.parquet(f"file://{tmp_path}/chars"))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = plan.split("== Initial Plan ==")[0]
    moved = [x for x in final.splitlines() if "Exchange" in x and "char_offset" in x or "Exchange hashpartitioning(attachment_id" in x and ", box" in x]
    assert "ReusedExchange" in final and sum("char_offset" in x for x in moved) <= 1


def test_characters_stay_where_they_are(spark, tmp_path):
    """With few regions no character is shuffled."""
    sf_dir = "/root/testdata/sf0.001"
    view(spark, sf_dir, "chars").write.parquet(f"file://{tmp_path}/chars")
    df = layout.nearest_char(flipped(spark, sf_dir), spark.read.parquet(f"file://{tmp_path}/chars"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and "box" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_many_regions_are_not_broadcast(spark, monkeypatch):
    """More regions than can be sent: nothing is broadcast, and dealt characters are neither shuffled nor sorted, but stream by the regions."""
    monkeypatch.setattr(layout, "SENT", 0)
    sf_dir = "/root/testdata/sf0.001"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10g")
    try:
        regions = flipped(spark, sf_dir).localCheckpoint()
        found, _, _ = layout._searched(regions, view(spark, sf_dir, "chars"), layout.BOX)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in plan and "ShuffledHashJoin" in plan
    assert not [x for x in plan.splitlines() if "Exchange" in x and "REPARTITION_BY_NUM" not in x and "char_offset" in x]
