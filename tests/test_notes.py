"""Large notes: citations in rounds, and runs and headings over ranges of one note's lines."""

import random

import pytest
from pyspark.sql import functions as F

from figshelf.operators import notes, ordered
from figshelf.plans.catalogue_queries import QUERIES

SF = "/root/testdata/sf0.001"
CITED = "note_id long, seq long, uris array<string>"


def greedy(rows):
    """Kept (note_id, seq, uris) by going through each note in order."""
    kept, taken = set(), {}
    first = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, [(u is not None, u or "") for u in r[2] or []])
    for n, seq, uris in sorted(rows, key=first):
        names = {u for u in uris or [] if u is not None}
        if not names & taken.setdefault(n, set()):
            kept.add((n, seq, None if uris is None else tuple(uris)))
            taken[n] |= names
    return kept


@pytest.mark.parametrize("fold", [0, 5, 1_000])
def test_rounds_equal_the_fold(spark, fold):
    rng = random.Random(fold)
    rows = [(n, i, [f"u{rng.randrange(30)}" for _ in range(rng.randint(1, 3))]) for n in (1, 2, None) for i in range(60)]
    rows += [(3, i, [f"c{i}", f"c{i + 1}"]) for i in range(12)] + [(4, i, [f"c{i}", f"c{i + 1}"]) for i in reversed(range(12))]  # chains
    rows += [(5, 1, None), (5, 2, []), (5, 3, [None]), (5, None, ["a"]), (5, None, ["b", None]), (5, 4, ["a", "z"]), (5, 4, ["b", "y"]), (5, 4, ["x"]), (5, 5, ["z", "y"])]
    df = spark.createDataFrame(rows, CITED).repartition(4)
    got = [(r["note_id"], r["seq"], None if r["uris"] is None else tuple(r["uris"])) for r in notes.kept_citations(df, fold).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(rows)
    assert notes.kept_citations(df.limit(0), fold).count() == 0


def test_rounds_end_on_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(notes, "ROUNDS", 2)
    rows = [(1, i, [f"c{i}", f"c{i + 1}"]) for i in range(50)]
    assert sorted(r["seq"] for r in notes.kept_citations(spark.createDataFrame(rows, CITED), 3).collect()) == list(range(0, 50, 2))


def test_a_note_of_very_many_citations(spark):
    """One note of 100,000 different citations, in rounds and in order: the same, and none is lost to another's URIs."""
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("note_id"), F.col("id").alias("seq"), F.array(F.concat(F.lit("a"), F.pmod(F.xxhash64("id"), F.lit(40_000)).cast("string")), F.concat(F.lit("b"), F.pmod(F.hash("id"), F.lit(40_000)).cast("string"))).alias("uris"))
    made = [{r["seq"] for r in notes.kept_citations(rows, fold).select("seq").collect()} for fold in (20_000, 100_000)]
    assert made[0] == made[1] and 20_000 < len(made[0]) < 40_000


def lines_of(spark, rows):
    return spark.createDataFrame(rows, "note_id long, seq long, attachment_id long, item_id long, attachment_title string, item_title string, comment string, key string").repartition(5)


@pytest.mark.parametrize("whole", [0, 1_000, 10**6])
def test_one_note_of_a_third_of_all_lines(spark, whole, monkeypatch):
    monkeypatch.setattr(ordered, "WHOLE", whole)
    rng, rows = random.Random(6), []
    for n, size in ((1, 3000), *((k, rng.randrange(0, 400)) for k in range(2, 32)), (None, 300)):
        a = 0
        for i in range(size):
            a = a if rng.random() < 0.6 else rng.randrange(6)
            item = None if a == 5 else a // 2
            rows.append((n, i * 3, None if a == 4 else a, item, f"t{a}", ["", "I", "J"][item] if item is not None else None, "c", "k"))
    want_runs, want_spans, want_heads, by_note = {}, {}, {}, {}
    for r in rows:
        by_note.setdefault(r[0], []).append(r)
    for n, lines in by_note.items():
        run, groups = 0, []
        for k, r in enumerate(lines):
            if k == 0 or r[2] != lines[k - 1][2]:
                run += 1
                groups.append(r)
            want_runs[n, r[1]] = run
        want_spans[n] = any(a[3] != b[3] for a, b in zip(lines, lines[1:]))
        for k, g in enumerate(groups):
            other = g[3] != groups[k - 1][3] if k else g[3] is not None
            several = g[3] is None or sum(x[3] == g[3] for x in groups) > 1
            want_heads[n, k + 1] = (g[5] if want_spans[n] and g[5] and other else None, g[4] if several else None)
    lines = lines_of(spark, rows)
    assert {(r["note_id"], r["seq"]): r["run_no"] for r in notes.group_runs(lines).collect()} == want_runs
    assert {r["note_id"]: r["spans_items"] for r in notes.spans_items(lines).collect()} == want_spans
    in_runs, spans = notes.runs_and_spans(lines)
    assert in_runs.columns == [*lines.columns, "run_no"]
    heads = notes.headings(notes.runs(in_runs), spans).collect()
    assert {(r["note_id"], r["run_no"]): (r["item_heading"], r["attachment_heading"]) for r in heads} == {k: v for k, v in want_heads.items() if k[0] is not None}
    assert notes.group_runs(lines.limit(0)).count() == 0 == notes.spans_items(lines.limit(0)).count()


def test_ranges_split_a_large_note(spark):
    """One note's lines lie in several ranges of about the same size."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).cast("long").alias("note_id"), F.col("id").alias("seq"))
    ranges = ordered.sorted_ranges(rows, ["note_id"], ["seq"])
    sizes = sorted(r["count"] for r in ranges.groupBy(ordered.PART).count().collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    assert ranges.where("note_id = 1").select(ordered.PART).distinct().count() > 1
    seen = ordered.with_before(ranges, ["note_id"], ["seq"], ["seq"])
    gaps = seen.where("NOT __first AND note_id = 1").selectExpr("max(seq - __before_seq)", "count(*)").first()
    assert gaps[0] <= 3 and gaps[1] == rows.where("note_id = 1").count() - 1
    summed = ordered.running_sum(ranges, ["note_id"], ["seq"], F.lit(1), "n").groupBy("note_id").agg(F.max("n").alias("n"), F.countDistinct("n").alias("d"), F.count(F.lit(1)).alias("c"))
    assert summed.where("n <> d OR n <> c").count() == 0


@pytest.mark.parametrize("whole", [0, 10**6])
def test_bodies_are_the_runs_under_their_headings(spark, whole, monkeypatch):
    monkeypatch.setattr(ordered, "WHOLE", whole)
    rng, rows = random.Random(7), []
    for n in (*range(1, 30), None):
        for i in range(rng.randrange(1, 40)):
            a = rng.randrange(7)
            title = None if a in (3, 6) else f"t{a}"
            rows.append((n, i if i else None, None if a == 4 else a, None if a == 5 else a // 2, title, ["", "I", None, "J"][a // 2] if a != 5 else None, rng.choice([None, "", "c\n"]), rng.choice([None, "k", "l"])))
    lines = lines_of(spark, rows)
    in_runs, spans = notes.runs_and_spans(lines)
    want = {}
    for g in notes.headings(notes.runs(in_runs), spans).orderBy("note_id", "run_no").collect():
        tags = "".join(f"<{t}>{g[c]}</{t}>\n" for t, c in (("h2", "item_heading"), ("h3", "attachment_heading")) if g[c] is not None)
        want[g["note_id"]] = want.get(g["note_id"], "") + tags + g["body"] + "\n"
    assert len(want) == 29 and {r["note_id"]: r["body"] for r in notes.bodies(lines).collect()} == want
    assert notes.bodies(lines.limit(0)).count() == 0


def test_bodies_leave_citations_and_join_lines_once(spark, monkeypatch):
    """The bodies have no use for citations; what is left after the lines are written is one shuffle by note, without joins."""
    monkeypatch.setattr(notes, "kept_citations", lambda *_: pytest.fail("citations are not asked for"))
    plan = QUERIES["j6_note_bodies"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_notes_of_lines_and_of_groups_are_the_same(spark):
    lines = spark.createDataFrame([(n, i, i, (i * n) % 4, "image", "c", f"k{i}") for n in (1, 2, 3) for i in range(20)], "note_id long, seq long, annotation_id long, attachment_id long, annotation_type string, comment string, key string")
    files = spark.createDataFrame([(0, "P.pdf", 9), (1, "Q.pdf", 8), (2, "R.pdf", None)], "attachment_id long, file_name string, parent_item_id int")
    items = spark.createDataFrame([(9, "Item"), (8, "Other")], "item_id int, title string")
    cited = spark.createDataFrame([(1, 1, ["a"])], CITED)
    resolved = notes.resolve_parents(lines, files, items)
    in_runs, spans = notes.runs_and_spans(resolved)
    want = notes.note_html(notes.headings(notes.runs(in_runs), spans), notes.dedupe_citations(cited), notes.note_schema_version(lines))
    assert sorted(notes.create_notes(lines, files, items, cited).collect()) == sorted(want.collect())


def test_first_citations_are_found_without_a_sort(spark):
    df = spark.createDataFrame([(1, 2, ["a"]), (1, 1, ["a"]), (2, 3, ["a"]), (2, None, ["a"])], CITED)
    first = notes.first_citations(df)
    assert {(r["note_id"], r["seq"]) for r in first.collect()} == {(1, 1), (2, None)}
    assert "Sort" not in first._jdf.queryExecution().executedPlan().toString()
