"""A Merkle manifest of a table: a digest for each row, one root for all, and a proof for each row (operator 13).

A row's leaf is H (the SHA-256 of the concatenated inputs, as lowercase hex; digests go in as hex text) of its columns, each `-` if null, else the byte
count of its UTF-8, a colon and the value. In each group the leaves ascend by id; while a group has several nodes, every FAN
consecutive ones (the last ones may be fewer, even one) become their H. What remains is the group's subroot; the subroots, by group (null first),
become the root likewise. A row's proof has the other nodes of each of its runs, from its leaf to the root.

Method: concatenated-level strings. The nodes of a group are numbered over range partitions of the sorted table: a number counted inside the
partition, plus the sizes of the partitions before. Each aligned block of BLOCK nodes keeps a level as one string of
hex digits of 64 places a node (as bytes, so that a substring is a slice); substrings of fixed width hash to the parents' string, up to the
block's own node. Those of a group's blocks are the nodes of the next tier, which is treated the same way, until one is left. From
the top down each row gets the substrings beside its node (the segments of its siblings) at each level, then those of its block's node. A fold hashes a leaf with its
siblings up to a root, which is how a changed row is told from an unchanged one without the other rows. SQL functions only.

Rows of one id are ordered by their leaves; rows that are equal in all leaf columns have equal leaves and are leaves of their own, next to each other.
A null id sorts first, a null group is a group. A table of one row has its leaf as root; an empty table gives no rows. Texts are hashed whole. Other columns,
of any name, are not part of the leaf unless they are named. All rows of a group never meet in one task: a task has a block, or a range of the sorted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figshelf.llm.common import CRC32_SQL, Writer, col, documents, working_tables

FAN, LEVELS = 8, 4
BLOCK = FAN**LEVELS  # nodes of a block: its lowest level has 256 KB
HEX = 64
SENT = 2_000  # groups' heads that are broadcast: up to 10 KB each
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: tuple[Column, ...]) -> Column:
    """The leaf of a row of these columns, in this order."""
    return digest(*map(_field, columns))


def numbered(rows: DataFrame, group: list[str], order: list[str], write: Writer, name: str) -> DataFrame:
    """rows (whose columns are plain names) with __r, the place from 0 in each group's order, and __n, the group's size.

    A written table of sorted ranges: rows count inside their partition, and only the sizes of each group's pieces, one for each partition, are summed in order.
    """
    at = F.monotonically_increasing_id()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *(F.col(c).asc_nulls_first() for c in [*group, *order])).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in [*group, *order]))
    sorted_ = write(dealt.select("*", F.spark_partition_id().alias("__p"), at.alias("__at")), name)
    pieces = sorted_.groupBy(*group, "__p").agg(F.min("__at").alias("__low"), F.count(F.lit(1)).alias("__size"))
    by_group = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__size").over(by_group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*(F.col(c).alias(f"__g{k}") for k, c in enumerate(group)), F.col("__p").alias("__q"), (before - F.col("__low")).alias("__shift"), F.sum("__size").over(by_group).alias("__n"))
    same = F.col("__p") == F.col("__q")
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"__g{k}"))
    # by partition as well, so that rows of one group do not meet
    return sorted_.join(pieces, same).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("__r"), "__n")


def _depth(n: Column) -> Column:
    """Levels that a block of a group of n nodes makes."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(n <= FAN**k, k).otherwise(out)
    return out


def _parents(level: Column, n: Column) -> Column:
    """The next level's string of a level of n nodes."""
    runs = F.sequence(F.lit(0), F.ceil(n / FAN).cast("int") - 1)
    made = F.transform(runs, lambda i: F.sha2(F.substring(level, i * (FAN * HEX) + 1, F.lit(FAN * HEX)), 256))
    return F.array_join(made, "").cast("binary")


def blocks_of(nodes: DataFrame, group: list[str]) -> DataFrame:
    """One row a block of nodes (group, __r, __n, node, rest): group, __b, __n, __depth, the level strings __l0 ..., __node (the block's own), __rows."""
    rows = nodes.withColumn("__b", F.floor(F.col("__r") / BLOCK)).groupBy(*group, "__b").agg(F.first("__n").alias("__n"), F.sort_array(F.collect_list(F.struct("__r", "node", "rest"))).alias("__rows"))
    rows = rows.withColumn("__depth", _depth(F.col("__n"))).withColumn("__l0", F.array_join(F.transform("__rows", lambda x: x["node"]), "").cast("binary"))
    for k in range(LEVELS):
        below = F.col(f"__l{k}")
        rows = rows.withColumn(f"__l{k + 1}", F.when(F.col("__depth") > k, _parents(below, F.octet_length(below) / HEX)).otherwise(below))
    return rows.withColumn("__node", F.substring(f"__l{LEVELS}", 1, HEX).cast("string"))


def beside(level: Column, place: Column) -> tuple[Column, Column]:
    """The segments of a level's string before and after a node, inside its run."""
    first = F.floor(place / FAN).cast("int") * (FAN * HEX)
    own = place * HEX
    left, right = F.substring(level, first + 1, own - first), F.substring(level, own + HEX + 1, first + FAN * HEX - own - HEX)
    return left.cast("string"), right.cast("string")


def _sides(place: Column) -> Column:
    """The segments beside a node at each level of its block, lowest first, as an array of (left, right)."""
    out = []
    for k in range(LEVELS):
        left, right = beside(F.col(f"__l{k}"), F.floor(place / FAN**k).cast("int"))
        out.append(F.when(F.col("__depth") > k, F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*out))


def tree(nodes: DataFrame, group: list[str], order: list[str], write: Writer, name: str) -> tuple[DataFrame, DataFrame]:
    """The trees of all groups of nodes (group, order, node, rest).

    First (group, root): the node that remains of each. Second the lowest blocks, with what stands beside each block's own node up to the root
    (`above`, lowest first: an array of (left, right)); nodes_of makes them nodes again. rest is any struct, handed through.
    """
    tier = numbered(nodes.select(*dict.fromkeys([*group, *order, "node", "rest"])), group, order, write, name).select(*group, "__r", "__n", "node", "rest")
    tiers = []
    while True:
        tiers.append(write(blocks_of(tier, group), f"{name}-blocks", keep=True))
        if tiers[-1].where(F.col("__n") > BLOCK).isEmpty():
            break
        none = F.struct(F.lit(None).cast("string").alias("none"))
        tier = tiers[-1].select(*group, F.col("__b").alias("__r"), F.ceil(F.col("__n") / BLOCK).alias("__n"), F.col("__node").alias("node"), none.alias("rest"))
    top = tiers.pop()
    none_above = F.array().cast("array<struct<left:string,right:string>>")
    roots, blocks = top.select(*group, F.col("__node").alias("root")), top.withColumn("above", none_above)
    for below in reversed(tiers):
        upper = nodes_of(blocks, group, "__r").select(*(F.col(c).alias(f"__g{k}") for k, c in enumerate(group)), F.col("__r").alias("__q"), F.col("sides").alias("above"))
        same = F.col("__b") == F.col("__q")
        for k, c in enumerate(group):
            same &= F.col(c).eqNullSafe(F.col(f"__g{k}"))
        blocks = below.join(upper, same).drop("__q", *(f"__g{k}" for k in range(len(group))))
    return roots, blocks


def nodes_of(blocks: DataFrame, keep: list[str], *more: str) -> DataFrame:
    """The nodes of blocks: keep, the fields `more` of the node, node, rest and sides, what stands beside it up to the root.

    All of a block's rows are made inside its own row, so that the long strings are not repeated for each.
    """
    made = F.transform("__rows", lambda x: F.struct(*(x[c].alias(c) for c in (*more, "node", "rest")), F.concat(_sides((x["__r"] - F.col("__b") * BLOCK).cast("int")), F.col("above")).alias("sides")))
    return blocks.select(*keep, made.alias("__made")).select(*keep, F.inline("__made"))


def folded(leaf: Column, sides: Column) -> Column:
    """The root that a leaf gives with what stands beside it."""
    return F.aggregate(sides, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof_text(sides: Column) -> Column:
    """The siblings of all levels, left to right, lowest level first."""
    return F.array_join(F.transform(sides, lambda s: F.concat(s["left"], s["right"])), "")


def merkle_manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = LEAF_COLUMNS, claimed: Column | None = None) -> DataFrame:
    """Per row: its id (id), group, leaf, claim, subroot, root and sides, the siblings on its way to the root.

    claimed: the leaf that a holder of the row claims (a column over rows), to be folded with the siblings; the row's own leaf if not given.
    """
    leaf = leaf_of(tuple(map(col, columns)))
    rest = F.struct(F.col("id"), F.when(F.col("claim") != F.col("node"), F.col("claim")).alias("claim"))
    named = rows.select(col(id_col).alias("id"), col(group_col).alias("grp"), leaf.alias("node"), (leaf if claimed is None else claimed).alias("claim"))
    with working_tables(rows.sparkSession) as write:
        named = write(named, "manifest-leaves")  # whole texts are hashed once: to deal out ranges, Spark reads its rows twice
        subroots, under = tree(named.select("grp", "id", "node", rest.alias("rest")), ["grp"], ["id", "node"], write, "manifest")
        # a group's name in front of its bytes: groups go by these, null first
        tops = subroots.select(F.lit(0).alias("all"), F.col("grp").cast("string").cast("binary").alias("by"), F.col("root").alias("node"), F.struct("grp").alias("rest"))
        roots, over = tree(tops, ["all"], ["by"], write, "manifest-top")
        heads = nodes_of(over, ["all"]).select(F.col("rest.grp").alias("__grp"), F.col("node").alias("subroot"), F.col("sides").alias("__over"), "all").join(roots, "all").select("__grp", "subroot", "__over", "root")
    # groups' heads go to their blocks, of which there are few, and not to their rows. A group may have a third of all blocks: heads of a
    # counted number are broadcast, and more of them meet the blocks by a join of two shuffles, which Spark can split
    few = subroots.limit(SENT + 1).count() <= SENT
    headed = under.join(F.broadcast(heads) if few else heads, F.col("grp").eqNullSafe(F.col("__grp"))).withColumn("above", F.concat("above", "__over"))
    found = nodes_of(headed, ["grp", "subroot", "root"])
    return found.select(F.col("rest.id").alias("id"), "grp", F.col("node").alias("leaf"), F.coalesce("rest.claim", "node").alias("claim"), "subroot", "root", "sides")


LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, checked against rows of which a third are tampered with: by the checksum of the id, their text is lower-cased."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", *LOWER)).otherwise(F.col("text"))
    claim = leaf_of(tuple(tampered if c == "text" else F.col(c) for c in LEAF_COLUMNS))
    found = merkle_manifest(documents(spark, sf_dir), claimed=claim)
    out = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest(proof_text(F.col("sides"))).alias("proof_sha256"), folded(F.col("claim"), F.col("sides")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"


def _levels(name: str, start: str) -> str:
    """Levels of all groups as rows (g, lvl, i, d), and their runs (g, lvl, j, ds) with more than one level above."""
    return f"""{name} AS (SELECT g, 0 AS lvl, i, d, n FROM ({start}) z
  UNION ALL SELECT g, lvl + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY g, lvl, i // 8),
{name}_runs AS (SELECT g, lvl, i // 8 AS j, list(d ORDER BY i) AS ds FROM {name} WHERE n > 1 GROUP BY g, lvl, i // 8)"""


#: A row climbs its group's levels, then those of the subroots (stage 1); lo and hi cut its own node out of its run.
OP13_SQL = f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF.format('text')} AS leaf,
  CASE WHEN {CRC32_SQL.format('doc_id')} % 3 = 0 THEN {_LEAF.format(f"translate(text, '{LOWER[0]}', '{LOWER[1]}')")} ELSE {_LEAF.format('text')} END AS claim FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g FROM t),
{_levels('a', 'SELECT g, i, leaf AS d, n FROM o')},
sub AS (SELECT g, d AS subroot FROM a WHERE n = 1),
{_levels('b', 'SELECT 0 AS g, g AS i, subroot AS d, (SELECT count(*) FROM sub) AS n FROM sub')},
top AS (SELECT d AS root FROM b WHERE n = 1),
climb AS (SELECT r, g, 0 AS stage, 0 AS lvl, i, claim AS node, '' AS proof FROM o
  UNION ALL SELECT c.r, c.g, CASE WHEN x.ds IS NULL THEN 1 ELSE c.stage END, CASE WHEN x.ds IS NULL THEN 0 ELSE c.lvl + 1 END, CASE WHEN x.ds IS NULL THEN c.g ELSE c.i // 8 END,
    CASE WHEN x.ds IS NULL THEN c.node ELSE sha256(array_to_string(x.ds[1:c.i % 8], '') || c.node || array_to_string(x.ds[c.i % 8 + 2:], '')) END,
    CASE WHEN x.ds IS NULL THEN c.proof ELSE c.proof || array_to_string(x.ds[1:c.i % 8], '') || array_to_string(x.ds[c.i % 8 + 2:], '') END
  FROM climb c LEFT JOIN (SELECT 0 AS stage, * FROM a_runs UNION ALL SELECT 1, * FROM b_runs) x
    ON c.stage = x.stage AND CASE WHEN c.stage = 0 THEN c.g ELSE 0 END = x.g AND c.lvl = x.lvl AND c.i // 8 = x.j WHERE x.ds IS NOT NULL OR c.stage = 0),
done AS (SELECT r, arg_max(node, 1000 * stage + lvl) AS folded_root, arg_max(proof, 1000 * stage + lvl) AS proof FROM climb GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM o JOIN done ON o.r = done.r JOIN sub ON o.g = sub.g CROSS JOIN top
"""
