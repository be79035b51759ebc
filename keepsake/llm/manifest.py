"""Merkle manifest of a dataset: one root for all rows, and a proof for each.

A row's leaf is H of its fields, H being the lowercase hex sha256 of its inputs one after another. The
leaves of a group ascend by id; every three neighbours, the last run fewer, become the H of their run, as
long as several nodes are left. What remains is the group's subroot, and the subroots, by group, make the
root in the same way.

Method. Rows are range-partitioned by group, id and leaf, and a row's slot in its group follows from its
place in its range and the sizes of the ranges before. Slots are dense, so the nodes of level k are the
rows whose slot 3 ** k divides, and a node's siblings are 3 ** k or 2 * 3 ** k rows before or after it:
lag and lead columns of fixed offset, masked by the slot and by the number of nodes of the level. The
first child of a run hashes the parent. ``LEVELS`` levels are worked on in one window over blocks of
3 ** LEVELS slots, which no run crosses, so no window grows with a group: a group of a third of all rows
is many blocks. Each block leaves one node, and these are the rows of the next tier, until every group has
one. On the way back a node's siblings are the last ones seen in its block, and the rest of its path is
that of its block: a join with a table 3 ** LEVELS times smaller, by the key the windows are dealt by.

What crosses the network for a row is its id, group and digests, never its text. Window partitions hold at
most 3 ** LEVELS rows, the table of ranges one row for each range and group in it.

A null field is ``-``, so it differs from an empty one. A null group is a group of its own, the first. A
null id comes first in its group; rows with the same id go by leaf, and rows with the same leaf as well
are alike, so their order changes nothing. Texts of any length are hashed whole. A group of one row has
its leaf as subroot; one group's subroot is the root. An empty table gives an empty result. Only the named
columns are read, and the result has its own names, so other columns cannot clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Workspace, session

FANOUT, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_OF_RANGE = 33  # bits of monotonically_increasing_id that number the rows of a partition


def encoded(field: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    value = field.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def numbered(rows: DataFrame, order: list[str], space: Workspace, name: str) -> DataFrame:
    """``rows`` with ``slot``, the place in their group ``key`` by ``order``, and ``n``, the size of the group."""
    ranged = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange("key", *order, "place")
    placed = space.save(ranged.sortWithinPartitions("key", *order, "place").withColumn("place", F.monotonically_increasing_id())
                        .withColumn("span", F.shiftright("place", ROWS_OF_RANGE)), f"{name}-placed")
    spans = placed.groupBy("key", "span").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("key").orderBy("span")
    spans = space.save(spans.select(
        "key", "span", (F.sum("rows").over(before) - F.col("rows") - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("key")).alias("n")), f"{name}-spans")
    return placed.join(spans, ["key", "span"]).withColumn("slot", F.col("place") + F.col("shift")).drop("place", "span", "shift")


def blocks(nodes: DataFrame) -> tuple[DataFrame, Window]:
    """The nodes with their block, and the window over it."""
    return (nodes.withColumn("block", F.floor(F.col("slot") / FANOUT ** LEVELS).cast("long")),
            Window.partitionBy("key", "block").orderBy("slot"))


def climbed(nodes: DataFrame) -> DataFrame:
    """The nodes with ``h0`` .. ``h<LEVELS>``, their hashes where they are nodes of that level, and ``s0`` ..,
    the siblings before and after them where the level has several nodes."""
    out, window = blocks(nodes)
    out = out.withColumn("h0", text_of(F.col("hash")))
    for k in range(LEVELS):
        step, own = FANOUT ** k, f"h{k}"
        several = F.col("n") > step
        digit = F.floor(F.col("slot") / step) % FANOUT
        after = [F.lead(own, i * step).over(window) for i in range(1, FANOUT)]
        before = [F.lag(own, i * step).over(window) for i in range(1, FANOUT)]
        around = [f"{side}{i}" for side in "ab" for i in range(1, FANOUT)]
        out = out.select("*", *[c.alias(name) for c, name in zip(after + before, around)])
        right = F.concat(*[F.when(digit + i < FANOUT, F.coalesce(f"a{i}", F.lit(""))).otherwise("") for i in range(1, FANOUT)])
        left = F.concat(*[F.when(digit >= i, F.col(f"b{i}")).otherwise("") for i in reversed(range(1, FANOUT))])
        out = out.withColumns({
            f"s{k}": F.when(several & (F.col("slot") % step == 0), F.struct(left.alias("left"), right.alias("right"))),
            f"h{k + 1}": F.when(F.col("slot") % (FANOUT * step) == 0, F.when(several, F.sha2(F.concat(own, right), 256)).otherwise(F.col(own)))})
        out = out.drop(*around)
    return out


def up(nodes: DataFrame) -> DataFrame:
    """The nodes of the next tier: one for each block."""
    top = climbed(nodes).filter(F.col("slot") % FANOUT ** LEVELS == 0)
    return top.select("key", F.col("block").alias("slot"), F.ceil(F.col("n") / FANOUT ** LEVELS).cast("long").alias("n"),
                      F.unhex(f"h{LEVELS}").alias("hash"))


def down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes with ``path``, the siblings on their way up. ``above``: ``key, slot, path`` and what else
    is to be handed down, of the next tier."""
    window = blocks(nodes)[1].rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = climbed(nodes).select(*nodes.columns, "block", *[F.last(f"s{k}", ignorenulls=True).over(window).alias(f"s{k}") for k in range(LEVELS)])
    joined = seen.join(above.withColumnsRenamed({"slot": "block", "path": "rest"}), ["key", "block"])
    own = F.filter(F.array(*[f"s{k}" for k in range(LEVELS)]), lambda s: s.isNotNull())
    return joined.withColumn("path", F.concat(own, "rest")).drop("block", "rest", *[f"s{k}" for k in range(LEVELS)])


def tiers(leaves: DataFrame, space: Workspace, name: str) -> list[DataFrame]:
    """The nodes of every tier (``key, slot, n, hash``); in the last every group has one."""
    out = [leaves]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(space.save(up(out[-1].select("key", "slot", "n", "hash")), f"{name}-{len(out)}"))
    return out


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS,
             carried: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, path`` of every row, and the ``carried`` columns (their names must be
    others). ``path`` lists the siblings (``left``, ``right``) of each level that has several nodes, from
    the leaf to the root: see :func:`proof` and :func:`fold`."""
    spark = session(docs.sparkSession)
    space = Workspace(spark, "manifest")
    group = docs[group_col].cast("string")
    rows = docs.select(F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("key"), docs[id_col].alias("doc_id"),
                       F.unhex(leaf(*[docs[f] for f in fields])).alias("hash"), *[c.alias(n) for n, c in (carried or {}).items()])
    leaves = space.save(numbered(rows, ["doc_id", "hash"], space, "leaves"), "leaves")
    space.drop("leaves-placed", "leaves-spans")
    levels = tiers(leaves, space, "tier")

    subroots = levels[-1].select(F.lit("").alias("key"), F.col("key").alias("group"), "hash")
    subroots = space.save(numbered(subroots, ["group"], space, "subroots"), "subroots")
    above = tiers(subroots, space, "top")
    paths = above[-1].select("key", "slot", F.array().cast("array<struct<left: string, right: string>>").alias("path"),
                             text_of(F.col("hash")).alias("root"))
    for number, tier in reversed(list(enumerate(above[:-1]))):
        paths = space.save(down(tier, paths).select("key", "slot", "path", "root", *(["group", "hash"] if number == 0 else [])), f"top-paths-{number}")
    if len(above) == 1:  # a single group: its subroot is the root
        paths = above[0].select("key", "slot", F.array().cast("array<struct<left: string, right: string>>").alias("path"),
                                text_of(F.col("hash")).alias("root"), "group", "hash")
    paths = paths.select(F.col("group").alias("key"), F.lit(0).cast("long").alias("slot"), "path", "root", text_of(F.col("hash")).alias("subroot"))
    for number, tier in reversed(list(enumerate(levels[1:-1], 1))):
        paths = space.save(down(tier, paths).select("key", "slot", "path", "root", "subroot"), f"paths-{number}")
    last = down(leaves, paths) if len(levels) > 1 else leaves.join(paths.drop("slot"), "key")
    return last.select("doc_id", text_of(F.col("hash")).alias("leaf"), "subroot", "root", "path", *(carried or {}))


def proof(path: Column) -> Column:
    """H of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(own_leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, own_leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def verified(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every row, and whether the row, tampered with where 2 divides the crc32 of
    its id (a missing one counts as an empty text), still folds to the root. Tampering takes the line
    breaks out of the text."""
    own = {f: docs[f] for f in FIELDS}
    even = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 2 == 0
    changed = leaf(*(own | {"text": F.replace(docs["text"], F.lit("\n"), F.lit(""))}).values())
    tampered = F.when(even & F.contains(docs["text"], F.lit("\n")), F.unhex(changed))  # else the leaf itself
    found = manifest(docs, carried={"tampered": tampered})
    folded = found.withColumn("folded_root", fold(F.coalesce(text_of(F.col("tampered")), "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
