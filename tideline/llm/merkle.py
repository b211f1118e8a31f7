"""A manifest of a dataset: hash trees whose blocks are collapsed by higher-order functions.

Leaves of one group get their numbers by one range sort of (group, order): a row's number is
its place in its partition plus what stands in the partitions before, a sum of one row for
each partition and group.  A block is an array of up to ``FAN ** LEVELS`` neighbouring nodes; ``sequence``,
``transform``, ``slice`` and ``aggregate`` collapse it level by level inside one row.  Roots of
blocks are the nodes of the next round, until each group has one node.  So a group of
any size is many blocks, and the rounds are few.

Going back down, each block is given what stands beside its root above, so that every
leaf gets its proof: for each level the digests left and right of its own.

Digests are lower-case hexadecimal SHA-256 of texts.  Defined cases: null fields are ``-``; a null
group is a group; rows sort by doc_id, null first, then by leaf, and equal rows stand in any order,
which changes no digest; a group of one leaf has it as its root; texts are hashed whole; extra columns
are left out, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import settle

#: Nodes under one parent, and levels that a block collapses at once.
FAN, LEVELS = 3, 5
BLOCK = FAN**LEVELS
PROOF = "array<struct<l:string,r:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of some fields, each as its UTF-8 bytes' count, ``:`` and itself, or ``-`` if null."""
    part = lambda f: F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-"))
    return digest(F.concat(*map(part, fields)))


def fold(node: Column, proof: Column) -> Column:
    """The root that a node and what stands beside it, level by level, lead to."""
    return F.aggregate(proof, node, lambda at, p: digest(F.concat(p["l"], at, p["r"])))


def proof_text(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["l"], p["r"])), "")


def numbered(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds pos: each row's number, from 0, in its group; nodes must stay the same when read again."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_id", F.monotonically_increasing_id())
    dealt = settle(dealt, "numbered").withColumn("_p", F.shiftright("_id", 33))
    # a row for each partition and group, not for each node
    parts = dealt.groupBy("_p", group).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return dealt.join(parts, ["_p", group]).withColumn("pos", F.col("_before") + F.col("_id") - F.col("_first")).drop("_p", "_id", "_first", "_n", "_before")


def _collapse(nodes: Column, levels: Column) -> Column:
    """array<array<string>>: a block's nodes, level by level, from themselves to their root."""

    def up(all_: Column, _: Column) -> Column:
        last = F.element_at(all_, -1)
        runs = F.sequence(F.lit(1), F.size(last), F.lit(FAN))
        return F.concat(all_, F.array(F.transform(runs, lambda at: digest(F.array_join(F.slice(last, at, FAN), "")))))

    return F.when(levels > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), F.array(nodes), up)).otherwise(F.array(nodes))


def _beside(levels: Column, depth: Column, at: Column) -> Column:
    """The proof of a block's node number ``at`` (from 0) up to the block's root."""

    def one(k: Column) -> Column:
        row = F.get(levels, k)
        here = F.floor(at / F.pow(F.lit(float(FAN)), k.cast("double"))).cast("int")
        run = here - F.pmod(here, F.lit(FAN)) + 1
        return F.struct(F.array_join(F.slice(row, run, here + 1 - run), "").alias("l"), F.array_join(F.slice(row, here + 2, run + FAN - here - 2), "").alias("r"))

    return F.when(depth > 0, F.transform(F.sequence(F.lit(0), F.greatest(depth, F.lit(1)) - 1), one)).otherwise(F.array().cast(PROOF))


def collapse(nodes: DataFrame, group: str = "grp") -> tuple[list[DataFrame], DataFrame]:
    """(rounds, roots) of nodes (group, pos, node, ..): the blocks of each round, the first with the nodes' other columns
    in ``items``, and (group, root)."""
    rounds = []
    while True:
        others = [c for c in nodes.columns if c not in (group, "pos", "node")]
        blocks = nodes.groupBy(group, F.floor(F.col("pos") / BLOCK).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "node", *others))).alias("items"))
        # only a group of one block may end before LEVELS
        own = sum(((F.size("items") > FAN**k).cast("int") for k in range(LEVELS)), F.lit(0))
        blocks = blocks.withColumn("depth", F.when(F.col("block") == 0, own).otherwise(LEVELS))
        blocks = blocks.withColumn("levels", _collapse(F.col("items.node"), F.col("depth"))).withColumn("root", F.element_at(F.element_at("levels", -1), 1))
        items = F.transform("items", lambda x: F.struct(*(x[c].alias(c) for c in others))) if others else F.col("items.pos")
        rounds.append(settle(blocks.select(group, "block", "depth", "levels", items.alias("items"), "root"), "blocks"))
        nodes = rounds[-1].select(group, F.col("block").alias("pos"), F.col("root").alias("node"))
        if not nodes.where("pos > 0").limit(1).count():
            return rounds, nodes.select(group, F.col("node").alias("root"))


def proofs(rounds: list[DataFrame], above: DataFrame, group: str = "grp") -> DataFrame:
    """(group, pos, node, item, apex, proof) of the first round's nodes.  ``above`` (group, apex, proof): the root of each
    group and what stands beside it further up."""
    at = above.withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        x = blocks.join(at.withColumnsRenamed({"pos": "block", "proof": "up"}), [group, "block"])
        x = x.select(group, "block", "depth", "levels", "apex", "up", F.posexplode(F.arrays_zip(F.get("levels", F.lit(0)).alias("node"), F.col("items").alias("item"))).alias("i", "e"))
        beside = F.concat(_beside(F.col("levels"), F.col("depth"), F.col("i")), F.col("up"))
        at = x.select(group, (F.col("block") * BLOCK + F.col("i")).alias("pos"), F.col("e.node").alias("node"), F.col("e.item").alias("item"), "apex", beside.alias("proof"))
        if blocks is not rounds[0]:
            at = at.drop("node", "item")
    return at


def manifest(docs: DataFrame, group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), other: Column | None = None) -> DataFrame:
    """(doc_id, leaf, other, subroot, root, proof): each row's leaf in the tree of its group, in the order of doc_id; the
    groups' roots are the leaves of one tree more, in the order of group with null first.  ``other``: a text
    in place of the text, whose leaf comes along (null where it is the same or null)."""
    # 0 sorts before 1: the null group first, the others by their bytes
    grp = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    changed = F.lit(None).cast("string") if other is None else F.when(other != F.col("text").cast("string"), other)
    again = F.when(changed.isNotNull(), leaf(*(changed if f == "text" else F.col(f) for f in fields)))
    leaves = settle(docs.select("doc_id", grp.alias("grp"), leaf(*map(F.col, fields)).alias("node"), again.alias("other")), "leaves")
    rounds, roots = collapse(numbered(leaves, "grp", ["doc_id", "node"]))
    tops, top = collapse(numbered(settle(roots.select(F.lit("").alias("all"), "grp", F.col("root").alias("node")), "roots"), "all", ["grp"]), "all")
    above = proofs(tops, top.select("all", F.col("root").alias("apex"), F.array().cast(PROOF).alias("proof")), "all")
    above = above.select(F.col("item.grp").alias("grp"), F.struct(F.col("node").alias("subroot"), F.col("apex").alias("root")).alias("apex"), "proof")
    x = proofs(rounds, above)
    return x.select("item.doc_id", F.col("node").alias("leaf"), "item.other", "apex.subroot", "apex.root", "proof")
