"""Merkle manifest of a dataset, on concatenated level strings.

Leaves are numbered within their group in one order. Each aligned block of BLOCK = 8 ** LEVELS leaves keeps a level of its
tree as one string of hex digests: fixed-width substrings of it, RUN digests long, hash to the next level's string, and
what flanks a node within its substring are its siblings. A block's last node is a leaf of the next round, where again
BLOCK of them make a block, until one node a group is left; the groups' roots go through the same rounds.

All of it is SQL functions over bounded rows: a block holds 512 leaves at most, whatever a group's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom.llm.common import stash

#: Nodes that are hashed together, levels that a block climbs, and the width of a hex digest.
RUN, LEVELS, WIDE = 8, 3, 64
BLOCK = RUN**LEVELS
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts, one after another; digests enter as hex text."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def framed(value: Column) -> Column:
    """A field as its UTF-8 byte count, a colon and its value; "-" if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return digest(*map(framed, values))


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``pos``: each row's place within its ``part``, from 0, in the order of the given columns; ``n``: rows of its part.

    Rows are range-sorted, the tasks' counts are added up, and no part has to fit one task: equal rows are told apart by
    where they were first written. The counts are at most one row a task and part.
    """
    named = stash(rows.withColumn("_row", F.monotonically_increasing_id()), f"{label}-rows")
    keys = [F.col("part"), *(F.col(c).asc_nulls_first() for c in order), F.col("_row")]
    ranged = named.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = stash(ranged.withColumn("_row", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_row", 33)), f"{label}-sorted")
    counts = ranged.groupBy("part", "_task").agg(F.count("*").alias("_many"), F.min("_row").alias("_first"))
    whole = Window.partitionBy("part")
    before = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "_task", (F.coalesce(F.sum("_many").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_many").over(whole).alias("n"))
    return ranged.join(offsets, ["part", "_task"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_row", "_task", "_shift")


def piece(level: Column, start: Column, nodes: Column | int = RUN) -> Column:
    """``nodes`` digests of a level's string, from number ``start`` on. Levels are binary, so that a substring costs its own length only."""
    return F.substring(level, start * WIDE + 1, (F.lit(nodes) if isinstance(nodes, int) else nodes) * WIDE)


def above(level: Column) -> Column:
    """The next level's string: a digest of each aligned substring of RUN digests, the last may be shorter."""
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) / WIDE - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: digest(piece(level, i * RUN))), "").cast("binary")


def grown(blocks: DataFrame) -> DataFrame:
    """Level strings l0 .. l3 of each block; a level that the part doesn't have is the one below. A part of several blocks has them all."""
    for k in range(LEVELS):
        blocks = blocks.withColumn(f"l{k + 1}", F.when(F.col("n") > RUN**k, above(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return blocks


def flanks(place: Column) -> Column:
    """What stands left and right of a node in its run, level by level, for a place within a block."""
    out, at = [], place
    for k in range(LEVELS):
        run = at - F.pmod(at, F.lit(RUN))
        own = F.struct(
            piece(F.col(f"l{k}"), run, at - run).cast("string").alias("left"),
            piece(F.col(f"l{k}"), at + 1, run + RUN - 1 - at).cast("string").alias("right"),
        )
        out.append(F.when(F.col("n") > RUN**k, own))
        at = F.floor(at / RUN).cast("int")
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def blocks_of(nodes: DataFrame) -> DataFrame:
    """Blocks of numbered nodes: their level strings, and ``held``, the nodes' structs in order."""
    key = [F.col("part"), F.floor(F.col("pos") / BLOCK).alias("block")]
    held = nodes.groupBy(*key).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node", "held"))).alias("held"))
    return grown(held.withColumn("l0", F.array_join(F.col("held.node"), "").cast("binary")))


def climb(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The blocks of numbered nodes (part, pos, n, node, held), and of the nodes above them, up to one block a part; each table has BLOCK times fewer rows than the one before."""
    most, made = nodes.agg(F.max("n")).first()[0] or 0, []
    while not made or most > 1:
        made.append(stash(blocks_of(nodes), f"{label}-blocks"))
        most = -(-most // BLOCK)
        nodes = made[-1].select("part", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col(f"l{LEVELS}").cast("string").alias("node"), F.lit(None).cast("int").alias("held"))
    return made


def roots_of(blocks: DataFrame) -> DataFrame:
    return blocks.select("part", F.col(f"l{LEVELS}").cast("string").alias("root"))


def descend(levels: list[DataFrame], above_all: DataFrame) -> DataFrame:
    """(pos, node, held, proof) and the columns of ``above_all`` (part, and ``rest``, the proof of its root): proofs go down from block to node, by keys that hold BLOCK rows at most."""
    found = above_all.withColumn("block", F.lit(0).cast("long"))
    own = [c for c in found.columns if c not in ("part", "block", "rest")]
    for blocks in reversed(levels):
        each = blocks.join(found, ["part", "block"]).select("*", F.posexplode("held").alias("place", "one"))
        found = each.select("part", F.col("one.pos").alias("block"), *own, F.concat(flanks(F.col("place")), "rest").alias("rest"), F.col("one.node").alias("node"), F.col("one.held").alias("held"))
        if blocks is not levels[0]:
            found = found.drop("node", "held")
    return found.select(*own, F.col("block").alias("pos"), "node", "held", F.col("rest").alias("proof"))


def merkle_manifest(rows: DataFrame, group: str, order: list[str], leaf: str, keep: list[str]) -> DataFrame:
    """``keep``'s columns, leaf, subroot, root, and ``proof``: an array of (left, right), a node's siblings in its run, from the leaf's level through the group's root to the root.

    ``group`` names the column by whose values trees are made (cast to text; null first, then bytewise), ``order`` the
    columns by which leaves ascend (null first), ``leaf`` the column of their digests. Rows equal in ``order`` ascend by
    digest; rows equal in both are interchangeable and each is a leaf of its own. Without rows there is no row. A group
    of one leaf has that leaf as its root and no level; a single group's root is the root.
    Columns of other names aren't read.
    """
    part = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    named = rows.select(part.alias("part"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(order)), F.col(leaf).alias("node"), F.struct(*(F.col(c) for c in keep)).alias("held"))
    leaves = climb(numbered(named, [*(f"_by{i}" for i in range(len(order))), "node"], "leaves"), "leaves")
    subroots = roots_of(leaves[-1]).select(F.lit("").alias("part"), F.col("part").alias("held"), F.col("root").alias("node"))
    groups = climb(numbered(subroots, ["held"], "groups"), "groups")
    none = F.array().cast("array<struct<left string, right string>>")
    tops = descend(groups, roots_of(groups[-1]).withColumn("rest", none))
    found = descend(leaves, tops.select(F.col("held").alias("part"), F.col("node").alias("subroot"), "root", F.col("proof").alias("rest")))
    return found.select("held.*", F.col("node").alias("leaf"), "subroot", "root", "proof")


def siblings(proof: Column) -> Column:
    """All digests of a proof in one text: level by level, left to right."""
    return F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root to which a leaf and a proof lead."""
    return F.aggregate(proof, leaf, lambda node, x: digest(x["left"], node, x["right"]))


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of documents, a tree for each lang.

    A leaf is the digest of doc_id, source, lang, n_chars and text; null fields are "-", an empty text is "0:". Every
    row is a leaf, repeated rows too; null doc_ids come first. For rows where 3 divides crc32(doc_id), folded_root starts from a text whose A-Z are lower-cased, so
    it differs where the text has any; a null doc_id has no such remainder. Long texts only enter their own digest.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    rows = docs.select("doc_id", "lang", row_digest(*fields, F.col("text")).alias("leaf"), F.when(hit, row_digest(*fields, F.translate("text", LETTERS, LETTERS.lower()))).alias("changed"))
    made = merkle_manifest(rows, "lang", ["doc_id"], "leaf", ["doc_id", "changed"])
    out = made.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
