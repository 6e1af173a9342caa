"""A Merkle manifest of a table by slot pivots.

Leaves of a group stand in the order of their key, and every ``fanout`` consecutive nodes become their parent. A block holds the descendants
of one node ``LEVELS`` levels down: conditional aggregates spread them into ``fanout ** LEVELS`` slot columns of one row, and the block's inner
nodes come from concatenating neighbouring columns. So a tree over n leaves takes one grouping for every ``LEVELS`` levels, on rows that
shrink by the number of slots each time. On the way down each block gives each of its slots the siblings in the block (the run's
columns without the slot's own) in front of the siblings that the block itself was given; only digests of blocks and
their paths are joined, never leaves with each other. Group roots are the leaves of one more tree of the same kind.

Every stage is a written table, so a lost executor costs a re-read. No group is ever in one task: positions come from
range-dealt counting, blocks are bounded.

Defined cases: null fields count as ``-``; a group of null is a group of its own and stands first; rows without an order key stand
first in their group; rows with the same key are ordered by their leaf digest, and equal ones are interchangeable; a lone leaf is its group's
root, and a lone group's root the root; an empty table has no rows and no root. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.ordered import numbered
from winnow.session import materialise

LEVELS = 4


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """One field of a leaf: bytes, a colon and the value, or ``-``."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _inner(blocks: DataFrame, fanout: int) -> DataFrame:
    """Adds ``_level0`` to ``_level<LEVELS>`` (arrays of the block's nodes), ``_up`` (levels until the group is one node) and ``_top``."""
    slots, kept = fanout**LEVELS, blocks.columns
    out = blocks.selectExpr(*kept, *[f"_s{k}.digest AS _d0_{k}" for k in range(slots)])
    columns = [[f"_d0_{k}" for k in range(slots)]]
    for level in range(1, LEVELS + 1):
        below = columns[-1]
        runs = [below[k:k + fanout] for k in range(0, len(below), fanout)]
        columns.append([f"_d{level}_{k}" for k in range(len(runs))])
        whole = [", ".join([run[0], *[f"coalesce({c}, '')" for c in run[1:]]]) for run in runs]
        made = [f"CASE WHEN {run[0]} IS NOT NULL THEN sha2(concat({text}), 256) END AS {name}" for run, text, name in zip(runs, whole, columns[-1])]
        out = out.selectExpr("*", *made)
    up = " + ".join(f"CASE WHEN _n > {fanout**level} THEN 1 ELSE 0 END" for level in range(LEVELS))
    levels = [f"array({', '.join(names)}) AS _level{level}" for level, names in enumerate(columns)]
    out = out.selectExpr(*kept, *levels, f"{up} AS _up", f"array({', '.join(names[0] for names in columns)}) AS _tops")
    return out.withColumn("_top", F.get("_tops", F.col("_up"))).drop("_tops")


def _siblings(slot: Column, fanout: int) -> Column:
    """For each level that is climbed: what stands left and right of the slot's ancestor in its run."""
    steps = []
    for level in range(LEVELS):
        own = F.floor(slot / fanout**level).cast("int")
        place = own % fanout
        nodes = F.col(f"_level{level}")
        left, right = F.slice(nodes, own - place + 1, place), F.slice(nodes, own + 2, fanout - 1 - place)
        steps.append(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
    return F.slice(F.array(*steps), F.lit(1), F.col("_up"))


class _Tree:
    """Blocks of all stages over nodes (_g, _at, _n, _node): _node is a struct whose first field is the digest."""

    def __init__(self, nodes: DataFrame, fanout: int, label: str):
        self.fanout, self.slots, self.label = fanout, fanout**LEVELS, label
        self.stages: list[DataFrame] = []
        left = nodes.agg(F.max("_n")).first()[0] or 0
        while True:
            nodes = self._stage(nodes)
            left = -(-left // self.slots)
            if left <= 1:
                break
        self.roots = nodes.select("_g", F.col("_node.digest").alias("digest"))

    def _stage(self, nodes: DataFrame) -> DataFrame:
        spread = [F.expr(f"max(CASE WHEN _at % {self.slots} = {k} THEN _node END) AS _s{k}") for k in range(self.slots)]
        blocks = nodes.groupBy("_g", F.expr(f"_at div {self.slots}").alias("_b")).agg(F.first("_n").alias("_n"), *spread)
        blocks = materialise(_inner(blocks, self.fanout), self.label)
        self.stages.append(blocks)
        fewer = F.when(F.col("_n") > self.slots, F.ceil(F.col("_n") / self.slots).cast("long")).otherwise(F.lit(1))
        return blocks.select("_g", F.col("_b").alias("_at"), fewer.alias("_n"), F.struct(F.col("_top").alias("digest")).alias("_node"))

    def paths(self, above: DataFrame) -> DataFrame:
        """(_node, _path, more): every leaf with its siblings up to what ``above`` (_g, _path, more) adds for its group."""
        more = [c for c in above.columns if c not in ("_g", "_path")]
        held = above.withColumn("_b", F.lit(0).cast("long"))
        for blocks in reversed(self.stages):
            cells = blocks.select("_g", "_b", "_up", *[f"_level{k}" for k in range(LEVELS)], F.posexplode(F.array(*[f"_s{k}" for k in range(self.slots)])).alias("_slot", "_node"))
            each = cells.where("_node IS NOT NULL").withColumn("_own", _siblings(F.col("_slot"), self.fanout)).select("_g", "_b", "_slot", "_node", "_own")
            each = each.join(held, ["_g", "_b"])
            slot = (F.col("_b") * self.slots + F.col("_slot")).alias("_b")
            held = each.select("_g", slot, "_node", F.concat("_own", "_path").alias("_path"), *more)
            if blocks is not self.stages[0]:
                held = held.drop("_node")
        return held.select("_node", "_path", *more)


def manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id",
    altered: dict[str, Column] | None = None, fanout: int = 2,
) -> DataFrame:
    """Per row: the order key, leaf, altered_leaf, subroot, root, path (left and right siblings, from the leaf up to the root).

    ``altered`` gives other values of some fields, for which ``altered_leaf`` is made; without it that is the leaf.
    """
    other = altered or {}
    leaf = digest(*[field(F.col(f)) for f in fields])
    changed = digest(*[field(other.get(f, F.col(f))) for f in fields]) if other else leaf
    name = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = docs.select(name.alias("_g"), F.col(order).alias("_key"), leaf.alias("_leaf"), changed.alias("_altered"))
    placed = numbered(materialise(leaves, "leaves"), "_g", ["_key", "_leaf"], "leaves")
    node = F.struct(F.col("_leaf").alias("digest"), F.col("_key").alias("key"), F.col("_altered").alias("altered"))
    tree = _Tree(placed.select("_g", "_at", "_n", node.alias("_node")), fanout, "blocks")

    subroots = numbered(tree.roots.select(F.lit("").alias("_all"), F.col("_g").alias("_name"), "digest"), "_all", ["_name"], "subroots")
    named = F.struct("digest", F.col("_name").alias("name"))
    crown = _Tree(subroots.select(F.col("_all").alias("_g"), "_at", "_n", named.alias("_node")), fanout, "crown")
    root = crown.roots.first()  # one row, none for an empty table
    start = crown.roots.select("_g", F.array().cast("array<struct<left:string,right:string>>").alias("_path"))
    above = crown.paths(start).select(F.col("_node.name").alias("_g"), "_path", F.col("_node.digest").alias("subroot"))
    return tree.paths(materialise(above, "groups")).select(
        F.col("_node.key").alias(order), F.col("_node.digest").alias("leaf"), F.col("_node.altered").alias("altered_leaf"), "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"), F.col("_path").alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda below, run: digest(run["left"], below, run["right"]))


def proof_digest(path: Column) -> Column:
    """H of all siblings on the way, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), ""), 256)


def tampering_found(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against a copy in which ``n_chars`` is one more where 7 divides crc32 of the id.

    Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Documents without id are never tampered with.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.when(hit, F.try_add(F.col("n_chars").cast("long"), F.lit(1))).otherwise(F.col("n_chars").cast("long"))
    made = manifest(docs, altered={"n_chars": more}).withColumn("folded_root", folded(F.col("altered_leaf"), F.col("path")))
    return made.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
