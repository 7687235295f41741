"""A Merkle manifest of a dataset: one tree of hashes for each language, one tree over their roots.

H is the lowercase hex SHA-256 of its inputs on end, digests as hex text. A level's nodes stand in runs of ``fanout``; each
run becomes its H, the last one with fewer nodes too, even one; the level with a single node is the root.

Leaves are sorted by range over tasks, so each task holds a stretch of known first index of some trees. It pushes leaves on
a stack (a mountain range): when a node is the last of its run and the whole run lies on the stack, the run is carried to
its parent. What stays are the stretch's peaks: a logarithmic number, at both ends also unaligned ones, whose runs lie in
two stretches. Peaks of a block of 2^14 leaves are merged in one group, 2^14 blocks in another, and these of a tree in one
more; short runs are hashed there, without padding. The way up from a peak is sent back to its stretch, where each leaf adds its own
way to the peak. Only peaks and counts are shuffled besides the leaves' digests: no text, and nothing passes the driver.

Nulls: a null field is ``-``; a null doc_id stands first and a null lang's tree too. Rows of equal doc_id stand by their
leaf's digest; repeated rows have one leaf each. An empty table has no rows. Columns other than the five are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._shared import removed, written

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Leaves in a stretch, and leaves whose peaks are merged in one group.
STRETCH, BLOCK = 1 << 16, 1 << 14


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column | None = None) -> Column:
    """The leaf of a row, with another value for n_chars if given."""
    return F.sha2(F.concat(*[_field(n_chars if n_chars is not None and x == "n_chars" else F.col(x)) for x in FIELDS]), 256)


class Range:
    """A stack of peaks over leaves first, first + 1, … of a tree; ``nodes``: level -> index -> digest, all it has seen."""

    def __init__(self, first: int, fanout: int, top: int):
        self.next, self.fanout, self.top = first, fanout, top
        self.stack: list[tuple[int, int, str]] = []
        self.nodes: list[dict[int, str]] = [{} for _ in range(top + 1)]

    def push(self, digest: str) -> None:
        fan, stack, level, index = self.fanout, self.stack, 0, self.next
        self.next += 1
        stack.append((0, index, digest))
        self.nodes[0][index] = digest
        while level < self.top and index % fan == fan - 1 and len(stack) >= fan and stack[-fan][:2] == (level, index - fan + 1):
            digest = _h("".join(x[2] for x in stack[-fan:]))
            del stack[-fan:]
            level, index = level + 1, index // fan
            stack.append((level, index, digest))
            self.nodes[level][index] = digest


def _step(run: list[str], k: int) -> str:
    return "".join(run[:k]) + "|" + "".join(run[k + 1 :])


def fold(digest: str, steps: list[str]) -> str:
    """The root above ``digest``; a step is the digests before it in its run, a bar, and those behind it."""
    for step in steps:
        before, _, after = step.partition("|")
        digest = _h(before + digest + after)
    return digest


def merged(nodes: list[tuple[int, int, str]], low: int, high: int, total: int, fanout: int) -> tuple[str, list[list[str]], list[tuple[int, int, str]]]:
    """From (level, index, digest) of nodes that cover one node of level ``high`` in a tree of ``total`` leaves: its digest,
    each node's steps up to it, and the nodes made. In a lower tree the root stands for the node."""
    levels: list[dict[int, str]] = [{} for _ in range(high + 1)]
    for level, index, digest in nodes:
        levels[level][index] = digest
    up: dict[tuple[int, int], str] = {}
    made = []
    for level in range(low, high):
        width = -(-total // fanout**level)
        if width == 1:
            high = level
            break
        for parent in sorted({index // fanout for index in levels[level]}):
            first = parent * fanout
            run = [levels[level][k] for k in range(first, min(first + fanout, width))]
            for k in range(len(run)):
                up[level, first + k] = _step(run, k)
            levels[level + 1][parent] = _h("".join(run))
            made.append((level + 1, parent, levels[level + 1][parent]))
    (root,) = levels[high].values()
    paths = []
    for level, index, _ in nodes:
        path = []
        while level < high:
            path.append(up[level, index])
            level, index = level + 1, index // fanout
        paths.append(path)
    return root, paths, made


def _ranged(leaves: pa.Table, first: int, fanout: int, top: int) -> tuple[pa.Table, Range]:
    leaves = leaves.sort_by("at")
    range_ = Range(first, fanout, top)
    for digest in leaves["digest"].to_pylist():
        range_.push(digest.hex())
    return leaves, range_


def _peaks(sorted_: DataFrame, counts: DataFrame, fanout: int, top: int) -> DataFrame:
    """pid, k, n, first, level, index, digest of each stretch's peaks."""
    names = ["pid", "k", "n", "first", "level", "index", "digest"]

    def run(leaves: pa.Table, count: pa.Table) -> pa.Table:
        told = count.to_pylist()[0]
        _, range_ = _ranged(leaves, told["first"], fanout, top)
        rows = [(told["pid"], told["k"], told["n"], told["first"], *x) for x in range_.stack]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)

    return sorted_.select("pid", "k", "at", "digest").groupBy("pid", "k").cogroup(counts.groupBy("pid", "k")).applyInArrow(run, "pid long, k string, n long, first long, level int, index long, digest string")


_MADE = "array<struct<level:int,index:long,digest:string>>"
_MADE_ARROW = pa.list_(pa.struct([("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())]))


def _merge(nodes: DataFrame, keys: list[str], low: int, high: int, fanout: int) -> DataFrame:
    """``nodes`` (k, n, level, index, digest and more) with node, the digest above them in their group, steps up to it, and
    made, on one row of a group, the nodes made."""

    def run(group: pa.Table) -> pa.Table:
        at = [(r["level"], r["index"], r["digest"]) for r in group.select(["level", "index", "digest"]).to_pylist()]
        root, paths, made = merged(at, low, high, group["n"][0].as_py(), fanout)
        made = [{"level": a, "index": b, "digest": c} for a, b, c in made]
        group = group.append_column("node", pa.array([root] * len(at), pa.string())).append_column("steps", pa.array(paths, pa.list_(pa.string())))
        return group.append_column("made", pa.array([made] + [[]] * (len(at) - 1), _MADE_ARROW))

    schema = ", ".join(f"`{x}` {t}" for x, t in nodes.dtypes)
    return nodes.groupBy(*keys).applyInArrow(run, f"{schema}, node string, steps array<string>, made {_MADE}")


def _grown(leaves: DataFrame, order: list[str], fanout: int, stretch: int, block: int) -> tuple[DataFrame, DataFrame, list[DataFrame], int]:
    """Sorted leaves with pid and at, their counts, peaks merged in blocks, blocks in blocks of blocks, these in trees, and
    the first blocks' level."""
    top = max(1, math.ceil(math.log(block, fanout) - 1e-9))
    first = written(leaves)
    tasks = max(1, -(-first.count() // stretch))
    keys = ["k", *order]
    row = F.monotonically_increasing_id()
    dealt = first.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys, "digest").withColumn("_row", row)
    sorted_ = written(dealt.withColumns({"pid": F.shiftright("_row", 33), "at": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_row"))
    removed(first)
    of_tree = Window.partitionBy("k")
    before = F.coalesce(F.sum("m").over(of_tree.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(sorted_.groupBy("pid", "k").agg(F.count("*").alias("m")).select("pid", "k", before.alias("first"), F.sum("m").over(of_tree).alias("n")))
    # a peak of the blocks' level is a block; lower ones lie within one
    place = F.expr("index div cast(round(power({}, {} - level)) as bigint)".format(fanout, top))
    rounds = [written(_merge(_peaks(sorted_, counts, fanout, top).withColumn("block", place), ["k", "block"], 0, top, fanout))]
    for low, high in ((top, 2 * top), (2 * top, 64)):
        nodes = rounds[-1].groupBy("k", "block").agg(F.first("n").alias("n"), F.first("node").alias("digest")).withColumns({"level": F.lit(low), "index": F.col("block")})
        above = F.expr(f"index div {fanout**top}") if high < 64 else F.lit(0).cast("long")
        rounds.append(written(_merge(nodes.withColumn("block", above), ["k", "block"], low, high, fanout)))
    return sorted_, counts, rounds, top


def _proved(leaves: DataFrame, order: list[str], above: Callable, each: Callable, schema: str, fanout: int, stretch: int, block: int) -> DataFrame:
    """``each`` of a stretch's leaves (an Arrow table), their steps and the trees' subroot and root.

    ``leaves``: k (the tree), digest (binary), the columns of ``order`` and more. ``above``: from k, subroot of each tree to
    k, rest (steps from there on) and root.
    """
    sorted_, _, rounds, top = _grown(leaves, order, fanout, stretch, block)
    ends = above(rounds[-1].select("k", F.col("node").alias("subroot")).distinct())
    ways = rounds[0].select("pid", "k", "first", "level", "index", "block", "steps")
    for table in rounds[1:]:
        further = table.select("k", F.col("index").alias("block"), F.col("block").alias("next"), F.col("steps").alias("more"), F.col("node").alias("subroot"))
        ways = ways.drop("subroot").join(further, ["k", "block"]).withColumns({"block": F.col("next"), "steps": F.concat("steps", "more")}).drop("next", "more")
    ways = ways.join(ends, "k").withColumn("steps", F.concat("steps", "rest"))
    ways = ways.select("pid", "k", "first", "level", "index", "steps", "subroot", "root")

    def run(own: pa.Table, peaks: pa.Table) -> pa.Table:
        told = peaks.to_pylist()
        first = told[0]["first"]
        own, range_ = _ranged(own, first, fanout, top)
        up = {(r["level"], r["index"]): r["steps"] for r in told}

        def steps(index: int) -> list[str]:
            level, out = 0, []
            while (level, index) not in up:
                start = index - index % fanout
                out.append(_step([range_.nodes[level][k] for k in range(start, start + fanout)], index - start))
                level, index = level + 1, index // fanout
            return out + up[level, index]

        return each(own, (steps(k) for k in range(first, first + own.num_rows)), told[0]["subroot"], told[0]["root"])

    return sorted_.groupBy("pid", "k").cogroup(ways.groupBy("pid", "k")).applyInArrow(run, schema)


def _ways(own: pa.Table, steps: Iterator[list[str]], subroot: str, root: str) -> pa.Table:
    return pa.table([own["name"], pa.array(list(steps), pa.list_(pa.string())), pa.array([subroot] * own.num_rows, pa.string())], names=["k", "rest", "root"])


def _rooted(fanout: int, stretch: int, block: int) -> Callable:
    """From k, subroot of each tree to k, rest, root: the same tree over the subroots, in the order of k."""

    def above(trees: DataFrame) -> DataFrame:
        leaves = trees.select(F.lit("").alias("k"), F.col("k").alias("name"), F.unhex("subroot").alias("digest"))
        last = lambda t: t.select("k", F.array().cast("array<string>").alias("rest"), F.col("subroot").alias("root"))
        return written(_proved(leaves, ["name"], last, _ways, "k string, rest array<string>, root string", fanout, stretch, block))

    return above


def _leaves(documents: DataFrame, *more: Column) -> DataFrame:
    """k sorts as lang does, null first: languages by their UTF-8 bytes."""
    k = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    return documents.select(k.alias("k"), "doc_id", F.unhex(leaf()).alias("digest"), *more)


def manifest(documents: DataFrame, tampered: Column | None = None, fanout: int = 2, stretch: int = STRETCH, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot (of the language's tree), root, proof_sha256 (H of the leaf's siblings on its way to the root,
    level by level, each from left to right), folded_root and verified: whether that equals root.

    ``tampered``: a leaf of the row as found now, null where it is as it was; the fold begins with it.
    """
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    now = F.unhex(tampered) if tampered is not None else F.lit(None).cast("binary")

    def each(own: pa.Table, steps: Iterator[list[str]], subroot: str, root: str) -> pa.Table:
        leaves = [x.hex() for x in own["digest"].to_pylist()]
        found = [was if x is None else x.hex() for was, x in zip(leaves, own["now"].to_pylist(), strict=True)]
        proofs, folds = [], []
        for digest, way in zip(found, steps, strict=True):
            proofs.append(_h("".join(way).replace("|", "")))
            folds.append(fold(digest, way))
        n = len(leaves)
        columns = [pa.array(x, pa.string()) for x in (leaves, [subroot] * n, [root] * n, proofs, folds)]
        return pa.table([own["doc_id"], *columns, pa.array([x == root for x in folds], pa.bool_())], names=names)

    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _proved(_leaves(documents, now.alias("now")), ["doc_id"], _rooted(fanout, stretch, block), each, schema, fanout, stretch, block)


def nodes(documents: DataFrame, fanout: int = 2, stretch: int = STRETCH, block: int = BLOCK) -> DataFrame:
    """lang, level, index, digest of every node of the languages' trees; the leaves are level 0."""
    sorted_, counts, rounds, top = _grown(_leaves(documents), ["doc_id"], fanout, stretch, block)

    def run(leaves: pa.Table, count: pa.Table) -> pa.Table:
        told = count.to_pylist()[0]
        _, range_ = _ranged(leaves, told["first"], fanout, top)
        rows = [(told["k"], level, index, digest) for level, x in enumerate(range_.nodes) for index, digest in x.items()]
        types = [pa.string(), pa.int32(), pa.int64(), pa.string()]
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["k", "level", "index", "digest"])

    own = sorted_.select("pid", "k", "at", "digest").groupBy("pid", "k").cogroup(counts.groupBy("pid", "k")).applyInArrow(run, "k string, level int, index long, digest string")
    for table in rounds:
        own = own.unionByName(table.select("k", F.inline("made")))
    lang = F.when(F.col("k") != "0", F.substring("k", 2, 1 << 30))
    return own.select(lang.alias("lang"), "level", "index", "digest")
