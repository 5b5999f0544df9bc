"""Near-duplicate embeddings by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from syllabix.functions.joins import lookup_join
from syllabix.llm.blocks import map_block_pairs
from syllabix.llm.common import spread_rows
from syllabix.llm.components import components, spanning_edges
from syllabix.llm.cover_tree import CoverTree, close_pairs
from syllabix.session import pin, ship_package

# Vectors of a block; a task compares two of them. Labels of more vectors get a tree.
BLOCK_ROWS = 4_096
# Children of a node, vectors drawn for each of them, vectors from which a node is split, and levels below the root.
FAN, DRAWN, LEAF_ROWS, LEVELS = 64, 4, 512, 4
# Centres of all trees together: a proven bound for what all tasks get. Larger tables keep larger leaves.
MAX_CENTRES = 16_384
# Nodes of a smaller radius are not split: the threshold distance is about as large. Where at least half of a
# node's children are that small, the others are split whatever their number of vectors.
FINEST = 0.25


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Tree:
    """The upper levels of all labels' cover trees: nodes by number, their centres, and their children."""

    roots: dict[str, int] = field(default_factory=dict)
    centre: list[np.ndarray | None] = field(default_factory=list)
    children: dict[int, list[int]] = field(default_factory=dict)

    def add(self, centre: np.ndarray | None) -> int:
        self.centre.append(centre)
        return len(self.centre) - 1

    def split(self, node: int, centres: np.ndarray) -> None:
        self.children[node] = [self.add(c) for c in centres]

    def descend(self, node: int, points: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Which of the points pass each node below ``node``, and their distances from its centre; to the nearest child each time."""
        stack = [(node, np.arange(len(points)))]
        while stack:
            at, mine = stack.pop()
            below = self.children.get(at)
            if not below or not len(mine):
                continue
            centres = np.stack([self.centre[c] for c in below])
            nearest = (points[mine] @ centres.T).argmax(axis=1)
            for k in np.unique(nearest).tolist():
                own = mine[nearest == k]
                yield own, below[k], np.linalg.norm(points[own] - centres[k], axis=1)
                stack.append((below[k], own))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    names = np.array(batch.column("group").to_pylist(), object)
    for name in set(names.tolist()):
        yield name, np.flatnonzero(names == name)


def _map(rows: DataFrame, function, schema: str) -> DataFrame:
    """``function(batch)`` on Arrow batches, a dict of arrays each."""
    ship_package(rows.sparkSession)
    target = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return rows.mapInArrow(run, schema)


def _passed(batch: pa.RecordBatch, tree: Tree) -> dict[str, np.ndarray]:
    """Per node, how many of the batch's vectors pass it and how far away the farthest is."""
    found: dict[int, tuple[int, float]] = {}
    for name, at in _groups(batch):
        points = unit(matrix(batch.column("vector").take(pa.array(at))))
        found[tree.roots[name]] = (len(at), 2.0)
        for own, node, distance in tree.descend(tree.roots[name], points):
            found[node] = (len(own), float(distance.max()))
    return {"node": list(found), "n": [n for n, _ in found.values()], "radius": [r for _, r in found.values()]}


def _leaves(batch: pa.RecordBatch, tree: Tree) -> np.ndarray:
    leaf = np.zeros(batch.num_rows, np.int64)
    for name, at in _groups(batch):
        leaf[at] = tree.roots[name]
        for own, node, _ in tree.descend(tree.roots[name], unit(matrix(batch.column("vector").take(pa.array(at))))):
            leaf[at[own]] = node
    return leaf


def _drawn(batch: pa.RecordBatch, tree: Tree, rate: dict[int, float]) -> dict[str, object]:
    """Vectors that become centres of their leaf's children, by the hash of their identifiers."""
    leaf = _leaves(batch, tree)
    share = (batch.column("ticket").to_numpy().astype(np.uint64) >> np.uint64(11)) / float(1 << 53)
    chosen = np.flatnonzero(share < np.array([rate.get(int(v), 0.0) for v in leaf]))
    return {"node": leaf[chosen], "item": batch.column("item").to_numpy()[chosen], "vector": batch.column("vector").take(pa.array(chosen))}


def separated(points: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Up to ``most`` of the points, the farthest from those before first, while they are more than ``apart`` from all before."""
    order, near = [0], np.linalg.norm(points - points[0], axis=1)
    while len(order) < most and near.max() > apart:
        order.append(int(near.argmax()))
        np.minimum(near, np.linalg.norm(points - points[order[-1]], axis=1), out=near)
    return points[order]


def _wide(tree: Tree, stats: dict[int, tuple[int, float]], leaf_rows: int) -> list[int]:
    """Leaves to split: those of many vectors, and those left wide where their siblings are small; the largest first."""
    parent = {c: v for v, below in tree.children.items() for c in below}

    def clustered(v: int) -> bool:
        radii = [stats[c][1] for c in tree.children.get(parent.get(v, -1), []) if c in stats]
        return 2 * sum(r <= FINEST for r in radii) >= max(1, len(radii))

    found = [v for v, (n, radius) in stats.items() if v not in tree.children and n > 1 and radius > FINEST and (n > leaf_rows or clustered(v))]
    return sorted(found, key=lambda v: (-stats[v][0], v))


def _node_stats(rows: DataFrame, shared: Broadcast) -> dict[int, tuple[int, float]]:
    passed = _map(rows.select("group", "vector"), lambda batch: _passed(batch, shared.value), "node bigint, n bigint, radius double")
    found = passed.groupBy("node").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()  # at most all nodes
    return {r["node"]: (r["n"], r["radius"]) for r in found}


def grow(rows: DataFrame, groups: list[str], levels: int, fan: int, leaf_rows: int) -> tuple[Tree, dict[int, tuple[int, float]]]:
    """Trees of the given groups, and the number of vectors and the exact covering radius of every node.

    Level by level, wide leaves get up to ``fan`` children. Their centres are vectors drawn from all
    of the leaf's, ``DRAWN`` times as many, kept while they are more than half the leaf's radius apart; every vector goes to the
    nearest. The largest leaves come first and there are ``MAX_CENTRES`` in all. Only drawn vectors, counts and radii reach the driver.
    """
    context = rows.sparkSession.sparkContext
    tree = Tree()
    for name in groups:
        tree.roots[name] = tree.add(None)
    stats = _node_stats(rows, context.broadcast(tree))
    kind = rows.schema["vector"].dataType.simpleString()
    for _ in range(levels):
        room = (MAX_CENTRES + len(groups) - len(tree.centre)) // fan
        wide = _wide(tree, stats, leaf_rows)[: max(0, room)]
        if not wide:
            break
        rate, shared = {v: DRAWN * fan / stats[v][0] for v in wide}, context.broadcast(tree)
        ticketed = rows.withColumn("ticket", F.xxhash64("item", F.lit(len(tree.centre))))
        drawn = _map(
            ticketed.select("group", "item", "ticket", "vector"), lambda batch: _drawn(batch, shared.value, rate),
            f"node bigint, item bigint, vector {kind}").toArrow().combine_chunks()
        node, item = drawn.column("node").to_numpy(), drawn.column("item").to_numpy()
        for v in np.unique(node).tolist():
            at = np.flatnonzero(node == v)
            at = at[np.argsort(item[at])][: 2 * DRAWN * fan]
            points = unit(matrix(drawn.column("vector").take(pa.array(at)).combine_chunks()))
            tree.split(v, separated(points, fan, stats[v][1] / 2))
        stats = _node_stats(rows, context.broadcast(tree))
    return tree, stats


def leaf_pairs(tree: Tree, stats: dict[int, tuple[int, float]], first: int, second: int, reach: float) -> Iterator[tuple[int, int]]:
    """Leaves below two nodes that may hold vectors within ``reach`` of each other.

    Both subtrees are descended together; a pair of nodes stays only if its centres are no farther
    apart than both covering radii and ``reach``. A pair is named once.
    """
    stack = [(first, second)]
    while stack:
        a, b = stack.pop()
        below, beside = tree.children.get(a, [a]), tree.children.get(b, [b])
        below, beside = [c for c in below if c in stats], [c for c in beside if c in stats]
        if below == [a] and beside == [b]:
            yield a, b
            continue
        if not below or not beside:
            continue
        x, y = ([tree.centre[c] for c in side] for side in (below, beside))
        if x[0] is None or y[0] is None:
            near = np.ones((len(below), len(beside)), bool)
        else:
            radius = [np.array([stats[c][1] for c in side]) for side in (below, beside)]
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * np.stack(x) @ np.stack(y).T))
            near = apart <= radius[0][:, None] + radius[1][None, :] + reach
        if a == b:
            near &= np.triu(np.ones_like(near))
        stack += [(below[i], beside[j]) for i, j in np.argwhere(near).tolist()]


def _block_table(tree: Tree, stats: dict[int, tuple[int, float]], name: str, block_rows: int) -> dict[int, tuple[int, int]]:
    """First block and number of blocks of every leaf of a group: neighbours in the tree share a block, a large leaf has several."""
    out: dict[int, tuple[int, int]] = {}
    block, free = -1, 0
    stack = [tree.roots[name]]
    while stack:
        node = stack.pop()
        below = [c for c in tree.children.get(node, []) if c in stats]
        if below:
            stack += below[::-1]
            continue
        n = stats[node][0]
        if n > block_rows:
            parts = -(-n // block_rows)
            out[node], block, free = (block + 1, parts), block + parts, 0
            continue
        if n > free:
            block, free = block + 1, block_rows
        out[node] = (block, 1)
        free -= n
    return out


def links(part: pa.Table, cosine: float) -> dict[str, list]:
    """Of one block pair: the weight each vector is linked with, and a forest over the links."""
    side = part.column("_side").to_numpy()
    first, second = part.column("_i")[0].as_py(), part.column("_j")[0].as_py()
    points = unit(matrix(part.column("vector").combine_chunks()))
    a = np.flatnonzero(side == first)
    tree = CoverTree(points[a], finest=0.05)
    if first == second:
        x, y = close_pairs(tree, tree, cosine)
        different = x != y
        x, y = a[x[different]], a[y[different]]
    else:
        b = np.flatnonzero(side == second)
        if not len(a) or not len(b):
            return {}
        x, y = close_pairs(tree, CoverTree(points[b], finest=0.05), cosine)
        x, y = np.concatenate([a[x], b[y]]), np.concatenate([b[y], a[x]])
    weight, items = part.column("weight").to_numpy(), part.column("item").to_pylist()
    linked = np.bincount(x, weight[y], part.num_rows).astype(np.int64)
    rows = np.flatnonzero(linked).tolist()
    once = x < y
    p, q = spanning_edges(x[once], y[once], part.num_rows)
    return {
        "item": [items[i] for i in rows] + [items[i] for i in p],
        "links": linked[rows].tolist() + [0] * len(p),
        "other": [None] * len(rows) + [items[i] for i in q],
    }


def embedding_dedup(
    vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Vectors linked by cosine within their label: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Equal vectors of a label form a class, compared once and counted as often as they
    occur. A label of more than ``block_rows`` classes gets a cover tree over the table (see ``grow``):
    nested levels of centres with exact covering radii. Pairs of nodes are descended together and pruned
    by these radii; leaves are gathered into blocks, vectors meet only in the surviving pairs of
    blocks, and inside one a task descends the cover trees of both blocks. It returns
    sums and at most one edge per vector, so a dense group is not expanded into pairs.
    Results are exact. Where no radius bound prunes (vectors spread evenly in many
    dimensions) a vector meets every block of its label.

    Vectors that are null, without components, zero or hold null or non-finite
    components, vectors without label, and vectors of different lengths are linked with
    nothing. ``component_id`` is the smallest linked identifier. Identifiers are whole
    numbers; rows without one are linked with nothing. Rows repeated with one identifier
    count as different vectors. Other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).alias("_label"), F.col(embedding).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(
        F.col("id").isNotNull() & F.col("_label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("_usable", usable)
    key = ["_label", "vector"]
    classes = pin(
        rows.filter("_usable").groupBy(*key).agg(F.min("id").alias("item"), F.count(F.lit(1)).alias("weight"))
        .withColumn("group", F.concat_ws(":", F.col("_label").cast("string"), F.size("vector").cast("string")))
    )
    met = block_copies(classes.select("group", "item", "weight", "vector"), cosine, block_rows)
    found = pin(map_block_pairs(met, lambda part: links(part, cosine), "item bigint, links bigint, other bigint"))
    numbers = found.groupBy("item").agg(F.sum("links").alias("links"))
    linked = components(found.filter("other IS NOT NULL").select(F.col("item").alias("a"), F.col("other").alias("b")))
    named = pin(
        classes.select(*key, "item", "weight").join(numbers, "item", "left")
        .join(linked.withColumnRenamed("node", "item"), "item", "left")
        .select(*key, (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "item").alias("component_id"))
    )
    plain = rows.filter("NOT _usable").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return (
        rows.filter("_usable").join(named, key).select("id", "n_links", "component_id").unionByName(plain)
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", vec_id)
    )


def alive_blocks(
    rows: DataFrame, tree: Tree, stats: dict[int, tuple[int, float]], cosine: float, block_rows: int,
) -> tuple[DataFrame, dict[str, dict[int, tuple[int, int]]]]:
    """Pairs of blocks (``group``, ``block``, ``other``, both ways) that the trees leave, and the blocks of every leaf.

    Subtrees below the roots are dealt to tasks in pairs.
    """
    spark = rows.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7
    tables = {name: _block_table(tree, stats, name, block_rows) for name in tree.roots}
    shared = spark.sparkContext.broadcast((tree, stats, tables))
    tops = []
    for name, root in tree.roots.items():
        below = [c for c in tree.children.get(root, [root]) if c in stats]
        tops += [(name, a, b) for i, a in enumerate(below) for b in below[i:]]  # at most FAN * FAN pairs a root

    def traverse(batch: pa.RecordBatch) -> dict[str, list]:
        tree, stats, tables = shared.value
        found: set[tuple[str, int, int]] = set()
        for name, a, b in zip(*(batch.column(c).to_pylist() for c in ("group", "a", "b")), strict=True):
            if a != b:
                near = np.linalg.norm(tree.centre[a] - tree.centre[b]) <= stats[a][1] + stats[b][1] + reach
                if not near:
                    continue
            for x, y in leaf_pairs(tree, stats, a, b, reach):
                (p, n), (q, m) = tables[name][x], tables[name][y]
                for i in range(p, p + n):
                    for j in range(q, q + m):
                        found |= {(name, i, j), (name, j, i)}
        return {"group": [f[0] for f in found], "block": [f[1] for f in found], "other": [f[2] for f in found]}

    pairs = spread_rows(spark.createDataFrame(tops, "group string, a bigint, b bigint"))
    return _map(pairs, traverse, "group string, block int, other int").distinct(), tables


def block_copies(classes: DataFrame, cosine: float, block_rows: int) -> DataFrame:
    """Every vector once per surviving pair of blocks that its block takes part in, as ``map_block_pairs`` takes them."""
    counted = pin(classes.groupBy("group").agg(F.count(F.lit(1)).alias("n")))
    # The trees have room for this many labels' children; further large labels are cut into blocks by hash.
    large = [r["group"] for r in counted.filter(F.col("n") > block_rows).orderBy(F.desc("n"), "group").limit(MAX_CENTRES // FAN).collect()]
    kind = classes.schema["vector"].dataType.simpleString()
    in_tree = classes.sparkSession.createDataFrame([(g,) for g in large], "group string")
    flat = lookup_join(classes, counted.withColumn("_parts", F.ceil(F.col("n") / block_rows).cast("int")).drop("n"), ["group"], "inner")
    flat = flat.join(F.broadcast(in_tree), "group", "left_anti").select(
        "group", "item", "weight", "vector", F.pmod(F.xxhash64("item"), F.col("_parts")).cast("int").alias("_side"),
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    if large:
        rows = classes.join(F.broadcast(in_tree), "group", "left_semi")
        tree, stats = grow(rows, large, LEVELS, FAN, LEAF_ROWS)
        alive, tables = alive_blocks(rows, tree, stats, cosine, block_rows)
        shared = classes.sparkSession.sparkContext.broadcast((tree, tables))

        def placed(batch: pa.RecordBatch) -> dict[str, object]:
            tree, tables = shared.value
            leaf, item = _leaves(batch, tree), batch.column("item").to_numpy()
            group = batch.column("group").to_pylist()
            ticket = batch.column("ticket").to_numpy().astype(np.uint64)
            where = [tables[g][v] for g, v in zip(group, leaf.tolist(), strict=True)]
            side = [p + int(t % np.uint64(n)) for (p, n), t in zip(where, ticket, strict=True)]
            return {"group": group, "item": item, "weight": batch.column("weight"), "vector": batch.column("vector"), "_side": side}

        named = _map(
            rows.withColumn("ticket", F.xxhash64("item")).select("group", "item", "weight", "vector", "ticket"), placed,
            f"group string, item bigint, weight bigint, vector {kind}, _side int")
        partners = alive.groupBy("group", F.col("block").alias("_side")).agg(F.collect_list("other").alias("_others"))
        flat = flat.unionByName(lookup_join(named, partners, ["group", "_side"], "inner").select(
            "group", "item", "weight", "vector", "_side", F.explode("_others").alias("_other")))
    return flat.select(
        F.col("group").alias("_group"), F.least("_side", "_other").alias("_i"), F.greatest("_side", "_other").alias("_j"),
        "_side", "item", "weight", "vector")
