"""MinHash near-deduplication with odd sketches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabix.functions.joins import lookup_join
from syllabix.llm.blocks import block_pairs, map_block_pairs
from syllabix.llm.common import active, map_batches, pin_batched
from syllabix.llm.components import Forest, components
from syllabix.llm.shingles import HASHES, band_keys, estimated_similarity, minhashes, odd_sketches, set_digest, shingle_set
from syllabix.session import pin

# A filter passed to all tasks is a set of bucket numbers below this, whatever the corpus size.
FILTER_BUCKETS = 1 << 20
# Sketches of a block; a task compares those of two blocks at a time.
BLOCK_ROWS = 1_200
# Rows up to which plain loops are faster than arrays.
FEW_ROWS = 12
# Full sets of a tile: tiles with more open pairs than rows are compared whole, others pair by pair.
TILE_ROWS = 96
# Estimates from which pairs are taken first for a forest.
TIERS = (0.93, 0.87, 0.0)
# Forests are tried again while at least this share of their edges is confirmed.
WORTHWHILE = 0.1


@dataclass(frozen=True)
class Settings:
    """Similarity and sketches.

    Documents are linked if ``100 * intersection >= percent * union``. At 85 percent, 32
    bands of 4 samples miss a pair with probability 5e-11; the sketch admits pairs whose
    estimate reaches ``sketch_floor``, over five standard deviations below.
    """

    percent: int = 85
    shingle: int = 5
    samples: int = 128
    bands: int = 32
    bits: int = 512
    sketch_floor: float = 0.68


def _signatures(columns: dict[str, list], s: Settings) -> dict[str, list]:
    active(HASHES)
    sets = [shingle_set(t, s.shingle) for t in columns["text"]]
    full = [i for i, x in enumerate(sets) if len(x)]
    samples = minhashes([sets[i] for i in full], s.samples) if full else np.empty((0, s.samples), np.uint64)
    keys, sketches = band_keys(samples, s.bands).view(np.int64), odd_sketches(samples, s.bits)
    bands: list = [None] * len(sets)
    sketch: list = [None] * len(sets)
    for row, i in enumerate(full):
        bands[i], sketch[i] = keys[row].tolist(), sketches[row].tobytes()
    return {
        "id": columns["id"], "n_shingles": [len(x) for x in sets], "digest": [set_digest(x) for x in sets],
        "bands": bands, "sketch": sketch,
    }


def _sets(columns: dict[str, list], size: int) -> dict[str, list]:
    active(HASHES)
    sets = [shingle_set(t, size) for t in columns["text"]]
    return {"item": columns["item"], "digest": [set_digest(x) for x in sets], "shingles": [x.tobytes() for x in sets]}


@lru_cache(maxsize=4)
def _admitted(s: Settings) -> np.ndarray:
    """Estimated similarity by the number of differing bits alone; 0 below the floor."""
    known = estimated_similarity(np.arange(s.bits + 1), s.samples, s.bits).astype(np.float32)
    known[known < s.sketch_floor] = 0
    return known


def _estimates(part: pa.Table, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of both blocks of a block pair, and the estimated similarities; 0 for what the sketches do not admit."""
    sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint64).reshape(part.num_rows, -1)
    side = part.column("_side").to_numpy()
    first, second = part.column("_i")[0].as_py(), part.column("_j")[0].as_py()
    a = np.flatnonzero(side == first)
    b = a if first == second else np.flatnonzero(side == second)
    differing = np.zeros((len(a), len(b)), np.uint16)
    for word in range(sketch.shape[1]):
        differing += np.bitwise_count(sketch[a, word][:, None] ^ sketch[b, word][None, :])
    estimate = _admitted(s)[differing]
    if first == second:
        estimate[np.tril_indices(len(a))] = 0
    return a, b, estimate


def _open(part: pa.Table, a: np.ndarray, b: np.ndarray, estimate: np.ndarray, s: Settings) -> np.ndarray:
    """Estimates of the pairs that may be links and are not united yet; 0 for others."""
    size, label = part.column("size").to_numpy(), part.column("label").to_numpy()
    x, y = size[a][:, None], size[b][None, :]
    possible = 100 * np.minimum(x, y) >= s.percent * np.maximum(x, y)
    return np.where(possible & (label[a][:, None] != label[b][None, :]), estimate, 0)


def forest_over(
    a: np.ndarray, b: np.ndarray, strength: np.ndarray, rows: int, label: np.ndarray | None = None, tiers: tuple[float, ...] = TIERS,
) -> tuple[list[int], list[int]]:
    """Pairs of positive strength that unite all rows which such pairs connect, stronger tiers first; at most one less than rows.

    ``label`` names what is united beforehand.
    """
    group = np.unique(label, return_inverse=True)[1] if label is not None else np.arange(rows)
    x, y = [], []
    for tier in tiers:
        wanted = strength > tier if tier == 0 else strength >= tier
        for i in np.flatnonzero(wanted.any(axis=1)):
            near = np.flatnonzero(wanted[i])
            other = group[b[near]]
            apart = other != group[a[i]]
            if not apart.any():
                continue
            found, first = np.unique(other[apart], return_index=True)
            for name, k in zip(found, near[apart][first], strict=True):
                x.append(int(a[i]))
                y.append(int(b[k]))
                group[group == name] = group[a[i]]
    return x, y


def _few_edges(part: pa.Table, s: Settings, labelled: bool) -> dict[str, list]:
    """The same forest for a group of few rows, without arrays; with labels only over open pairs, the likeliest first."""
    nodes, side = part.column("node").to_pylist(), part.column("_side").to_pylist()
    sketch = [int.from_bytes(v) for v in part.column("sketch").to_pylist()]
    whole = part.column("_i")[0].as_py() == part.column("_j")[0].as_py()
    size = part.column("size").to_pylist() if labelled else None
    names = part.column("label").to_pylist() if labelled else nodes
    known, found = _admitted(s), []
    for j in range(len(nodes)):
        for i in range(j):
            if (whole or side[i] != side[j]) and names[i] != names[j]:
                estimate = known[(sketch[i] ^ sketch[j]).bit_count()]
                if estimate and (not labelled or 100 * min(size[i], size[j]) >= s.percent * max(size[i], size[j])):
                    found.append((-estimate, i, j))
    forest, first, out = Forest(len(nodes)), {}, {"a": [], "b": []}
    for i, name in enumerate(names):
        forest.join(i, first.setdefault(name, i))
    for _, i, j in sorted(found):
        if forest.join(i, j):
            out["a"].append(nodes[i])
            out["b"].append(nodes[j])
    return out


def candidate_edges(part: pa.Table, s: Settings) -> dict[str, list]:
    """A forest over the pairs that the sketches admit."""
    if part.num_rows <= FEW_ROWS:
        return _few_edges(part, s, labelled=False)
    a, b, estimate = _estimates(part, s)
    # Which of the admitted pairs unite a cluster does not matter.
    x, y = forest_over(a, b, estimate, part.num_rows, tiers=(0.0,))
    items = part.column("node").to_pylist()
    return {"a": [items[i] for i in x], "b": [items[i] for i in y]}


def open_forest(part: pa.Table, s: Settings) -> dict[str, list]:
    """A forest over the open pairs of two blocks, to be confirmed."""
    if part.num_rows <= FEW_ROWS:
        return _few_edges(part, s, labelled=True)
    a, b, estimate = _estimates(part, s)
    x, y = forest_over(a, b, _open(part, a, b, estimate, s), part.num_rows, part.column("label").to_numpy())
    items = part.column("node").to_pylist()
    return {"a": [items[i] for i in x], "b": [items[i] for i in y]}


def open_pairs(part: pa.Table, s: Settings) -> dict[str, list]:
    """All open pairs of two blocks: as pairs ``a``, ``b``, or as members ``a`` of a ``tile`` where these are fewer."""
    a, b, estimate = _estimates(part, s)
    wanted = _open(part, a, b, estimate, s) > 0
    items = np.array(part.column("node").to_pylist(), np.int64)
    group, i, j = (part.column(c)[0].as_py() for c in ("_group", "_i", "_j"))
    out: dict[str, list] = {"a": [], "b": [], "tile": []}
    for top in range(0, len(a), TILE_ROWS):
        strip = wanted[top : top + TILE_ROWS]
        for left in np.unique(np.flatnonzero(strip.any(axis=0)) // TILE_ROWS) * TILE_ROWS:
            tile = strip[:, left : left + TILE_ROWS]
            rows, columns = a[top : top + TILE_ROWS][tile.any(axis=1)], b[left : left + TILE_ROWS][tile.any(axis=0)]
            members = np.union1d(items[rows], items[columns])
            if tile.sum() > len(members):
                name = f"{group}:{i}:{j}:{top}:{left}"
                out["a"] += members.tolist()
                out["b"] += [None] * len(members)
                out["tile"] += [name] * len(members)
            else:
                x, y = np.nonzero(tile)
                out["a"] += items[a[top + x]].tolist()
                out["b"] += items[b[left + y]].tolist()
                out["tile"] += [None] * len(x)
    return out


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two full sets are similar."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (small + large - common)


def _confirmed(columns: dict[str, list], percent: int) -> dict[str, list]:
    """Of pairs with their full sets, those that are links."""
    sets = [[np.frombuffer(v, np.uint64) for v in columns[c]] for c in ("first", "second")]
    kept = [linked(x, y, percent) for x, y in zip(*sets, strict=True)]
    return {c: [v for v, k in zip(columns[c], kept, strict=True) if k] for c in ("a", "b")}


def confirmed_edges(part: pa.Table, s: Settings) -> dict[str, list]:
    """A forest over the links of one tile; rows that are united already are not compared."""
    a, b, estimate = _estimates(part, s)
    estimate = _open(part, a, b, estimate, s)
    sets = [np.frombuffer(v, np.uint64) for v in part.column("shingles").to_pylist()]
    labels = {}
    first = [labels.setdefault(v, i) for i, v in enumerate(part.column("label").to_pylist())]
    items, forest, out = part.column("node").to_pylist(), Forest(part.num_rows), {"a": [], "b": []}
    for i, k in enumerate(first):
        forest.join(i, k)
    x, y = np.nonzero(estimate)
    for k in np.argsort(-estimate[x, y], kind="stable"):
        i, j = int(a[x[k]]), int(b[y[k]])
        if forest.find(i) != forest.find(j) and linked(sets[i], sets[j], s.percent):
            forest.join(i, j)
            out["a"].append(items[i])
            out["b"].append(items[j])
    return out


def near_dedup(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Groups of near copies: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    1. Documents of equal shingle sets form a class with its smallest identifier as
       representative, so copies are never compared or expanded into pairs.
    2. Representatives meet in the buckets of MinHash bands. Inside a bucket, odd
       sketches (parity bitmaps of the samples) are compared and a forest over the
       admitted pairs is kept; its components are clusters that hold every link.
    3. The texts of clusters with two members or more are read again, once. Sketches inside
       a cluster give forests of open pairs, the likeliest first; full sets are joined to
       these pairs alone, what is confirmed is united, and what is left open is tried again
       while that confirms enough. All pairs still open are then confirmed pair by pair, or
       in tiles of at most ``2 * TILE_ROWS`` sets where these are fewer than the pairs. The
       components of the confirmed links are the result.

    Buckets and clusters of any size are cut into blocks of ``BLOCK_ROWS`` sketches (64 bytes
    each); a task compares two blocks, so a row is copied once per block of its group. A
    full set moves at most once per open pair and never for pairs united already. A group of
    m representatives that are alike but not linked still costs m * m / 2 sketch
    comparisons and as many confirmations, spread over tasks, because no link may be lost.

    Identifiers are whole numbers. A text without words has no shingles and is linked with nothing (``component_id`` is
    its own identifier). A missing text is one without words. Rows without identifier
    belong to the class of their text but represent it only together with others: their
    ``component_id`` is that of the class, or null. Rows repeated with one identifier get
    the same answer if their texts are the same; an identifier with several texts is in
    the class of each. Other columns are not read, an empty table gives no rows.
    """
    s = settings
    whole = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = pin_batched(map_batches(
        whole, _signatures, "id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch binary", s))
    classes = pin(
        signed.filter("n_shingles > 0").groupBy("digest").agg(
            F.min("id").alias("item"), F.first("n_shingles").alias("size"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        ).filter("item IS NOT NULL").withColumn("node", F.monotonically_increasing_id())
    )
    clusters = components(_bucket_edges(classes, s))
    found = pin(classes.select("node", "digest", "item").join(_links(whole, classes, clusters, s), "node", "left").select(
        "digest", "item", F.coalesce("component", "node").alias("component")))
    least = found.groupBy("component").agg(F.min("item").alias("least"))
    named = pin(found.join(least, "component").select("digest", F.col("least").alias("component")))
    return (
        signed.select("id", "n_shingles", "digest").join(named, "digest", "left")
        .select(
            F.col("id").alias(doc_id), "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id")))
    )


def _bucket_edges(classes: DataFrame, s: Settings) -> DataFrame:
    """Edges between representatives that share a bucket and have similar sketches."""
    keys = classes.select("node", F.explode("bands").alias("bucket"))
    crowded = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    met = keys.join(crowded, "bucket").join(classes.select("node", "sketch"), "node")
    pairs = block_pairs(met, "bucket", F.ceil(F.col("rows") / BLOCK_ROWS), "node").drop("rows")
    return map_block_pairs(pairs, lambda part: candidate_edges(part, s), "a bigint, b bigint")


def _member_sets(whole: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``node`` and full ``shingles`` of the clusters' members, one row each; their texts are read again."""
    bucket = F.pmod(F.xxhash64("item"), F.lit(FILTER_BUCKETS)).cast("bigint")
    wanted = F.broadcast(members.select(bucket.alias("_bucket")).distinct())
    texts = whole.withColumnRenamed("id", "item").withColumn("_bucket", bucket).join(wanted, "_bucket", "left_semi")
    sets = map_batches(texts.select("item", "text"), _sets, "item bigint, digest binary, shingles binary", size)
    once = sets.dropDuplicates(["item", "digest"])  # repeated rows; the join has the same keys and needs no other exchange
    return pin_batched(once.join(members.select("node", "item", "digest"), ["item", "digest"]).select("node", "shingles"))


def _links(whole: DataFrame, classes: DataFrame, clusters: DataFrame, s: Settings) -> DataFrame:
    """``node`` and ``component`` by the confirmed links of all clusters."""
    members = pin(classes.select("node", "item", "digest", "size", "sketch").join(clusters, "node"))
    sets = _member_sets(whole, members, s.shingle)
    sizes = pin(members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")))
    narrow = lookup_join(members.drop("item", "digest"), sizes, ["component"], "inner")

    def labelled(found: DataFrame) -> DataFrame:
        label = found.select("node", F.col("component").alias("_label"))
        return narrow.join(label, "node", "left").withColumn("label", F.coalesce("_label", "node")).drop("_label")

    def blocks(found: DataFrame) -> DataFrame:
        return block_pairs(labelled(found), "component", F.col("blocks"), "node").drop("blocks")

    def confirmed(pairs: DataFrame) -> DataFrame:
        ends = [sets.withColumnsRenamed({"node": end, "shingles": name}) for end, name in (("a", "first"), ("b", "second"))]
        return map_batches(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "first", "second"), _confirmed, "a bigint, b bigint", s.percent)

    edges = members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    found = components(edges)
    while True:
        tried = pin(map_block_pairs(blocks(found), lambda part: open_forest(part, s), "a bigint, b bigint"))
        new = pin_batched(confirmed(tried))
        n_tried, n_new = tried.count(), new.count()
        if n_new:
            edges = edges.unionByName(new)
            found = components(edges)
        if not n_tried:
            return found
        if n_new < WORTHWHILE * n_tried:
            break
    rest = pin(map_block_pairs(blocks(found), lambda part: open_pairs(part, s), "a bigint, b bigint, tile string"))
    tiles = rest.filter("tile IS NOT NULL").select("tile", F.col("a").alias("node"))
    rows = tiles.join(labelled(found).drop("component", "blocks"), "node").join(sets, "node")
    dealt = rows.select(
        F.col("tile").alias("_group"), *[F.lit(0).alias(c) for c in ("_i", "_j", "_side")], "node", "size", "sketch", "label", "shingles")
    more = map_block_pairs(dealt, lambda part: confirmed_edges(part, s), "a bigint, b bigint")
    pairs = confirmed(rest.filter("tile IS NULL").select("a", "b"))
    return components(edges.unionByName(pin_batched(more)).unionByName(pin_batched(pairs)))
