"""Exact top-k search by inner product: a KD-tree for each shard of the vectors.

Space is cut into cells by the upper levels of a KD-tree, fitted on a bounded sample;
a cell's rows are dealt into shards of bounded size, and each shard becomes one row
that holds a KD-tree of its own (median splits, tight bounding boxes). Queries are
packed into blocks. A box is worth the largest product that any point in it could
have. The queries of a block go to cells in three waves: to one shard of the cell
that is worth most to each, to the eighth of the cells that are worth most, to the
others; what a wave finds raises each query's kth score, and a query goes only to
cells worth as much as that. Within a shard it walks the tree best-first and stops
when the best box left is below the kth score.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, join_hot, materialize, ready

SHARD_ROWS = 4096
BLOCK_ROWS = 256
#: A leaf's products are one matrix row; smaller leaves cost more steps than they save products.
LEAF_ROWS = 256
#: Blocks of queries that go through a tree in one piece of work.
BLOCKS = 8
#: Cells at most, and rows of the sample that their cuts are fitted on. They bear on speed only.
CELLS = 64
SAMPLE = 4096
#: Vector lengths that get cuts, the most frequent ones; vectors of others lie in one cell a length.
CUT_DIMS = 8
#: Lengths whose cell boxes are broadcast: 2 x CELLS vectors each.
BROADCAST_DIMS = 16


def _small(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        return {k: held[k] for k in held.files}


def build_tree(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes in arrays: rows [start, end) of the reordered vectors, children (-1: leaf), tight box.

    A node whose vectors are all equal stays one leaf, sorted by id.
    """
    order = np.argsort(ids, kind="stable")
    start, end, left, right, low, high = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        k = len(start)
        own = vectors[order[a:b]]
        start.append(a), end.append(b), left.append(-1), right.append(-1)
        low.append(own.min(axis=0)), high.append(own.max(axis=0))
        return k

    todo = [node(0, len(ids))]
    while todo:
        k = todo.pop()
        a, b = start[k], end[k]
        if b - a <= LEAF_ROWS or not vectors.shape[1]:
            continue
        span = high[k].astype(np.float64) - low[k]
        axis = int(span.argmax())
        if span[axis] <= 0:
            continue
        own = order[a:b]
        values = vectors[own, axis]
        middle = np.partition(values, len(values) // 2)[len(values) // 2]
        below = values < middle if (values < middle).any() else values <= middle
        order[a:b] = np.concatenate([own[below], own[~below]])  # stable: ids stay sorted in a leaf
        cut = a + int(below.sum())
        left[k], right[k] = node(a, cut), node(cut, b)
        todo += [left[k], right[k]]
    box = lambda x: np.array(x).reshape(len(start), vectors.shape[1])
    return {"ids": ids[order], "vectors": vectors[order], "start": np.array(start), "end": np.array(end), "left": np.array(left), "right": np.array(right), "low": box(low), "high": box(high)}


def search(tree: dict[str, np.ndarray], ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, has_floor: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, id, score) of what the shard adds to each query's k best.

    ``floor``: a score that k other rows are known to reach; what lies below it is left out.
    """
    most = [int(np.abs(x.astype(object)).max()) if x.size else 0 for x in (vectors, tree["vectors"])]
    kind = np.float64 if most[0] * most[1] * max(1, vectors.shape[1]) < 2**52 else object  # exact either way
    points, low, high = (tree[x].astype(kind) for x in ("vectors", "low", "high"))
    queries = vectors.astype(kind)
    up, down = np.where(queries > 0, queries, 0), np.where(queries < 0, queries, 0)
    bounds = up @ high.T + down @ low.T  # the largest product that a box allows
    start, end, left, right = (tree[x].tolist() for x in ("start", "end", "left", "right"))
    same = (tree["low"] == tree["high"]).all(axis=1) if tree["low"].shape[1] else np.ones(len(start), bool)
    for q in range(len(ids)):
        bound, own = bounds[q].tolist(), int(ids[q])
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst kept first
        todo = [(-bound[0], 0)]
        while todo:
            value, n = heapq.heappop(todo)
            if (len(best) == k and -value < best[0][0]) or (has_floor[q] and -value < floor[q]):
                break
            if left[n] >= 0:
                for child in (left[n], right[n]):
                    heapq.heappush(todo, (-bound[child], child))
                continue
            a = start[n]
            # equal vectors lie by id, so the first k + 1 hold the k best whatever the query's own id
            members = tree["ids"][a : end[n]]
            if same[n]:
                members = members[members != own][:k]
            scores = points[a : a + len(members)] @ queries[q]
            if len(best) == k and len(members) > k:
                near = np.flatnonzero(scores >= best[0][0])
                members, scores = members[near], scores[near]
            for i, s in zip(members.tolist(), scores.tolist(), strict=True):
                if i != own:
                    if len(best) < k:
                        heapq.heappush(best, (int(s), -i))
                    elif (int(s), -i) > best[0]:
                        heapq.heapreplace(best, (int(s), -i))
        for score, i in best:
            if not has_floor[q] or score >= floor[q]:
                yield own, -i, score


def _tree_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf["id"].to_numpy(np.int64)
    vectors = np.array(pdf["vector"].tolist(), np.int64).reshape(len(ids), -1)
    tree = build_tree(ids, vectors)
    tree = {k: v if k == "ids" else _small(v) for k, v in tree.items()}
    first = pdf[["dim", "cell", "shard"]].head(1).reset_index(drop=True)
    return first.assign(low=[tree["low"][0].tolist()], high=[tree["high"][0].tolist()], tree=[_packed(**tree)])


def _block_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf["id"].to_numpy(np.int64)
    vectors = np.array(pdf["vector"].tolist(), np.int64).reshape(len(ids), -1)
    floor = pdf["floor"].to_numpy(np.int64, na_value=0) if pdf["floor"].notna().any() else np.zeros(len(ids), np.int64)
    held = _packed(ids=ids, vectors=_small(vectors), floor=floor, has_floor=pdf["floor"].notna().to_numpy())
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "queries": [held]})


def _search_rows(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for tree, blocks in zip(pdf["tree"], pdf["blocks"], strict=True):
            held = _unpacked(tree)  # once for all its blocks
            for queries in blocks:
                q = _unpacked(queries)
                found = list(search(held, q["ids"], q["vectors"], q["floor"], q["has_floor"], k))
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")


def dealt(points: DataFrame, shards: int | Column) -> DataFrame:
    """``points`` with a shard from 0 to ``shards`` - 1: rows are dealt, not ids, so rows that repeat an id spread like any others."""
    return points.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))


def fit_cuts(vectors: np.ndarray, depth: int) -> tuple[list[int], list[int]]:
    """(axes, cuts) of the upper levels of a KD-tree, in heap order: a vector below the cut on the axis goes left.

    The axis is the one of the greatest variance, the cut its median. Where no cut parts the vectors, all go left.
    """
    axes, cuts, members = [], [], [vectors]
    for n in range(2**depth - 1):
        own = members[n]
        axis, cut = 0, np.iinfo(np.int64).max
        if len(own):
            widest = int(own.astype(np.float64).var(axis=0).argmax())
            values = own[:, widest]
            above = values[values > values.min()]
            if len(above):
                axis, cut = widest, max(int(np.sort(values)[len(values) // 2]), int(above.min()))
        below = own[:, axis] < cut
        axes.append(axis), cuts.append(int(cut))
        members += [own[below], own[~below]]
    return axes, cuts


def _leaf(axes: list[int], cuts: list[int], depth: int) -> Column:
    """The number of the leaf that ``vector`` comes to, from 0."""
    axis, cut = F.array(*map(F.lit, axes)), F.array(*(F.lit(c).cast("long") for c in cuts))
    down = lambda n, _: n * 2 + 1 + (F.get("vector", F.get(axis, n)) >= F.get(cut, n)).cast("int")
    return F.aggregate(F.array_repeat(F.lit(0), depth), F.lit(0), down) - (2**depth - 1)


def with_cells(points: DataFrame, n_points: int) -> DataFrame:
    """``points`` with a cell each, of as many as there are shards, ``CELLS`` at most."""
    depth = max(0, min(CELLS, -(-n_points // SHARD_ROWS)).bit_length() - 1)
    cell = F.lit(0)
    if depth:
        sample = points.sample(min(1.0, SAMPLE / n_points), 1).select("vector", "dim").limit(2 * SAMPLE).toPandas()
        for dim in sample["dim"].value_counts().index[:CUT_DIMS]:
            if dim:
                axes, cuts = fit_cuts(np.array(sample["vector"][sample["dim"] == dim].tolist(), np.int64), depth)
                cell = F.when(F.col("dim") == int(dim), _leaf(axes, cuts, depth)).otherwise(cell)
    return points.withColumn("cell", cell.cast("int"))


def cell_boxes(trees: DataFrame) -> DataFrame:
    """(dim, cells): for each vector length its cells' shards and boxes, an entry per cell and axis."""
    sides = trees.select("dim", "cell", F.posexplode_outer(F.arrays_zip("low", "high")).alias("axis", "x"))
    sides = sides.groupBy("dim", "cell", "axis").agg(F.count(F.lit(1)).alias("shards"), F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    return sides.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("cell", F.coalesce("axis", F.lit(0)).alias("axis"), "shards", "low", "high"))).alias("cells"))


def _route_rows(batches: Iterator[pd.DataFrame], wave: int) -> Iterator[pd.DataFrame]:
    """What of each block goes to which cell in this wave: 0, the best cell; 1, the best eighth; 2, the others.

    A query's home, one shard of its best cell, is met in wave 0 and left out (``home``, else -1) in wave 1.
    """
    for pdf in batches:
        for dim, block, data, cells in pdf[["dim", "block", "queries", "cells"]].itertuples(index=False):
            q, per_cell = _unpacked(data), max(1, dim)
            # cells come sorted, each with an entry per axis
            numbers = [c["cell"] for c in cells[::per_cell]]
            shards = [c["shards"] for c in cells[::per_cell]]
            low, high = (np.array([c[side] or 0 for c in cells], object).reshape(-1, per_cell)[:, :dim] for side in ("low", "high"))
            vectors = q["vectors"].astype(object)
            most = [max((abs(int(v)) for v in x.flat), default=0) for x in (vectors, low, high)]
            kind = np.float64 if most[0] * max(most[1:]) * per_cell < 2**52 else object  # exact either way
            vectors, low, high = (x.astype(kind) for x in (vectors, low, high))
            bounds = np.where(vectors > 0, vectors, 0) @ high.T + np.where(vectors < 0, vectors, 0) @ low.T
            rank = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1)
            near = max(1, -(-len(numbers) // 8))
            due = {0: rank == 0, 1: rank < near, 2: rank >= near}[wave]
            due &= ~q["has_floor"][:, None] | (bounds >= q["floor"][:, None]).astype(bool)
            out = []
            for j, number in enumerate(numbers):
                home = block % shards[j]
                for skip, chosen in ((home, due[:, j] & (rank[:, j] == 0)), (-1, due[:, j] & (rank[:, j] != 0))):
                    if chosen.any():
                        out.append((dim, block, number, shards[j], skip, _packed(**{k: v[chosen] for k, v in q.items()})))
            yield pd.DataFrame(out, columns=["dim", "block", "cell", "shards", "home", "queries"])


def routed(packed: DataFrame, boxes: DataFrame, wave: int) -> DataFrame:
    """(dim, cell, shard, block, queries): the pieces of query blocks that shards meet in a wave."""
    rows = packed.join(boxes, "dim").mapInPandas(lambda it: _route_rows(it, wave), "dim int, block int, cell int, shards int, home int, queries binary")
    if wave == 0:
        return rows.withColumn("shard", F.col("home")).drop("shards", "home")
    all_shards = F.array_remove(F.sequence(F.lit(0), F.col("shards") - 1), F.col("home"))
    return rows.withColumn("shard", F.explode(all_shards)).drop("shards", "home")


def blocks_of(asked: DataFrame) -> DataFrame:
    """Queries (id, vector, dim, block, floor) packed by block; ``floor``: a score that k other rows are known to reach, or null."""
    return asked.groupBy("dim", "block").applyInPandas(_block_rows, "dim int, block int, queries binary")


def grow_trees(points: DataFrame, n_points: int) -> DataFrame:
    """(dim, cell, shard, low, high, tree): a tree per shard, with its box."""
    celled = with_cells(points, n_points)
    sizes = materialize(celled.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("shards", F.ceil(F.col("n") / SHARD_ROWS).cast("int")), "cells")
    if sizes.count() <= FEW:
        celled = celled.join(F.broadcast(sizes.drop("n")), ["dim", "cell"])
    else:
        celled = join_hot(celled, sizes, ["dim", "cell"], "n", n_points)
    trees = dealt(celled, F.col("shards")).groupBy("dim", "cell", "shard")
    return materialize(trees.applyInPandas(_tree_rows, "dim int, cell int, shard int, low array<long>, high array<long>, tree binary"), "trees")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product for each of ``queries``.

    Components become floor(256 * x). A row of the query's own id is no candidate;
    ties go to the smaller id. Columns: query_id, rank (from 1), vec_id, score; fewer
    than k rows where there are fewer candidates. Rows whose vector or id is null or
    whose vector holds a null or non-finite component take no part; vectors meet
    only those of their own length. Repeated rows of one id are candidates each; a
    repeated query id asks once, with its smallest vector. An empty table gives no
    rows. Other columns are not read.
    """
    spark = ready(vectors.sparkSession)

    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vector_col)
        finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        as_ints = F.transform(x, lambda v: F.floor(F.lit(256.0) * v.cast("double")))
        return df.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), as_ints.alias("vector")).withColumn("dim", F.size("vector"))

    points = whole(vectors)
    asked = whole(queries).groupBy("id").agg(F.min_by(F.struct("vector", "dim"), F.struct("dim", "vector")).alias("x")).select("id", "x.vector", "x.dim")
    n_points, n_asked = points.count(), asked.count()
    trees = grow_trees(points, n_points)
    boxes = materialize(cell_boxes(trees), "boxes")
    boxes = F.broadcast(boxes) if boxes.count() <= BROADCAST_DIMS else boxes
    blocks = max(1, -(-n_asked // BLOCK_ROWS))
    salts = -(-blocks // BLOCKS)  # a shard meets its blocks in so many pieces of work, each in a task of its own
    salted = trees.select("dim", "cell", "shard", "tree", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for wave in range(3):
        if found is None:
            seeded = asked.withColumn("floor", F.lit(None).cast("long"))
        else:
            floors = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
            seeded = asked.join(floors.select(F.col("query_id").alias("id"), "floor"), "id", "left")
        met = routed(blocks_of(seeded), boxes, wave).withColumn("salt", F.pmod("block", F.lit(salts)).cast("int"))
        met = met.groupBy("dim", "cell", "shard", "salt").agg(F.collect_list("queries").alias("blocks"))  # about BLOCKS
        pairs = met.join(salted, ["dim", "cell", "shard", "salt"]).select("tree", "blocks")
        new = pairs.mapInPandas(lambda it: _search_rows(it, k), "query_id long, vec_id long, score long")
        new = new if found is None else found.unionByName(new)
        ranked = new.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = ranked if wave == 2 else materialize(ranked.drop("rank"), "found")
    return found
