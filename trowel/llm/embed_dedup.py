"""Embedding near-dedup with a robust-pruned flat graph.

Vectors of one label are clustered: centres come from a bounded sample by spherical k-means, and each
vector goes to its two nearest centres and to two more that are about as near, so shards overlap; shards above MOST members are clustered
again. Centres whose vectors mostly are within range of each other make one shard, so a group of near copies
stays whole; such a shard above MOST, and one that DEPTH rounds leave above it, is dense: all pairs of its
blocks are compared exactly, which gives counts and tree edges without lists. In any other shard every vector gets neighbours by robust pruning (nearest first, dropping candidates
that a chosen neighbour is ALPHA times nearer to). Adjacency lists of a vector from all its shards are
united, and each shard is searched with the united lists: its members and their close neighbours elsewhere.
Each member is searched from the shard's medoid and its own place by greedy beam search, which then
expands every vector found within range until none is new. Cosines are in double precision.

Exact copies are one class first, so a vector with any number of copies is one node. A search returns
one row per class with what it found and a tree edge; components come from the edges. audit_recall
measures the share of brute-force links found for the queries whose id is divisible by 20.

Defined results: null label, null vector, zero norm, null or non-finite components link with nothing
(n_links 0, own component, kept); vectors of different lengths do not link; repeated rows are vectors
that are linked; a null vec_id links with nothing and has a null component. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trowel.operators.graph import stars
from trowel.session import ship_package, shuffle_parts, stage_table

#: Members of a shard, wanted and at most; sample per centre; rounds of clustering.
TARGET, MOST, SAMPLE, DEPTH = 512, 2048, 32, 4
#: Neighbours of a vector in one shard, out of so many nearest; those out of as many drawn at random;
#: beam of the search, pruning factor.
DEGREE, POOL, FAR, BEAM, ALPHA = 24, 64, 8, 8, 1.2
#: Centres of one clustering at most; how much farther than the nearest a third or fourth may be.
CENTRES, MARGIN = 64, 0.03
#: Vectors of a dense shard that a task compares with as many.
BLOCK = 8192


def _unit_rows(batches):
    """(vec_id, shard, digest, unit): shard names label and length; null where the vector cannot link."""
    for batch in batches:
        ids, labels, vectors = (batch.column(i).to_pylist() for i in range(3))
        shard, digest, unit = [], [], []
        for i, label, v in zip(ids, labels, vectors, strict=True):
            x = np.array([np.nan] if v is None else [np.nan if c is None else c for c in v], np.float64)
            norm = float(np.sqrt(x @ x)) if len(x) and np.isfinite(x).all() else 0.0
            if i is None or label is None or not np.isfinite(norm) or norm == 0:
                shard.append(None)
                digest.append(None)
                unit.append(None)
            else:
                shard.append(f"{label}/{len(x)}")
                digest.append(hashlib.md5(x.tobytes()).hexdigest())
                unit.append((x / norm).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard, pa.string()), pa.array(digest, pa.string()), pa.array(unit, pa.binary())], ["vec_id", "shard", "digest", "unit"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), np.float64) for x in column])


def _centres(threshold: float):
    def centres(table: pa.Table) -> pa.Table:
        """Spherical k-means on a shard's sample; child: the shard of each centre; tight: is most of the shard within range?"""
        return _clustered(table, threshold)

    return centres


def _clustered(table: pa.Table, threshold: float) -> pa.Table:
    x = _matrix(table.column("unit"))
    k = min(table.column("wanted")[0].as_py(), len(x))
    rng = np.random.default_rng(7)
    x = x[np.lexsort(x.T[:4])]
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        own = np.argmax(x @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centre)
    # centres are united if half of the sampled pairs across them are within range, and tight if half of those of one are
    own = np.argmax(x @ centre.T, axis=1)
    member = np.zeros((len(x), k))
    member[np.arange(len(x)), own] = 1
    inside = (x @ x.T >= threshold).astype(float)
    np.fill_diagonal(inside, 0)
    size = member.sum(axis=0)
    pairs = np.outer(size, size) - np.diag(size)
    close = (2 * (member.T @ inside @ member) >= pairs) & (pairs > 0)
    child = np.arange(k)
    _join(child, *np.nonzero(close))
    tight = np.zeros(k, bool)
    tight[child[np.flatnonzero(np.diag(close))]] = True
    name = table.column("shard")[0].as_py()
    return pa.table({"shard": pa.array([name]), "k": pa.array([k], pa.int32()), "centres": pa.array([centre.tobytes()], pa.binary()), "child": pa.array([child.tolist()], pa.list_(pa.int32())), "tight": pa.array([tight.tolist()], pa.list_(pa.bool_()))})


def _assign(members: pa.Table, centres: pa.Table) -> pa.Table:
    """Each member once for each shard of its two nearest centres, and of the next two if they are within MARGIN of the nearest."""
    if not len(members):
        return pa.table({"shard": pa.array([], pa.string()), "tight": pa.array([], pa.bool_()), "node": pa.array([], pa.int64()), "copies": pa.array([], pa.int64()), "unit": pa.array([], pa.binary())})
    x = _matrix(members.column("unit"))
    centre = np.frombuffer(centres.column("centres")[0].as_py(), np.float64).reshape(centres.column("k")[0].as_py(), -1)
    cosine = x @ centre.T
    near = np.argsort(-cosine, axis=1, kind="stable")[:, :4]
    close = np.take_along_axis(cosine, near, 1)
    chosen = close >= close[:, :1] - MARGIN
    chosen[:, :2] = True
    name = members.column("shard")[0].as_py()
    child, tight = (np.array(centres.column(c)[0].as_py()) for c in ("child", "tight"))
    row, to = np.divmod(np.unique(np.nonzero(chosen)[0] * len(child) + child[near[chosen]]), len(child))
    rows = pa.array(row)
    return pa.table({"shard": pa.array([f"{name}.{c}" for c in to.tolist()]), "tight": pa.array(tight[to]), "node": members.column("node").take(rows), "copies": members.column("copies").take(rows), "unit": members.column("unit").take(rows)})


def shards_of(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Nodes in overlapping shards (shard, node, copies, unit): those of at most MOST members, and the dense ones."""
    spark = nodes.sparkSession
    done: DataFrame | None = None
    dense: DataFrame | None = None
    nodes = nodes.withColumn("tight", F.lit(False))
    for turn in range(DEPTH + 1):
        sizes = nodes.groupBy("shard").agg(F.count("*").alias("n"), (F.max("tight") | F.lit(turn == DEPTH)).alias("whole")).where(F.col("n") > MOST)
        large = stage_table(spark, sizes, "large")
        small = nodes.join(large.select("shard"), "shard", "left_anti").drop("tight")
        done = small if done is None else done.union(small)
        kept = nodes.join(large.where("whole").select("shard"), "shard", "left_semi").drop("tight")
        dense = kept if dense is None else dense.union(kept)
        large = large.where("not whole").drop("whole")
        if not large.take(1):
            break
        big = nodes.drop("tight").join(large, "shard").withColumn("wanted", F.least(F.lit(CENTRES), F.greatest(F.lit(2), F.ceil(F.col("n") / TARGET))).cast("int"))
        # about SAMPLE per centre, CENTRES * SAMPLE a shard at most, chosen by a hash of the id
        share = F.least(F.lit(1.0), SAMPLE * F.col("wanted") / F.col("n"))
        sample = big.where(F.pmod(F.xxhash64("node", "shard"), F.lit(1_000_003)) < share * 1_000_003)
        centres = sample.groupBy("shard").applyInArrow(_centres(threshold), "shard string, k int, centres binary, child array<int>, tight array<boolean>")
        centres = stage_table(spark, centres.join(large, "shard").select("shard", "k", "centres", "child", "tight", F.ceil(F.col("n") / MOST).alias("salts")), "centres")
        salted = big.join(centres.select("shard", "salts"), "shard").withColumn("salt", F.pmod(F.xxhash64("node"), "salts")).select("shard", "salt", "node", "copies", "unit")
        spread = centres.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("shard", "salt", "k", "centres", "child", "tight")
        split = salted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(_assign, "shard string, tight boolean, node long, copies long, unit binary")
        nodes = stage_table(spark, split, "shards")
    return done, dense


def _compare(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        """All pairs of a block with another, or within one: each vector's copies within range, and a tree edge.

        A pair that an earlier dense shard has too is counted there.
        """
        name, second = table.column("shard")[0].as_py(), table.column("second").to_numpy(zero_copy_only=False)
        left, right = (table.filter(pa.array(second == side)) for side in (False, True))
        same = not len(right) and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        right = left if same else right
        if not len(left) or not len(right):
            return pa.table({"node": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "others": pa.array([], pa.int64())})
        ids = [t.column("node").to_numpy() for t in (left, right)]
        x, y = _matrix(left.column("unit")), _matrix(right.column("unit"))
        copies = [t.column("copies").to_numpy().astype(float) for t in (left, right)]
        earlier = [[{d for d in v if d < name} for v in t.column("dense").to_pylist()] for t in (left, right)]
        twice = [(np.array([d in v for v in earlier[0]]), np.array([d in v for v in earlier[1]])) for d in sorted(set().union(*earlier[0]) & set().union(*earlier[1]))]
        others = [np.zeros(len(v)) for v in ids]
        parent, base = np.arange(len(x) + (0 if same else len(y))), 0 if same else len(x)
        for at in range(0, len(x), 1024):
            hit = x[at : at + 1024] @ y.T >= threshold
            if same:
                hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
            _unite(parent, hit, at, base)
            for a, b in twice:
                hit[np.ix_(a[at : at + 1024], b)] = False
            others[0][at : at + 1024] += hit @ copies[1]
            if not same:
                others[1] += copies[0][at : at + 1024] @ hit
        nodes = ids[0] if same else np.concatenate(ids)
        count = others[0] if same else np.concatenate(others)
        root = nodes[[_top(parent, i) for i in range(len(nodes))]]
        return pa.table({"node": pa.array(nodes), "root": pa.array(root), "others": pa.array(count.astype(np.int64))})

    return compare


def _unite(parent: np.ndarray, hit: np.ndarray, first: int, base: int) -> None:
    """Unites the trees of rows (numbered from first) and columns (from base) of a matrix of pairs; each row and column is read once or twice."""
    left = hit.any(axis=1)
    while left.any():
        rows, ahead = np.array([left.argmax()]), np.zeros(hit.shape[1], bool)
        every = [rows]
        left[rows] = False
        while len(rows):
            new = hit[rows].any(axis=0) & ~ahead
            ahead |= new
            at = np.flatnonzero(left)
            rows = at[hit[np.ix_(at, np.flatnonzero(new))].any(axis=1)]
            left[rows] = False
            every.append(rows)
        tops = {_top(parent, int(i)) for i in np.concatenate((np.concatenate(every) + first, np.flatnonzero(ahead) + base))}
        for top in tops:
            parent[top] = min(tops)


def dense_links(dense: DataFrame, threshold: float) -> DataFrame:
    """(node, root, others): tree edges and copies within range in dense shards, by comparing all pairs of their blocks."""
    held = dense.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("dense"))
    blocks = dense.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = dense.join(blocks, "shard").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).join(held, "node")
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "node", "copies", "unit", "dense")
    return paired.groupBy("shard", "i", "j").applyInArrow(_compare(threshold), "node long, root long, others long")


def robust_prune(similar: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of every vector out of its pool, nearest first; -1 where it has fewer. All vectors step together."""
    rows = np.arange(len(pool))[:, None]
    own = 1 - similar[rows, pool]
    alive = pool != rows
    out = np.full((len(pool), degree), -1, np.int64)
    for step in range(degree):
        left = alive.any(axis=1)
        if not left.any():
            break
        first = alive.argmax(axis=1)
        chosen = pool[rows[:, 0], first]
        out[left, step] = chosen[left]
        alive &= alpha * (1 - similar[chosen[:, None], pool]) > own
        alive[rows[:, 0], first] = False
    return out


def _build(close: float):
    def build(table: pa.Table) -> pa.Table:
        """Adjacency lists of a shard, both ways, and of each list the neighbours with a cosine of close or more."""
        return _adjacency(table, close)

    return build


def _adjacency(table: pa.Table, close: float) -> pa.Table:
    nodes, order = table.column("node").to_numpy(), np.argsort(table.column("node").to_numpy())
    nodes = nodes[order]
    x = _matrix(table.column("unit"))[order].astype(np.float32)
    similar = x @ x.T
    width = min(POOL + 1, len(x))
    pool = np.argpartition(-similar, width - 1, axis=1)[:, :width]
    pool = np.take_along_axis(pool, np.argsort(-np.take_along_axis(similar, pool, 1), axis=1, kind="stable"), 1)
    # a group of near copies would only have neighbours within: some are pruned from a random pool
    drawn = np.random.default_rng(11).integers(0, len(x), (len(x), width))
    drawn = np.take_along_axis(drawn, np.argsort(-np.take_along_axis(similar, drawn, 1), axis=1, kind="stable"), 1)
    near = np.hstack((robust_prune(similar, pool), robust_prune(similar, drawn, FAR)))
    a, b = np.repeat(np.arange(len(x)), near.shape[1]), near.reshape(-1)
    a, b = a[b >= 0], b[b >= 0]
    ahead = np.unique(a * len(x) + b)
    back = np.setdiff1d(b * len(x) + a, ahead)
    a, b = np.concatenate((ahead, back)) // len(x), np.concatenate((ahead, back)) % len(x)
    # of the way back, lists that are too long lose the farthest
    rank = np.lexsort((-similar[a, b], np.arange(len(a)) >= len(ahead), a))
    a, b = a[rank], b[rank]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    a, b = a[place < 2 * (DEGREE + FAR)], b[place < 2 * (DEGREE + FAR)]
    cuts = np.searchsorted(a, np.arange(len(x) + 1))
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(nodes[b]))
    inside = similar[a, b] >= close
    cuts = np.concatenate(([0], np.cumsum(inside)))[cuts]
    return pa.table({"node": pa.array(nodes), "near": lists, "close": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(nodes[b[inside]]))})


def _search(threshold: float):
    def search(table: pa.Table) -> pa.Table:
        """Members of a shard searched over its members and their neighbours: links of all vectors, both ways, and one tree edge each."""
        ids, first = np.unique(table.column("node").to_numpy(), return_index=True)
        member = np.zeros(len(ids), bool)
        member[np.searchsorted(ids, table.column("node").to_numpy()[table.column("member").to_numpy(zero_copy_only=False)])] = True
        table = table.take(pa.array(first))
        x, copies = _matrix(table.column("unit")), table.column("copies").to_numpy()
        lists = [np.array(v, np.int64) for v in table.column("near").to_pylist()]
        size = np.array([len(v) for v in lists])
        flat, owner = np.concatenate(lists), np.repeat(np.arange(len(ids)), size)
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here = ids[at] == flat
        at, owner = at[here], owner[here]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        graph = np.full((len(ids), int(place.max(initial=0)) + 1), -1, np.int64)
        graph[owner, place] = at
        queries = np.flatnonzero(member)
        mean = x[queries].sum(axis=0)
        medoid = int(queries[np.argmax(x[queries] @ mean)])
        parent = np.arange(len(ids))
        held = [v or [] for v in table.column("dense").to_pylist()]
        dense = [np.array([d in v for v in held]) for d in sorted(set().union(*held))]
        out, pairs = {"node": [], "found": [], "copies": []}, [np.zeros(0, np.int64)]
        for block in np.array_split(queries, max(1, -(-len(queries) * len(ids) // 4_000_000))):
            q, hit = _range_search(x, graph, block, medoid, threshold)
            q = block[q]
            _join(parent, q, hit)
            for inside in dense:  # counted there
                apart = ~(inside[q] & inside[hit])
                q, hit = q[apart], hit[apart]
            pairs += [q * len(ids) + hit, hit * len(ids) + q]  # what one of two vectors finds, both have
        q, hit = np.divmod(np.unique(np.concatenate(pairs)), len(ids))
        own, start = np.unique(q, return_index=True)
        for i, part in zip(own.tolist(), np.split(hit, start[1:]), strict=False):
            out["node"].append(int(ids[i]))
            out["found"].append(ids[part].tolist())
            out["copies"].append(copies[part].tolist())
        roots = {int(ids[i]): int(ids[_top(parent, i)]) for i in range(len(ids)) if parent[i] != i}
        extra = [n for n in roots if n not in set(out["node"])]
        nodes = out["node"] + extra
        return pa.table(
            {
                "node": pa.array(nodes, pa.int64()),
                "root": pa.array([roots.get(n, n) for n in nodes], pa.int64()),
                "found": pa.array(out["found"] + [[]] * len(extra), pa.list_(pa.int64())),
                "copies": pa.array(out["copies"] + [[]] * len(extra), pa.list_(pa.int64())),
            }
        )

    return search


def _top(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the trees of all pairs, by steps of minimum labels."""
    while True:
        label = parent.copy()
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        parent[:] = label
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, before[a], low)
        np.minimum.at(parent, before[b], low)
        if (parent == before).all():
            return


def _range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query's place, vector) of all vectors found within range, queries themselves left out. All queries step together."""
    n, seen = len(queries), np.zeros((len(queries), len(x)), bool)
    pool, score = np.full((n, BEAM), -1, np.int64), np.full((n, BEAM), -np.inf)
    spent = np.zeros((n, BEAM), bool)
    pool[:, 0], score[:, 0] = start, x[queries] @ x[start]
    pool[:, 1], score[:, 1] = queries, np.where(queries == start, -np.inf, 1.0)  # a query is a vector of the graph: its own lists are known
    seen[:, start] = seen[np.arange(n), queries] = True
    hits_q, hits_v = [np.flatnonzero(score[:, 0] >= threshold), np.arange(n)], [np.full(int((score[:, 0] >= threshold).sum()), start), queries]

    def look(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unseen neighbours of v for the queries at q, with their cosines."""
        near = graph[v]
        q = np.repeat(q, near.shape[1])
        near = near.reshape(-1)
        q, near = q[near >= 0], near[near >= 0]
        fresh = ~seen[q, near]
        key = np.unique(q[fresh] * len(x) + near[fresh])
        q, near = key // len(x), key % len(x)
        seen[q, near] = True
        cosine = np.empty(len(q))
        for i in range(0, len(q), 100_000):
            cosine[i : i + 100_000] = np.einsum("ij,ij->i", x[queries[q[i : i + 100_000]]], x[near[i : i + 100_000]])
        inside = cosine >= threshold
        hits_q.append(q[inside])
        hits_v.append(near[inside])
        return q, near, cosine

    while True:
        open_ = np.where(spent | (pool < 0), -np.inf, score)
        best = open_.argmax(axis=1)
        live = np.flatnonzero(open_[np.arange(n), best] > -np.inf)
        if not len(live):
            break
        spent[live, best[live]] = True
        q, near, cosine = look(live, pool[live, best[live]])
        if not len(q):
            continue
        rows, inverse = np.unique(q, return_inverse=True)
        place = np.arange(len(q)) - np.searchsorted(q, q)
        wide = np.full((len(rows), int(place.max()) + 1), -1, np.int64)
        wide_score = np.full(wide.shape, -np.inf)
        wide[inverse, place], wide_score[inverse, place] = near, cosine
        ids, scores = np.hstack((pool[rows], wide)), np.hstack((score[rows], wide_score))
        used = np.hstack((spent[rows], np.zeros(wide.shape, bool)))
        top = np.argsort(-scores, axis=1, kind="stable")[:, :BEAM]
        pool[rows], score[rows], spent[rows] = (np.take_along_axis(m, top, 1) for m in (ids, scores, used))
    # range expansion: everything within range is expanded, whether the beam kept it or not
    edge_q, edge_v = np.concatenate(hits_q), np.concatenate(hits_v)
    while len(edge_q):
        new_q, new_v = [], []
        for i in range(0, len(edge_q), 20_000):
            done = len(hits_q)
            look(edge_q[i : i + 20_000], edge_v[i : i + 20_000])
            new_q += hits_q[done:]
            new_v += hits_v[done:]
        edge_q, edge_v = np.concatenate(new_q), np.concatenate(new_v)
    pairs = np.unique(np.concatenate(hits_q) * len(x) + np.concatenate(hits_v))
    q, v = pairs // len(x), pairs % len(x)
    other = queries[q] != v
    return q[other], v[other]


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stage_table(spark, rows.mapInArrow(_unit_rows, "vec_id long, shard string, digest string, unit binary"), "units")
    nodes = rows.where("shard is not null").groupBy("shard", "digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    return rows, stage_table(spark, nodes, "nodes")


def found_links(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, root, found, copies) from every shard's search, and dense shards (shard, node, copies, unit), whose pairs these leave out."""
    spark = nodes.sparkSession
    shards, dense = (stage_table(spark, t, "shards") for t in shards_of(nodes.select("shard", "node", "copies", "unit"), threshold))
    # a vector within range of a member's link is at an angle of twice the threshold's at most
    lists = shards.groupBy("shard").applyInArrow(_build(2 * threshold**2 - 1), "node long, near array<long>, close array<long>")
    merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    united = stage_table(spark, lists.groupBy("node").agg(merged("near"), merged("close")), "graph")
    held = dense.groupBy("node").agg(F.collect_set("shard").alias("dense"))
    known = stage_table(spark, nodes.select("node", "copies", "unit").join(united.select("node", "near"), "node").join(held, "node", "left"), "known")
    members = shards.select("shard", "node", F.lit(True).alias("member"))
    around = shards.select("shard", "node").join(united, "node").select("shard", F.explode("close").alias("node")).distinct().withColumn("member", F.lit(False))
    wanted = members.union(around).groupBy("shard", "node").agg(F.max("member").alias("member"))
    return wanted.join(known, "node").groupBy("shard").applyInArrow(_search(threshold), "node long, root long, found array<long>, copies array<long>"), dense


def dedup_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows, nodes = _classes(vectors)
    found, dense = found_links(nodes, threshold)
    found, exact = stage_table(spark, found, "found"), stage_table(spark, dense_links(dense, threshold), "exact")
    labels = stars(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(exact.select("node", "root")))
    # each other once, and besides it the copies of those that have any: arrays of numbers are made distinct by hashing, of pairs by comparing all
    several = F.filter(F.arrays_zip("found", "copies"), lambda p: p["copies"] > 1)
    several = F.array_distinct(F.flatten(F.collect_list(several)))
    once = F.size(F.array_distinct(F.flatten(F.collect_list("found")))).cast("long")
    counts = found.groupBy("node").agg((once + F.aggregate(several, F.lit(0).cast("long"), lambda s, p: s + p["copies"] - 1)).alias("others"))
    counts = counts.union(exact.select("node", "others")).groupBy("node").agg(F.sum("others").alias("others"))
    classes = nodes.select("shard", "digest", "node", "copies").join(counts, "node", "left").join(labels, "node", "left")
    joined = rows.select("vec_id", "shard", "digest").join(classes, ["shard", "digest"], "left")
    component = F.coalesce("component", "node", "vec_id")
    return joined.select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def audit_recall(vectors: DataFrame, threshold: float = 0.93, every: int = 20) -> DataFrame:
    """One row: links of the queries (vec_id divisible by every) by brute force in blocks, and how many of them the graph found."""
    rows, nodes = _classes(vectors)
    found, dense = found_links(nodes, threshold)
    held = dense.groupBy("node").agg(F.collect_set("shard").alias("dense"))
    got = found.select("node", F.explode("found").alias("other")).distinct()
    queries = rows.where(f"shard is not null and vec_id % {every} = 0").select("shard", "digest").join(nodes, ["shard", "digest"]).select("shard", "node", "unit").distinct()
    queries = stage_table(vectors.sparkSession, queries, "queries")

    def brute(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = [[], []]
        if len(left) and len(right):
            a, b, q = left.column("node").to_numpy(), right.column("node").to_numpy(), _matrix(left.column("unit"))
            for i in range(0, len(b), 8192):
                x, y = np.nonzero(q @ _matrix(right.column("unit").slice(i, 8192)).T >= threshold)
                pairs[0] += a[x].tolist()
                pairs[1] += b[y + i].tolist()
        return pa.table({"node": pa.array(pairs[0], pa.int64()), "other": pa.array(pairs[1], pa.int64())})

    parts = shuffle_parts(vectors.sparkSession)
    spread = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = nodes.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))
    truth = spread.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(brute, "node long, other long").where("node <> other")
    hit = truth.join(got.withColumn("hit", F.lit(True)), ["node", "other"], "left").join(held, "node", "left").join(held.toDF("other", "dense_too"), "other", "left")
    known = F.coalesce("hit", F.arrays_overlap("dense", "dense_too"), F.lit(False))
    return hit.agg(F.count("*").alias("links"), F.count_if(known).alias("found"))
