"""Embedding near-dedup over a robust-pruned flat graph.

Vectors are dealt to overlapping shards: each goes to the OVERLAP nearest of its label's
centroids. A shard that gets more than LARGE vectors is dealt again to centroids of its own, level by level, so shards
stay small at any number of vectors. Each shard builds a flat proximity graph by robust pruning: a vector takes its
nearest candidate and drops the others that are ALPHA times closer to it than to
the vector. Components of the graph are joined by their nearest pairs. A vector's adjacency lists of
all its shards are united. Then each shard searches the united graph for each of its vectors: greedily
from the vector itself and the shard's medoid with a beam, and once vectors in range turn up, onward
through all vectors near the range. Links are verified in double precision.

A shard whose search misses too much of a sample is compared in exact blocks instead. So is a large shard that
centroids would cut through its links, such as one great group of near copies: its blocks are dealt to tasks as pairs of chunks. An audit
compares a bounded sample of vectors with all rows; where it finds less than LEAST_RECALL of their links, vectors are dealt to twice as many
shards, and in the end labels are compared in exact blocks as a whole.

Equal vectors are one node with a count, so copies of any number cost one node. Pairs don't leave
their shard: it returns link counts and a spanning forest of the links. A pair that
shares several shards counts in the first of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vframe.llm.common import addressed, attach, components, discard, written

COSINE = 0.98
#: Vectors that centroids are fitted on, at most, of all and of a large shard; every vector is indexed.
SAMPLE, SHARD_SAMPLE = 32_768, 4096
#: Vectors a centroid should get, vectors from which on a shard is dealt again, and centroids that it is dealt to at most.
SHARD, LARGE, SPLIT = 768, 3072, 64
#: Shards that each vector goes to, at first and at most.
OVERLAP, MOST_OVERLAP = 2, 8
#: Vectors that one task deals again at once, and those of a chunk in exact blocks.
DEAL, CHUNK = 32_768, 2048
#: The share of a large shard's sampled links that dealing it again may not fall below.
LEAST_SHARED = 0.95
#: Candidates, neighbours and slack of robust pruning; beam of the search.
CANDIDATES, DEGREE, ALPHA, BEAM = 64, 32, 1.2, 32
#: How far below the range a vector may lie for the search to go on through it.
SLACK = 0.06
#: Vectors that the audit compares with all rows, at most.
AUDIT = 256
#: Vectors of a shard whose search is compared with the whole shard, and the mean recall below which exact blocks replace it.
PROBES, LEAST_RECALL = 64, 0.9

DEALT = "shard string, id long, n long, vec array<double>"
LINKS = "a long, b long, n long"


def _unit(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
    x /= np.abs(x).max(1, keepdims=True)  # against overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(10):
        nearest = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-30), centres)
    return centres


def fit_centroids(nodes: DataFrame) -> dict[str, np.ndarray]:
    """Centroids by partition (label and dimension), from at most SAMPLE vectors."""
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("part", "vec").toArrow()
    if not sample.num_rows:
        return {}
    total = nodes.count()
    out = {}
    names = np.array(sample.column("part").to_pylist(), object)
    for part in sorted(set(names)):
        mine = sample.filter(pa.array(names == part))
        size = total * mine.num_rows / sample.num_rows
        k = int(min(max(1, -(-size // SHARD)), max(1, mine.num_rows // 8)))
        out[part] = _centroids(_unit(mine.column("vec")), k)
    return out


def _bridges(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Edges that join the components of a graph: in each round every component takes its nearest outsider."""
    m, out = len(x), [np.zeros((0, 2), np.int64)]
    root = list(range(m))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    fresh = edges
    while True:
        for a, b in fresh.tolist():
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        group = np.array([top(i) for i in range(m)])
        if not group.any():
            return np.concatenate(out)
        best, mate = np.empty(m, x.dtype), np.empty(m, np.int64)
        for at in range(0, m, 256):
            sims = x[at : at + 256] @ x.T
            sims[group[at : at + 256, None] == group] = -2
            mate[at : at + 256] = sims.argmax(1)
            best[at : at + 256] = sims.max(1)
        order = np.lexsort((-best, group))
        first = order[np.unique(group[order], return_index=True)[1]]
        fresh = np.stack([first, mate[first]], 1)
        out.append(fresh)


def _pruned(x: np.ndarray) -> list[np.ndarray]:
    """The robust-pruned graph of a shard, both directions of each edge."""
    m = len(x)
    width = min(CANDIDATES, m - 1)
    edges = [np.zeros((0, 2), np.int64)]
    if width < 1:
        return [np.zeros(0, np.int64)] * m
    for at in range(0, m, 256):
        rows = np.arange(at, min(m, at + 256))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        order = np.take_along_axis(sims, near, 1).argsort(1)[:, ::-1]
        near = np.take_along_axis(near, order, 1)
        far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, 1)))
        mutual = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bld,bkd->blk", x[near], x[near], optimize=True)))
        alive = np.ones(near.shape, bool)
        each = np.arange(len(rows))
        for _ in range(min(DEGREE, width)):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            edges.append(np.stack([rows[some], near[each, first][some]], 1))
            alive &= ALPHA * mutual[each, first] > far
            alive[each, first] = False
    both = np.concatenate([*edges, _bridges(x, np.concatenate(edges))])
    both = np.unique(np.concatenate([both, both[:, ::-1]]), axis=0)
    return np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, m)))


def _in_range(x: np.ndarray, adjacency: list[np.ndarray], start: int, q: int, cosine: float) -> list[int]:
    """Range-expanding greedy search, from rows q and ``start``, for the rows within ``cosine`` of row q."""
    query = x[q]
    near = {v: float(x[v] @ query) for v in (q, start)}
    todo = sorted((-s, v) for v, s in near.items())
    best = sorted(near.values())  # a heap of the beam's similarities
    while todo:
        sim, node = heapq.heappop(todo)
        if len(best) >= BEAM and -sim < best[0] and -sim < cosine - SLACK:
            break
        fresh = [v for v in adjacency[node].tolist() if v not in near]
        if not fresh:
            continue
        for v, s in zip(fresh, (x[fresh] @ query).tolist(), strict=True):
            near[v] = s
            if s >= cosine - SLACK or len(best) < BEAM or s > best[0]:
                heapq.heappush(todo, (-s, v))
                heapq.heappush(best, s)
                if len(best) > BEAM:
                    heapq.heappop(best)
    return [v for v, s in near.items() if s >= cosine - 1e-5 and v != q]


def _build(members: pa.Table) -> pa.Table:
    ids = members.column("id").to_numpy()
    order = ids.argsort()
    graph = _pruned(_unit(members.column("vec"))[order].astype(np.float32))
    ids = ids[order]
    return pa.table({"id": ids, "near": pa.array([ids[g] for g in graph], pa.list_(pa.int64()))})


def _links(members: pa.Table, exact: np.ndarray, found: np.ndarray, cosine: float) -> pa.Table:
    """Verified link counts (a, null, n) and a spanning forest (a, b, null) of the pairs that a matrix marks."""
    ids, copies = members.column("id").to_numpy(), members.column("n").to_numpy()
    for at in range(0, len(ids), 512):
        found[at : at + 512] &= exact[at : at + 512] @ exact.T >= cosine
    found |= found.T
    a, b, n = [], [], []
    rest = np.arange(len(ids))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = found[x, rest]
            fresh = rest[near]
            a += [int(ids[x])] * len(fresh)
            b += ids[fresh].tolist()
            front += fresh.tolist()
            rest = rest[~near]
    n += [None] * len(a)
    here, shared = members.column("shard")[0].as_py(), {}
    for i, names in enumerate(members.column("shards").to_pylist()):
        for name in names:
            if name < here:
                shared.setdefault(name, []).append(i)
    for some in shared.values():  # these pairs count in an earlier shard
        found[np.ix_(some, some)] = False
    counts = np.concatenate([found[at : at + 512] @ copies for at in range(0, len(ids), 512)])
    linked = np.flatnonzero(counts)
    a += ids[linked].tolist()
    b += [None] * len(linked)
    n += counts[linked].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def _search(members: pa.Table, cosine: float) -> pa.Table:
    """The links of a shard by searches of the united graph, or by exact blocks where a sample shows that they miss too much."""
    members = members.sort_by("id")
    ids = members.column("id").to_numpy()
    exact = _unit(members.column("vec"))
    x = exact.astype(np.float32)
    united = []
    for near in members.column("near").to_pylist():
        at = np.searchsorted(ids, near)
        at = np.minimum(at, len(ids) - 1)
        united.append(at[ids[at] == np.array(near)] if len(near) else np.zeros(0, np.int64))
    medoid = int((x @ x.mean(0)).argmax())
    probes = np.unique(np.linspace(0, len(ids) - 1, PROBES).astype(int))
    true = [set(np.flatnonzero(x @ x[q] >= cosine).tolist()) - {q} for q in probes]
    shares = [len(t.intersection(_in_range(x, united, medoid, q, cosine))) / len(t) for q, t in zip(probes, true, strict=True) if t]
    if shares and np.mean(shares) < LEAST_RECALL:
        found = np.ones((len(ids), len(ids)), bool)
    else:
        found = np.zeros((len(ids), len(ids)), bool)
        for q in range(len(ids)):
            found[q, _in_range(x, united, medoid, q, cosine)] = True
        found |= found.T
    np.fill_diagonal(found, False)
    return _links(members, exact, found, cosine)


def _compare(members: pa.Table, cosine: float) -> pa.Table:
    """The links between two chunks of a shard, or within one, by exact comparison."""
    chunk = members.column("c").to_numpy()
    both = members.column("c1")[0].as_py() != members.column("c2")[0].as_py()
    found = chunk[:, None] != chunk if both else ~np.eye(len(chunk), dtype=bool)
    return _links(members, _unit(members.column("vec")), found, cosine)


def _nodes(vectors: DataFrame, row: str, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(row, vec_id, part, vec): label and dimension as one key; vectors that link with nothing have a null part. A negative zero becomes zero."""
    vec = F.transform(F.col(vec_col).cast("array<double>"), lambda v: v + F.lit(0.0))
    sound = F.col(label_col).isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    part = F.concat_ws("|", F.col(label_col).cast("string"), F.size("vec").cast("string"))
    plain = vectors.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col), vec.alias("vec"))
    return plain.select("row", "vec_id", F.when(sound, part).alias("part"), "vec")


def recall(nodes: DataFrame, counts: DataFrame, cosine: float = COSINE) -> float:
    """The share of true links that ``counts`` (id, n_links) has, for at most AUDIT nodes against all."""
    sample = nodes.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(AUDIT).select("id", "part", "vec", "n").toArrow()
    if not sample.num_rows:
        return 1.0
    ids = sample.column("id").to_numpy()
    parts = np.array(sample.column("part").to_pylist(), object)
    queries = {p: (ids[parts == p], _unit(sample.filter(pa.array(parts == p)).column("vec"))) for p in set(parts)}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, mine, n = (batch.column(c) for c in ("part", "id", "n"))
            out_ids, out_n = [], []
            names = np.array(names.to_pylist(), object)
            for p in set(names) & set(queries):
                rows = np.flatnonzero(names == p)
                some, q = queries[p]
                hit = _unit(batch.column("vec").take(pa.array(rows))) @ q.T >= cosine
                hit &= mine.to_numpy()[rows][:, None] != some
                out_ids += some.tolist()
                out_n += (hit * n.to_numpy()[rows][:, None]).sum(0).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out_n, pa.int64())], names=["id", "true"])

    true = nodes.select("id", "part", "vec", "n").mapInArrow(compare, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    both = true.join(counts, "id", "left").agg(F.sum("true"), F.sum(F.coalesce("n_links", F.lit(0)))).first()
    return both[1] / both[0] if both[0] else 1.0


def _nearest(x: np.ndarray, centres: np.ndarray, overlap: int) -> np.ndarray:
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :overlap]


def _dealt(nodes: DataFrame, overlap: int) -> DataFrame:
    """The nodes in their shards by centroids of a sample of all."""
    centroids = fit_centroids(nodes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("part").to_pylist(), object)
            for p in set(names):
                mine = batch.filter(pa.array(names == p))
                centres = centroids.get(p)
                alone = centres is None or len(centres) == 1
                near = np.zeros((mine.num_rows, 1), int) if alone else _nearest(_unit(mine.column("vec")), centres, overlap)
                yield _copied(mine, near, p)

    return nodes.mapInArrow(deal, DEALT)


def _copied(members: pa.RecordBatch | pa.Table, near: np.ndarray, prefix: str) -> pa.RecordBatch:
    back = np.repeat(np.arange(members.num_rows), near.shape[1])
    take = members.take(pa.array(back))
    columns = [take.column(c) for c in ("id", "n", "vec")]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([f"{prefix}|{c}" for c in near.ravel()], pa.string()), *columns], names=["shard", "id", "n", "vec"])


def _refined(members: DataFrame, overlap: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(small shards, large ones that centroids would cut through their links, with their size)."""

    def plan(sample: pa.Table) -> pa.Table:
        """Centroids of a large shard as one list; null where they would part linked vectors or gain nothing."""
        x, size = _unit(sample.column("vec")), sample.column("size")[0].as_py()
        centres = _centroids(x, int(max(2, min(SPLIT, -(-size // SHARD), len(x) // 8))))
        cells = np.zeros((len(x), len(centres)), np.float32)
        np.put_along_axis(cells, _nearest(x, centres, overlap), 1, 1)
        y = x.astype(np.float32)
        linked = kept = 0
        for at in range(0, len(x), 512):
            near = y[at : at + 512] @ y.T >= cosine
            near[np.arange(len(near)), at + np.arange(len(near))] = False
            linked += int(near.sum())
            kept += int((near & (cells[at : at + 512] @ cells.T > 0)).sum())
        useless = kept < LEAST_SHARED * linked or cells.sum(0).max() > 0.9 * len(x)
        return pa.table({"shard": sample.column("shard")[:1], "centres": pa.array([None if useless else centres.ravel()], pa.list_(pa.float64()))})

    def deal(members: pa.Table, plans: pa.Table) -> pa.Table:
        if not members.num_rows:
            return pa.table({"shard": pa.array([], pa.string()), "id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float64()))})
        x = _unit(members.column("vec"))
        centres = plans.column("centres")[0].values.to_numpy().reshape(-1, x.shape[1])
        return pa.Table.from_batches([_copied(members, _nearest(x, centres, overlap), members.column("shard")[0].as_py())])

    small, dense = [], []
    while True:
        sizes = members.groupBy("shard").agg(F.count("*").alias("size"))
        large = written(sizes.where(F.col("size") > LARGE))
        if large.isEmpty():
            small.append(members)
            break
        inside = members.join(large, "shard", "left")
        small.append(inside.where("size is null").drop("size"))
        big = written(inside.where("size is not null"))
        share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(SHARD_SAMPLE * float(1 << 30)) / F.col("size")
        plans = written(big.where(share).groupBy("shard").applyInArrow(plan, "shard string, centres array<double>"))
        cut = plans.where("centres is not null")
        dense.append(big.join(cut, "shard", "left_anti"))
        deals = F.ceil(F.col("size") / DEAL).cast("int")
        left = big.join(cut.select("shard"), "shard", "left_semi").withColumn("deal", F.pmod(F.xxhash64("id"), deals).cast("int"))
        right = cut.join(large, "shard").select("shard", "centres", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
        members = written(left.groupBy("shard", "deal").cogroup(right.groupBy("shard", "deal")).applyInArrow(deal, DEALT))
    none = members.withColumn("size", F.lit(0).cast("long")).where("false")
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, dense, none)


def _in_blocks(dense: DataFrame, lists: DataFrame, compare: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Links of large shards (with their size): each pair of chunks is a task's work."""
    k = F.ceil(F.col("size") / CHUNK).cast("int")
    dealt = dense.withColumn("c", F.pmod(F.xxhash64(F.lit(3), "id"), k).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), k - 1)))
    pairs = dealt.withColumns({"c1": F.least("c", "j"), "c2": F.greatest("c", "j")}).drop("j", "size")
    return pairs.join(lists, "id").groupBy("shard", "c1", "c2").applyInArrow(compare, LINKS)


def _linked(nodes: DataFrame, overlap: int, cosine: float) -> DataFrame:
    """Link counts (a, null, n) and a spanning forest (a, b, null); without an overlap by exact blocks of whole parts."""
    compare = lambda members: _compare(members, cosine)
    if not overlap:
        sizes = nodes.groupBy("part").agg(F.count("*").alias("size"))
        whole = nodes.join(sizes, "part").select(F.col("part").alias("shard"), "id", "n", "vec", "size")
        return written(_in_blocks(whole, nodes.select("id", F.array("part").alias("shards")), compare))
    small, dense = map(written, _refined(written(_dealt(nodes, overlap)), overlap, cosine))
    lists = small.select("id", "shard").unionByName(dense.select("id", "shard")).groupBy("id").agg(F.collect_set("shard").alias("shards"))
    built = small.groupBy("shard").applyInArrow(_build, "id long, near array<long>")
    united = built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    search = lambda table: _search(table, cosine)
    searched = small.join(united.join(lists, "id"), "id").groupBy("shard").applyInArrow(search, LINKS)
    return written(searched.unionByName(_in_blocks(dense, lists, compare)))


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE
) -> DataFrame:
    """Link vectors of equal label at ``cosine`` or more and group what is linked.

    Returns vec_id, n_links (other rows linked directly, copies included), component_id,
    kept and audit_recall (the audit's result, the same in each row), one row for each input row. Components
    and cosines are in double precision, whatever the vectors' type. Vectors
    that are null, empty, zero or hold null or non-finite components, and vectors without a
    label, link with nothing; so do vectors of different dimension. Rows are told apart by their place: those that
    repeat an identifier link by their own vectors, and a row without one takes part, its component being the
    least identifier of its group, null if none has one. No rows give no rows; other columns are ignored.
    """
    vectors, row = addressed(vectors)
    rows = written(_nodes(vectors, row, id_col, vec_col, label_col))
    sound = rows.where("part is not null")
    nodes = written(
        sound.groupBy("part", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id())
    )
    overlap = OVERLAP
    while True:
        found = _linked(nodes, overlap, cosine)
        counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
        known = nodes.join(counts, "id", "left").withColumn("n_links", F.coalesce("others", F.lit(0)))
        audit = recall(nodes, known.select("id", "n_links"), cosine)
        if audit >= LEAST_RECALL or not overlap:
            break
        discard(found)
        overlap = 2 * overlap if overlap < MOST_OVERLAP else 0
    groups = components(found.where("b is not null").select("a", "b"))
    member = known.join(groups, known["id"] == groups["node"], "left").withColumn("group", F.coalesce("component", "id"))
    least = member.groupBy("group").agg(F.min("least").alias("component_id"))
    digest = F.sha2(F.concat_ws("|", "part", F.to_json(F.struct("vec"))), 256)
    links = (F.col("n_links") + F.col("n") - 1).alias("n_links")
    lookup = attach(member.select("id", "group", digest.alias("_key"), links), least, "group", "id").select("_key", "n_links", "component_id")
    keyed = rows.select("row", "vec_id", F.when(F.col("part").isNotNull(), digest).alias("_key"))
    out = attach(keyed, lookup, "_key", "row")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        F.lit(audit).alias("audit_recall"),
    )
