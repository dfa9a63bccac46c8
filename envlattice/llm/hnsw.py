"""Near-duplicate vectors by navigable small-world graphs, one a shard."""

from __future__ import annotations

import pickle
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written
from .components import components

#: Distinct vectors of a shard. A pair of shards is one task: two graphs and a table of so many squared bits.
SHARD = 8192
#: Links of a node above the ground and on it, and beams while a graph is built and at a query's start.
M, M0, BUILD_BEAM, BEAM = 12, 24, 48, 32
#: Queries of each kind that a task audits against brute force, and the share of their links that must be found.
AUDIT, RECALL = 256, 0.99
#: How far below the threshold a search that is among links goes on from node to node.
MARGIN = 0.02


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, by cosine."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.exact = vectors / norms
        self.v = self.exact.astype(np.float32)
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        self.levels = np.floor(-np.log(1 - draws) / np.log(M)).astype(int)
        self.adjacent: list[dict[int, list[int]]] = [{} for _ in range(int(self.levels.max(initial=0)) + 1)]
        self.entry, self.top = -1, -1
        for i in range(n):
            self._insert(i)

    def _beam(self, q: np.ndarray, entries: list[int], width: int, adjacent: dict) -> list[tuple[float, int]]:
        """(cosine, node) of the best ``width`` nodes that a best-first search comes upon, best first."""
        v, seen = self.v, set(entries)
        todo: list[tuple[float, int]] = []
        best: list[tuple[float, int]] = []
        for s, x in zip((v[entries] @ q).tolist(), entries, strict=True):
            heappush(todo, (-s, x))
            heappush(best, (s, x))
        while len(best) > width:
            heappop(best)
        while todo:
            s, x = heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            around = [y for y in adjacent[x] if y not in seen]
            if not around:
                continue
            seen.update(around)
            for s, y in zip((v[around] @ q).tolist(), around, strict=True):
                if len(best) < width:
                    heappush(best, (s, y))
                    heappush(todo, (-s, y))
                elif s > best[0][0]:
                    heappop(best)
                    heappush(best, (s, y))
                    heappush(todo, (-s, y))
        return sorted(best, reverse=True)

    def _choose(self, ranked: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in order of nearness, but none that is nearer to one chosen before; the nearest fill up the rest."""
        nodes = [x for _, x in ranked]
        if len(nodes) <= most:
            return nodes
        among = self.v[nodes] @ self.v[nodes].T
        chosen: list[int] = []
        nearest = np.full(len(nodes), -2.0, np.float32)
        for i, (s, _) in enumerate(ranked):
            if s >= nearest[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.maximum(nearest, among[i], out=nearest)
        if len(chosen) < most:
            have = set(chosen)
            chosen += [i for i in range(len(nodes)) if i not in have][: most - len(chosen)]
        return [nodes[i] for i in chosen]

    def _insert(self, i: int) -> None:
        level, q = int(self.levels[i]), self.v[i]
        if self.entry < 0:
            for layer in range(level + 1):
                self.adjacent[layer][i] = []
            self.entry, self.top = i, level
            return
        entries = [self.entry]
        for layer in range(self.top, level, -1):
            entries = [self._beam(q, entries, 1, self.adjacent[layer])[0][1]]
        for layer in range(min(level, self.top), -1, -1):
            adjacent, most = self.adjacent[layer], M0 if layer == 0 else M
            found = self._beam(q, entries, BUILD_BEAM, adjacent)
            adjacent[i] = self._choose(found, M)
            for x in adjacent[i]:
                around = adjacent[x]
                around.append(i)
                if len(around) > most + 8:
                    s = self.v[around] @ self.v[x]
                    ranked = [(float(s[k]), around[k]) for k in np.argsort(-s, kind="stable")]
                    adjacent[x] = self._choose(ranked, most)
            entries = [x for _, x in found]
        for layer in range(self.top + 1, level + 1):
            self.adjacent[layer][i] = []
        if level > self.top:
            self.entry, self.top = i, level

    def near(self, q: np.ndarray, threshold: float, beam: int) -> np.ndarray:
        """Nodes whose cosine to the unit vector ``q`` is at least ``threshold`` in double precision, as far as found.

        A beam search leads to the region; from the links found there the search spreads to all neighbours that are
        near the threshold, so a query's links may be far more than its beam.
        """
        low, entries = q.astype(np.float32), [self.entry]
        for layer in range(self.top, 0, -1):
            entries = [self._beam(low, entries, 1, self.adjacent[layer])[0][1]]
        ground = self.adjacent[0]
        front = [x for s, x in self._beam(low, entries, beam, ground) if s >= threshold - MARGIN]
        seen = set(front)
        hits = list(front)
        while front:
            around = list({y for x in front for y in ground[x]} - seen)
            if not around:
                break
            seen.update(around)
            s = self.v[around] @ low
            front = [around[k] for k in np.flatnonzero(s >= threshold - MARGIN)]
            hits += front
        nodes = np.array(sorted(hits), np.int64)
        return nodes[self.exact[nodes] @ q >= threshold] if len(nodes) else nodes


def exact(queries: np.ndarray, graph: Graph, threshold: float) -> list[np.ndarray]:
    """Links of every query by brute force, in blocks."""
    blocks = (queries[i : i + AUDIT] @ graph.exact.T >= threshold for i in range(0, len(queries), AUDIT))
    return [np.flatnonzero(row) for block in blocks for row in block]


def probes(graph: Graph, threshold: float) -> np.ndarray:
    """AUDIT unit vectors that have a link each: vectors of the graph, turned by angles up to that of the threshold."""
    n, dim = graph.exact.shape
    rng = np.random.default_rng(n)
    near = graph.exact[rng.choice(n, AUDIT)]
    away = rng.normal(size=near.shape)
    away -= (away * near).sum(axis=1, keepdims=True) * near
    size = np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(threshold + (1 - threshold) / 100, 1, (AUDIT, 1))
    turned = cosine * near + np.sqrt(1 - cosine**2) * away / np.where(size > 0, size, 1)
    return np.where(size > 1e-9, turned, near)


def search(queries: np.ndarray, graph: Graph, threshold: float, same: bool = False) -> tuple[list[np.ndarray], int, tuple[int, int]]:
    """Links of every query (unit vectors), by a beam that is widened until the audit finds RECALL of them; the beam; and
    how many links were audited and how many of those found.

    The audit compares what the search finds with brute force over the shard for two kinds of vectors: AUDIT of the queries, drawn
    at random, and AUDIT made by ``probes``, which have links even where queries hardly do. With ``same`` the queries are the
    graph's own vectors, and a vector's match with itself is no link. Where no beam passes, brute force is the result.
    """
    n = len(queries)
    some = np.random.default_rng(n).permutation(n)[:AUDIT]
    real = queries[some] @ graph.exact.T >= threshold
    if same:
        real[np.arange(len(some)), some] = False
    made = probes(graph, threshold)
    truth = np.concatenate([real, made @ graph.exact.T >= threshold])
    audited = [(q, t) for q, t in zip(np.concatenate([queries[some], made]), truth, strict=True) if t.any()]
    total, beam = sum(int(t.sum()) for _, t in audited), BEAM
    while beam < len(graph.exact):
        found = sum(int(t[graph.near(q, threshold, beam)].sum()) for q, t in audited)
        if found >= RECALL * total:
            return [graph.near(q, threshold, beam) for q in queries], beam, (total, found)
        beam *= 2
    return exact(queries, graph, threshold), len(graph.exact), (total, total)


def link(a: Graph, b: Graph | None, threshold: float) -> tuple[np.ndarray, tuple[int, int]]:
    """Which vectors of ``a`` link with which of ``b`` (or of ``a`` itself), found from either side; and the audit's counts."""
    other = a if b is None else b
    found = np.zeros((len(a.exact), len(other.exact)), bool)
    hits, _, (total, seen) = search(a.exact, other, threshold, same=b is None)
    for i, of_i in enumerate(hits):
        found[i, of_i] = True
    if b is None:
        found |= found.T
        np.fill_diagonal(found, False)
    else:
        hits, _, (more, also) = search(b.exact, a, threshold)
        total, seen = total + more, seen + also
        for j, of_j in enumerate(hits):
            found[of_j, j] = True
    return found, (total, seen)


def forest(found: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Enough of the links (row, column) to connect what all of them connect."""
    n = len(found)
    group = np.arange(n if same else n + found.shape[1])
    shift = 0 if same else n
    edges = []
    for i in range(n):
        hits = np.flatnonzero(found[i])
        if not len(hits):
            continue
        groups, first = np.unique(group[hits + shift], return_index=True)
        joined = groups[groups != group[i]]
        edges += [(i, int(hits[k])) for g, k in zip(groups, first, strict=True) if g != group[i]]
        if len(joined):
            group[np.isin(group, joined)] = group[i]
    return edges


_KEYS = ["label", "dim"]


def _build(table: pa.Table) -> pa.Table:
    ids = table["node"].to_numpy()
    order = np.argsort(ids, kind="stable")
    vectors = np.array(table["vector"].combine_chunks().flatten()).reshape(len(ids), -1)[order]
    graph = Graph(vectors.astype(np.float64), seed=int(table["shard"][0].as_py()))
    blob = pickle.dumps((ids[order], table["n"].to_numpy()[order], graph), protocol=5)
    return pa.table({c: table[c][:1] for c in [*_KEYS, "shard", "shards"]} | {"index": pa.array([blob], pa.large_binary())}).cast(
        pa.schema([("label", table["label"].type), ("dim", pa.int32()), ("shard", pa.int32()), ("shards", pa.int32()), ("index", pa.binary())])
    )


def _pair(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        sides = sorted(zip(table["shard"].to_pylist(), table["index"].to_pylist(), strict=True), key=lambda x: x[0])
        loaded = [pickle.loads(blob) for _, blob in sides]
        (ids, n, a), (other_ids, other_n, b) = loaded[0], loaded[-1]
        same = len(loaded) == 1
        found, (total, seen) = link(a, None if same else b, threshold)
        # a node's links, or a link between nodes, or what the audit counted
        out = list(zip(ids.tolist(), (found @ other_n).tolist(), [None] * len(ids), strict=True))
        if not same:
            out += zip(other_ids.tolist(), (n @ found).tolist(), [None] * len(other_ids), strict=True)
        out = [x for x in out if x[1]]
        out += [(int(ids[i]), 0, int(other_ids[j])) for i, j in forest(found, same)]
        out = [(None, total, seen), *out]
        columns = list(zip(*out, strict=True))
        names = ["node", "links", "other"]
        keys = {c: pa.chunked_array([pa.repeat(table[c][0], len(out))]) for c in _KEYS}
        return pa.table(keys | {name: pa.array(c, pa.int64()) for name, c in zip(names, columns, strict=True)})

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    shard: int | None = None,
) -> DataFrame:
    """(id, n_links, component, kept, recall) for every row, comparing rows of one label and one number of components.

    Equal vectors of a label are one node, with their number; the nodes of a label are dealt to shards of at most about SHARD,
    each with a graph, and every node asks every shard, from either side of each pair of shards. ``n_links`` counts the
    other rows of cosine ``threshold`` or more that were found, ``component`` is the smallest id that links lead to, and
    a row is kept if that is its own. ``recall`` is the share of links that the audits of the row's label found. Null labels,
    and vectors that are null, empty, zero or hold null or non-finite components, link with nothing. Nodes are no ids: rows of
    one id but of other labels or vectors are rows like any others, and those of a null id take part but give no component its
    name. A row that occurs again links with itself. An empty table gives none, and no other column is read.
    """
    parts = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), parts.alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & sound & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.coalesce(usable, F.lit(False)), F.col("vector")))
    valid = rows.where("vector is not null").withColumn("dim", F.size("vector"))
    distinct = valid.groupBy(*_KEYS, "vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    size = shard or SHARD
    shards = distinct.groupBy(*_KEYS).agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("shards"))
    dealt = distinct.join(shards, _KEYS).withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    kind = rows.schema["label"].dataType.simpleString()
    index = written(
        dealt.groupBy(*_KEYS, "shard").applyInArrow(_build, f"label {kind}, dim int, shard int, shards int, index binary"),
        "graphs",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    sides = index.withColumn("other", other).withColumns({"low": F.least("shard", "other"), "high": F.greatest("shard", "other")})
    found = written(
        sides.groupBy(*_KEYS, "low", "high").applyInArrow(_pair(threshold), f"label {kind}, dim int, node long, links long, other long"),
        "found",
    )
    forget(index)
    audits = found.where("node is null").groupBy(*_KEYS).agg((F.sum("other") / F.sum("links")).alias("recall"))
    linked = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(
        found.where("node is not null and other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    )
    best = joined.join(distinct.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("name"))
    named = joined.join(best, "component").select("node", "name")
    groups = (
        distinct.join(linked, "node", "left")
        .join(named, "node", "left")
        .select(
            *_KEYS, "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("name", "least").alias("component"),
        )
    )
    out = valid.join(groups, [*_KEYS, "vector"]).join(audits, _KEYS, "left").select("id", "n_links", "component", "recall")
    alone = rows.where("vector is null").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(None).cast("double").alias("recall")
    )
    out = out.unionAll(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
    return out.select("id", "n_links", "component", "kept", "recall")
