"""Near-duplicate vectors by navigable small-world graphs, one per shard.

Vectors are compared only within a label. Equal vectors form a class first. The classes of a label are cut into shards by
hash; every shard gets a hierarchical small-world graph, and every class searches every shard of its label with a beam.

* Each search task audits itself: for a sample of its queries it compares the links found with those of a scan of the whole
  shard, and widens the beam until the recall reaches ``AUDIT_RECALL``; a beam as wide as the shard is a scan.
* A query whose whole beam links may have more links than the beam holds: it scans the shard. So no group of copies is cut.
* Every link is verified by cosine in double precision. A task returns, for each query, the number of linked vectors and one
  edge to its component among what the task saw, never the pairs of a group; components are joined across tasks.

Defined results: a vector that is null, empty, zero, or holds a null or a non-finite component, or whose label is null, links
with nothing; vectors of different length do not link; rows that repeat a vec_id are vectors of their own and one
node together; a null vec_id links with nothing and keeps a null component_id; an empty table gives an empty result.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.llm.graph import components
from tendermill.llm.store import stored

SHARD, QUERIES = 16_384, 8_192
#: Neighbours of a vector in upper layers (twice as many in the lowest), and the beam while a graph is built.
DEGREE, BUILD_BEAM = 12, 48
BEAM, AUDITED, AUDIT_RECALL = 48, 64, 0.995
_STEP, _BATCH = 4, 512


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors, built and searched for many vectors in step."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], entry: int) -> None:
        self.unit, self.layers, self.entry = unit, layers, entry

    @classmethod
    def built(cls, unit: np.ndarray, seed: int) -> SmallWorld:
        n = len(unit)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(DEGREE)).astype(int)
        graph = cls(unit, [], int(np.argmax(level)))
        graph.layers = [np.full((n, DEGREE * (1 if k else 2)), -1, np.int32) for k in range(level.max() + 1)]
        for k in range(level.max(), -1, -1):
            order = np.argsort(-level, kind="stable")[: (level >= k).sum()]
            order = np.concatenate(([graph.entry], order[order != graph.entry]))
            done = 1
            while done < len(order):
                batch = order[done: done + min(_BATCH, max(1, done))]
                graph._insert(k, batch)
                done += len(batch)
        return graph

    def _insert(self, k: int, batch: np.ndarray) -> None:
        q = self.unit[batch]
        found, near = self._beam(self.layers[k], q, self._descend(q, k), BUILD_BEAM)
        among = q @ q.T
        np.fill_diagonal(among, -2)
        m = min(len(batch), DEGREE)
        top = np.argpartition(-among, m - 1, axis=1)[:, :m]
        found = np.concatenate((found, batch[top]), axis=1)
        near = np.concatenate((near, np.take_along_axis(among, top, 1)), axis=1)
        near[(found == batch[:, None]) | (found < 0)] = -2
        chosen = self._diverse(found, near, DEGREE)
        self.layers[k][batch, :DEGREE] = chosen
        self._link_back(k, batch, chosen)

    def _link_back(self, k: int, batch: np.ndarray, chosen: np.ndarray) -> None:
        layer = self.layers[k]
        to, new = chosen.ravel(), np.repeat(batch, chosen.shape[1])
        to, new = to[to >= 0], new[to >= 0]
        by = np.lexsort((-(self.unit[to] * self.unit[new]).sum(1), to))
        to, new = to[by], new[by]
        node, first, many = np.unique(to, return_index=True, return_counts=True)
        wide = min(int(many.max(initial=0)), 2 * layer.shape[1])
        place = np.arange(len(to)) - np.repeat(first, many)
        more = np.full((len(node), wide), -1, np.int64)
        held = place < wide
        more[np.repeat(np.arange(len(node)), many)[held], place[held]] = new[held]
        found = np.concatenate((layer[node].astype(np.int64), more), axis=1)
        near = np.einsum("bmd,bd->bm", self.unit[found], self.unit[node])
        near[found < 0] = -2
        layer[node] = self._diverse(found, near, layer.shape[1])

    def _diverse(self, found: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
        """Up to ``keep`` of the found, nearest first, leaving out those nearer to a kept one; gaps are filled by the nearest left out."""
        by = np.argsort(-near, axis=1)[:, : 3 * keep]
        found, near = np.take_along_axis(found, by, 1), np.take_along_axis(near, by, 1)
        between = np.einsum("bmd,bnd->bmn", self.unit[found], self.unit[found])
        valid = near > -2
        valid[:, 1:] &= found[:, 1:] != found[:, :-1]
        kept = np.zeros(found.shape, dtype=bool)
        for j in range(found.shape[1]):
            kept[:, j] = valid[:, j] & ~((between[:, j] > near[:, j: j + 1]) & kept).any(1) & (kept.sum(1) < keep)
        rank = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :keep]
        return np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(found, rank, 1), -1)

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """Entry points in layer ``to``."""
        at = np.full((len(q), 1), self.entry)
        for k in range(len(self.layers) - 1, to, -1):
            at = self._beam(self.layers[k], q, at, 4)[0]
        return at

    def _beam(self, layer: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest vectors found from the entries, nearest first; -1 where there are fewer."""
        rows = len(q)
        met = np.zeros((rows, len(self.unit)), dtype=bool)
        ids = np.full((rows, width), -1, dtype=np.int64)
        near = np.full((rows, width), -2.0)
        e = min(entries.shape[1], width)
        ids[:, :e] = entries[:, :e]
        near[:, :e] = np.where(ids[:, :e] >= 0, np.einsum("bmd,bd->bm", self.unit[ids[:, :e]], q), -2)
        r, c = np.nonzero(ids >= 0)
        met[r, ids[r, c]] = True
        read = ids < 0
        active = np.arange(rows)
        while len(active):
            a = active[:, None]
            waiting = np.where(read[active], -3.0, near[active])
            pick = np.argpartition(-waiting, min(_STEP, width) - 1, axis=1)[:, :_STEP] if width > _STEP else np.argsort(-waiting, axis=1)
            open_ = np.take_along_axis(waiting, pick, 1) > -3
            more = open_.any(1)
            active, a, pick, open_ = active[more], a[more], pick[more], open_[more]
            if not len(active):
                break
            read[a, pick] = True
            reached = np.where(open_[:, :, None], layer[ids[a, pick]], -1).reshape(len(active), -1).astype(np.int64)
            order = np.sort(reached, axis=1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
            fresh = (order >= 0) & ~met[a, order]
            r, c = np.nonzero(fresh)
            met[active[r], order[r, c]] = True
            found = np.full(order.shape, -2.0)
            found[r, c] = np.einsum("nd,nd->n", self.unit[order[r, c]], q[active[r]])
            all_ids = np.concatenate((ids[active], np.where(fresh, order, -1)), axis=1)
            all_near = np.concatenate((near[active], found), axis=1)
            all_read = np.concatenate((read[active], ~fresh), axis=1)
            top = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            ids[active], near[active], read[active] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_near, all_read))
        by = np.argsort(-near, axis=1)
        return np.take_along_axis(ids, by, 1), np.take_along_axis(near, by, 1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self._beam(self.layers[0], q, self._descend(q, 0), width)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _graph_blob(ids, copies, vectors) -> bytes:
    by = np.argsort(ids)
    graph = SmallWorld.built(_unit(vectors[by]).astype(np.float32), len(ids))
    out = io.BytesIO()
    np.savez(out, ids=ids[by], copies=copies[by], vectors=vectors[by], entry=graph.entry, **{f"layer{k}": x for k, x in enumerate(graph.layers)})
    return out.getvalue()


def links_of(graph: SmallWorld, exact: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) links of the unit vectors ``q`` in a shard, by beams that widen until an audit passes."""
    n = len(exact)
    audited = np.random.default_rng(len(q)).permutation(len(q))[:AUDITED]
    truth = (q[audited] @ exact.T >= least).sum()
    width = BEAM
    while True:
        query, member = [], []
        for first in range(0, len(q), _BATCH):
            part = q[first: first + _BATCH]
            if width < n:
                ids, near = graph.search(part.astype(np.float32), width)
                full = np.flatnonzero(near[:, -1] >= least - 1e-5)  # more links than the beam holds: scan
                near[full] = -2
                r, c = np.nonzero(near >= least - 1e-5)
                m = ids[r, c]
                good = np.einsum("nd,nd->n", part[r], exact[m]) >= least
                query.append(first + r[good])
                member.append(m[good])
            else:
                full = np.arange(len(part))
            r, m = np.nonzero(part[full] @ exact.T >= least)
            query.append(first + full[r])
            member.append(m)
        query, member = np.concatenate(query), np.concatenate(member)
        if width >= n or np.isin(query, audited).sum() >= AUDIT_RECALL * truth:
            return query, member
        width *= 2


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges between vec_ids: the nodes, and the least vec_id that each reaches here."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = place[: len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            return nodes, nodes[label]
        label = least


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; see the module's text."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    fit = rows.where("fit").withColumn("size", F.size("vector"))
    classes = stored(fit.groupBy("label", "size", "vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")))
    shards = classes.groupBy("label", "size").agg(F.count("*").alias("n"))
    shards = shards.select("label", "size", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"), F.ceil(F.col("n") / QUERIES).cast("int").alias("blocks"))
    placed = classes.join(shards, ["label", "size"]).withColumn("hash", F.xxhash64("first_id"))
    placed = placed.withColumn("shard", F.pmod("hash", "shards").cast("int")).withColumn("block", F.pmod(F.shiftright("hash", 20), F.col("blocks")).cast("int"))
    kind = dict(vectors.select(F.col(label).alias("label")).dtypes)["label"]

    def build(group: pa.Table) -> pa.Table:
        blob = _graph_blob(*(group.column(c).to_numpy() for c in ("first_id", "copies")), _matrix(group.column("vector")))
        one = group.slice(0, 1)
        return pa.table({"label": one.column("label"), "size": one.column("size"), "shard": one.column("shard"), "blocks": one.column("blocks"),
                         "graph": pa.array([blob], pa.binary())})

    members = placed.select("label", "size", "shard", "blocks", "first_id", "copies", "vector")
    graphs = stored(members.groupBy("label", "size", "shard").applyInArrow(build, f"label {kind}, size int, shard int, blocks int, graph binary"))
    no = F.lit(None)
    graph_rows = graphs.select("label", "size", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "graph",
                               no.cast("long").alias("first_id"), no.cast("array<double>").alias("vector"))
    query_rows = placed.select("label", "size", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block",
                               no.cast("binary").alias("graph"), "first_id", "vector")

    def search(group: pa.Table) -> pa.Table:
        blobs = group.column("graph").combine_chunks()
        is_query = blobs.is_null().to_numpy(zero_copy_only=False)
        held = np.load(io.BytesIO(blobs[int(np.flatnonzero(~is_query)[0])].as_py()))
        ids, copies, exact = held["ids"], held["copies"], _unit(held["vectors"])
        graph = SmallWorld(exact.astype(np.float32), [held[f"layer{k}"] for k in range(sum(x.startswith("layer") for x in held.files))], int(held["entry"]))
        queries = group.filter(pa.array(is_query))
        own = queries.column("first_id").to_numpy()
        query, member = links_of(graph, exact, _unit(_matrix(queries.column("vector"))), least)
        other = own[query] != ids[member]
        query, member = query[other], member[other]
        linked = np.bincount(query, copies[member], len(own)).astype(np.int64)
        nodes, root = _roots(own[query], ids[member])
        away = nodes != root
        nodes, root = nodes[away], root[away]
        return pa.table({"a": pa.array(np.concatenate((own, nodes))), "b": pa.array(np.concatenate((own, root))),
                         "linked": pa.array(np.concatenate((linked, np.zeros(len(nodes), np.int64))))})

    found = stored(graph_rows.unionByName(query_rows).groupBy("label", "size", "shard", "block").applyInArrow(search, "a long, b long, linked long"))
    linked = found.groupBy("a").agg(F.sum("linked").alias("linked"))
    copies = fit.join(classes, ["label", "size", "vector"]).select("vec_id", "first_id", "copies", "label", "size", "vector")
    node = components(found.select("a", "b").where("a != b").unionByName(copies.where("vec_id != first_id").select(F.col("vec_id").alias("a"), F.col("first_id").alias("b"))), "a", "b")
    counted = copies.join(linked, F.col("first_id") == F.col("a"), "left").select("vec_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = counted.unionByName(rows.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links")))
    out = out.join(node, F.col("vec_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
