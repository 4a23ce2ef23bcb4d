"""Most similar vectors of every vector, by robust-pruned directed graphs over shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of sign bits before the signed bytes of a record, and dimensions.
SIGN_BYTES, DIMENSIONS = 8, 64
#: Vectors of a shard on average; cells of a profile at most (their centroids are broadcast:
#: at most 1 MB a profile). Beyond CELLS * SHARD vectors shards grow, up to SHARD_MOST.
SHARD, CELLS, SHARD_MOST = 1_000, 4_096, 50_000
#: Vectors that ask in one shard at most; those of a cell that more ask are split.
ASKERS_MOST = 200_000
#: Vectors of a profile on which the cells are fitted, about.
SAMPLE = 20_000
#: Cells in which the neighbours of a vector are sought at most; beside the nearest one, its
#: home, those of which the centroid is less similar than the home's by the margin at most.
PROBES, MARGIN = 6, 0.03
#: Out-degree and beam of a graph, and how much farther than by way of a neighbour a
#: candidate may be before it is pruned.
DEGREE, BEAM, SLACK = 10, 12, 1.2
#: Vectors that a search expands at a time, and members among which it looks for its entry.
WIDE, PIVOTS = 4, 64
#: Vectors that search in step, marks of visits and products of an exact search held at a time.
STEP, MARKS, PRODUCTS = 2_048, 16_000_000, 4_000_000


def decode(records: pa.Array) -> np.ndarray:
    """The signed bytes of the records, a row each; all are of one length."""
    if not len(records):
        return np.zeros((0, DIMENSIONS), np.int8)
    if isinstance(records, pa.ChunkedArray):
        records = records.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(records.type) else np.int32
    at = np.frombuffer(records.buffers()[1], kind)[records.offset : records.offset + len(records) + 1]
    return np.frombuffer(records.buffers()[2], np.int8)[at[0] : at[-1]].reshape(len(records), -1)[:, SIGN_BYTES:]


class Graph:
    """A directed graph over unit vectors in which greedy search finds near neighbours.

    Vectors enter in batches.  Each is sought by a greedy beam search over the graph so far;
    of what that met, robust pruning keeps the nearest candidate and drops all others that
    are nearer to it, by the slack, than to the vector, and so on, so that edges point in
    different directions.  Edges back are added, and pruned alike once they outgrow the
    room of a vector, which is twice the degree.  A search enters at the nearest of a few
    members, the pivots, or at a vector's own place.
    """

    def __init__(self, unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, slack: float = SLACK):
        self.x, self.degree, self.beam, self.slack = np.ascontiguousarray(unit, np.float32), degree, beam, slack
        n = len(unit)
        self.edges = np.full((n, 2 * degree), -1, np.int32)
        self.held = np.zeros(n, np.int32)
        self.rng = np.random.default_rng(n)
        order = self.rng.permutation(n).astype(np.int32)
        self.pivots = order[:PIVOTS]
        at = len(self.pivots)
        self._insert(self.pivots, np.zeros((at, 0), np.int32), np.zeros((at, 0), np.float32))
        while at < n:
            # batches grow with the graph, so that most of it is there to be searched
            part = order[at : at + min(STEP, max(PIVOTS, at // 2))]
            self._insert(part, *self.search(self.x[part], keep=beam))
            at += len(part)

    def _insert(self, part: np.ndarray, ids: np.ndarray, far: np.ndarray) -> None:
        few = min(8 if ids.shape[1] else len(part), len(part)) - 1
        if few > 0:
            # members of a batch are not in the graph yet: let each meet the nearest of them
            near = self.x[part] @ self.x[part].T
            np.fill_diagonal(near, -2)
            top = np.argpartition(-near, few - 1, axis=1)[:, :few]
            ids = np.concatenate([ids, part[top]], axis=1)
            far = np.concatenate([far, 1 - np.take_along_axis(near, top, axis=1)], axis=1)
        if not ids.shape[1]:
            return
        kept, count = self._prune(part, ids, far)
        self.edges[part, : self.degree], self.held[part] = kept, count
        source, target = np.repeat(part, self.degree), kept.ravel()
        ok = target >= 0
        self._link_back(target[ok], source[ok])

    def _link_back(self, node: np.ndarray, new: np.ndarray) -> None:
        room = self.edges.shape[1]
        order = np.argsort(node, kind="stable")
        node, new = node[order], new[order]
        # an edge that is there already is not added again
        fresh = ~(self.edges[node] == new[:, None]).any(axis=1)
        node, new = node[fresh], new[fresh]
        nodes, first, count = np.unique(node, return_index=True, return_counts=True)
        place = self.held[node] + np.arange(len(node)) - np.repeat(first, count)
        fits = place < room
        self.edges[node[fits], place[fits]] = new[fits]
        total = self.held[nodes] + count
        self.held[nodes] = np.minimum(total, room)
        full = nodes[total >= room]
        for at in range(0, len(full), STEP):
            part = full[at : at + STEP]
            ids = self.edges[part]
            extra = int(min(np.max(total[np.searchsorted(nodes, part)]) - room, room))
            if extra > 0:
                more = np.full((len(part), extra), -1, np.int32)
                row = np.searchsorted(part, node)
                late = (place >= room) & (place < room + extra) & (row < len(part))
                late[late] = part[row[late]] == node[late]
                more[row[late], place[late] - room] = new[late]
                ids = np.concatenate([ids, more], axis=1)
            far = 1 - np.einsum("nd,nkd->nk", self.x[part], self.x[ids])
            kept, held = self._prune(part, ids, far)
            self.edges[part] = -1
            self.edges[part, : self.degree], self.held[part] = kept, held

    def _prune(self, node: np.ndarray, ids: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates the diverse nearest, at most ``degree``, -1 for none, and how many."""
        # of equal distances any may come first: else all near copies would choose the same few
        far = np.where((ids < 0) | (ids == node[:, None]), np.inf, far + 2e-7 * self.rng.random(far.shape, np.float32))
        order = np.argsort(far, axis=1)
        ids, far = np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)
        alive = np.isfinite(far)
        alive[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        x = self.x[ids]
        between = self.slack * (1 - np.matmul(x, x.transpose(0, 2, 1)))
        out = np.full((len(node), self.degree), -1, np.int32)
        count = np.zeros(len(node), np.int32)
        spare = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            take = np.flatnonzero(alive[:, j] & (count < self.degree))
            if not len(take):
                continue
            out[take, count[take]] = ids[take, j]
            count[take] += 1
            worse = (between[take, j, j + 1 :] <= far[take, j + 1 :]) & alive[take, j + 1 :]
            spare[take, j + 1 :] |= worse
            alive[take, j + 1 :] &= ~worse
        # places that are left go to the nearest of the dropped candidates
        for j in range(ids.shape[1]):
            take = np.flatnonzero(spare[:, j] & (count < self.degree))
            if len(take):
                out[take, count[take]] = ids[take, j]
                count[take] += 1
        return out, count

    def search(self, queries: np.ndarray, keep: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``keep`` nearest vectors met by a beam search for each query, with distances.

        ``own`` has the place of each query that is itself a member, -1 for others.
        """
        n, step = len(queries), min(STEP, max(16, MARKS // max(1, len(self.x))))
        parts = [self._search(queries[a : a + step], keep, None if own is None else own[a : a + step]) for a in range(0, n, step)]
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros((0, keep), np.int32), np.zeros((0, keep), np.float32))

    def _search(self, queries: np.ndarray, keep: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        beam, x = max(self.beam, keep), self.x
        q = np.ascontiguousarray(queries, np.float32)
        n = len(q)
        ids = np.full((n, beam), -1, np.int32)
        far = np.full((n, beam), np.inf, np.float32)
        done = np.ones((n, beam), bool)
        met = np.full((n, len(x)), -1, np.int32)
        rows = np.arange(n)
        near = q @ x[self.pivots].T
        few = min(WIDE, len(self.pivots), beam)
        top = np.argpartition(-near, few - 1, axis=1)[:, :few]
        ids[:, :few], far[:, :few], done[:, :few] = self.pivots[top], 1 - np.take_along_axis(near, top, axis=1), False
        if own is not None:
            # a member enters at its own place, unless that is one of the pivots it enters at
            mine = np.flatnonzero((own >= 0) & ~(ids[:, :few] == own[:, None]).any(axis=1))
            ids[mine, few - 1], far[mine, few - 1] = own[mine], 1 - np.einsum("nd,nd->n", q[mine], x[own[mine]])
        order = np.argsort(far, axis=1)
        ids, far, done = (np.take_along_axis(v, order, axis=1) for v in (ids, far, done))
        met[rows[:, None], np.where(ids >= 0, ids, ids[:, :1])] = 0
        while True:
            open_ = ~done
            r, c = np.nonzero(open_ & (np.cumsum(open_, axis=1, dtype=np.int16) <= WIDE))
            if not len(r):
                return ids[:, :keep], far[:, :keep]
            done[r, c] = True
            next_ = self.edges[ids[r, c]]
            row = np.repeat(r, next_.shape[1])
            next_ = next_.ravel()
            ok = next_ >= 0
            row, next_ = row[ok], next_[ok]
            ok = met[row, next_] < 0
            row, next_ = row[ok], next_[ok]
            # of a vector that several edges lead to, the last stays
            at = np.arange(len(row), dtype=np.int32)
            met[row, next_] = at
            ok = met[row, next_] == at
            row, next_ = row[ok], next_[ok]
            dist = 1 - np.einsum("nd,nd->n", x[next_], q[row])
            ok = dist < far[row, -1]
            row, next_, dist = row[ok], next_[ok], dist[ok]
            if not len(row):
                continue
            live, first, count = np.unique(row, return_index=True, return_counts=True)
            width = int(count.max())
            place = np.arange(len(row)) - np.repeat(first, count)
            line = np.repeat(np.arange(len(live)), count)
            more_far = np.full((len(live), width), np.inf, np.float32)
            more_ids = np.full((len(live), width), -1, np.int32)
            more_far[line, place], more_ids[line, place] = dist, next_
            all_far = np.concatenate([far[live], more_far], axis=1)
            order = np.argsort(all_far, axis=1)[:, :beam]
            far[live] = np.take_along_axis(all_far, order, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], more_ids], axis=1), order, axis=1)
            done[live] = np.take_along_axis(np.concatenate([done[live], more_ids < 0], axis=1), order, axis=1)


def fit_cells(unit: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Centroids (unit vectors) of spherical k-means on a bounded sample."""
    rng = np.random.default_rng(len(unit))
    centre = unit[rng.permutation(len(unit))[:cells]].copy()
    for _ in range(rounds):
        near = np.argmax(unit @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 0, total / np.maximum(size, 1e-9), centre)
    return centre


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def valid_vectors(cache: DataFrame) -> DataFrame:
    """``profile, chunk_sha, record, v1, v2`` of the rows that are vectors.

    A record of the right length whose SHA-256 is its record_sha in either case; null
    profiles and chunk_shas name nothing.  ``v1`` and ``v2``, 128 bits, name the content of
    the record within its profile.
    """
    rows = cache.where(F.octet_length("record") == SIGN_BYTES + DIMENSIONS).where(F.lower("record_sha") == F.sha2("record", 256))
    content = [F.xxhash64(F.lit(salt), "profile", "record").alias(name) for salt, name in (("a", "v1"), ("b", "v2"))]
    return rows.where("profile is not null and chunk_sha is not null").select("profile", "chunk_sha", "record", *content)


@dataclass(frozen=True)
class Cells:
    """The cells of a profile: centroids, the number of the first, and the parts of members and of askers that each is split into."""

    first: int
    centre: np.ndarray
    parts: np.ndarray
    slices: np.ndarray

    def probes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, cells and ranks of where each vector is sought."""
        near = unit @ self.centre.T
        most = min(PROBES, len(self.centre))
        top = np.argpartition(-near, most - 1, axis=1)[:, :most]
        far = -np.take_along_axis(near, top, axis=1)
        order = np.argsort(far, axis=1, kind="stable")
        top, far = np.take_along_axis(top, order, axis=1), np.take_along_axis(far, order, axis=1)
        row, rank = np.nonzero(far <= far[:, :1] + MARGIN)
        return row, top[row, rank], rank


def fit_profiles(rows: DataFrame) -> dict[str, Cells]:
    """Cells of every profile of ``profile, record, v1``, fitted on a sample of about ``SAMPLE`` vectors each.

    The sample is drawn by hash, a content once.  What it tells about the sizes of cells
    decides how many parts they are split into.  There are few profiles, one an encoder.
    """
    sizes = {r["profile"]: r["n"] for r in rows.groupBy("profile").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a profile
    share = F.lit(0.0)
    for profile, n in sizes.items():
        share = F.when(F.col("profile") == profile, SAMPLE / n).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("v1"), F.lit(1_000_000)) < share * 1_000_000).select("profile", "record").distinct()

    def fit(table: pa.Table) -> pa.Table:
        profile = table.column("profile")[0].as_py()
        unit = _unit(decode(table.take(pc.sort_indices(table, [("record", "ascending")])).column("record")))
        cells = Cells(0, fit_cells(unit, min(CELLS, max(1, -(-sizes[profile] // SHARD)), len(unit))), np.zeros(0), np.zeros(0))
        _, at, rank = cells.probes(unit)
        n, scale = len(cells.centre), sizes[profile] / len(unit)
        members, askers = np.bincount(at[rank == 0], minlength=n) * scale, np.bincount(at, minlength=n) * scale
        return pa.table({
            "profile": [profile] * n, "cell": pa.array(np.arange(n, dtype=np.int32)), "centre": pa.array(list(cells.centre.astype(np.float32)), pa.list_(pa.float32())),
            "parts": pa.array(np.maximum(1, np.ceil(members / SHARD_MOST)).astype(np.int32)), "slices": pa.array(np.maximum(1, np.ceil(askers / ASKERS_MOST)).astype(np.int32)),
        })

    fitted: dict[str, list] = {}
    for r in drawn.groupBy("profile").applyInArrow(fit, "profile string, cell int, centre array<float>, parts int, slices int").orderBy("profile", "cell").collect():  # at most CELLS rows a profile
        fitted.setdefault(r["profile"], []).append(r)
    out, first = {}, 0
    for profile in sizes:
        own = fitted.get(profile)
        # a profile of so few vectors that none was drawn is one cell
        centre = np.array([r["centre"] for r in own], np.float32) if own else np.zeros((1, DIMENSIONS), np.float32)
        parts, slices = (np.array([r[c] for r in own], np.int64) if own else np.ones(1, np.int64) for c in ("parts", "slices"))
        out[profile] = Cells(first, centre, parts, slices)
        first += len(centre)
    return out


_MEMBER, _ASKS = 1, 2


def _route(vectors: DataFrame, cells: dict[str, Cells]) -> DataFrame:
    """``v1, v2, place, record, cell, part, role``: each vector where it is a member and where it asks.

    Members of a split cell are in one part each, in every slice of the askers; an asker is
    in one slice, in every part of the members.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for profile in names.unique():
                own = batch.filter(pc.equal(names, profile))
                known = shared.value[profile.as_py()]
                row, cell, rank = known.probes(_unit(decode(own.column(4))))
                draw = own.column(1).to_numpy(zero_copy_only=False).view(np.uint64)[row]
                parts, slices = known.parts[cell], known.slices[cell]
                part, slice_ = (draw % parts.astype(np.uint64)).astype(np.int64), ((draw >> np.uint64(32)) % slices.astype(np.uint64)).astype(np.int64)
                whole = (parts == 1) & (slices == 1)
                out = [(row[whole], cell[whole], np.zeros(whole.sum(), np.int64), np.where(rank[whole] == 0, _MEMBER | _ASKS, _ASKS))]
                for i in np.flatnonzero(~whole):
                    for p in range(parts[i]):
                        for s in range(slices[i]):
                            role = _MEMBER * (rank[i] == 0 and p == part[i]) | _ASKS * (s == slice_[i])
                            if role:
                                out.append((row[i : i + 1], cell[i : i + 1], np.array([p * slices[i] + s]), np.array([role])))
                row, cell, part, role = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(i).take(pa.array(row)) for i in (1, 2, 3, 4)), pa.array((known.first + cell).astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(role.astype(np.int8))],
                    names=["v1", "v2", "place", "record", "cell", "part", "role"],
                )

    return vectors.select("profile", "v1", "v2", "place", "record").mapInArrow(route, "v1 long, v2 long, place long, record binary, cell int, part int, role byte")


def _best(dot: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` largest products; of equal ones those of smaller place.

    Those that are equal in both to the last are in as well.
    """
    k = min(k, dot.shape[1])
    kth = -np.partition(-dot, k - 1, axis=1)[:, k - 1 : k]
    r, c = np.nonzero((dot >= kth) & np.isfinite(dot))
    d, p = dot[r, c], place[r, c]
    order = np.lexsort((p, -d, r))
    r, c, d, p = r[order], c[order], d[order], p[order]
    first = np.searchsorted(r, r)
    last = np.minimum(first + k, np.searchsorted(r, r, side="right")) - 1
    ok = (d > d[last]) | ((d == d[last]) & (p <= p[last]))
    return r[ok], c[ok]


def search_shard(members: np.ndarray, places: np.ndarray, sought: np.ndarray, own: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Askers, members and products: of each vector sought the ``k`` best members, of products of ``least`` on.

    ``own`` has the place of each asker among the members, -1 if it is none.  A beam is
    enough where its farthest vector shows that no vector beyond it can reach the last of
    the ``k``; where it does not, as among many near copies, all members are compared.
    """
    graph = Graph(_unit(members))
    exact, unit = members.astype(np.float32), _unit(sought)
    longest = float(np.linalg.norm(exact, axis=1).max())
    beam = max(BEAM, 2 * (k + 1))
    ids, far = graph.search(unit, beam, own)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(at: np.ndarray, dot: np.ndarray, ids: np.ndarray) -> None:
        r, c = _best(dot, places[ids], k)
        parts.append((at[r], ids[r, c], dot[r, c].astype(np.int32)))

    for first in range(0, len(sought), STEP):
        at = np.arange(first, min(first + STEP, len(sought)))
        met, asks = ids[at], sought[at].astype(np.float32)
        # products of signed bytes are exact in single precision
        dot = np.einsum("qd,qkd->qk", asks, exact[met])
        dot = np.where((met < 0) | (met == own[at, None]) | (dot < least), -np.inf, dot)
        kth = -np.sort(-dot, axis=1)[:, min(k, dot.shape[1]) - 1]
        # no vector beyond a full beam has a greater product than this, but for rounding;
        # a beam that is not full met all members or those that the graph leads to
        count = (met >= 0).sum(axis=1)
        beyond = np.where(count == met.shape[1], (1 - far[at, -1] + 1e-5) * np.linalg.norm(asks, axis=1) * longest, np.inf)
        short = (count < len(members)) & (beyond >= np.maximum(kth, least))
        keep(at[~short], dot[~short], met[~short])
        again, step = at[short], max(1, PRODUCTS // len(members))
        for x in range(0, len(again), step):
            part = again[x : x + step]
            dot = sought[part].astype(np.float32) @ exact.T
            dot = np.where((np.arange(len(members)) == own[part, None]) | (dot < least), -np.inf, dot)
            keep(part, dot, np.broadcast_to(np.arange(len(members)), dot.shape))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int32))


_HITS = "v1 long, v2 long, o1 long, o2 long, dot int"


def _search_group(table: pa.Table, k: int, least: float) -> pa.Table:
    v1, v2, place = (table.column(n).to_numpy() for n in ("v1", "v2", "place"))
    order = np.lexsort((v2, v1))
    role = table.column("role").to_numpy()[order]
    v1, v2, place, vectors = v1[order], v2[order], place[order], decode(table.column("record"))[order]
    home, asks = np.flatnonzero(role & _MEMBER), np.flatnonzero(role & _ASKS)
    if len(home) and len(asks):
        own = np.full(len(role), -1, np.int64)
        own[home] = np.arange(len(home))
        a, m, dot = search_shard(vectors[home], place[home], vectors[asks], own[asks], k, least)
        a, m = asks[a], home[m]
    else:
        a = m = dot = np.zeros(0, np.int64)
    return pa.table([pa.array(x) for x in (v1[a], v2[a], v1[m], v2[m], dot.astype(np.int32))], names=["v1", "v2", "o1", "o2", "dot"])


def _place(name: str):
    """A number that orders names as they do, by their first seven bytes."""
    return F.conv(F.rpad(F.substring(F.hex(F.col(name)), 1, 14), 14, "0"), 16, 10).cast("long")


def nearest_classes(vectors: DataFrame, cells: dict[str, Cells], k: int, least: float = -np.inf) -> DataFrame:
    """``v1, v2, o1, o2, dot``: of each vector the ``k`` most similar others, of products of ``least`` on.

    ``vectors`` has ``profile, v1, v2, place, record``; of those as similar as the last the
    ones of smaller place are among the result, however many they are.  What one vector
    finds about another counts for both, so that a pair is found if either looks into the
    other's home.
    """
    shards = _route(vectors, cells)
    # one shard a group: bounded by SHARD_MOST members and ASKERS_MOST askers
    hits = shards.groupBy("cell", "part").applyInArrow(lambda table: _search_group(table, k, least), _HITS)
    both = F.array(F.struct("v1", "v2", "o1", "o2", "dot"), F.struct(F.col("o1").alias("v1"), F.col("o2").alias("v2"), F.col("v1").alias("o1"), F.col("v2").alias("o2"), "dot"))
    ranked = Window.partitionBy("v1", "v2").orderBy(F.col("dot").desc())
    return hits.select(F.explode(both).alias("h")).select("h.*").distinct().withColumn("i", F.rank().over(ranked)).where(F.col("i") <= k).drop("i")


def similar_pairs(cache: DataFrame, k: int = 5, least: float = 0.9) -> DataFrame:
    """``profile, chunk_sha_a, chunk_sha_b``: pairs of which one is among the ``k`` most similar others of the other.

    Similarity is the dot product of the signed bytes over 16129, at least ``least``; of
    equal ones the smaller chunk_sha comes first; profiles are apart.  Repeated rows count
    once, and rows that are not vectors count for nothing.

    Vectors of equal content are one class: the graph holds each class once, and of a class
    only its ``k + 1`` smallest names can be among anyone's nearest, so that copies, however
    many, are neither searched nor paired with each other.  Every member of a class then
    gets the class's neighbours and its own fellows.

    Classes are put into cells of a k-means fitted on a bounded sample; a graph is built for
    each cell's shard and searched by all vectors of which the cell is among the nearest.
    The dot products of what the searches meet are exact; the search itself is approximate.
    """
    valid = valid_vectors(cache)
    cells = fit_profiles(valid)
    rows = valid.distinct()
    first = Window.partitionBy("v1", "v2").orderBy("chunk_sha")
    # ranks are cut off on the map side already, so that a class of many copies stays small
    named = rows.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1)
    classes = named.groupBy("v1", "v2").agg(F.min(F.struct("chunk_sha", "profile", "record")).alias("m"), F.array_sort(F.collect_set("chunk_sha")).alias("names"))
    at_least = int(np.ceil(round(least * 127 * 127, 6)))
    # of a class only its smallest name can decide a tie for a place among the k best classes
    vectors = classes.select(F.col("m.profile").alias("profile"), "v1", "v2", _place("m.chunk_sha").alias("place"), F.col("m.record").alias("record"))
    names = classes.select(F.col("v1").alias("o1"), F.col("v2").alias("o2"), "names")
    fellows = classes.where(F.size("names") > 1).select("v1", "v2", F.col("v1").alias("o1"), F.col("v2").alias("o2"), _square("m.record").alias("dot"))
    near = nearest_classes(vectors, cells, k, at_least)
    listed = near.unionByName(fellows).join(names, ["o1", "o2"]).select("v1", "v2", "dot", F.explode("names").alias("name"))
    pooled = Window.partitionBy("v1", "v2").orderBy(F.col("dot").desc(), "name")
    pool = listed.withColumn("i", F.row_number().over(pooled)).where(F.col("i") <= k + 1)
    pool = pool.groupBy("v1", "v2").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name", "dot"))), lambda x: F.struct(x["name"], x["dot"])).alias("pool"))
    own = rows.select("profile", "chunk_sha", "v1", "v2").join(pool, ["v1", "v2"])
    others = F.slice(F.filter("pool", lambda x: x["name"] != F.col("chunk_sha")), 1, k)
    pairs = own.select("profile", "chunk_sha", F.explode(others).alias("o")).where(F.col("o.dot") >= at_least)
    a, b = F.least("chunk_sha", "o.name"), F.greatest("chunk_sha", "o.name")
    return pairs.select("profile", a.alias("chunk_sha_a"), b.alias("chunk_sha_b")).distinct()


def _square(record: str):
    """The dot product of a record's signed bytes with themselves."""

    @F.arrow_udf("int")
    def square(records: pa.Array) -> pa.Array:
        v = decode(records).astype(np.int32)
        return pa.array((v * v).sum(axis=1).astype(np.int32))

    return square(record)
