"""Approximate nearest neighbours by NN-descent, searched greedily over its graph.

Equal vectors are one node. A first graph comes from a few random orders: nodes are sorted by the signs and values of random
projections, cut into blocks of BLOCK, and compared within their block. Then each round of NN-descent joins every node with
its neighbours, those that it points to and the REVERSE nearest of those that point to it, and compares these with each other:
the neighbours of neighbours. Of two neighbours that were both there in the round before, the node has compared them already,
so at least one of a pair is new. A node keeps its DEGREE nearest; no node meets more than DEGREE + REVERSE others in one
place, however many point to it. Rounds end when one of them changes no more than a share DELTA of the edges.

A query starts at its own node and in each round looks at the neighbours of the best `width` nodes seen so far, until there
is none among these that it hasn't looked from. For SAMPLE of the queries the nearest are also found by brute force, one pass
over the nodes; while the search has less than RECALL of these, the width is doubled, from WIDTH on, and all queries go on from
where they are. Of a query the KEPT * WIDTH nearest nodes are kept: what is farther cannot come back among them. When the width
grows beyond that, all that was kept is looked at anew and KEPT times the new width is kept. Nearness there is that of float16 unit vectors; the result's order and scores are of the original vectors
in double precision.

Nodes are dealt by their hash into parts of at most about PART_BYTES of unit vectors, queries into groups of QUERIES. What one
part (or group) tells another in a step is one row of packed arrays: a row for each pair of parts, not for each edge. Vectors
go to a part once, however many of its nodes ask for them, and of what a part says of one node only the nearest few are sent,
so a node that very many point to gets no more than that from each part. Steps are grouped by the part that they go to.

Defined results: a vector that is null, empty, zero, or has null or non-finite components takes no part, neither as query nor
as candidate, and so does one that is not of the most frequent length (of the longest of these, if there are more); a null id
takes no part; repeated rows (id and vector) count once, rows with the query's id are not its candidates; with fewer
candidates than asked for, all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import bounded_sample, durable, read_table

DEGREE = 32
REVERSE = 32
BLOCK = 2048
ORDERS = 6
DELTA = 0.001
WIDTH = 96
RECALL = 0.95
SAMPLE = 400
KEPT = 4
#: Unit vectors of a part, in bytes; queries of a group; entries that a task holds before it sends them.
PART_BYTES = 1 << 20
QUERIES = 64
HELD = 1 << 20
#: A node's id is its part's number and, in the last bits, its place there.
PLACE = 16
#: Rounding to float16 moves a cosine of unit vectors by less than this.
ROUNDING = 0.002
_MESSAGE = "part long, kind int, src long, ids binary, at binary, d binary, flag binary, unit binary"
_TYPES = {"ids": np.int64, "at": np.int32, "d": np.float32, "flag": np.uint8, "unit": np.float16}
_SCHEMA = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("src", pa.int64()), *[(name, pa.binary()) for name in _TYPES]])
#: Kinds of rows. What parts keep: unit vectors, graph, paths; queries' groups: the queries and what they have seen. The others are sent.
UNITS, GRAPH, PATHS, QUERY, SEEN, EDGE, AROUND, WANTED, ANSWER, OFFER, EXPAND, NEXT, SCORE, FOUND = range(14)


@dataclass
class Index:
    units: DataFrame  # a row a part: its nodes' unit vectors in float16
    vectors: DataFrame  # nid, embedding
    members: DataFrame  # nid, vec_id
    graph: DataFrame  # a row a part: of each node the nearest, nearest first; d is 1 - cosine
    size: int  # components of a vector
    degree: int


def usable(v: Column) -> Column:
    """True for vectors with a direction."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) > 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _SCHEMA)


def _packed(kind: int, part: int, src: int = -1, **columns: np.ndarray) -> dict:
    return {"part": int(part), "kind": kind, "src": int(src), **{k: np.ascontiguousarray(v, _TYPES[k]).tobytes() for k, v in columns.items()}}


def _dealt(kind: int, src: int, part: np.ndarray, **columns: np.ndarray) -> list[dict]:
    """A row of packed columns for each part that something goes to."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.r_[np.flatnonzero(_starts(part)), len(part)]
    columns = {k: v[order] for k, v in columns.items()}
    return [_packed(kind, part[a], src, **{k: v[a:b] for k, v in columns.items()}) for a, b in zip(cuts, cuts[1:])]


def _rows(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pc.equal(table.column("kind"), kind))


def _got(table: pa.Table, kind: int, *names: str) -> list[np.ndarray]:
    """The columns of all rows of one kind, put together."""
    rows = _rows(table, kind)
    return [np.frombuffer(b"".join(rows.column(n).to_pylist()), _TYPES[n]) for n in names]


def _by_part(frames: list[DataFrame], work: Callable[[int, pa.Table], list[dict]]) -> DataFrame:
    """work() gives, for a part and all rows that go to it, the rows that it sends on."""

    def run(table: pa.Table) -> pa.Table:
        return _table(work(table.column("part")[0].as_py(), table))

    every = frames[0]
    for more in frames[1:]:
        every = every.unionByName(more)
    return every.groupBy("part").applyInArrow(run, _MESSAGE)


def _each(frame: DataFrame, work: Callable[[int, pa.Table], list[dict]]) -> DataFrame:
    """The same for what is a row a part already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from _table(work(b.column("part")[i].as_py(), pa.Table.from_batches([b.slice(i, 1)]))).to_batches()

    return frame.mapInArrow(run, _MESSAGE)


def _starts(x: np.ndarray) -> np.ndarray:
    """True where a run of equal values starts."""
    return np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)


def _ranks(x: np.ndarray) -> np.ndarray:
    """Places in runs of equal values, from 0."""
    starts = np.flatnonzero(_starts(x))
    return np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))


def _bits(d: np.ndarray) -> np.ndarray:
    """Numbers in the order of distances, which are not negative."""
    return np.ascontiguousarray(d, np.float32).view(np.uint32).astype(np.int64)


def _nearest_of(u: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the `most` nearest of each u (below 2 ** 31), by u and distance, and their ranks."""
    order = np.argsort((u.astype(np.int64) << 32) | _bits(d), kind="stable")
    rank = _ranks(u[order])
    return order[rank < most], rank[rank < most]


def _place(nid: np.ndarray) -> np.ndarray:
    return nid & ((1 << PLACE) - 1)


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """vectors(vec_id, embedding) -> (nid, embedding, with distinct embeddings; nid, vec_id; length of an embedding)."""
    v = vectors.where("vec_id is not null").where(usable(F.col("embedding")))
    length = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    size, n = (length["n"], length["count"]) if length else (0, 0)
    v = v.where(F.size("embedding") == size).select("vec_id", "embedding")
    a_part = max(64, min(8192, PART_BYTES // (2 * max(size, 1))))
    parts = max(1, -(-n // a_part), min(32, n // 256))
    least = v.groupBy("embedding").agg(F.min("vec_id").alias("least")).withColumn("part", F.pmod(F.xxhash64("embedding"), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("least", "embedding")) - 1
    distinct = durable(least.select("embedding", (F.shiftleft("part", PLACE) + place).alias("nid")), "vectors")
    return distinct.select("nid", "embedding"), durable(v.join(distinct, "embedding").select("nid", "vec_id").distinct(), "members"), size


def _unit_rows(table: pa.Table) -> pa.Table:
    """The vectors of a part -> their unit vectors, by place."""
    table = table.sort_by("nid")
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return _table([_packed(UNITS, table.column("part")[0].as_py(), unit=flat / np.linalg.norm(flat, axis=1, keepdims=True))])


def _ids(part: int, n: int) -> np.ndarray:
    return (part << PLACE) + np.arange(n, dtype=np.int64)


def _binary(x: np.ndarray) -> pa.Array:
    """An array of bytes, one for each row of x."""
    x = np.ascontiguousarray(x)
    wide = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * wide).astype(np.int32)), pa.py_buffer(x)])


def _matrix(units, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float16).reshape(-1, size)


def _block_neighbours(degree: int, block: int, size: int):
    """Rows in a random order -> for each node the nearest in its blocks, which overlap by half: with the half before it, its
    own and the one after it."""
    half = max(1, block // 2)

    def near(before, own, after):
        ids, x = (np.concatenate([h[i] for h in (before, own, after) if h is not None]) for i in (0, 1))
        d = 1 - own[1] @ x.T
        d[np.arange(len(own[0])), np.arange(len(own[0])) + (len(before[0]) if before else 0)] = np.inf
        most = min(degree, len(ids) - 1)
        best = np.argpartition(d, most - 1, axis=1)[:, :most] if most else np.empty((len(own[0]), 0), int)
        return np.repeat(own[0], most), ids[best].ravel(), np.take_along_axis(d, best, axis=1).ravel()

    def halves(batches):
        """(order, ids, units), at most `half` of one order at once."""
        kept: list = []
        for b in batches:
            orders, ids, x = b.column("order").to_numpy(), b.column("nid").to_numpy(), _matrix(b.column("unit").to_pylist(), size)
            cuts = np.r_[np.flatnonzero(_starts(orders)), len(orders)]
            for a, z in zip(cuts, cuts[1:]):
                if kept and kept[0] != orders[a]:
                    yield tuple(kept)
                    kept = []
                while a < z:
                    kept = kept or [orders[a], ids[:0], x[:0].astype(np.float32)]
                    take = min(z - a, half - len(kept[1]))
                    kept[1:] = np.r_[kept[1], ids[a : a + take]], np.r_[kept[2], x[a : a + take].astype(np.float32)]
                    a += take
                    if len(kept[1]) == half:
                        yield tuple(kept)
                        kept = []
        if kept:
            yield tuple(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        before = own = None

        def sent(least: int):
            nonlocal held
            if held and sum(len(h[0]) for h in held) >= least:
                u, v, d = (np.concatenate(c) for c in zip(*held))
                held = []
                yield from _table(_dealt(OFFER, -1, u >> PLACE, at=_place(u), ids=v, d=np.maximum(d, 0))).to_batches()

        def compared(after):
            if own:
                held.append(near(before[1:] if before and before[0] == own[0] else None, own[1:], after[1:] if after and after[0] == own[0] else None))
                yield from sent(HELD)

        for after in halves(batches):
            yield from compared(after)
            before, own = own, after
        yield from compared(None)
        yield from sent(1)

    return run


def first_graph(units: DataFrame, size: int, n: int, degree: int, block: int, orders: int, seed: int) -> DataFrame:
    """Neighbours within blocks of a few random orders."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, unit in zip(b.column("part").to_pylist(), b.column("unit").to_pylist()):
                x = _matrix([unit], size)
                for order in range(orders):
                    planes = np.random.default_rng(seed + order).standard_normal((size, 9)).astype(np.float32)
                    y = x.astype(np.float32) @ planes
                    code = ((y[:, :8] > 0) << np.arange(8)).sum(axis=1) + 1 / (1 + np.exp(-4 * y[:, 8].astype(float)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), order, np.int32)), pa.array(code, pa.float64()), pa.array(_ids(part, len(x))), _binary(x)], names=["order", "code", "nid", "unit"])

    partitions, by = max(1, min(orders * n // (4 * block), 100_000)), ["order", "code", "nid"]
    rows = units.mapInArrow(keyed, "order int, code double, nid long, unit binary").repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    return _by_part([_each(units, _no_edges(degree, size)), rows.mapInArrow(_block_neighbours(degree, block, size), _MESSAGE)], _merged(degree))


def _no_edges(degree: int, size: int):
    def work(part: int, table: pa.Table) -> list[dict]:
        m = len(_got(table, UNITS, "unit")[0]) // size
        return [_packed(GRAPH, part, ids=np.full(m * degree, -1), d=np.full(m * degree, np.inf), flag=np.zeros(m * degree))]

    return work


def _merged(degree: int):
    """A part's graph with what was offered to it: the nearest `degree` of each node are kept, and those that weren't there marked."""

    def work(part: int, table: pa.Table) -> list[dict]:
        ids, d = _got(table, GRAPH, "ids", "d")
        at, near, far = _got(table, OFFER, "at", "ids", "d")
        nearer = far < d.reshape(-1, degree)[at, -1]
        at, near, far, old = at[nearer], near[nearer], far[nearer], np.flatnonzero(ids >= 0)
        u, v = np.r_[old // degree, at], np.r_[ids[old], near]
        order = np.argsort((u << (62 - PLACE)) | (v << 1) | np.r_[np.zeros(len(old), int), np.ones(len(at), int)])
        order = order[_starts((u[order] << (62 - PLACE)) | v[order])]
        u, v, far, new = u[order], v[order], np.r_[d[old], far][order], order >= len(old)
        best, rank = _nearest_of(u, far, degree)
        to = u[best] * degree + rank
        out = {"ids": np.full(len(ids), -1), "d": np.full(len(ids), np.inf, np.float32), "flag": np.zeros(len(ids), np.uint8)}
        out["ids"][to], out["d"][to], out["flag"][to] = v[best], far[best], new[best]
        return [_packed(GRAPH, part, **out)]

    return work


def _edges(degree: int, reverse: int):
    """What a part points to, sent there; no more than the `reverse` nearest that point to one node."""

    def work(part: int, table: pa.Table) -> list[dict]:
        ids, d, flag = _got(table, GRAPH, "ids", "d", "flag")
        edge = np.flatnonzero(ids >= 0)
        to, u = np.unique(ids[edge], return_inverse=True)
        best, _ = _nearest_of(u, d[edge], reverse)
        edge, to = edge[best], to[u[best]]
        return _dealt(EDGE, part, to >> PLACE, ids=_ids(part, 1)[0] + edge // degree, at=_place(to), d=d[edge], flag=flag[edge])

    return work


def _around(table: pa.Table, degree: int, reverse: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each node of a part those that it points to and the nearest that point to it, sorted, -1 after the last; and which are new."""
    ids, flag = (x.reshape(-1, degree) for x in _got(table, GRAPH, "ids", "flag"))
    who, at, d, new = _got(table, EDGE, "ids", "at", "d", "flag")
    order = np.argsort(who, kind="stable")
    who, at, d, new = who[order], at[order], d[order], new[order]
    best, rank = _nearest_of(at, d, reverse)
    none = np.iinfo(np.int64).max
    key = np.full((len(ids), degree + reverse), none)
    key[:, :degree] = np.where(ids >= 0, ids * 2 + (1 - flag.astype(np.int64)), none)
    key[at[best], degree + rank] = who[best] * 2 + (1 - new[best].astype(np.int64))
    key.sort(axis=1)
    key[:, 1:][(key[:, 1:] >> 1) == (key[:, :-1] >> 1)] = none
    key.sort(axis=1)
    return np.where(key == none, -1, key >> 1), (key != none) & (key & 1 == 0)


def _meet(degree: int, reverse: int):
    """Who meets at each node of a part; of those whose vectors this needs, their parts are asked."""

    def work(part: int, table: pa.Table) -> list[dict]:
        ids, new = _around(table, degree, reverse)
        some = new.any(axis=1) & (ids[:, 1] >= 0)
        ids, new = ids[some], new[some]
        wanted = np.unique(ids[ids >= 0])
        return [_packed(AROUND, part, ids=ids, flag=new), *_dealt(WANTED, part, wanted >> PLACE, ids=wanted)]

    return work


def _answer(degree: int, size: int):
    """Vectors to the parts that asked, with the distance of what each node has at the last place."""

    def work(part: int, table: pa.Table) -> list[dict]:
        units, worst = _got(table, UNITS, "unit")[0].reshape(-1, size), _got(table, GRAPH, "d")[0].reshape(-1, degree)[:, -1]
        out = [{**r, "kind": AROUND} for r in _rows(table, AROUND).to_pylist()]
        for r in _rows(table, WANTED).select(["src", "ids"]).to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            out.append(_packed(ANSWER, r["src"], part, ids=ids, d=worst[_place(ids)], unit=units[_place(ids)]))
        return out

    return work


def _compare(degree: int, reverse: int, take: int, size: int):
    """For each node of a part: those around it compared with each other; to each of them those nearer than what it has."""

    def offers(who, u, v, d):
        order = np.argsort((u << 32) | v)
        order = order[_starts((u[order] << 32) | v[order])]
        best, _ = _nearest_of(u[order], d[order], degree)
        u, v, d = u[order][best], v[order][best], d[order][best]
        return _dealt(OFFER, -1, who[u] >> PLACE, at=_place(who[u]), ids=who[v], d=d)

    def work(part: int, table: pa.Table) -> list[dict]:
        around, new = (x.reshape(-1, degree + reverse) for x in _got(table, AROUND, "ids", "flag"))
        who, worst, units = _got(table, ANSWER, "ids", "d", "unit")
        units, order = units.reshape(-1, size), np.argsort(who)
        step, out, held = max(1, (1 << 21) // max((degree + reverse) * size, (degree + reverse) ** 2)), [], []
        for a in range(0, len(around), step):
            there, fresh = around[a : a + step] >= 0, new[a : a + step] > 0
            wide = there.any(axis=0).sum()
            there, fresh = there[:, :wide], fresh[:, :wide]
            at = order[np.minimum(np.searchsorted(who, around[a : a + step, :wide], sorter=order), len(who) - 1)]
            x = units[at].astype(np.float32)
            d = 1 - x @ x.transpose(0, 2, 1)
            good = (d < np.where(there, worst[at], -np.inf)[:, :, None]) & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :])
            good[:, np.arange(wide), np.arange(wide)] = False
            p, i = np.nonzero(good.sum(axis=2) > take)
            if len(p):  # only the `take` nearest
                some = np.where(good[p, i], d[p, i], np.inf)
                good[p, i] &= some <= np.partition(some, take - 1, axis=1)[:, take - 1 : take]
            p, i, j = np.nonzero(good)
            held.append((at[p, i], at[p, j], np.maximum(d[p, i, j], 0)))
            if sum(len(h[0]) for h in held) >= HELD or a + step >= len(around):
                out += offers(who, *(np.concatenate(c) for c in zip(*held)))
                held = []
        return out

    return work


def descend(units: DataFrame, graph: DataFrame, size: int, degree: int, reverse: int, take: int = 16) -> DataFrame:
    """One round: the graph joined with itself through each node."""
    meet = _by_part([graph, _each(graph, _edges(degree, reverse))], _meet(degree, reverse))
    answers = _by_part([units, graph, meet], _answer(degree, size))
    return _by_part([graph, _by_part([answers], _compare(degree, reverse, take, size))], _merged(degree))


def _sums(frame: DataFrame, work: Callable[[pa.Table], tuple[int, ...]], names: list[str]) -> tuple[int, ...]:
    """Sums of what work() gives for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in work(pa.Table.from_batches([b.slice(i, 1)]))], names=names)

    counted = frame.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return tuple(counted.agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in names]).first())


def _changed(table: pa.Table) -> tuple[int, int]:
    """Edges of the graph, and how many of them were not in the last one."""
    ids, flag = _got(table, GRAPH, "ids", "flag")
    return (ids >= 0).sum(), (flag > 0).sum()


def build(vectors: DataFrame, degree: int = DEGREE, reverse: int = REVERSE, block: int = BLOCK, orders: int = ORDERS, delta: float = DELTA, seed: int = 8) -> Index:
    """vectors(vec_id, embedding) -> the index of every row."""
    own, members, size = nodes_of(vectors)
    part = F.shiftright("nid", PLACE).alias("part")
    units = durable(own.select(part, "nid", "embedding").groupBy("part").applyInArrow(_unit_rows, _MESSAGE), "units")
    graph = durable(first_graph(units, size, own.count(), degree, block, orders, seed), "graph")
    while True:
        graph = durable(descend(units, graph, size, degree, reverse), "graph")
        edges, new = _sums(graph, _changed, ["edges", "new"])
        if new <= delta * edges:
            break
    return Index(units, own, members, graph, size, degree)


def _paths(degree: int, reverse: int):
    """Where a search can go from each node: the graph's edges and, of those that point to a node, the `reverse` nearest, turned round."""

    def work(part: int, table: pa.Table) -> list[dict]:
        return [_packed(PATHS, part, ids=_around(table, degree, reverse)[0])]

    return work


def _begin(table: pa.Table) -> pa.Table:
    """The queries of a group, at their own nodes. That distance stands before all others."""
    part, ids, n = table.column("part")[0].as_py(), table.column("qid").to_numpy(), table.num_rows
    rows = [_packed(QUERY, part, ids=ids), _packed(SEEN, part, ids=ids, at=np.arange(n), d=np.full(n, -1), flag=np.zeros(n))]
    rows[0]["unit"] = b"".join(table.column("asked").to_pylist())
    return _table(rows)


def _fresh(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes among the best `width` of a query that it hasn't looked from, and the query's place in its group."""
    ids, at, flag = _got(table, SEEN, "ids", "at", "flag")
    fresh = (_ranks(at) < width) & (flag == 0)
    return ids[fresh], at[fresh]


def _expand(width: int):
    def work(part: int, table: pa.Table) -> list[dict]:
        ids, at = _fresh(table, width)
        return _dealt(EXPAND, part, ids >> PLACE, ids=ids, at=at)

    return work


def _anew(part: int, table: pa.Table) -> list[dict]:
    return [{**r, "flag": bytes(len(r["flag"]))} for r in table.to_pylist()]


def _follow(wide: int):
    def work(part: int, table: pa.Table) -> list[dict]:
        paths, out = _got(table, PATHS, "ids")[0].reshape(-1, wide), []
        for r in _rows(table, EXPAND).select(["src", "ids", "at"]).to_pylist():
            to, at = paths[_place(np.frombuffer(r["ids"], np.int64))], np.frombuffer(r["at"], np.int32)
            key = np.sort((np.repeat(at.astype(np.int64), wide) << (62 - PLACE) | to.ravel())[to.ravel() >= 0])
            key = key[_starts(key)]
            out.append(_packed(NEXT, r["src"], part, ids=key & ((1 << (62 - PLACE)) - 1), at=key >> (62 - PLACE)))
        return out

    return work


def _unseen(size: int):
    """Of the nodes that a group's queries have come to, those that they don't have, sent to their parts with the queries."""

    def work(part: int, table: pa.Table) -> list[dict]:
        if not _rows(table, NEXT).num_rows:
            return []
        asked = _got(table, QUERY, "unit")[0].reshape(-1, size)
        key, seen = ((at.astype(np.int64) << (62 - PLACE)) | ids for ids, at in (_got(table, kind, "ids", "at") for kind in (NEXT, SEEN)))
        key = np.sort(key)
        key, seen = key[_starts(key)], np.sort(seen)
        key = key[seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] != key]
        ids, at = key & ((1 << (62 - PLACE)) - 1), key >> (62 - PLACE)
        out = _dealt(SCORE, part, ids >> PLACE, ids=ids, at=at)
        for r in out:
            r["unit"] = asked[np.unique(np.frombuffer(r["at"], np.int32))].tobytes()
        return out

    return work


def _score(size: int):
    def work(part: int, table: pa.Table) -> list[dict]:
        units, out = _got(table, UNITS, "unit")[0].reshape(-1, size).astype(np.float32), []
        for r in _rows(table, SCORE).select(["src", "ids", "at", "unit"]).to_pylist():
            ids, at, asked = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["at"], np.int32), _matrix([r["unit"]], size).astype(np.float32)
            which, d = np.unique(at, return_inverse=True)[1], np.empty(len(ids), np.float32)
            for a in range(0, len(ids), 1 << 14):
                d[a : a + (1 << 14)] = 1 - np.einsum("ij,ij->i", units[_place(ids[a : a + (1 << 14)])], asked[which[a : a + (1 << 14)]])
            out.append({**_packed(FOUND, r["src"], part, d=np.maximum(d, 0)), "ids": r["ids"], "at": r["at"]})
        return out

    return work


def _saw(width: int, kept: int):
    """The best `kept` of what was seen and found. From the best `width` of what was seen a query has looked by now."""

    def work(part: int, table: pa.Table) -> list[dict]:
        ids, at, d, flag = _got(table, SEEN, "ids", "at", "d", "flag")
        more = _got(table, FOUND, "ids", "at", "d")
        flag = np.r_[(flag > 0) | (_ranks(at) < width), np.zeros(len(more[0]), bool)]
        ids, at, d = (np.r_[x, y] for x, y in zip((ids, at, d), more))
        order = np.lexsort((ids, d, at)) if len(more[0]) else np.arange(len(ids))
        order = order[_ranks(at[order]) < kept]
        return [_packed(SEEN, part, ids=ids[order], at=at[order], d=d[order], flag=flag[order])]

    return work


def _best_seen(most: int, margin: float, size: int):
    """qid, nid, d: what a query has seen, the `most` nearest and all that are farther than the last of these by no more than `margin`."""

    def run(table: pa.Table) -> pa.Table:
        qids, (ids, at, d) = _got(table, QUERY, "ids")[0], _got(table, SEEN, "ids", "at", "d")
        rank, last = _ranks(at), np.full(len(qids), np.inf, np.float32)
        last[at[rank == most - 1]] = d[rank == most - 1]
        good = (rank < most) | (d <= last[at] + margin)
        return pa.table({"qid": qids[at[good]], "nid": ids[good], "d": d[good]})

    return run


def _brute_force(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """queries(qid, asked), few -> qid, far, many: the distance of the k-th nearest node besides the query's own, and how many
    nodes that counts (fewer than k in a small table). One pass over the nodes; a task keeps the k nearest of its own."""
    rows, size = queries.select("qid", "asked").collect(), index.size
    ids = np.array([r["qid"] for r in rows], np.int64)
    shared = index.units.sparkSession.sparkContext.broadcast((ids, _matrix([bytes(r["asked"]) for r in rows], size).astype(np.float32) if rows else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        best = np.empty((len(ids), 0), np.float32)
        for b in batches:
            for part, unit in zip(b.column("part").to_pylist(), b.column("unit").to_pylist()):
                if len(ids):
                    x = _matrix([unit], size).astype(np.float32)
                    d = 1 - asked @ x.T
                    own = np.flatnonzero(ids >> PLACE == part)
                    d[own, _place(ids[own])] = np.inf
                    best = np.c_[best, np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d]
                    best = np.sort(best, axis=1)[:, :k]
        q, _ = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(best[np.isfinite(best)], pa.float32())], names=["qid", "d"])

    found = index.units.mapInArrow(run, "qid long, d float").withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d"))).where(F.col("r") <= k)
    return found.groupBy("qid").agg(F.max("d").alias("far"), F.count("*").alias("many"))


def _recall(seen: DataFrame, truth: DataFrame) -> float:
    """The share of the nearest that was seen. Nodes as near as the k-th count as well as it does."""
    met = seen.where("nid <> qid").join(F.broadcast(truth), "qid").where(F.col("d") <= F.col("far") + 1e-6).groupBy("qid").agg(F.count("*").alias("met"))
    share = truth.join(met, "qid", "left").agg(F.sum(F.least(F.coalesce("met", F.lit(0)), "many")) / F.sum("many")).first()[0]
    return 1.0 if share is None else share


def _nodes(index: Index) -> DataFrame:
    """nid, unit: a row a node."""
    size = index.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, unit in zip(b.column("part").to_pylist(), b.column("unit").to_pylist()):
                x = _matrix([unit], size)
                yield pa.RecordBatch.from_arrays([pa.array(_ids(part, len(x))), _binary(x)], names=["nid", "unit"])

    return index.units.mapInArrow(run, "nid long, unit binary")


def search(index: Index, queries: DataFrame, k: int, width: int = WIDTH, recall: float = RECALL, sample: int = SAMPLE, reverse: int = REVERSE) -> DataFrame:
    """queries(qid: a node) -> qid, nid, d: its own node and the k best nodes besides that a greedy search finds, with all that
    may be as near by the original vectors. Beyond the number of nodes the width doesn't grow: by then all that the graph reaches was seen."""
    size, graph, degree = index.size, index.graph, index.degree
    queries = durable(queries.join(_nodes(index).withColumnsRenamed({"nid": "qid", "unit": "asked"}), "qid"), "queries")
    paths = durable(_by_part([graph, _each(graph, _edges(degree, reverse))], _paths(degree, reverse)), "paths")
    truth, most = durable(_brute_force(index, bounded_sample(queries, "qid", sample), k), "truth"), index.vectors.count()
    groups, width = max(1, -(-queries.count() // QUERIES)), max(width, 2 * (k + 1))
    kept = KEPT * width
    begun = durable(queries.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(groups))).groupBy("part").applyInArrow(_begin, _MESSAGE), "begun")
    asked, seen = begun.where(F.col("kind") == QUERY), begun.where(F.col("kind") == SEEN)
    while True:
        while _sums(seen, lambda table, width=width: (len(_fresh(table, width)[0]),), ["fresh"])[0]:
            step = _by_part([paths, _each(seen, _expand(width))], _follow(degree + reverse))
            scored = _by_part([index.units, _by_part([asked, seen, step], _unseen(size))], _score(size))
            seen = durable(_by_part([seen, scored], _saw(width, kept)), "seen")
        best = asked.unionByName(seen).groupBy("part").applyInArrow(_best_seen(k + 1, 2 * ROUNDING, size), "qid long, nid long, d float")
        if width >= most or _recall(best, truth) >= recall:
            return best
        width *= 2
        if width > kept:
            kept, seen = KEPT * width, _each(seen, _anew)


def nearest(vectors: DataFrame, asked: DataFrame, k: int, **params) -> DataFrame:
    """The k nearest rows found for each row of vectors whose id is in asked(vec_id): query_id, rank, vec_id, score."""
    index = build(vectors, **params)
    rows = index.members.join(asked.select("vec_id").distinct(), "vec_id", "left_semi")
    # Ids that share a vector ask once.
    found = search(index, rows.select(F.col("nid").alias("qid")).distinct(), k).select("qid", "nid")
    exact = found.join(index.vectors.withColumnRenamed("embedding", "x"), "nid").join(index.vectors.select(F.col("nid").alias("qid"), F.col("embedding").alias("y")), "qid")
    exact = exact.select("qid", "nid", cosine(F.col("x"), F.col("y")).alias("score"))
    few = index.members.withColumn("r", F.row_number().over(Window.partitionBy("nid").orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    best = exact.join(few, "nid").withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    per = rows.select(F.col("nid").alias("qid"), F.col("vec_id").alias("query_id")).join(best.select("qid", "vec_id", "score"), "qid").where("vec_id <> query_id")
    out = per.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)
