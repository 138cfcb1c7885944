"""Embedding near-dedup by NN-descent.

Equal vectors of one label are one class.  A graph holds the ``NEIGHBOURS`` nearest classes known of each class.  It starts
from blocks of random orders (classes sorted by the signs of random projections), more of them the larger the label, so that
a pair at the threshold meets in one.  It is refined by local joins: all neighbours of a class, and those that count it as
theirs, are compared with each other.  Pairs at the threshold are links.

Each round also draws fresh orders.  The share of their links that the graph had before is its recall, measured on links
however rare they are; a label goes on, with all links found kept, until that share is enough.  A list full of links is
saturated: there are more links than it can hold.  Such lists are enlarged to their whole component, which is compared tile
by tile, each task returning counts for its members rather than pairs.  At last an audit takes a bounded sample of classes
and finds their links exactly among all classes; while it falls short, all labels are refined again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, longs_of
from .components import components

THRESHOLD = 0.93
NEIGHBOURS = 8
BITS = 32
BLOCK = 256
#: Share of the pairs at the threshold that the first orders are to meet, and fresh orders of a round.
COVER = 0.99
FRESH = 4
REVERSE = 64
TILE = 512
AUDITED = 512
RECALL = 0.98
EDGE = "v long, u long, sim double"


def _vectors(batch: pa.RecordBatch, name: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """Flat doubles of the vectors of a batch, and their offsets."""
    column = batch.column(name)
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length one.  Scaled by a power of two first, so that no square overflows or vanishes."""
    with np.errstate(under="ignore"):
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _units(flat: np.ndarray, offsets: np.ndarray, a: int, b: int, dim: int) -> np.ndarray:
    return _scaled(flat[offsets[a] : offsets[b]].reshape(b - a, dim))


def _edges(v: list, u: list, sim: list) -> Iterator[pa.RecordBatch]:
    if v:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (v, u, sim)], names=["v", "u", "sim"])


def _nearest(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges from each row to its ``k`` most similar others with another id."""
    sim = x @ x.T
    sim[ids[:, None] == ids[None, :]] = -2
    k = min(k, len(x) - 1)
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k < len(x) - 1 else np.argsort(-sim, axis=1)[:, :k]
    s = np.take_along_axis(sim, best, axis=1)
    ok = s > -2
    return np.repeat(ids, k).reshape(-1, k)[ok], ids[best][ok], s[ok]


def vector_classes(rows: DataFrame) -> DataFrame:
    """Distinct vectors of a label: ``v`` (smallest id), ``label``, ``dim``, ``vec``, ``copies``.  ``rows``: vec_id, label, vec."""
    return rows.distinct().groupBy("label", "vec").agg(F.min("vec_id").alias("v"), F.count("*").alias("copies")).select("v", "label", F.size("vec").alias("dim"), "vec", "copies")


def orders_needed(size: Column, block: int, threshold: float, cover: float) -> Column:
    """Orders in which pairs at the threshold meet with probability ``cover``, for a label of ``size`` classes.

    A block holds classes whose codes agree in about log2(2 size / block) bits.  Signs agree with probability 1 - angle / pi.
    """
    agree = F.pow(F.lit(1 - math.acos(threshold) / math.pi), F.greatest(F.log2(2 * size / block), F.lit(0.0)))
    needed = F.ceil(math.log(1 - cover) / F.log(1 - F.least(agree, F.lit(0.999))))
    return F.when(size <= block, 1).otherwise(needed).cast("int")


def first_graph(classes: DataFrame, k: int, block: int, turn: int) -> DataFrame:
    """Neighbours within blocks of ``block`` classes in random orders; blocks overlap by half.

    The column ``orders`` says how many orders a class takes part in; ``turn`` chooses which.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            flat, offsets = _vectors(batch)
            dims, orders = longs_of(batch, "dim"), longs_of(batch, "orders")
            for o in range(int(orders.max(initial=0))):
                codes = np.zeros(batch.num_rows, np.int64)
                for dim in np.unique(dims[orders > o]).tolist():
                    if (dim, o) not in planes:
                        planes[dim, o] = np.random.default_rng([11, dim, turn, o]).normal(size=(dim, BITS))
                    at = np.flatnonzero((dims == dim) & (orders > o))
                    signs = _scaled(flat[offsets[at][:, None] + np.arange(dim)]) @ planes[dim, o] > 0
                    codes[at] = signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                columns = [pa.array(np.full(batch.num_rows, o, np.int32)), *(batch.column(c) for c in ("label", "dim")), pa.array(codes), batch.column("v"), batch.column("vec")]
                out = pa.RecordBatch.from_arrays(columns, names=["o", "label", "dim", "code", "v", "vec"])
                yield out if orders.min() > o else out.filter(pa.array(orders > o))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tail, tail_ids = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, offsets = _vectors(batch)
            o, label, dim, v = (longs_of(batch, c) for c in ("o", "label", "dim", "v"))
            starts = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (label[1:] != label[:-1]) | (dim[1:] != dim[:-1])])
            found = [], [], []
            for a, b in zip(starts.tolist(), np.r_[starts[1:], len(o)].tolist()):
                here = (o[a], label[a], dim[a])
                x, ids = _units(flat, offsets, a, b, int(dim[a])), v[a:b]
                if key == here:
                    x, ids = np.concatenate([tail, x]), np.concatenate([tail_ids, ids])
                key, tail, tail_ids = here, x[-(block // 2) :], ids[-(block // 2) :]
                for s in range(0, max(1, len(ids) - block // 2), block // 2):
                    if len(ids[s : s + block]) > 1:
                        for part, got in zip(found, _nearest(x[s : s + block], ids[s : s + block], k)):
                            part.append(got)
            yield from _edges(*found)

    kind = dict(classes.dtypes)["vec"]
    rows = classes.mapInArrow(coded, f"o int, label long, dim int, code long, v long, vec {kind}")
    order = ["o", "label", "dim", "code", "v"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, EDGE)


def best_of(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar neighbours of each class; equal ones by id."""
    order = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    return edges.groupBy("v", "u").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def local_join(graph: DataFrame, classes: DataFrame, k: int, reverse: int) -> DataFrame:
    """New edges between neighbours of a common class.

    A class that very many count as neighbour meets them in groups of about ``reverse``, its own neighbours in each.
    """
    back = graph.select(F.col("u").alias("w"), F.col("v").alias("u")).join(graph.select(F.col("v").alias("w"), "u"), ["w", "u"], "left_anti")
    groups = cut(graph.groupBy(F.col("u").alias("w")).agg(F.ceil(F.count("*") / reverse).cast("int").alias("groups")))
    own = graph.select(F.col("v").alias("w"), "u").join(groups, "w", "left")
    own = own.select("w", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1)).alias("c"), "u")
    others = back.join(groups, "w").select("w", F.pmod(F.xxhash64("u"), "groups").cast("int").alias("c"), "u")
    sent = own.union(others).join(classes.select(F.col("v").alias("u"), "dim", "vec"), "u")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, held_ids = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, offsets = _vectors(batch)
            w, c, dim, u = (longs_of(batch, n) for n in ("w", "c", "dim", "u"))
            starts = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (c[1:] != c[:-1])])
            found = [], [], []
            for a, b in zip(starts.tolist(), np.r_[starts[1:], len(w)].tolist()):
                x, ids = _units(flat, offsets, a, b, int(dim[a])), u[a:b]
                if key == (w[a], c[a]):  # a group over the border of two batches
                    x, ids = np.concatenate([held, x]), np.concatenate([held_ids, ids])
                key, held, held_ids = (w[a], c[a]), x, ids
                if len(ids) > 1:
                    for part, got in zip(found, _nearest(x, ids, k)):
                        part.append(got)
            yield from _edges(*found)

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "w", "c").sortWithinPartitions("w", "c").mapInArrow(joined, EDGE)


def dense_links(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """``v``, ``n`` (copies linked) among all members of each group, tile by tile.  ``members``: group, v, dim, vec, copies."""
    tiles = cut(members.groupBy("group").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    placed = members.join(tiles, "group").withColumn("mine", F.pmod(F.xxhash64("v"), "tiles").cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sent = sent.select("group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("second"), "v", "dim", "vec", "copies")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x, v, copies = None, None, None, None  # residents: members of tile i, seen before those of tile j
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, offsets = _vectors(batch)
            g, i, j, dim, ids, n = (longs_of(batch, c) for c in ("group", "i", "j", "dim", "v", "copies"))
            second = batch.column("second").to_numpy(zero_copy_only=False)
            change = (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (second[1:] != second[:-1])
            starts = np.flatnonzero(np.r_[True, change])
            out_v, out_n = [], []
            for a, b in zip(starts.tolist(), np.r_[starts[1:], len(g)].tolist()):
                here = (g[a], i[a], j[a])
                y = _units(flat, offsets, a, b, int(dim[a]))
                if key != here:
                    key, x, v, copies = here, y[:0], ids[:0], n[:0]
                if i[a] == j[a]:
                    near = y @ y.T >= threshold
                    np.fill_diagonal(near, False)
                    out_v.append(ids[a:b]), out_n.append(near @ n[a:b])
                if len(x) and (second[a] or i[a] == j[a]):
                    near = x @ y.T >= threshold
                    out_v += [v, ids[a:b]]
                    out_n += [near @ n[a:b], near.T @ copies]
                if not second[a]:
                    x, v, copies = np.concatenate([x, y]), np.concatenate([v, ids[a:b]]), np.concatenate([copies, n[a:b]])
            if out_v:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_n).astype(np.int64))], names=["v", "n"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["group", "i", "j", "second"]
    return sent.repartition(parts, "group", "i", "j").sortWithinPartitions(*order).mapInArrow(counted, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))


def audit(classes: DataFrame, links: DataFrame, threshold: float, audited: int) -> float:
    """Share of the true links of ``audited`` classes (those least by hash) that ``links`` (v, n) has."""
    sample = classes.orderBy(F.xxhash64("v", F.lit("audit")), "v").limit(audited)
    asked = [(r.v, r.label, r.dim, r.vec) for r in sample.select("v", "label", "dim", "vec").collect()]
    groups: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for label, dim in {(r[1], r[2]) for r in asked}:
        of = [r for r in asked if r[1:3] == (label, dim)]
        groups[label, dim] = np.array([r[0] for r in of]), _scaled(np.array([r[3] for r in of], float))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _vectors(batch)
            label, dim, v, copies = (longs_of(batch, c) for c in ("label", "dim", "v", "copies"))
            for (of_label, of_dim), (ids, x) in groups.items():
                at = np.flatnonzero((label == of_label) & (dim == of_dim))
                if len(at):
                    y = flat[offsets[at][:, None] + np.arange(of_dim)]
                    near = x @ _scaled(y).T >= threshold
                    near &= ids[:, None] != v[at][None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((near @ copies[at]).astype(np.int64))], names=["v", "n"])

    true = {r["v"]: r["n"] for r in classes.mapInArrow(exact, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()}
    names = classes.sparkSession.createDataFrame([(a[0],) for a in asked], "v long")
    found = {r["v"]: r["n"] for r in links.join(F.broadcast(names), "v").collect()}
    total = sum(true.values())
    return sum(min(found.get(v, 0), n) for v, n in true.items()) / total if total else 1.0


def _with_orders(classes: DataFrame, threshold: float) -> DataFrame:
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    return classes.join(sizes, ["label", "dim"]).withColumn("orders", orders_needed(F.col("size"), BLOCK, threshold, COVER)).drop("size")


def refined(graph: DataFrame, classes: DataFrame, going: DataFrame, k: int, threshold: float, turn: int) -> tuple[DataFrame, DataFrame]:
    """The graph after a local join and fresh orders of the classes ``going``, and per label and length how many links these
    orders met and how many of them the graph knew.

    Only links of classes whose list is not full of links count: full lists are enlarged later and need not hold them.
    """
    fresh = cut(best_of(first_graph(going.withColumn("orders", F.lit(FRESH)), k, BLOCK, turn), k))
    held = graph.where(F.col("sim") >= threshold)
    full = held.groupBy("v").count().where(F.col("count") >= k)
    asked = fresh.where(F.col("sim") >= threshold).join(full, "v", "left_anti")
    both = held.select("v", "u").union(held.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct().withColumn("had", F.lit(1))
    told = asked.join(both, ["v", "u"], "left").join(going.select("v", "label", "dim"), "v")
    shares = cut(told.groupBy("label", "dim").agg(F.count("*").alias("met"), F.count("had").alias("known")))
    joined = local_join(graph.join(going.select("v"), "v", "left_semi"), classes, k, REVERSE)
    return cut(best_of(graph.union(fresh).union(joined), k)), shares


def near_duplicates(
    embeddings: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, recall: float = RECALL,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept``, ``audited_recall`` for each row.

    Rows link if their labels are equal, their vectors of one length, and their cosine is at least ``threshold``.  Vectors
    that are null, empty, zero or hold null or non-finite parts, rows without a label or without an id link with nothing;
    their component is their own id.  A repeated row (id, label and vector) is one vector, reported as often as it comes.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vec"))
    sound = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = cut(_with_orders(vector_classes(rows.where("sound").drop("sound")), threshold))
    graph = cut(best_of(first_graph(classes, neighbours, BLOCK, 0), neighbours))
    copies = classes.select(F.col("v").alias("u"), "copies")
    turn, met = 0, 1.0
    while True:
        going = classes
        while True:
            turn += 1
            graph, shares = refined(graph, classes, going, neighbours, threshold, turn)
            short = shares.where(F.col("known") < recall * F.col("met"))
            known = shares.agg(F.sum("known"), F.sum("met")).first()
            met = known[0] / known[1] if known[1] else met
            if short.isEmpty():
                break
            going = cut(classes.join(short.select("label", "dim"), ["label", "dim"], "left_semi"))
        close = graph.where(F.col("sim") >= threshold)
        pairs = cut(close.select("v", "u").union(close.select("u", "v")).distinct())
        member = cut(components(pairs.select(F.col("v").alias("a"), F.col("u").alias("b"))))
        group = member.union(member.select(F.col("component").alias("node"), "component").distinct())
        full = close.groupBy("v").count().where(F.col("count") >= neighbours)
        dense = cut(group.join(full, group["node"] == full["v"]).select(F.col("component").alias("group")).distinct())
        members = group.join(dense, group["component"] == dense["group"]).select("group", F.col("node").alias("v")).join(classes, "v")
        counted = dense_links(members, threshold, TILE)
        listed = pairs.join(copies, "u").groupBy("v").agg(F.sum("copies").alias("m"))
        links = cut(listed.join(counted, "v", "full").select("v", F.greatest("m", "n").alias("n")))
        reached = min(met, audit(classes, links, threshold, AUDITED))
        if reached >= recall:
            break
    told = classes.select("v", "label", "vec", "copies").join(links, "v", "left").join(group.select(F.col("node").alias("v"), "component"), "v", "left")
    told = told.select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "v").alias("component_id"))
    linked = rows.where("sound").drop("sound").join(told, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone)
    return out.withColumns({"kept": F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)), "audited_recall": F.lit(reached)})
