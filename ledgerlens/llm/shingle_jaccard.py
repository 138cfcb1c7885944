"""Near-dedup by SimHash tiles, then exact Jaccard similarity of word shingles for every link.

Equal shingle sets are one class.  The SimHash of each class goes through the tiles of ``simhash_tiles``, whose links are
candidates.  Pairs at 0.8 may differ in more bits than tiles can search, so banded fingerprints add the others.  A class has ``BANDS`` fingerprints, each of the least ``ROWS`` hashes under as many
random orders, and two classes meet if one fingerprint agrees: a pair at 0.8 misses all of them once in ten million.
Pairs that meet are compared in full, so every link is exact.  First each meets the smallest of its bucket; then the
members that those links left in different groups meet each other, in tiles.

Only digests and fingerprints of all texts are kept; the hashes of a text are computed again where it is compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, longs_of, slices, texts_of
from .components import components, forest
from .simhash_tiles import FOLD, RADIUS, SEED, fingerprint, similar_classes

SHINGLE = 5
#: Least similarity of a link, in tenths: whole numbers, so that the threshold itself is met exactly.
TENTHS = 8
BANDS = 30
ROWS = 4
#: Sets compared with one set in one group of a task, and hashes that one side of a tile holds.
GROUP = 512
TILE = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return (h ^ (h >> np.uint64(29))) * MIX


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, letters A-Z folded; one of all words where they are fewer."""
    words = text.encode().translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    each = np.frombuffer(b"".join([digest(w, SEED) for w in words]), np.uint64)
    size = min(shingle, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mix(h ^ each[k : k + len(h)])
    return np.unique(h)


def band_hashes(hashes: np.ndarray, orders: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A fingerprint for each ``rows`` of the orders (odd multipliers), different from band to band."""
    least = np.full(len(orders), np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * orders).min(axis=0), out=least)
    least = least.reshape(-1, rows)
    h = np.arange(1, len(least) + 1, dtype=np.uint64)
    for k in range(rows):
        h = _mix(h ^ least[:, k])
    return h


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with two hashes that tell their text; a null text is empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("|"), "text")})


def described(texts: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``h1``, ``h2``, 128-bit digest ``d1``, ``d2`` of the shingle set, its size ``n``, SimHash ``fp``
    and ``bands`` of every row."""
    orders = np.random.default_rng(13).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = list(texts_of(batch))
            sets = [shingle_hashes(t, shingle) for t in texts]
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            bands = [band_hashes(s, orders).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            digests = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes(), SEED) for s in sets), np.int64).reshape(-1, 2)
            arrays = [*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())]
            arrays += [pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h1", "h2", "d1", "d2", "n", "fp", "bands"])

    return texts.mapInArrow(describe, "doc_id long, h1 long, h2 long, d1 long, d2 long, n long, fp long, bands array<long>")


def _sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``v`` and ``hashes`` for the wanted classes (``v``, and ``doc_id``, ``h1``, ``h2`` of the row that stands for each)."""
    keys = {c: F.col(c).alias(f"_{c}") for c in ("doc_id", "h1", "h2")}
    wanted = wanted.select("v", *keys.values())
    same = [texts["h1"] == wanted["_h1"], texts["h2"] == wanted["_h2"], texts["doc_id"].eqNullSafe(wanted["_doc_id"])]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            sets = [shingle_hashes(t, shingle).view(np.int64) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(sets, pa.list_(pa.int64()))], names=["v", "hashes"])

    return texts.join(wanted, same).select("v", "text").mapInArrow(hashed, "v long, hashes array<long>")


def linked(pairs: DataFrame, sets: DataFrame, tenths: int = TENTHS) -> DataFrame:
    """Of ``pairs`` (``a``, ``b``) those whose sets (``v``, ``hashes``) are similar.

    A set that very many are compared with meets them in groups of about ``GROUP``.
    """
    groups = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")))
    own = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("c"), F.lit(False).alias("second"), F.col("a").alias("v"))
    others = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("c"), F.lit(True).alias("second"), F.col("b").alias("v"))
    sent = own.union(others).join(sets, "v")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            a, c, v = (longs_of(batch, x) for x in ("a", "c", "v"))
            second = batch.column("second").to_numpy(zero_copy_only=False)
            column = batch.column("hashes")
            flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - (column.offsets[0].as_py() if len(column) else 0)
            near = []
            for k in range(batch.num_rows):
                one = flat[ends[k] : ends[k + 1]]
                if not second[k]:
                    key, held = (a[k], c[k]), one.copy()
                elif key == (a[k], c[k]):
                    both = len(np.intersect1d(held, one, assume_unique=True))
                    if (10 + tenths) * both >= tenths * (len(held) + len(one)):
                        near.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(v[near])], names=["a", "b"])

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "a", "c").sortWithinPartitions("a", "c", "second").mapInArrow(compared, "a long, b long")


def crossed(named: DataFrame, sets: DataFrame, tenths: int = TENTHS) -> DataFrame:
    """Links between members of a bucket that are in different groups, one of them outside the group of the bucket's first.

    ``named``: ``band``, ``v``, size ``n``, group ``g``, group ``fg`` of the first.  A bucket is cut into tiles by the hashes it
    holds: those outside by all members.  A set is sent once a tile, so a bucket of moderate sets is sent once or twice.
    """
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = F.col("g") != F.col("fg")
    sizes = named.groupBy("band").agg(F.sum("n").alias("all"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("left"))
    sizes = sizes.where("left > 0").select("band", *[F.ceil(F.col(c) / TILE).cast("int").alias(f"{c}_chunks") for c in ("all", "left")])
    there = cut(named.join(sizes, "band"), clear=True)
    chunk = lambda c: F.pmod(F.xxhash64("v"), F.col(f"{c}_chunks")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"{c}_chunks") - 1))
    held = there.where(out).select("band", chunk("left").alias("x"), every("all").alias("y"), F.lit(False).alias("second"), "v", "n", "g")
    met = there.select("band", every("left").alias("x"), chunk("all").alias("y"), F.lit(True).alias("second"), "v", "n", "g")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, index = None, [], None

        def indexed():
            hashes = np.concatenate([r[3] for r in rows])
            order = np.argsort(hashes, kind="stable")
            return hashes[order], np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])[order], *(np.array([r[k] for r in rows], np.int64) for k in range(3))

        for batch in batches:
            band, x, y, v, n, g = (longs_of(batch, c) for c in ("band", "x", "y", "v", "n", "g"))
            second = batch.column("second").to_numpy(zero_copy_only=False)
            column = batch.column("hashes")
            flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - (column.offsets[0].as_py() if len(column) else 0)
            found_a, found_b = [], []
            for k in range(batch.num_rows):
                if tile != (band[k], x[k], y[k]):
                    tile, rows, index = (band[k], x[k], y[k]), [], None
                one = flat[ends[k] : ends[k + 1]]
                if not second[k]:
                    rows.append((v[k], n[k], g[k], one.copy()))
                    continue
                if not rows:
                    continue
                index = index or indexed()
                hashes, owner, vs, ns, gs = index
                low = np.searchsorted(hashes, one, "left")
                many = np.searchsorted(hashes, one, "right") - low
                at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
                both = np.bincount(owner[at], minlength=len(rows))
                near = np.flatnonzero(((10 + tenths) * both >= tenths * (ns + n[k])) & (gs != g[k]))
                if len(near):
                    found_a.append(np.full(len(near), v[k])), found_b.append(vs[near])
            if found_a:
                a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    sent = held.union(met).join(sets, "v").repartition(parts, "band", "x", "y").sortWithinPartitions("band", "x", "y", "second")
    return sent.mapInArrow(compare, "a long, b long")


def _stored(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder and read again.  A checkpoint keeps the estimated size, a product over all joins
    behind it, whose digits double with every round of the contraction until planning never ends."""
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/near-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tiled(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Candidates ``a``, ``b`` that join all classes (``v``, SimHash ``fp``) within ``radius`` bits: equal ones meet the least, the
    others in tiles."""
    heads = cut(classes.groupBy("fp").agg(F.min("v").alias("rep")))
    equal = classes.join(heads, "fp").where("v <> rep").select(F.col("rep").alias("a"), F.col("v").alias("b"))
    return equal.union(similar_classes(heads, radius))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tenths: int = TENTHS) -> DataFrame:
    """``doc_id``, ``component_id`` (smallest id reachable) for each row.

    Texts without words are copies of each other.  Rows that share an id are one document.  A row with a null id links
    through its text; where no row reachable has an id, its component is null.
    """
    texts = _texts(docs, id_col, text_col)
    rows = cut(described(texts, shingle).withColumn("row", F.monotonically_increasing_id()))
    classes = rows.groupBy("d1", "d2").agg(F.min(F.struct("row", "doc_id", "h1", "h2", "fp")).alias("m"), F.min("doc_id").alias("least"))
    classes = cut(classes.select("d1", "d2", F.col("m.row").alias("v"), "m.doc_id", "m.h1", "m.h2", "m.fp", "least"), clear=True)
    met = rows.join(classes.select(F.col("v").alias("row")), "row").select(F.col("row").alias("v"), "n", F.explode("bands").alias("band"))
    shared = met.groupBy("band").agg(F.min(F.struct("v", "n")).alias("first"), F.count("*").alias("members")).where("members > 1")
    met = cut(met.join(cut(shared.select("band", "first"), clear=True), "band"), clear=True)  # only bands that several classes hold
    size = F.least("n", "m") * 10 >= F.greatest("n", "m") * tenths  # sets whose sizes differ by more cannot be similar
    stars = met.where("v <> first.v").select(F.col("first.v").alias("a"), F.col("v").alias("b"), "n", F.col("first.n").alias("m")).where(size).select("a", "b")
    stars = cut(tiled(classes.select("v", "fp")).union(stars).distinct(), clear=True)

    def sets_of(asked: DataFrame) -> DataFrame:
        return _sets(texts, cut(classes.join(asked.distinct(), "v").select("v", "doc_id", "h1", "h2"), clear=True), shingle)

    links = cut(linked(stars, sets_of(stars.select(F.col("a").alias("v")).union(stars.select(F.col("b").alias("v")))), tenths), clear=True)
    group = _stored(components(links))

    label = group.select(F.col("node").alias("v"), "component")
    named = met.join(label, "v", "left").select("band", "v", "n", F.coalesce("component", "v").alias("g"), F.col("first.v").alias("fv"))
    first = label.select(F.col("v").alias("fv"), F.col("component").alias("fg"))
    named = cut(named.join(first, "fv", "left").select("band", "v", "n", "g", F.coalesce("fg", "fv").alias("fg")), clear=True)
    apart = named.where("g <> fg").select("band").distinct()  # buckets that one group does not cover
    named = cut(named.join(apart, "band"), clear=True)
    if named.take(1):
        links = links.union(cut(crossed(named, sets_of(named.select("v")), tenths).distinct(), clear=True))

    told = cut(rows.select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "v"), ["d1", "d2"]).select("doc_id", "v"), clear=True)
    by_id = told.where("doc_id is not null").groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a <> z")
    same = cut(told.join(cut(by_id), "doc_id").select("a", F.col("v").alias("b")))
    found = cut(components(_stored(links.union(same))))
    named = cut(classes.select("v", "least").join(found.select(F.col("node").alias("v"), "component"), "v", "left").select("v", "least", F.coalesce("component", "v").alias("g")))
    smallest = named.groupBy("g").agg(F.min("least").alias("component_id"))
    return told.join(named.join(smallest, "g").select("v", "component_id"), "v").select("doc_id", "component_id")
