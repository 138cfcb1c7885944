"""Document fingerprints from prefix polynomial hashes.

A prefix array holds the hash ``sum(code[i] * B**i) mod 2**31 - 1`` of every prefix of a text, for two bases.  The hash of
any span is a difference of two entries, brought back to position 0 by a power of the inverse base: two spans are equal if
these agree, and the longest common extension of two positions is found by binary search.

A fingerprint is the hash and length of the whole text and the least ``SLOTS`` mixed hashes of its spans of ``SPAN`` code
points, each with its number among the equal spans of a block.  The likeness of two fingerprints estimates the share of spans
that their texts have in common, repeats counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices, texts_of

P = np.uint64(2**31 - 1)
#: One base for each of the two hashes.
BASES = (1_213_417_691, 907_133_923)
#: Code points whose prefix array is held at a time when a text is fingerprinted.
BLOCK = 1 << 15
SPAN = 8
SLOTS = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


def reduced(x: np.ndarray) -> np.ndarray:
    """Modulo 2**31 - 1, by adding the high bits to the low ones."""
    x = (x & P) + (x >> np.uint64(31))
    x = (x & P) + (x >> np.uint64(31))
    return np.where(x >= P, x - P, x)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), int(P)))
        out = np.concatenate([out, reduced(out * step)])
    return out[:n]


def tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, for texts of up to ``n`` code points; a process keeps them for sizes up to a block."""
    make = lambda m: [(_powers(b, m + 1), _powers(pow(b, -1, int(P)), m + 1)) for b in BASES]
    return kept(("prefix powers", BLOCK), lambda: make(BLOCK + SPAN)) if n <= BLOCK + SPAN else make(n)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class PrefixHashes:
    """Hashes of all spans of a text (given as code points plus one)."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.tables = tables(self.n)
        # the sum of up to 2**33 entries below 2**31 fits 64 bits
        self.prefix = [reduced(np.concatenate([np.zeros(1, np.uint64), np.cumsum(reduced(codes * powers[: self.n]))])) for powers, _ in self.tables]

    def span(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """62-bit hashes of the spans of ``length`` code points from ``at`` on."""
        out = None
        for (_, inverse), prefix in zip(self.tables, self.prefix):
            h = reduced((prefix[at + length] + P - prefix[at]) * inverse[at])
            out = h if out is None else (out << np.uint64(31)) | h
        return out

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length."""
        count, out = self.n - length + 1, None
        for (_, inverse), prefix in zip(self.tables, self.prefix):
            h = reduced((prefix[length:] + P - prefix[:count]) * inverse[:count])
            out = h if out is None else (out << np.uint64(31)) | h
        return out

    def whole(self) -> int:
        return int(self.prefix[0][self.n]) << 31 | int(self.prefix[1][self.n])

    def common(self, at: np.ndarray, other: PrefixHashes, place: np.ndarray) -> np.ndarray:
        """Longest common extensions: how far the texts agree from ``at`` here and ``place`` there, by binary search."""
        at, place = np.asarray(at, np.int64), np.asarray(place, np.int64)
        low, high = np.zeros(len(at), np.int64), np.minimum(self.n - at, other.n - place)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.span(at, middle) == other.span(place, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _least(values: np.ndarray, slots: int) -> np.ndarray:
    """The least distinct values."""
    if len(values) > 8 * slots:  # far fewer are looked at, if they hold enough distinct ones
        few = np.unique(values[values < np.uint64(2**64 * (4 * slots / len(values)))])
        if len(few) >= slots:
            return few[:slots]
    return np.unique(values)[:slots]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * MIX
    return (h ^ (h >> np.uint64(29))) * MIX


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Mixed hashes in which the second, third, ... of equal ones differ from the first."""
    h = np.sort(hashes)
    again = np.flatnonzero(h[1:] == h[:-1]) + 1
    out = _mixed(h)
    if len(again):
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        number = again - starts[np.searchsorted(starts, again, "right") - 1]
        out[again] = _mixed(out[again] ^ number.astype(np.uint64))
    return out


def span_of(n: int, span: int = SPAN) -> int:
    """Length of the spans of a text: shorter for texts that have fewer than four of ``span``."""
    return min(span, max(1, n // 4))


def fingerprint(codes: np.ndarray, span: int = SPAN, slots: int = SLOTS) -> tuple[int, int, np.ndarray]:
    """Length, hash of all, and the least mixed hashes of numbered spans (high 32 bits).

    The prefix array is built a block at a time, so memory does not grow with the text.
    """
    n, hashes, least = len(codes), [0, 0], np.zeros(0, np.uint64)
    span = span_of(n, span)
    for at in range(0, n, BLOCK):
        here = PrefixHashes(codes[at : at + BLOCK + span - 1])
        inside = min(BLOCK, n - at)
        for k, base in enumerate(BASES):
            hashes[k] = (hashes[k] + pow(base, at, int(P)) * int(here.prefix[k][inside])) % int(P)
        if here.n >= span:
            h = _numbered(here.windows(span))
            least = _least(np.concatenate([least, _least(h, slots)]) if at else h, slots)
    return n, hashes[0] << 31 | hashes[1], least >> np.uint64(32)


def written(mark: tuple[int, int, np.ndarray]) -> str:
    """A fingerprint as text: length and hash of the whole, 16 hex digits each, then 8 digits for each slot."""
    n, whole, least = mark
    return f"{n:016x}{whole:016x}{least.astype('>u4').tobytes().hex()}"


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray], slots: int = SLOTS) -> float:
    """Estimated share of spans in common, 0 to 1; 1 for equal texts."""
    if a[:2] == b[:2]:
        return 1.0
    x, y = set(a[2].tolist()), set(b[2].tolist())
    top = min((max(z) for z in (x, y) if len(z) >= slots), default=None)
    if top is not None:  # beyond the least of the two greatest one of them is not known
        x, y = {v for v in x if v <= top}, {v for v in y if v <= top}
    return len(x & y) / len(x | y) if x or y else 0.0


KEY = ["no_id", "place", "text_hash"]
OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "common_prefix long"
)


def _key_bytes(no_id: np.ndarray, place: np.ndarray, text_hash: np.ndarray) -> np.ndarray:
    """Keys as byte strings that sort like them."""
    out = np.zeros((len(place), 17), np.uint8)
    out[:, 0] = no_id
    for at, column in ((1, place), (9, text_hash)):
        out[:, at : at + 8] = (column.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by as many code points from the start of the other (or all it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of the text edited with its neighbour, the next by descending id, after the last the first.

    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``,
    ``common_prefix`` (code points that text and edited text share from the start, by binary search on the prefix arrays).

    A null text is empty.  Rows without an id come after all others; rows that share an id follow one another by a hash
    of their texts.  Equal rows follow each other: all but the last of them have their own text as next.

    Rows are dealt by range into blocks whose first keys are known, and the first row of a block is also sent to the
    block before it, so that each row finds its next one in its own task.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"), text.alias("text"), doc_id.isNull().cast("int").alias("no_id"),
        F.coalesce(F.bitwise_not(doc_id), F.lit(0)).cast("long").alias("place"), F.xxhash64(text).alias("text_hash"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.select(*KEY).distinct().repartitionByRange(parts, *KEY).withColumn("part", F.spark_partition_id())
    firsts = [r[0] for r in ranges.groupBy("part").agg(F.min(F.struct(*KEY)).alias("first")).select("first").collect()]  # one a partition
    bounds = np.sort(_key_bytes(*(np.array([f[k] for f in firsts], np.int64) for k in range(3))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            keys = _key_bytes(*(batch.column(c).to_numpy() for c in KEY))
            _, first, copies = np.unique(keys, return_index=True, return_counts=True)  # equal rows travel as one with their number
            block = np.searchsorted(bounds, keys[first], "right") - 1
            leads = bounds[block] == keys[first]
            take = np.concatenate([first, first[leads]])
            out = batch.take(pa.array(take))
            target = np.concatenate([block, (block[leads] - 1) % len(bounds)])
            extra = [target.astype(np.int32), np.concatenate([np.zeros(len(first), np.int32), np.ones(leads.sum(), np.int32)]), np.concatenate([copies, copies[leads]])]
            yield pa.RecordBatch.from_arrays([*out.columns, *map(pa.array, extra)], names=[*out.schema.names, "block", "guest", "copies"])

    dealt = rows.mapInArrow(deal, "doc_id long, text string, no_id int, place long, text_hash long, block int, guest int, copies long")
    dealt = dealt.repartitionById(parts, "block").sortWithinPartitions("block", "guest", *KEY)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in OUT.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
        out: list[tuple] = []

        def row(doc_id, text, own, other_text, other):
            changed = edited(text, other_text)
            codes = codes_of(changed)
            new = fingerprint(codes)
            # the texts agree on what was kept; beyond that they mostly part at once, so spans grow from a short one
            at, head, same = len(text) - len(text) // 2, 64, True
            while same and at < len(changed):
                step = min(head, len(text) - at, len(changed) - at)
                ours, theirs = PrefixHashes(codes_of(text[at : at + step])), PrefixHashes(codes[at : at + step])
                shared = int(ours.common([0], theirs, [0])[0])
                at, head, same = at + shared, min(2 * head, BLOCK), shared == step
            shared = at
            return (
                doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(new),
                likeness(own, new), likeness(own, other), shared,
            )

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

        held, closed = None, False
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("doc_id", *KEY, "guest", "copies")]
            for doc_id, no_id, place, text_hash, guest, copies, text in zip(*columns, texts_of(batch)):
                key = (no_id, place, text_hash)
                if not guest and held is not None and held[1] == key:
                    held[4] += copies
                    continue
                if closed:
                    continue
                own = fingerprint(codes_of(text))
                if held is not None:
                    if held[4] > 1:
                        again = row(held[0], held[2], held[3], held[2], held[3])
                        for at in range(0, held[4] - 1, 4096):
                            yield batch_of([again] * min(4096, held[4] - 1 - at))
                    out.append(row(held[0], held[2], held[3], text, own))
                held, closed = [doc_id, key, text, own, copies], bool(guest)
            if len(out) >= 256:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(mark, OUT)
