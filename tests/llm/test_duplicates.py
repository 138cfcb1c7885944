"""Near-duplicate operators against brute force."""

import collections
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from ledgerlens.llm import nn_descent
from ledgerlens.llm.chunk_dedup import anchors, chunks, drop_spans, gear, gear_table, repeated_spans, substring_repeats
from ledgerlens.llm.components import components, forest
from ledgerlens.llm.line_dedup import drop_lines
from ledgerlens.llm.simhash_tiles import fingerprint, near_duplicates, similar_classes

from .conftest import words

SPACE = " \t\n\x0b\x0c\r"


class Union:
    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not found:
        return 0
    parts = [" ".join(found[k : k + 3]) for k in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(60)] + [(1000, 2000 + k) for k in range(500)] + [(rng.randint(5000, 5300), rng.randint(5000, 5300)) for _ in range(150)] + [(7, 7), (None, 3)]
    u = Union()
    for a, b in pairs:
        if a is not None:
            u.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: u.find(n) for n in u.up if u.find(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_keeps_components():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, 400), rng.integers(0, 300, 400)
    u, v = Union(), Union()
    for x, y in zip(a.tolist(), b.tolist()):
        u.join(x, y)
    x, y = forest(a, b)
    assert len(x) < len(set(a) | set(b))
    for p, q in zip(x.tolist(), y.tolist()):
        v.join(p, q)
    assert all(u.find(n) == v.find(n) for n in u.up)


@pytest.mark.parametrize("chunk", [4096, 3])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_tiles_miss_no_link(spark, chunk, radius):
    rng = random.Random(radius)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            f ^= 1 << rng.randrange(64)
            f ^= rng.choice([0, 1 << rng.randrange(64)])
    fps = [0, 2**64 - 1, 1, 3, *sorted(fps)]
    u = Union()
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                u.join(i, j)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    got = {r.node: r.component for r in components(similar_classes(spark.createDataFrame(rows, "fp long, rep long"), radius, chunk)).collect()}
    assert got == {n: u.find(n) for n in u.up if u.find(n) != n}


def test_simhash(odd, odd_rows, none, spark, real):
    some = [tuple(r) for r in real.select("doc_id", "text").where("doc_id % 3 = 0").collect()]
    for rows, df in ((odd_rows, odd), (some, spark.createDataFrame(some, "doc_id long, text string"))):
        fps = [plain_fingerprint(r[1]) for r in rows]
        assert fps == [fingerprint(r[1] or "") for r in rows]
        u = Union()
        for i, a in enumerate(fps):
            u.find(i)
            for j in range(i):
                if (a ^ fps[j]).bit_count() <= 2 or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                    u.join(i, j)
        least = {}
        for i, r in enumerate(rows):
            if r[0] is not None:
                least[u.find(i)] = min(least.get(u.find(i), r[0]), r[0])
        want = sorted((r[0] or -1, f"{fps[i]:016x}", least.get(u.find(i), -1)) for i, r in enumerate(rows))
        assert sorted((r.doc_id or -1, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in near_duplicates(df).collect()) == want
    assert near_duplicates(none).count() == 0


def plain_drop(rows, min_key=20, min_docs=3):
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(SPACE))
    holds, rank = collections.defaultdict(set), lambda i: -(2**63) if i is None else i
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_key:
                holds[key(line)].add(rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holds.get(key(x), ())) < min_docs or max(holds[key(x)]) == rank(i)]
        out.append((rank(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("partitions", ["8", "61"])
def test_line_dedup(spark, odd, odd_rows, none, partitions):
    rng = random.Random(4)
    common = [words(rng, 8) for _ in range(6)]
    rows = [(r[0], r[1]) for r in odd_rows] + [(1000 + k, "\n".join(rng.choices([*common, words(rng, 5), "", "no"], k=9))) for k in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions == "8")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, kept_text string, n_lines long")
        for min_docs in (2, 3, 5):
            got = sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in drop_lines(df, min_docs=min_docs).collect())
            assert got == plain_drop(rows, min_docs=min_docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert drop_lines(none).count() == 0


def test_gear_is_local():
    table, data = gear_table(), np.frombuffer(random.Random(5).randbytes(3000), np.uint8)
    want, h = [], 0
    for i in range(len(data)):
        h = sum(int(table[data[i - j]]) << j for j in range(min(16, i + 1))) % 2**32
        want.append(h)
    assert gear(data, table).tolist() == want
    for text in ("", "a", "é" * 3000, "a" * 5000, "xyz é漢 " * 900):
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = anchors(raw, table)
        assert (not len(raw) and not len(ends)) or ends[-1] == len(raw)
        cut = [bytes(raw[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        assert "".join(c.decode() for c in cut) == text and all(0 < len(c) <= 512 for c in cut)
        begin, end = chunks(raw, table)
        assert all(b - a >= 56 for a, b in zip(begin, end)) and set(begin) | set(end) <= {0, *ends}


def test_shared_passages(spark, none, odd):
    rng = random.Random(6)
    docs, passages = [], [words(rng, 60) for _ in range(40)]
    for k, p in enumerate(passages):
        docs += [(2 * k, f"{words(rng, 50)} {p} {words(rng, 20)}"), (2 * k + 1, f"{words(rng, 7)} x{p} {words(rng, 90)}")]
    docs += [(1000 + k, words(rng, 150)) for k in range(60)] + [(2000, None), (2001, ""), (None, docs[0][1]), (1059, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in substring_repeats(df).collect()}
    assert set(found) <= {2 * k + 1 for k in range(40)} and len(found) >= 39
    assert all(r.first_doc_ids == [i - 1] for i, r in found.items())
    texts = dict(docs)
    kept = {r.doc_id: r for r in drop_spans(df, repeated_spans(df)).collect()}
    for i, r in found.items():
        raw = texts[i].encode()
        for s in r.spans:
            assert raw[s.start : s.start + s.size].decode() in texts[i - 1]
        assert len(kept[i].kept_text.encode()) == len(raw) - r.n_bytes
    assert kept[0].kept_text == texts[0] and kept[2000].kept_text == ""
    assert substring_repeats(none).count() == 0
    assert {2, 3} <= {r.doc_id for r in substring_repeats(odd).collect()}


def plain_links(rows, threshold):
    sound = [i for i, (v, label, x) in enumerate(rows) if v is not None and label is not None and x and all(p is not None and np.isfinite(p) for p in x) and any(x)]
    u, near = Union(), collections.defaultdict(set)
    for i in sound:
        u.find(rows[i][0])
        for j in sound:
            (a, la, x), (b, lb, y) = rows[i], rows[j]
            if a != b and la == lb and len(x) == len(y) and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                near[a].add(b)
                u.join(a, b)
    return sorted((v, len(near[v]), u.find(v) if v in u.up else v) for v, _, _ in rows if v is not None)


def test_nn_descent(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        center = rng.normal(size=24)
        for _ in range([1, 2, 3, 40, 700][c % 5] if c < 10 else 25):
            rows.append((len(rows), int(c % 3), np.float32(center + rng.normal(size=24) * 0.08).tolist()))
    rows += [(len(rows) + k, 1, rows[0][2]) for k in range(30)]
    n = len(rows)
    rows += [(n, None, rows[0][2]), (n + 1, 1, None), (n + 2, 1, [0.0] * 24), (n + 3, 1, [float("nan")] * 24), (n + 4, 1, []), (n + 5, 1, [1.0, 2.0]), (n + 6, 1, [2.0, 4.0]),
             (n + 7, 1, [1.0, None]), (n + 8, 1, [float("inf")] * 24), (None, 1, rows[0][2]), (5, *rows[5][1:]), (n + 9, rows[0][1], [2 * x for x in rows[0][2]])]
    order = np.random.default_rng(1).permutation(len(rows)).tolist()
    df = spark.createDataFrame([(*rows[i], 1, "x") for i in order], "vec_id long, label int, embedding array<float>, n_links int, component_id string")
    out = nn_descent.near_duplicates(df).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out if r.vec_id is not None)
    assert got == plain_links(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None) and len(out) == len(rows)
    assert out[0].audited_recall >= 0.98
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def test_rare_links_of_a_large_label(spark):
    """300 planted pairs among 20,000 unrelated vectors of one label."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(300):
        aside = rng.normal(size=64)
        aside -= aside @ x[k] * x[k]
        x[10000 + k] = 0.945 * x[k] + math.sqrt(1 - 0.945**2) * aside / np.linalg.norm(aside)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "label": 1, "embedding": x.tolist()}), "vec_id long, label int, embedding array<double>")
    out = nn_descent.near_duplicates(df)
    links = {r.vec_id: r.component_id for r in out.where("n_links > 0").collect()}
    assert all(links[v] == v % 10000 for v in links) and len(links) >= 0.98 * 600
    assert abs(out.first().audited_recall - len(links) / 600) <= 0.02


def test_parts_of_any_size(spark):
    rows = [(1, 1, [1e200, 1e200]), (2, 1, [1e200, 1.01e200]), (3, 1, [1e-310, 1e-310]), (4, 1, [-1.0, 1.0]), (5, 1, [1e308, -1e308])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}
