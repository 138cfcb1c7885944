"""Conversation repair, ranked search and prefix hashes against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlens.llm import conversation_repair as CR
from ledgerlens.llm import nra_search as NS
from ledgerlens.llm import prefix_hashes as PH
from ledgerlens.llm import queries as Q

from .conftest import words

BLANK = " \t\n\x0b\x0c\r"
TURNS = "conv_id long, turn long, role string, text string"


# ---------------------------------------------------------------- conversations
def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """(cost, audit, repaired lines) by trying all edits; rows are (fault, role, text)."""

    known = {}
    for i in range(len(rows), -1, -1):
        for inserts in range(4):
            for state in "-sua":
                found = [(0, "", ())] if i == len(rows) and state in "-a" else []
                follow = "a" if state == "u" else "u"
                name = {"u": "user", "a": "assistant"}[follow]

                def add(letter, cost, line, key):
                    if (rest := known[key]) is not None:
                        found.append((cost + rest[0], letter + rest[1], line + rest[2]))

                if inserts:
                    add("I", 2, (f"{name}:",), (i, follow, inserts - 1))
                if i < len(rows):
                    fault, role, text = rows[i]
                    add("D", 3, (), (i + 1, state, 3))
                    if fault not in ("blank", "duplicate"):
                        more = fault == "truncated"
                        if role[:1] == follow or role[:1] == "s" and state == "-":
                            add("K", more, (f"{role}:{text}",), (i + 1, role[:1], 3))
                        add("R", 2 + more, (f"{name}:{text}",), (i + 1, follow, 3))
                known[i, state, inserts] = min(found, default=None)
    return known[0, "-", 3]


def plain_conversations(original, rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in original}:
        mine = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        told, seen = [], set()
        for _, _, role, text in mine:
            bare = text.strip(BLANK)
            told.append(("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None, role, text))
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = plain_repair(tuple(told))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(sum(t[0] == f for t in told) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def random_turns(seed, convs, longest):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why", "", " \n", "Really?  ", "cut off", "Fine.\nMore", None, "x" * 300 + "."]
    for c in range(convs):
        for k in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            turn = rng.choice([k] * 8 + [None, k - 1, k + 3])
            rows.append((c, turn, role, rng.choice(texts) if rng.random() < 0.4 else f"Turn {rng.random()}" + rng.choice(".!? ")))
    rows += [(None, k, "user", "Hello.") for k in range(5)] + [(10**6, 0, "user", None)] + [(10**6 + 1, None, "system", "a.")] * 4
    return rows


def summed(spark, rows, damage=True):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], TURNS + ", cost long, key string")
    edits = CR.repair(CR.damaged(df) if damage else df)
    return {r.conv_id: tuple(r)[1:] for r in CR.summaries(edits, df).collect()}


def test_repair_equals_all_edits_tried(spark):
    rows = random_turns(1, 150, 9)
    assert summed(spark, rows) == plain_conversations(rows, plain_damage(rows))
    show = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    assert summed(spark, rows, damage=False) == plain_conversations(rows, show)


def test_conversations_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(CR, "PIECE", 500)
    rng = random.Random(5)
    rows = [r for r in random_turns(2, 12, 6) if r[0] is not None]
    for conv, n in ((3, 900), (7, 400), (8, 1)):  # one conversation holds most rows
        rows += [(conv, 100 + k // 2, rng.choice(["user", "assistant", "assistant", "system"]), f"{'again' if k % 9 == 0 else k}{rng.choice(['.', '!', ''])}") for k in range(n)]
    rows += [(9, None, "user", "Same.")] * 300
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert summed(spark, rows) == plain_conversations(rows, plain_damage(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_block_tables_do_not_depend_on_the_block():
    rng = random.Random(3)
    for _ in range(50):
        symbols = bytes(rng.randrange(9) for _ in range(rng.randint(0, 20)))
        traces = [list(CR.Tables(b).trace(symbols, CR.Tables(b).end, CR.START, True)) for b in (1, 2, 3)]
        assert traces[0] == traces[1] == traces[2]
        assert CR.Tables(3).costs(symbols, CR.Tables(3).end)[1] + CR.Tables(3).vectors[CR.Tables(3).through(symbols)[CR.Tables(3).end]][CR.START] == sum(t[3] for t in traces[0])


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert CR.summaries(CR.repair(none), none).count() == 0


def test_registered_repair(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in Q.QUERIES["op11_conversation_repair"](spark, sf_dir).collect()}
    assert got == plain_conversations(rows, plain_damage(rows))


# ---------------------------------------------------------------- search
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_search(docs, items, k=10):
    counts = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    wanted = collections.defaultdict(set)
    for item, text in items:
        wanted[item].update(plain_terms(text))
    out = set()
    for item, terms in wanted.items():
        found = []
        for doc, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out |= {(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])}
    return out


def asked(df):
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("postings, block_bytes", [(1 << 20, 32 << 20), (300, 32 << 20), (2000, 4000)])
def test_search_equals_all_scores(spark, odd_rows, odd, monkeypatch, postings, block_bytes):
    monkeypatch.setattr(NS, "POSTINGS", postings)
    rng = random.Random(4)
    items = [(k, words(rng, rng.randint(1, 30))) for k in range(25)]
    items += [(100, odd_rows[0][1][:200]), (101, odd_rows[8][1]), (102, "Ünïcödé 漢字"), (103, None), (104, "??"), (105, "the ONE one"), (100, "lo mi"), (None, "ka lo")]
    items += [(200 + k, " ".join(rng.sample(odd_rows[20 + k][1].split(), 15))) for k in range(10)]
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    got = asked(NS.search(odd, table, block_bytes=block_bytes))
    assert got == plain_search([(r[0], r[1]) for r in odd_rows], items)
    assert len({g[:2] for g in got}) == len(got)


def test_search_with_ties_and_hot_words(spark):
    rng = random.Random(6)
    docs = [(k, "common word " + rng.choice(["rare", "plain", "odd one", ""])) for k in range(900)] + [(900 + k, words(rng, 20)) for k in range(100)]
    items = [(0, "common"), (1, "rare odd common"), (2, "word nothing"), (3, docs[950][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = asked(NS.search(frame, spark.createDataFrame(items, "item_id long, text string")))
    assert got == plain_search(docs, items)


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(NS, "PIECE", 50)
    rng = random.Random(7)
    text = " ".join(rng.choice(["Ab", "ñ漢z", "x" * rng.randint(1, 400), "a-b_c.D9", "  "]) for _ in range(300))
    assert [t.decode() for p in NS.terms_of(text.encode()) for t in p] == plain_terms(text)


def test_search_reads_no_list_to_its_end_for_nothing():
    """Documents that cannot be among the best are left as soon as their bounds say so."""
    lists = [(np.arange(1000), np.r_[1000, np.full(999, 10)]), (np.arange(1000)[::-1], np.r_[5, np.full(999, 1)])]
    read = []
    real = NS.Level.read
    NS.Level.read = lambda self, least, only: (read.append((least, None if only is None else int(only.sum()))), real(self, least, only))[1]
    try:
        docs, scores = NS.best(lists, 1000, 500, 1)
    finally:
        NS.Level.read = real
    assert docs.tolist() == [0] and scores.tolist() == [1001]
    assert read[0][1] is None and all(n == 1 for _, n in read[1:])


def test_search_of_nothing(spark, none):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert NS.search(none, items).count() == 0
    assert NS.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_registered_search(spark, sf_dir, duck):
    got = Q.QUERIES["op12_nra_search"](spark, sf_dir)
    want = duck.execute(Q.ORACLES["op12_nra_search"]).fetchall()
    assert asked(got) == set(want) and got.count() == len(want)


# ---------------------------------------------------------------- prefix hashes
def test_spans_and_common_extensions():
    rng = random.Random(8)
    a = "".join(rng.choice("ab") for _ in range(500)) + "\U0001f600é" * 20
    b = a[:200] + "x" + a[201:]
    x, y = PH.PrefixHashes(PH.codes_of(a)), PH.PrefixHashes(PH.codes_of(b))
    for _ in range(300):
        n = rng.randint(0, 40)
        i, j = rng.randint(0, len(a) - n), rng.randint(0, len(b) - n)
        assert (x.span(np.array([i]), n) == y.span(np.array([j]), n))[0] == (a[i : i + n] == b[j : j + n])
    at, place = [rng.randint(0, len(a)) for _ in range(300)], [rng.randint(0, len(b)) for _ in range(300)]
    want = [next((k for k in range(len(a)) if a[i + k : i + k + 1] != b[j + k : j + k + 1] or i + k >= len(a)), 0) for i, j in zip(at, place)]
    assert x.common(at, y, place).tolist() == want
    code = [c + 1 for c in map(ord, a)]
    assert x.whole() == sum(c * pow(PH.BASES[0], k, 2**31 - 1) for k, c in enumerate(code)) % (2**31 - 1) << 31 | sum(c * pow(PH.BASES[1], k, 2**31 - 1) for k, c in enumerate(code)) % (2**31 - 1)


def numbered_spans(text, n, block):
    """Spans with their number among equal ones of the same block."""
    out = set()
    for at in range(0, len(text), block):
        seen = collections.Counter()
        for k in range(at, min(at + block, len(text) - n + 1)):
            seen[text[k : k + n]] += 1
            out.add((text[k : k + n], seen[text[k : k + n]]))
    return out


@pytest.mark.parametrize("block", [PH.SPAN, 64, 1000, 1 << 15])
def test_fingerprint_by_blocks(monkeypatch, block):
    monkeypatch.setattr(PH, "BLOCK", block)
    rng = random.Random(9)
    text, junk = words(rng, 400), "again and " * 150
    texts = [text, text[:1000] + words(rng, 200), text[300:], junk, junk[:700] + text[:700], text[:30], text[:34] + "x", "abcdefgh", "abcdxyzw", "abc", "a", ""]
    marks = [PH.fingerprint(PH.codes_of(t)) for t in texts]
    for t, mark in zip(texts, marks):
        assert mark[1] == PH.PrefixHashes(PH.codes_of(t)).whole() and mark[0] == len(t) and len(set(mark[2].tolist())) == len(mark[2])
        assert len(mark[2]) == min(PH.SLOTS, len(numbered_spans(t, PH.span_of(len(t)), block)))
    for t, x in zip(texts, marks):
        for u, y in zip(texts, marks):
            if PH.span_of(len(t)) == PH.span_of(len(u)) and t and u:
                a, b = (numbered_spans(v, PH.span_of(len(v)), block) for v in (t, u))
                assert abs(PH.likeness(x, y) - len(a & b) / len(a | b)) <= (0.25 if len(a | b) > PH.SLOTS else 1e-9)


def plain_marks(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, -(rows[k][0] or 0)))
    out = []
    for at, k in enumerate(order):
        doc_id, text = rows[k][0], rows[k][1] or ""
        other = rows[order[(at + 1) % len(order)]][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        shared = next((i for i, (a, b) in enumerate(zip(text, changed)) if a != b), min(len(text), len(changed)))
        own, new, theirs = (PH.fingerprint(PH.codes_of(t)) for t in (text, changed, other))
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), PH.written(own), PH.written(new), PH.likeness(own, new), PH.likeness(own, theirs), shared))
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_fingerprints_with_next_document(spark, odd_rows, partitions):
    rows = [r for r in odd_rows if r[0] is not None] + [(None, "last of all", None, None, None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, place string, block int").repartition(partitions)
    got = PH.fingerprints(frame).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_marks(rows)))


def test_fingerprints_of_repeated_rows(spark):
    rows = [(7, "abc def ghi")] * 5000 + [(7, "other text")] * 3 + [(9, None)] * 4 + [(1, "end of it")]
    got = PH.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert collections.Counter((r.doc_id, r.n_chars) for r in got) == collections.Counter((i, len(t or "")) for i, t in rows)
    assert sum(r.near_next == 1.0 for r in got) == 4999 + 2 + 3
    one = PH.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdabcd").hexdigest() and one.near_next == 1.0
    assert PH.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_fingerprints(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = Q.QUERIES["op13_prefix_hashes"](spark, sf_dir).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_marks(rows)))
    told = [r for r in got if r.n_chars > 200 and r.fingerprint != r.edited_fingerprint]
    assert sum(r.near_edited > r.near_next for r in told) > 0.95 * len(told)
