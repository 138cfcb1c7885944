"""Every stage on its own input against brute force, and the whole run."""

import random
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as CP
from ledgerlens.llm import quality_fm, shingle_jaccard, simhash_tiles
from ledgerlens.llm.string_tiling import WORD

from .conftest import words
from .test_duplicates import Union, plain_drop
from .test_texts import plain_tiles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, sf_dir, odd_rows, tmp_path_factory):
    """The documents of the table with the odd rows, the rest as it is."""
    base = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(None if r[0] is None else 10**6 + r[0], *r[1:]) for r in odd_rows], docs.schema)
    docs.unionByName(more).write.parquet(f"{base}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{base}/{t}.parquet")
    return base


@pytest.fixture(scope="module")
def outputs(spark, tables, tmp_path_factory):
    """Input and output of each stage, written and read again in between."""
    base, df, found = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{tables}/documents.parquet"), {}
    for name, stage in CP.STAGES:
        stage(spark, df, tables).write.parquet(f"{base}/{name}")
        out = spark.read.parquet(f"{base}/{name}")
        found[name] = (df, out)
        df = out
    return found


def key(rows):
    return sorted((str(r.doc_id), r.text or "") for r in rows)


def test_columns(outputs):
    for name, (_, out) in outputs.items():
        assert out.columns == COLUMNS or name == "sentencepiece"
        assert out.count()


def test_quality(spark, tables, outputs):
    docs, out = outputs["quality"]
    model = quality_fm.learn(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    want = []
    for r in docs.collect():
        words, stats = quality_fm.features(r.text or "")
        x = [(int(i), 1 / max(1, len(words)) ** 0.5) for i in words] + [(int(i), 0.5) for i in quality_fm.indices(model.edges, stats)]
        z = model.bias + sum(model.linear[i] * v for i, v in x)
        z += sum(float(model.factors[a] @ model.factors[b]) * v * w for k, (a, v) in enumerate(x[:400]) for b, w in x[:k]) if len(x) <= 400 else 0
        if len(x) > 400:  # the identity, for long texts
            f = sum(model.factors[i] * v for i, v in x)
            z += 0.5 * float(f @ f - sum((model.factors[i] * v) @ (model.factors[i] * v) for i, v in x))
        if 1 / (1 + 2.718281828459045 ** -max(-30.0, min(30.0, z))) >= 0.3:
            want.append(r)
    assert key(out.collect()) == key(want)


def test_line_dedup(outputs):
    docs, out = outputs["line_dedup"]
    kept = [(i, text) for i, _, gone, text in plain_drop([(r.doc_id, r.text) for r in docs.collect()])]
    got = out.collect()
    assert sorted((-(2**63) if r.doc_id is None else r.doc_id, r.text) for r in got) == sorted(kept)
    assert all(r.n_chars == len(r.text) for r in got)


def plain_shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def test_near_copies_have_similar_shingles(spark, tables, outputs):
    rng, rows = random.Random(12), []
    for k in range(12):
        base = words(rng, 150).split()
        for j in range(1 + k % 5):
            changed = base.copy()
            for at in rng.sample(range(150), j):
                changed[at] = f"new{k}{j}{at}"
            rows.append((len(rows), " ".join(changed)))
    chain = [f"c{k}" for k in range(140)]
    rows += [(1000 + k, " ".join(chain[5 * k : 5 * k + 80])) for k in range(12)]  # neighbours are similar, ends are not
    rows += [(None, rows[3][1] + " more"), (3, words(rng, 60)), (2000, "one two"), (2001, "One  TWO"), (2002, "one three"), (2003, None), (2004, " ")]
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    stage = [(r.doc_id, r.text) for r in outputs["near_dedup"][0].collect()]
    differ = 0
    for rows in (rows, real, stage):
        sets, u = [plain_shingles(t) for _, t in rows], Union()
        for i, a in enumerate(sets):
            u.find(i)
            for j in range(i):
                near = a == sets[j] or 10 * len(a & sets[j]) >= 8 * len(a | sets[j])
                differ += near and a != sets[j]
                if near or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                    u.join(i, j)
        least = {}
        for i, (doc_id, _) in enumerate(rows):
            if doc_id is not None:
                least[u.find(i)] = min(least.get(u.find(i), doc_id), doc_id)
        want = [(str(d), t or "") for i, (d, t) in enumerate(rows) if d is None or d == least[u.find(i)]]
        got = CP.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), tables)
        assert key(got.collect()) == sorted(want)
    assert differ > 20


def test_near_copies_meet_in_tiles(spark):
    """The SimHash step of the stage: its candidates join exactly what lies within two bits."""
    rng, texts = random.Random(31), []
    for k in range(40):
        base = words(rng, 900).split()
        texts += [" ".join(base[:cut_at] + base[cut_at + 1 :]) for cut_at in range(1 + k % 4)] + [" ".join(base)]
    fps = [simhash_tiles.fingerprint(t, 5) for t in texts]
    want, got = Union(), Union()
    for i, a in enumerate(fps):
        want.find(i), got.find(i)
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                want.join(i, j)
    rows = [(i, a - 2**64 if a >= 2**63 else a) for i, a in enumerate(fps)]
    pairs = shingle_jaccard.tiled(spark.createDataFrame(rows, "v long, fp long")).collect()
    for r in pairs:
        got.join(r.a, r.b)
    groups = lambda u: {frozenset(j for j in range(len(fps)) if u.find(j) == u.find(i)) for i in range(len(fps))}
    assert groups(got) == groups(want) and 1 < len(groups(want)) < len(fps)


def test_decontaminate(spark, tables, outputs):
    docs, out = outputs["decontaminate"]
    items = [WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect() if r.text]
    seeds = {tuple(w[k : k + 5]) for w in items for k in range(len(w) - 4)}
    want = []
    for r in docs.collect():
        w = WORD.findall((r.text or "").lower())
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} & seeds
        near = [i for i in items if any(tuple(i[k : k + 5]) in grams for k in range(len(i) - 4))] if grams else []
        if not any(plain_tiles(i, w[:3000], 5) >= 0.5 * len(i) for i in near):
            want.append(r)
    assert key(out.collect()) == key(want) and len(want) < docs.count()


def test_sentencepiece(outputs):
    docs, out = outputs["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(CP.TOKENIZER))
    want = sorted((str(r.doc_id), library.encode(r.text or "")) for r in docs.collect())
    assert sorted((str(r.doc_id), r.ids) for r in out.collect()) == want


def test_run_is_the_stages(spark, tables, outputs):
    got = CP.run(spark, tables)
    assert sorted(map(str, got.collect())) == sorted(map(str, outputs["sentencepiece"][1].collect()))


def test_empty_table(spark, tables, none):
    for name, stage in CP.STAGES:
        assert stage(spark, none, tables).count() == 0, name


def test_clashing_columns_do_not_break_stages(spark, tables):
    extra = ("score", "_score", "fp", "n_lines", "kept_text", "_n", "_keep", "_lines", "_hash", "_doc", "n", "doc", "hash", "keep", "gone", "_gone", "label", "words", "v", "h1", "band")
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({c: F.lit("x") for c in extra})
    for name, stage in CP.STAGES:
        out = stage(spark, docs, tables)
        assert out.count(), name
        if name != "sentencepiece":
            assert out.columns == docs.columns and out.where(" and ".join(f"`{c}` = 'x'" for c in extra)).count() == out.count(), name
