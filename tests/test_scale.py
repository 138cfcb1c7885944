"""What must hold at any size: long documents and lines, folder tables, many batches, no texts on the wire."""

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import forms
from ledgerlens.operators import numbering as N
from ledgerlens.operators import patch as PT
from ledgerlens.operators.extraction import amounts as AM
from ledgerlens.operators.extraction import assemble as X
from ledgerlens.operators.extraction import items as IT
from ledgerlens.operators.extraction.lines import scan_lines
from ledgerlens.plans import registry
from ledgerlens.sources.domain import Domain
from ledgerlens.sources.render import invoice_text
from ledgerlens.streaming.core import table_stream


def seconds(df):
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def prose(n):
    return "\n".join(f"Linea de texto bastante larga {k}" + ("" if k % 7 else f" {k},50") + ("\nTotal factura 1,00" if k % 50 == 49 else "") for k in range(n))


def test_items_are_linear_in_lines(spark):
    docs = {n: spark.createDataFrame([(1, prose(n))], "doc_id long, text string") for n in (50, 500, 5000)}
    found = lambda n: IT.with_items(scan_lines(docs[n])).select("doc_id", "lineas")
    seconds(found(50))
    short, long = seconds(found(500)), seconds(found(5000))
    assert long < 10 * short + 10


def test_labels_are_linear_in_numbers(spark):
    line = " ".join(f"n{k} {k},10" for k in range(10000))
    rows = lambda text: AM.amount_rows(AM.with_amounts(scan_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))))
    assert seconds(rows(line)) < 30
    got = [r.label for r in rows("Base imponible: " + "1,10 " * 40 + "de cosas muy largas de nombre y apellido 7,20 x%").orderBy("match_index").collect()]
    assert got[0] == "Base imponible" and len(got) == 41 and got[-1].endswith("de nombre y apellido")


def test_one_document_per_invoice(spark):
    invoices = spark.createDataFrame([(1, 2, "SUBIDA", None, "F1", "2024-01-01", "P", 1.0), (2, 2, "SUBIDA", None, "F2", None, None, 2.0)],
                                     "id long, cliente_id long, estado string, created_at timestamp, numero_factura string, fecha string, proveedor_nombre string, total double")
    lines = spark.range(5000).select(F.lit(1).cast("long").alias("factura_id"), (F.col("id") + 1).alias("orden"), F.col("id").alias("producto_id"),
                                     F.lit(1.0).alias("cantidad"), F.lit(2.0).alias("precio_unitario"), F.lit(2.0).alias("importe"))
    docs = PT.to_documents(invoices, lines)
    assert sorted(r.id for r in docs.collect()) == [1, 2]
    assert PT.from_documents(docs).count() == 5000


def test_backfill_keeps_and_places_every_row(spark):
    rows = [(1, 10, "2024-01-02", 5), (2, 10, "2024-01-02", None), (3, 10, None, None), (4, None, "2024-01-01", None), (5, 10, "2024-01-01", None), (6, None, None, 9)]
    df = spark.createDataFrame(rows, "id long, cliente_id long, day string, numero_correlativo long").withColumn("created_at", F.to_timestamp("day"))
    out = N.backfill_correlative(df)
    assert out.columns.count("numero_correlativo") == 1
    assert {r.id: r.numero_correlativo for r in out.collect()} == {1: 5, 5: 1, 2: 2, 3: 3, 4: None, 6: 9}
    numbered, counters = N.assign_correlative(df.drop("numero_correlativo"), spark.createDataFrame([(10, 7)], "cliente_id long, ultimo_correlativo long"))
    assert {r.id: r.numero_correlativo for r in numbered.collect()} == {5: 8, 1: 9, 2: 10, 3: 11, 4: None, 6: None}
    assert [tuple(r) for r in counters.collect()] == [(10, 11)]


TEXTS = ["Retención artículo Nº", "ﬁn…²", "Ｆｕｌｌ　ｗｉｄｔｈ", "Ελλάδα ΐ", "Йод ёлка", "Việt Nam ế ộ", "がぎ", "plain", "́x", "x\ń", "", "각 한글", "ǭ̣q̣̇", "\U00100005é\U00100004", "ﷺ ㎏ ½"]
#: Latin, marks, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Tamil, Thai, Korean letters and syllables, Japanese, presentation forms, music, Kaithi.
SCRIPTS = [(0x41, 0x24F), (0x300, 0x36F), (0x370, 0x3FF), (0x400, 0x4FF), (0x590, 0x5FF), (0x600, 0x6FF), (0x900, 0x97F), (0xB80, 0xBFF), (0xE00, 0xE7F), (0x1100, 0x11FF),
           (0xAC00, 0xAD00), (0x3040, 0x30FF), (0x1E00, 0x1FFF), (0x2100, 0x2180), (0xFB00, 0xFDFF), (0xFF00, 0xFFEF), (0x1D100, 0x1D1FF), (0x11080, 0x110FF), (0xF900, 0xFA2F)]


@pytest.fixture(scope="module")
def scripts():
    rng = random.Random(1)
    texts = TEXTS + ["".join(chr(rng.randint(*rng.choice([*rng.sample(SCRIPTS, 2), (0x300, 0x345)]))) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    texts += ["".join(chr(c) for c in range(k, k + 100) if not 0xD800 <= c < 0xE000) for k in range(0, 0x11100, 100)]
    return [unicodedata.normalize(form, t) for t in texts for form in ("NFC", "NFD")] + texts


@pytest.mark.parametrize("form", ["NFKC", "NFC", "NFD"])
def test_normal_forms_of_many_scripts(spark, scripts, form):
    change = {"NFKC": forms.nfkc, "NFC": forms.nfc, "NFD": forms.nfd}[form]
    df = spark.createDataFrame(list(enumerate(scripts)) + [(-1, None)], "i int, t string").repartition(8)
    got = {r.i: r.o for r in df.select("i", change(F.col("t")).alias("o")).collect()}
    assert got.pop(-1) is None
    assert got == {i: unicodedata.normalize(form, t) for i, t in enumerate(scripts)}


def test_forms_are_computed_once_per_kind_of_piece(spark):
    """A text's accents are many but of few kinds; texts of more kinds than are looked up at once, and of codes, come out right too."""
    marks = [chr(c) for c in (0x300, 0x301, 0x308, 0x323)]
    many = "".join(f"{chr(b)}{a}{c} " for b in range(0x61, 0x7B) for a in marks for c in ["", *marks]) * 2
    beside = "e\u0301e\u0323\u0301e\u0301\u0323ee\u0301" + "q\u0301\u0323q\u0323\u0301q\u0301" + "\u0301"
    texts = [many, beside, beside[::-1], many + beside, "\U00100FFEe\u0301\U00100FFF\U00100FFFe\u0301", "".join(chr(c) for c in range(0xC0, 0x1EFF)), "\n\u0301\re\u0301$1\\e\u0301"]
    texts += [unicodedata.normalize(form, t) for t in texts for form in ("NFC", "NFD")]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", forms.nfc(F.col("t")).alias("NFC"), forms.nfd(F.col("t")).alias("NFD"), forms.nfkc(F.col("t")).alias("NFKC")).collect()
    for r in got:
        for form in ("NFC", "NFD", "NFKC"):
            assert r[form] == unicodedata.normalize(form, texts[r.i]), (form, r.i)
    # one by one, each piece went through all steps, which Spark interprets
    for form in (forms.nfc, forms.nfd):
        assert "array_distinct(regexp_extract_all" in df.select(form(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_decomposed_invoice_is_read_alike(spark):
    text = "Suministros Íñigo S.L.\nCIF: A00000026\nFactura Nº: FI20260001\nFecha: 01/02/2024\nDescripción\nCantidad\nPrecio\nImporte\nCañón\n2\n10,00\n20,00\nBase imponible 20,00\nIVA 21% 4,20\nTotal factura 24,20"
    rows = [(k, unicodedata.normalize(f, text)) for k, f in enumerate(("NFC", "NFD"))]
    one, two = X.extract_invoices(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").drop("doc_id").collect()
    assert one == two and len(one.lineas) == 1


def test_texts_are_not_shuffled(spark, sf_dir):
    for table, sql in (("documents", ("doc_id", "text")), ("pages", ("page_id as doc_id", "html as text"))):
        x = X.extract_invoices(spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*sql))
        assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()


STREAMS = ["throughput_per_minute", "upload_rate_limit", "dedup_stream", "live_counts_stream", "activity_feed_stream", "jobs_stateful_stream", "late_rows_stream"]


@pytest.fixture(scope="module")
def folders(spark, sf_dir, tmp_path_factory):
    """The tables once more, events and documents as folders of many files in the order of time."""
    base = tmp_path_factory.mktemp("tables")
    for t in ("documents", "orders", "events"):
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        key = {"documents": "doc_id", "orders": "o_orderkey", "events": "ts"}[t]
        parts = 5 if t != "orders" else 1
        # files written one after the other, so that their times tell their order
        rows = df.orderBy(key).toPandas()
        step = -(-len(rows) // parts)
        for k in range(parts):
            (base / f"{t}.parquet").mkdir(exist_ok=True)
            spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(f"{base}/{t}.parquet")
            time.sleep(0.02)
    return str(base)


def test_folders_stream_whole(spark, folders):
    q = table_stream(spark, folders, "events", 2).writeStream.format("memory").queryName("folder_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("folder_rows").count() == spark.read.parquet(f"{folders}/events.parquet").count()


@pytest.mark.parametrize("name", STREAMS)
def test_streams_alike_in_any_layout_and_batches(spark, sf_dir, folders, name):
    registry.plans()
    plan = registry._PLANS[name]
    rows = []
    for base, files in ((sf_dir, None), (folders, None), (folders, 1)):
        d = Domain(spark, base)
        d.files_per_trigger = files
        rows.append(sorted(map(str, plan(d).collect())))
    assert rows[0] and rows[0] == rows[1] == rows[2]


@pytest.fixture(scope="module")
def shuffled(spark, sf_dir, tmp_path_factory):
    """Events in files that each span the whole time; documents with ids far apart, copies first and last."""
    base = tmp_path_factory.mktemp("shuffled")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(5, "event_id").write.parquet(f"{base}/events.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    for k in (2, 0, 1):
        docs.withColumn("doc_id", F.col("doc_id") + k * 9_000_000).coalesce(1).write.mode("append").parquet(f"{base}/documents.parquet")
        time.sleep(0.02)
    return str(base)


@pytest.mark.parametrize("name", ["throughput_per_minute", "upload_rate_limit", "jobs_stateful_stream", "throughput_over_50", "uploads_per_hour", "logins_per_15_min", "dedup_stream"])
def test_no_row_is_late_in_shuffled_files(spark, shuffled, name):
    import duckdb

    registry.plans()
    d = Domain(spark, shuffled)
    d.files_per_trigger = 1
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.execute(f"create view {t} as select * from '{shuffled}/{t}.parquet/*.parquet'")
    want = con.execute(registry.oracles()[name]).fetchall()
    assert sorted(map(str, (tuple(r) for r in registry._PLANS[name](d).collect()))) == sorted(map(str, want))


def test_texts_are_rendered_and_scanned_without_lambdas(spark, sf_dir):
    """Lambdas are interpreted element by element; rendering has none, and the lines of an invoice move once, without windows."""
    plan = invoice_text(Domain(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Window" not in plan and plan.count("RepartitionByExpression") == 2


def test_lines_of_ragged_texts(spark):
    """Stripping in one pass over the text gives the lines that stripping one by one gives, long runs of blanks included."""
    blanks = " \t\r\f\x0b\x85  "
    texts = ["", " ", "\n\n", "a", " a \n\t\n b  c \r\n", "x" + " " * 200_000 + "y\n" + " \n" * 1000 + "z", f"a{blanks}\n{blanks}\nb{blanks}c\n{blanks}", "Nº 1\xa0\n 2ª² ﬁn"]
    folded = [unicodedata.normalize("NFKC", t) for t in texts]
    want = [[x.strip(blanks) for x in t.split("\n") if x.strip(blanks)] for t in folded]
    rows = scan_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.raw_lines for r in rows] == want
    assert all(r.text == "\n".join(r.lines) for r in rows)


def test_short_texts_are_dealt_over_tasks(spark, sf_dir):
    """Matching patterns takes long beside reading keys, so the tasks do not hang on how the file of orders is cut."""
    plan = registry.plans()["rectified_numbers"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
