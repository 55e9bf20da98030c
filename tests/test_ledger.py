import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import replies
from tallyloom.operators import duplicates, ledger
from tallyloom.sources import documents

TX = "id string, txn_date date, ord long, currency string, amount_original double, merchant string, account string"


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def tx(spark, rows):
    return spark.createDataFrame([(i, day(d), k, c, a, m, "acc") for k, (i, d, c, a, m) in enumerate(rows)], TX)


def test_exact_duplicates(spark):
    own = tx(spark, [("tx-001", 1, "USD", -50.0, "S"), ("tx-002", 1, "USD", -50.0, "S"), ("tx-003", 2, "USD", -25.0, "C"), ("tx-004", 3, "USD", -100.0, "X")])
    found = duplicates.exact_tier(own)
    assert [tuple(r) for r in found.collect()] == [("tx-002", "tx-001")]
    assert duplicates.entries(own, found).count() == 2
    assert [r.id for r in duplicates.greedy(own).collect()] == ["tx-002"]


def test_no_duplicates(spark):
    own = tx(spark, [("a", 1, "USD", -10.0, "x"), ("b", 4, "USD", -99.0, "x"), ("c", 9, "USD", -5.0, "x")])
    assert duplicates.exact_tier(own).isEmpty() and duplicates.greedy(own).isEmpty()


def test_anchor_not_previous_row(spark):
    own = tx(spark, [(str(k), k, "USD", -7.0, "m") for k in range(8)])
    assert {(r.id, r.duplicate_of) for r in duplicates.exact_tier(own).collect()} == {("1", "0"), ("2", "0"), ("3", "0"), ("5", "4"), ("6", "4"), ("7", "4")}


@pytest.mark.parametrize("seed", range(3))
def test_islands_equal_one_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(str(k), rng.randint(0, 20), rng.choice(["USD", "UYU"]), rng.choice([0.0, -100.0, -98.0, -102.0, 100.0, -250.0, -255.0, round(rng.uniform(-300, 300), 2)]), rng.choice(["shop a", "shop b", "other"])) for k in range(150)]
    own = tx(spark, rows)
    got = {r.id: (r.duplicate_of, r.needs_review, r.review_reason) for r in duplicates.greedy(own).collect()}
    plain = sorted((r.asDict() for r in own.collect()), key=lambda r: (r["txn_date"], r["ord"]))
    assert got == duplicates.resolve(plain, duplicates.similar_merchants)


def test_judge_failure_asks_for_review(spark):
    def broken(a, b):
        raise RuntimeError

    rows = [r.asDict() for r in tx(spark, [("a", 1, "USD", -100.0, "x"), ("b", 1, "USD", -101.0, "x")]).collect()]
    assert duplicates.resolve(rows, broken) == {"b": (None, True, "Duplicate check failed")}


def test_categories_and_failed_batches(spark):
    own = tx(spark, [("tx-001", 1, "USD", -50.0, "S"), ("tx-002", 2, "USD", -25.0, "C")])
    got = ledger.assign_categories(own, spark.createDataFrame([("tx-001", "Groceries"), ("tx-002", None)], "id string, category string")).orderBy("id").collect()
    assert (got[0].category, got[0].needs_review) == ("Groceries", False)
    assert got[1].category is None and got[1].needs_review and "confidently" in got[1].review_reason
    failed = ledger.fail_batches(ledger.in_batches(own, ["ord"]), spark.createDataFrame([(0, False)], "batch long, ok boolean")).collect()
    assert {r.review_reason for r in failed} == {"Categorization batch failed"}


def test_replies(spark):
    df = spark.createDataFrame([('[{"id":"a","category":"X"}]',), ("not valid json",), (None,)], "r string").select(replies.parse(F.col("r"), replies.CATEGORIES).alias("p"))
    assert [None if r.p is None else len(r.p) for r in df.collect()] == [1, None, 0]
    last = ledger.last_of(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, n int, category string"), ["id"], "n").collect()
    assert [r.category for r in last] == ["y"]


def test_cache_and_conversion(spark):
    docs = ledger.with_hash(spark.createDataFrame([("a.xlsx", "xlsx", "t"), ("b.pdf", "pdf", "u")], "source_file string, file_type string, content string"))
    cache = docs.where("source_file = 'a.xlsx'").select("source_file", "content_hash")
    assert [r.source_file for r in ledger.cache_hits(docs, cache).collect()] == ["a.xlsx"]
    assert [r.source_file for r in ledger.cache_misses(docs, cache).collect()] == ["b.pdf"]
    own = spark.createDataFrame([("1", "d1", "USD", 2.675), ("2", "d1", "UYU", 100.0), ("3", "d2", "UYU", 1.0), ("4", "d3", "UYU", 1.0)], "id string, date string, currency string, amount_original double")
    fx = spark.createDataFrame([("d1", "UYU", "USD", 0.025), ("d2", "UYU", "USD", 0.0)], "date string, from_currency string, to_currency string, rate double")
    assert {r.id: r.amount_base for r in ledger.convert(own, fx, "USD").collect()} == {"1": 2.675, "2": 2.5, "3": None, "4": None}
    assert ledger.upsert(fx, fx.where("date = 'd2'").withColumn("rate", F.lit(1.0)), ["date", "from_currency", "to_currency"]).count() == 2


def workbook(rows):
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(r)) + "</row>" for n, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_to_transactions(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["Bank"], [], ["Fecha", "Descripción", "Importe (UYU)", "Moneda", "Cuenta"], ["2026-01-02", "Shop", "-1,420.50", "UYU", "C1"], ["", "TOTAL", "-1420.5", "", ""]]))
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    (tmp_path / "empty.xlsx").write_bytes(workbook([]))
    found = documents.load_workbooks(spark, str(tmp_path)).collect()
    assert {(r.filename, r.error is None) for r in found} == {("a.xlsx", True), ("bad.xlsx", False)}
    good = documents.load_workbooks(spark, str(tmp_path)).where("error is null").select("source_file", "content")
    got = documents.parse_statement(good).collect()
    assert [(r.date, r.amount_original, r.merchant, r.account) for r in got] == [("2026-01-02", -1420.5, "Shop", "C1")]
    with pytest.raises(FileNotFoundError):
        documents.load_workbooks(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        documents.require_documents(good.limit(0))


def test_repeated_answers_rates_and_decisions_keep_one_row(spark):
    tx = spark.createDataFrame([("a", "2026-01-01", "UYU", 10.125)], "id string, date string, currency string, amount_original double")
    rates = spark.createDataFrame([("2026-01-01", "UYU", "USD", 2.0)] * 2, "date string, from_currency string, to_currency string, rate double")
    assert [r.amount_base for r in ledger.convert(tx, rates, "USD").collect()] == [20.25]  # the product is rounded, not the amount
    answers = spark.createDataFrame([("a", "X", 1), ("a", "Y", 2)], "id string, category string, pos int")
    assert [r.category for r in ledger.assign_categories(tx, answers).collect()] == ["Y"]
    decisions = spark.createDataFrame([("a", True), ("a", True)], "id string, checked boolean")
    assert [r.review_status for r in ledger.apply_decisions(tx, decisions).collect()] == ["confirmed"]
    rule = tx.select(*(ledger.keyword_category(F.lit(m)).alias(m) for m in ("Coffee Store", "RENT", "Nothing")))
    assert [list(r) for r in rule.collect()] == [["Dining", "Rent", None]]


def loop(rows):
    """The rule, straight from its statement, over all rows."""
    taken, out = set(), {}
    for i, (a_id, a_day, _, a_cur, a) in enumerate(rows):
        if a_id in taken:
            continue
        for b_id, b_day, _, b_cur, b in rows[i + 1 :]:
            if b_id not in taken and a_cur == b_cur and (b_day - a_day).days <= 3 and a == b:
                taken.add(b_id)
                out[b_id] = a_id
    return out


def test_duplicates_of_null_currency_and_many_rows_a_day(spark):
    import datetime
    import random

    rng = random.Random(3)
    rows = [(f"t{k}", datetime.date(2026, 1, 1) + datetime.timedelta(days=rng.randrange(20)), k, rng.choice(["USD", None]), rng.choice([-5.0, 7.0, 0.0])) for k in range(400)]
    rows.sort(key=lambda r: (r[1], r[2]))
    tx = spark.createDataFrame(rows, "id string, txn_date date, ord long, currency string, amount_original double").withColumn("merchant", F.lit("m"))
    want = loop(rows)
    assert {r.id: r.duplicate_of for r in duplicates.exact_tier(tx).collect()} == want
    assert {r.id: r.duplicate_of for r in duplicates.greedy(tx).collect()} == want


def test_documents_of_a_folder(spark, tmp_path):
    import zlib

    body = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Fecha Importe) Tj 0 -14 Td [(2026-01-02 ) -5 (\\(x\\) -50.00)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj <</Length " + str(len(body)).encode() + b" /Filter /FlateDecode>>\nstream\n" + body + b"\nendstream\nendobj\n%%EOF"
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.pdf").write_bytes(pdf)
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.xls").write_bytes(b"no zip")
    got = {r.filename: r for r in documents.load_documents(spark, str(tmp_path)).collect()}
    assert got["a.pdf"].content == "Fecha Importe\n2026-01-02 (x) -50.00" and got["a.pdf"].file_type == "pdf"
    assert got["b.pdf"].error and got["c.xls"].error
    read = documents.load_documents(spark, str(tmp_path), readers={"xls": lambda data: [["Date", "Amount"], ["2026-01-02", data.decode()]]})
    assert [r.content for r in read.where("filename = 'c.xls'").collect()] == ["| Date | Amount |\n| --- | --- |\n| 2026-01-02 | no zip |"]


def test_cells_with_pipes_and_line_breaks(spark):
    text, columns, n = documents.markdown([["Date", "Description", "Amount"], ["2026-01-02", "A|B\\\nC", "-1,000.50"]])
    got = documents.parse_statement(spark.createDataFrame([("f", text), ("f", text)], "source_file string, content string")).collect()
    assert [(r.merchant, r.amount_original) for r in got] == [("A|B\\ C", -1000.5)] * 2 and n == 1


def test_store(spark, tmp_path):
    from tallyloom.sources import store

    path = str(tmp_path / "rates")
    assert store.open_table(spark, path, store.RATES).isEmpty()
    new = spark.createDataFrame([("2026-01-01", "UYU", "USD", 0.02)], store.RATES)
    store.replace(ledger.upsert(store.open_table(spark, path, store.RATES), new, ["date", "from_currency", "to_currency"]), path)
    store.replace(ledger.upsert(store.open_table(spark, path, store.RATES), new.withColumn("rate", F.lit(0.5)), ["date", "from_currency", "to_currency"]), path)
    store.prune(spark, path, 1)
    assert [r.rate for r in store.open_table(spark, path, store.RATES).collect()] == [0.5]
    store.snapshot(new, "r1", str(tmp_path))
    assert store.resume(spark, "r1", str(tmp_path)).collect() == new.collect()
    store.write_report(spark.createDataFrame([("a\nb",)], "report string"), str(tmp_path / "report"))
    assert "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "report")).collect()).strip() == "a\nb"
