"""Sources, sinks, duplicates, streaming and state changes on small tables."""

import datetime as dt
import re
from decimal import Decimal as D

from pyspark.sql import functions as F

from taxlake.functions import names
from taxlake.operators import currency, duplicates, exports, extraction, ledger, listing, quality, search_index
from taxlake.plans import books
from taxlake.sources import rate_files, tables
from taxlake.sources.store import DocumentStore
from taxlake.streaming import intake

SF = "/root/testdata/sf0.001"


def test_daily_rate_file(spark, tmp_path):
    path = tmp_path / "daily.csv"
    path.write_text(
        "KEY,FREQ,CURRENCY,TIME_PERIOD,OBS_VALUE\nX,D,USD,2026-01-05,1.25\nX,D,USD,2026-01-06,-1\nX,D,USD,bad,1.1\nX,D,USD,2026-01-07,abc\nX,D,GBP,2026-01-05,0.8\n"
    )
    rows = {(r.currency, str(r.rate_date)): r.rate_to_eur for r in rate_files.read_daily(spark, str(path)).collect()}
    assert rows == {("USD", "2026-01-05"): D("0.8000000000"), ("GBP", "2026-01-05"): D("1.2500000000")}
    path.write_text("A,B\n1,2\n")
    assert rate_files.read_daily(spark, str(path)).count() == 0


def test_monthly_rate_file(spark, tmp_path):
    months = ";".join(f"M{i}" for i in range(1, 13))
    body = (
        f"Umrechnungskurse;;;;;;;;;;;;;\nLand;Währung;{months}\n"
        + 'Indonesien;1 Euro;"17.049,43 IDR";' + ";" * 10 + "\n"
        + 'USA;1 Euro;"1,2500 USD";"1,6000 USD";' + ";" * 9 + "\n"
        + 'USA neu;1 Euro;"2,0000 USD";' + ";" * 10 + "\nFußnote;x;;;;;;;;;;;;\n"
    )
    path = tmp_path / "monthly.csv"
    path.write_bytes(body.encode("windows-1252"))
    rows = {(r.currency, str(r.rate_date)): (r.rate_to_eur, r.source) for r in rate_files.read_monthly(spark, str(path), 2026).collect()}
    assert rows["USD", "2026-01-01"] == (D("0.5000000000"), "BMF USt-Umrechnungskurs 2026-01")
    assert rows["USD", "2026-02-01"][0] == D("0.6250000000")
    assert len(rows) == 3 and ("IDR", "2026-01-01") in rows


def test_asof_rates_match_brute_force(spark):
    rates = spark.createDataFrame(
        [("usd", dt.date(2026, 1, d), D(d), "ECB") for d in (1, 2, 12)] + [("USD", dt.date(2026, 1, 20), D(99), "manual")],
        "currency string, rate_date date, rate_to_eur decimal(18,10), source string",
    )
    got = {r.day.day: int(r.rate_to_eur) for r in currency.daily_calendar(rates).collect()}
    expected = {}
    for day in range(1, 32):
        known = [d for d in (1, 2, 12) if d <= day <= d + 7]
        if known:
            expected[day] = max(known)
    assert got == expected


def test_near_duplicates_match_brute_force(spark):
    rows = []
    for i in range(60):
        rows.append((f"d{i:02d}", 0, "expense", dt.date(2026, 1, 1 + i % 2), D(1000 + i % 4) / 100, f"N{i % 3}" if i % 5 else None,
                     f"Firm {i % 2}" if i % 7 else None, "us", f"s{i % 17}", dt.datetime(2026, 2, 1, 0, i), None if i % 11 else dt.datetime(2026, 3, 1)))
    df = spark.createDataFrame(
        rows,
        "id string, tenant_id int, direction string, invoice_date date, gross_amount_original decimal(18,2), invoice_number string, "
        "issuer_name string, recipient_name string, sha256 string, created_at timestamp, deleted_at timestamp",
    )
    got = {r.id: r.possible_duplicate_id for r in duplicates.near_duplicates(df).collect()}
    for a in rows:
        hits = [b for b in rows if b[10] is None and b[3] == a[3] and abs(b[4] - a[4]) <= D("0.01") and b[8] != a[8] and b[9] < a[9]
                and ((a[5] and a[5] == b[5]) or (a[6] and b[6] and a[6].lower() == b[6].lower()))]
        assert got[a[0]] == (min(hits, key=lambda b: (b[9], b[0]))[0] if hits else None)


def test_triples_against_all_pairs(spark):
    import random

    rng = random.Random(6)
    few = [D(x) for x in ("100.00", "19.00", "119.00", "7.00", "107.00", "200.00", "14.00", "214.00", "38.10", "238.10", "0.01")]
    many = sorted({D(rng.randrange(1, 60_000)) / 100 for _ in range(400)} | set(few))
    df = spark.createDataFrame([("a", few), ("b", many), ("c", [])], "doc_id string, amounts array<decimal(18,2)>")
    got = {tuple(r) for r in df.select("doc_id", F.inline(extraction.triples_in_row(F.col("amounts")))).collect()}

    def rate(net, vat):
        return next((r for r in (19, 7, 5) if abs(vat * 100 - net * r) <= net * D("0.4")), None)

    expected = {
        (name, n, v, n + v, rate(n, v)) for name, amounts in (("a", few), ("b", many)) for n in amounts for v in amounts
        if v < n and rate(n, v) and n + v in set(amounts)
    }
    assert got == expected and len(expected) > 10


LETTER = "id string, direction string, text string, own_name string, own_vat_id string"


def _read(spark, text, direction="expense", own="Max Beispiel"):
    df = spark.createDataFrame([("a", direction, text, own, None)], LETTER).withColumn("doc_id", F.col("id"))
    return extraction.extract(df).first()


def test_parties_are_read_from_their_blocks(spark):
    receipt = (
        "Receipt\nInvoice number\nAB-9\nDate paid\nApril 30, 2026\nNimbus AI, LLC\n\n2261 Market Street\nSan Francisco, California 94114\n"
        "United States\nbilling@nimbus.example\nBill to\nMax Beispiel\nMusterstraße 1\n12345 Beispielstadt\nGermany\nmax@example.com\n"
        "Description\nQty\nAmount\nNimbus Plus Subscription (per seat)\nApr 30–May 30, 2026\n1\n$50.00\nSubtotal\n$50.00\nTotal\n$50.00\n"
    )
    r = _read(spark, receipt)
    assert (r.issuer_name, r.issuer_country_code, r.recipient_name, r.recipient_country_code) == ("Nimbus AI, LLC", "US", "Max Beispiel", "DE")
    assert r.issuer_address == "2261 Market Street, San Francisco, California 94114, United States"
    assert r.recipient_address == "Musterstraße 1, 12345 Beispielstadt, Germany"
    assert r.description == "Nimbus Plus Subscription (per seat)" and r.field_confidence["description"] == D("0.85")
    letter = (
        "Muster Handels GmbH • Am Markt 3 • 20095 Hamburg\n\nRechnung an:\nMax Beispiel\nDublin 2\nIreland\n\n24.01.2026\n\nRechnungsnummer: A-1\n"
        "Steuernummer 12/345/67890\nBeratung zur Raumakustik   480,00 €\nGesamtbetrag: 480,00 EUR\n"
    )
    r = _read(spark, letter)
    assert (r.issuer_name, r.issuer_country_code, r.recipient_country_code) == ("Muster Handels GmbH", "DE", "IE")
    assert r.issuer_tax_number == "12/345/67890" and r.description == "Beratung zur Raumakustik"
    assert r.field_confidence["description"] == D("0.55") and r.field_confidence["invoiceDate"] == D("0.85")
    # an income document: the block of the customer, its country and no country of the user's own address
    out = "Max Beispiel\nMusterstraße 1\n12345 Beispielstadt\nDeutschland\n\nBill to\nAcme Corp.\n1 Main Street\nDublin\nIreland\n\nInvoice number A-7\nTotal 10.00 EUR\n"
    r = _read(spark, out, "income")
    assert (r.issuer_name, r.recipient_name, r.recipient_country_code, r.recipient_is_business) == ("Max Beispiel", "Acme Corp.", "IE", True)
    assert r.description is None and "missing_description" in {i.code for i in r.issues}
    assert _read(spark, "").issuer_name is None


def test_exports_and_storage(spark, tmp_path):
    docs = books.documents(spark, SF).limit(50).withColumn("stored_relative_path", F.lit('a;"b"')).cache()
    exports.write_csv(docs, str(tmp_path / "csv"))
    lines = [l for l in spark.read.text(str(tmp_path / "csv")).toPandas()["value"]]
    assert any(l.startswith("id,direction,invoice_date") for l in lines)
    assert sum('"a;""b"""' in l for l in lines) == 50
    exports.write_json(docs, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 50
    exports.write_partitioned(docs, str(tmp_path / "docs"))
    back = tables.read_documents(spark, str(tmp_path / "docs"))
    assert back.count() == 50 and back.filter("tax_period_year = 2024").count() == docs.filter("tax_period_year = 2024").count()
    docs.unpersist()


def test_json_columns_fall_back(spark):
    rows = spark.createDataFrame(
        [('[{"code":"a","severity":"info"}]', '{"x":0.5}', '{"signals":{"paid":true}}'), ("oops", None, "oops")],
        "issues_json string, field_confidence_json string, extraction_raw_json string",
    )
    first, second = tables.decode_json(rows).select("issues", "field_confidence", F.to_json("extraction_raw").alias("raw")).collect()
    assert first.issues[0].code == "a" and first.field_confidence == {"x": 0.5} and "paid" in first.raw
    assert second.issues == [] and second.field_confidence == {} and second.raw is None


def test_json_classification_moves_in_and_out(spark):
    rows = spark.createDataFrame(
        [('{"a":1,"vatClassification":{"code":"old"}}', '{"code":"new"}'), ("[1]", '{"code":"new"}'), ('{"a":1}', None), ('"text"', "null"), ("{", "{"), (None, None)],
        "extraction_raw_json string, vat_classification_json string",
    )
    read = tables.decode_json(rows)
    texts = [r.raw for r in read.select(F.to_json("extraction_raw").alias("raw")).collect()]
    assert texts[:3] == ['{"a":1,"vatClassification":{"code":"new"}}', '{"vatClassification":{"code":"new"}}', '{"a":1}'] and texts[4:] == [None, None]
    back = tables.encode_json(read).select("extraction_raw_json", "vat_classification_json").collect()
    assert [r[0] for r in back][:3] == ['{"a":1}', "{}", '{"a":1}'] and [r[1] for r in back][:3] == ['{"code":"new"}'] * 2 + [None]


def test_search_index(spark, tmp_path):
    names = ["Müller & Söhne", "MÜLLER AG", "50%_Buffet", "50x Buffet", "ab", None, "Groß", "aaa aaab"]
    rows = [(f"d{i}", n, None, n and n[::-1], None, "") for i, n in enumerate(names)] * 1
    docs = spark.createDataFrame(rows, "id string, issuer_name string, recipient_name string, description string, invoice_number string, original_filename string")
    path = str(tmp_path / "grams")
    search_index.write_index(docs, path)
    for term in ("müller", "50%_b", "50", "ab", "", "aaa", "aab", "GROß", "nothing", "söhne", "rellüm"):
        got = sorted(r.id for r in search_index.search_indexed(docs, path, term).collect())
        assert got == sorted(r.id for r in docs.where(listing.search(term)).collect())
    assert search_index.candidates(spark, path, "50%_b").count() == 1 and search_index.candidates(spark, path, "50") is None


def test_seek_pages_with_ties(spark):
    day = lambda i: None if i % 7 == 0 else dt.date(2024, 1, 1 + i % 3)
    rows = [(f"d{i:03}", day(i), dt.datetime(2024, 5, 1, i % 2)) for i in range(95)]
    docs = spark.createDataFrame(rows, "id string, invoice_date date, created_at timestamp").repartition(5)
    for sort in ("newest", "oldest", "recent"):
        whole = [r.id for r in docs.orderBy(*listing.order_by(sort)).collect()]
        starts = {r.page: r.start for r in listing.page_starts(docs, sort, 10).collect()}
        assert sorted(starts) == list(range(10))
        for page in (0, 4, 9):
            assert [r.id for r in listing.seek(docs, starts[page], sort, 10).collect()] == whole[page * 10 : page * 10 + 10]
    assert listing.page_starts(docs.where("false")).count() == 0


def test_quarantine(spark):
    rows = spark.createDataFrame([("2026-01-01", "a"), ("2026-13-01", "b"), (None, "zz")], "d string, n string")
    good, bad = quality.quarantine(rows, quality.RowContract(dates=["d"], lengths={"n": 1}))
    assert good.count() == 1 and {tuple(r.violations) for r in bad.collect()} == {("d",), ("n",)}


def _text_rows(spark):
    body = "ACME GmbH\nDE123456789\nRechnung\nRechnungsnummer: A-{0}\nRechnungsdatum: 24.01.2026\nHosting\nNettobetrag 100,00 EUR\nUmsatzsteuer 19 %: 19,00 EUR\nGesamtbetrag: 119,00 EUR\n"
    rows = [(f"t{i}", 0, "imp", "expense", body.format(i % 3), "Me", None, dt.datetime(2026, 2, 1, 0, i), None) for i in range(5)]
    return spark.createDataFrame(
        rows, "id string, tenant_id int, import_id string, direction string, text string, own_name string, own_vat_id string, created_at timestamp, duplicate_action string"
    )


def _dimensions():
    settings = lambda s: s.createDataFrame([(i, "ist") for i in range(8)], "tenant_id int, vat_method string")
    rates = lambda s: s.createDataFrame([], "currency string, rate_date date, rate_to_eur decimal(18,10), source string")
    return settings, rates


def test_intake_stream(spark, tmp_path):
    source, path, check = (str(tmp_path / n) for n in ("in", "store", "ck"))
    texts = _text_rows(spark)
    texts.coalesce(1).write.parquet(source)
    writer = intake.intake_writer(path, *_dimensions(), "2026-03-01")
    stream = lambda: spark.readStream.schema(texts.schema).parquet(source)
    intake.start_intake(stream(), writer, check).awaitTermination()
    docs = DocumentStore(spark, path).current()
    assert docs.count() == 3 and {r.vat_treatment_code for r in docs.collect()} == {"DE_EXPENSE_INPUT_VAT"}
    status = {r.status: r["count"] for r in spark.read.parquet(f"{path}/jobs").groupBy("status").count().collect()}
    assert status["duplicate"] == 2
    # the same texts again: everything meets the stored gate
    texts.withColumn("id", F.concat(F.lit("again"), "id")).coalesce(1).write.mode("append").parquet(source)
    intake.start_intake(stream(), writer, check).awaitTermination()
    assert DocumentStore(spark, path).current().count() == 3
    assert spark.read.parquet(f"{path}/audit").filter("event_type = 'import'").count() == 3


def _buckets_read(df):
    """How many buckets the scan of ``df`` is pruned to, by the partition filters of its plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if "LocalRelation" in plan and "Relation [" not in plan:
        return 0
    listed = re.search(r"bucket#\d+ IN \(([^)]*)\)", plan)
    if listed:
        return listed[1].count(",") + 1
    return 1 if re.search(r"bucket#\d+ = \d+", plan) else 64


def test_intake_batches_read_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    invoice = "Studio Muster GmbH\nRechnungsnummer: RE-{0}\nRechnungsdatum: 02.03.2026\nNettobetrag 100,00 EUR\nUmsatzsteuer 19 %: 19,00 EUR\nGesamtbetrag: {1} EUR\n{2}"
    at = lambda n: dt.datetime(2026, 3, 2, 10, n)
    schema = "id string, tenant_id int, import_id string, direction string, text string, own_name string, own_vat_id string, created_at timestamp, duplicate_action string"

    def batch(*rows):
        return spark.createDataFrame([(i, 1, "imp", "expense", t, None, None, at(n), action) for n, (i, t, action) in enumerate(rows)], schema)

    batches = [
        batch(("a", invoice.format(1, "119,00", ""), None), ("b", invoice.format(2, "119,00", ""), None), ("a2", invoice.format(1, "119,00", ""), None)),
        batch(("c", invoice.format(1, "119,00", ""), None), ("d", invoice.format(1, "119,01", "scan"), None), ("e", None, None), ("f", " ", None)),
        batch(("g", invoice.format(2, "119,00", ""), "import_anyway"), ("h", invoice.format(1, "119,03", "scan 2"), None)),
    ]
    write = intake.intake_writer(path, *_dimensions(), "2026-03-01")
    for number, rows in enumerate(batches):
        write(rows, number)
    jobs = {r.file_id: (r.status, r.existing_id, r.possible_duplicate_id, r.error_key) for r in spark.read.parquet(f"{path}/jobs").collect()}
    assert jobs["a2"][:2] == jobs["c"][:2] == ("duplicate", "a")
    assert jobs["b"][2] == "a"  # the same counterparty, day and amount
    assert jobs["d"][2] == "a" and jobs["g"][1] is None and jobs["h"][2] is None
    assert jobs["e"][0::3] == ("failed", "corrupt_pdf") and jobs["f"][0::3] == ("failed", "empty_pdf")
    store = DocumentStore(spark, path)
    docs = {r.id: r for r in store.current().collect()}
    assert set(docs) == {"a", "b", "d", "g", "h"}
    issue = [i for i in docs["d"].issues if i.code == "possible_duplicate"]
    assert issue[0].severity == "critical" and issue[0].params == {"id": "a", "filename": docs["a"].stored_filename}
    assert docs["d"].stored_filename == docs["a"].stored_filename.replace(".pdf", "-2.pdf")
    assert docs["h"].stored_filename == docs["a"].stored_filename.replace(".pdf", "-3.pdf")
    assert spark.read.parquet(f"{path}/audit").where("event_type = 'possible_duplicate_detected'").count() == 3
    # a batch reads the buckets of its own keys only, and a batch that runs again changes nothing
    wanted = store.keys(spark.createDataFrame([("content", "1|x")], "kind string, key string"))
    assert _buckets_read(wanted) == 1
    before = sorted(map(str, store.versions().collect()))
    write(batches[2], 2)
    assert sorted(map(str, store.versions().collect())) == before and [r.commit for r in store.log()] == [0, 1, 2]


def test_outcome_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    texts = _text_rows(spark)
    texts.coalesce(1).write.parquet(source)
    jobs = spark.readStream.schema(texts.schema).parquet(source).select("import_id", F.lit("completed").alias("status"))
    counts = intake.outcome_stream(jobs).writeStream.format("memory").queryName("totals").outputMode("update").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("totals").collect()[0].ok == 5


CHANGES = "id string, change_id long, at timestamp, kind string, field string, value string, read_at timestamp"


def test_intake_changes_purge_and_compaction_on_one_store(spark, tmp_path):
    path = str(tmp_path / "store")
    settings, rates = _dimensions()
    take, change = intake.intake_writer(path, settings, rates, "2026-03-01"), intake.change_writer(path, settings)
    texts = _text_rows(spark)
    take(texts, 0)
    store = DocumentStore(spark, path)
    now = lambda: {r.id: r for r in store.current().collect()}
    first = now()
    one, two, three = sorted(first)
    at = dt.datetime(2030, 1, 1)
    rows = [
        (one, 1, at, "payment", None, "not_paid", None), (two, 2, at, "delete", None, None, None),
        (three, 3, at, "patch", "description", "new text", first[three].updated_at), (three, 4, at, "patch", "description", "too late", at),
        (one, 5, at, "patch", "grossAmountOriginal", "a lot", None), ("nobody", 6, at, "delete", None, None, None),
    ]
    batch = spark.createDataFrame(rows, CHANGES)
    change(batch, 0)
    change(batch, 0)  # run again: replaces its own output
    assert [(r.writer, r.batch_id, r.commit) for r in store.log()] == [("intake", 0, 0), ("changes", 0, 1)]
    rows = now()
    assert rows[one].payment_status == "unpaid" and rows[two].deleted_at == at
    assert rows[three].description == "new text" and rows[three].review_status == "needs_review"
    reasons = {r.change_id: r.reason for r in spark.read.parquet(f"{path}/rejects").collect()}
    assert reasons == {4: "stale", 5: "invalid", 6: "unknown_document"}
    assert {r.event_type for r in spark.read.parquet(f"{path}/audit_changes").collect()} == {"payment_date_change", "delete", "manual_correction"}
    # what is in the trash can be taken in again, what was only edited cannot
    again = texts.where(F.col("id").isin(two, three)).withColumn("id", F.concat(F.lit("again"), "id"))
    take(again, 1)
    jobs = {r.file_id: r.status for r in spark.read.parquet(f"{path}/jobs").where("commit = 2").collect()}
    assert jobs["again" + three] == "duplicate" and jobs["again" + two] != "duplicate"
    # an edit that comes late, a purge, and a purge of a document that isn't in the trash
    late = dt.datetime(2001, 1, 1)
    more = [(three, 7, late, "patch", "description", "late text", None), (two, 8, at, "purge", None, None, None), (one, 9, at, "purge", None, None, None)]
    change(spark.createDataFrame(more, CHANGES), 1)
    rows = now()
    assert set(rows) == {one, three, "again" + two} and rows[three].description == "late text" and rows[three].updated_at > at
    change(spark.createDataFrame([(two, 10, at, "restore", None, None, None)], CHANGES), 2)
    assert set(now()) == set(rows)
    # compaction: the same documents in one commit, nothing of the purged one in any file
    before = sorted(map(str, store.current().select(sorted(store.current().columns)).collect()))
    assert store.compact() == 5 and store.vacuum() == [0, 1, 2, 3, 4] and store.compact() is None
    after = store.current()
    assert sorted(map(str, after.select(sorted(after.columns)).collect())) == before
    for table in ("versions", "keys"):
        files = spark.read.parquet(f"{path}/{table}")
        assert {r.commit for r in files.select("commit").distinct().collect()} == {5} and files.where(F.col("id") == two).count() == 0
    # the cube was kept up to date by differences all along
    cube = lambda rows: sorted(map(str, rows.select(sorted(rows.columns)).collect()))
    assert cube(store.cube()) == cube(ledger.merged_cube(ledger.ledger_cube(store.current()))) and store.cube().count() > 0
    # streams go on behind a compaction, and a batch from before it that runs again stays without effect
    change(batch, 0)
    change(spark.createDataFrame([(one, 11, at, "payment", None, "unknown", None)], CHANGES), 3)
    rows = now()
    assert rows[one].payment_status == "unknown" and rows[three].description == "late text" and store.log()[-1].commit == 6
    assert cube(store.cube()) == cube(ledger.merged_cube(ledger.ledger_cube(store.current())))
    named = store.versions(spark.createDataFrame([(one,)], "id string"))
    assert _buckets_read(named) == 1 and named.count() == 2


def test_unique_names_of_a_hot_name(spark):
    rows = spark.range(3_000).select(
        F.concat(F.lit("d"), F.lpad("id", 5, "0")).alias("id"), F.lit(1).alias("tenant_id"), F.lit("f").alias("folder"),
        F.when(F.col("id") % 2 == 0, "hot.pdf").otherwise(F.concat(F.lit("n"), F.col("id") % 500, F.lit(".pdf"))).alias("name"),
        F.lit(dt.datetime(2026, 1, 1)).alias("created_at"),
    ).repartition(7)
    got = {r.id: (r.stored_filename, r.attempt) for r in names.with_unique_names(rows, "folder", "name", F.lit(10)).collect()}
    seen, expected = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        seen[r.name] = seen.get(r.name, 10) + 1
        expected[r.id] = (r.name.replace(".pdf", f"-{seen[r.name]}.pdf"), seen[r.name])
    assert got == expected


def test_unique_names_across_parts(spark):
    """Names that end in one part and go on in several later ones; the documents are joined with nothing but a row a part."""
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("id"), F.lit(1).alias("tenant_id"), F.lit("f").alias("folder"),
        F.concat(F.lit("n"), (F.col("id") % 3), F.lit(".pdf")).alias("name"),
        (F.lit(dt.datetime(2026, 1, 1)) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("created_at"), F.lit("wide").alias("other"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        numbered = names.with_unique_names(rows, "folder", "name")
        got = {int(r.id): r.attempt for r in numbered.collect()}
        plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: i // 3 + 1 for i in range(400)}
    assert plan.count("strategy=broadcast") == plan.count("Join ")


def test_plain_names_are_cleaned_as_others(spark):
    texts = ["Customer#1 GmbH", "a  b", "RE-12", "e.K.", "x -y", "a_b.c-d", "Müller & Co", "5$ off", "ab\n", "a,b", "-a", "", " a", "a.b c", None, "a/b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = {r.i: r.t for r in names.with_sanitized(rows, {"t": (F.col("t"), 60)}).collect()}
    expected = ["Customer#1-GmbH", "a-b", "RE-12", "e.K", "x-y", "a_b.c-d", "Mueller-&-Co", "5USD-off", "ab", "a,b", "a", "", "a", "a.b-c", None, "a-b"]
    assert plain == dict(enumerate(expected))


def test_unnamed_documents_are_not_shuffled(spark):
    from taxlake.session import possibly_named

    rows = spark.range(1_000).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("id"), F.lit("wide").alias("other"))
    named = spark.createDataFrame([("5",), ("5",), ("700",), ("2000",), (None,)], "id string")
    kept = possibly_named(rows.unionByName(rows), named)
    found = [r.id for r in kept.collect()]
    assert kept.columns == rows.columns and found.count("5") == found.count("700") == 2 and len(found) < 20
    assert possibly_named(rows, spark.range(3)).count() == 1_000  # other types: left to the join


def test_settings_are_broadcast_to_documents(spark):
    """Also where the orders are far beyond the size that Spark broadcasts."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")
    try:
        rows = ledger.with_settings(books.documents(spark, SF).where("direction = 'income'"), books.stored_settings(spark, SF).select("tenant_id", "vat_method"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin [tenant_id" in plan


def test_changes_in_order(spark):
    from taxlake.operators import changes as state_changes

    docs = books.documents(spark, SF).filter("id in ('O1', 'O2')").withColumn("vat_method", F.lit("ist")).coalesce(1)
    day = lambda d: dt.datetime(2030, 1, d)
    batch = spark.createDataFrame(
        [
            ("O1", 1, day(1), "delete", None, None),
            ("O1", 2, day(2), "patch", "description", "in the trash"),
            ("O1", 3, day(3), "restore", None, None),
            ("O1", 4, day(4), "patch", "description", "first"),
            ("O1", 5, day(5), "patch", "description", "second"),
            ("O1", 6, day(5), "patch", "description", "second"),
            ("O1", 7, day(6), "patch", "grossAmountOriginal", "a lot"),
            ("O1", 8, day(7), "patch", "noSuchField", "x"),
            ("O1", 9, day(8), "delete", None, None),
            ("O2", 10, day(1), "purge", None, None),
            ("O2", 11, day(2), "delete", None, None),
            ("O2", 12, day(3), "purge", None, None),
            ("O2", 13, day(4), "restore", None, None),
            ("X", 14, day(1), "delete", None, None),
            ("O2", 15, None, None, None, None),
            (None, 16, day(1), "delete", None, None),
        ],
        "id string, change_id long, at timestamp, kind string, field string, value string",
    )
    resolved = state_changes.resolve(docs, batch).cache()
    fates = {r.change_id: r.fate for r in resolved.collect()}
    assert [fates[i] for i in range(1, 17)] == [
        "live", "in_trash", "live", "live", "live", "same", "invalid", "invalid", "live",
        "not_in_trash", "live", "live", "purged", "unknown_document", "invalid", "unknown_document",
    ]
    changed = state_changes.apply_changes(docs, resolved).cache()
    rows = {r.id: r for r in changed.collect()}
    assert (rows["O1"].outcome, rows["O1"].description, rows["O1"].deleted_at) == ("deleted", "second", day(8))
    assert rows["O2"].outcome == "purged"
    audit = state_changes.audit_rows(resolved, changed).filter("document_id = 'O1'").orderBy("change_id").collect()
    assert [r.change_id for r in audit] == [1, 3, 4, 5, 9]
    assert audit[3].previous_value == '{"field":"description","value":"first"}'
    assert state_changes.rejected_changes(resolved).count() == 9
    assert state_changes.resolve(docs, batch.limit(0)).count() == 0


def test_tariff_overrides_are_split(spark):
    rows = spark.createDataFrame([(2025, "own-1"), (1999, "own"), (2025, "no label!"), (None, "x")], "year int, label string")
    valid, rejected = quality.split_overrides(rows, F.array().cast("array<string>"))
    assert [tuple(r) for r in valid.collect()] == [(2025, "own-1")]
    assert {r.label: r.errors for r in rejected.collect()} == {"own": ["invalid_year"], "no label!": ["invalid_source_label"], "x": ["invalid_year"]}
