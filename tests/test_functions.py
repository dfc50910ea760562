"""Golden values of the column functions."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from taxlake.functions import lines, names, patterns as P, text as X, verdicts
from taxlake.functions.money import convert, round_money, truncate_money
from taxlake.functions.periods import filing_period, recognition, valid_iso_date, vat_assignment
from taxlake.functions.rates import is_iso_currency, printed_rate
from taxlake.operators import extraction
from taxlake.operators.income_tax import resolve_tariffs, tariff_table, taxpayer_tax


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0])


def test_money_rounds_half_away_from_zero(spark):
    amount = lambda x: F.lit(D(x))
    assert values(
        spark, round_money(amount("1.005")), round_money(amount("-1.005")),
        convert(amount("1.10"), amount("0.95")), truncate_money(amount("2.999")), truncate_money(amount("-1")),
    ) == [D("1.01"), D("-1.01"), D("1.05"), D("2.99"), D("0.00")]


@pytest.mark.parametrize(
    "year, income, assessment, expected",
    [
        (2025, "30000", "single", 4303), (2025, "50000", "single", 10691), (2025, "68481", "single", 17850),
        (2025, "100000", "single", 31088), (2025, "300000", "single", 115753), (2025, "100000", "joint", 21382),
        (2026, "20000", "single", 1570), (2026, "30000", "single", 4217), (2026, "-5", "single", 0),
    ],
)
def test_income_tax(spark, year, income, assessment, expected):
    payers = spark.createDataFrame(
        [(year, D(income), assessment, "none", False)],
        "year int, taxable_income decimal(18,2), assessment_type string, church_tax string, include_solidarity_surcharge boolean",
    )
    row = taxpayer_tax(payers, resolve_tariffs(tariff_table(spark))).collect()[0]
    assert row.income_tax == expected and row.exact_year_match


def test_surcharge_church_tax_and_fallback_years(spark):
    payers = spark.createDataFrame(
        [(2025, D(100000), "single", "rate8", True), (2025, D(300000), "single", "none", True),
         (2031, D(30000), "single", "none", True), (2019, D(30000), "single", "none", True)],
        "year int, taxable_income decimal(18,2), assessment_type string, church_tax string, include_solidarity_surcharge boolean",
    )
    rows = {(r.year, int(r.taxable_income)): r for r in taxpayer_tax(payers, resolve_tariffs(tariff_table(spark))).collect()}
    assert rows[2025, 100000].solidarity_surcharge == D("1325.42")
    assert rows[2025, 100000].church_tax == D("2487.04")
    assert rows[2025, 300000].solidarity_surcharge == D("6366.41")
    assert rows[2031, 30000].version == "2026.1" and not rows[2031, 30000].exact_year_match
    assert rows[2019, 30000].version == "2022.1"


def test_tariff_override_beats_built_in(spark):
    built_in = tariff_table(spark)
    override = built_in.filter("year = 2026").select(
        F.lit(2027).alias("year"), *[c for c in built_in.columns if c not in ("year", "version")], F.lit("gii-1").alias("label")
    )
    rows = {r.year: r for r in resolve_tariffs(built_in, override).filter("year in (2026, 2027, 2030)").collect()}
    assert rows[2027].version == "2027.0+gii-1+solzg-fallback-2026" and rows[2027].exact_year_match
    assert rows[2030].tariff_year == 2027 and not rows[2030].exact_year_match
    assert rows[2026].version == "2026.1"


def test_recognition_and_vat_date(spark):
    inv, pay, none = F.lit("2025-12-30").cast("date"), F.lit("2026-01-05").cast("date"), F.lit(None).cast("date")
    rec = lambda i, p, s, m: recognition(i, p, F.lit(s), F.lit(m))
    out = values(
        spark, rec(inv, pay, "paid", "euer"), rec(inv, none, "unpaid", "euer"), rec(inv, none, "unknown", "euer"),
        rec(inv, pay, "paid", "accrual"), rec(inv, pay, "paid", "unsure"), rec(none, none, "unknown", "accrual"),
        vat_assignment(inv, pay, F.lit("soll")), vat_assignment(inv, none, F.lit("ist")),
    )
    assert [r.date and str(r.date) for r in out] == [
        "2026-01-05", None, "2025-12-30", "2025-12-30", "2025-12-30", None, "2025-12-30", "2025-12-30",
    ]
    assert [r.definitive for r in out] == [True, False, False, True, False, False, True, False]
    assert out[2].reason == "payment_date_missing" and out[4].reason == "method_unsure"


def test_dates_and_periods(spark):
    assert values(spark, *[valid_iso_date(F.lit(s)) for s in ("2024-02-29", "2023-02-29", "1899-01-01", "24-1-1")]) == [
        True, False, False, False,
    ]
    today = F.lit("2026-05-02").cast("date")
    assert [tuple(r) for r in values(spark, *[filing_period(today, F.lit(f)) for f in ("monthly", "quarterly", "yearly")])] == [
        (2026, 2, 5), (2026, 2, None), (2026, None, None),
    ]


def test_amount_parsing(spark):
    cases = {
        ("1.300,00", "auto"): "1300", ("1,300.00", "auto"): "1300", ("€23.00", "auto"): "23", ("(12,50)", "de"): "-12.5",
        ("-5", "auto"): "-5", ("1,300", "en"): "1300", ("1,300", "de"): "1.3", ("1,300", "auto"): None, ("1.300", "de"): "1300",
        ("1'234.50", "auto"): "1234.5", ("1.300.000", "auto"): "1300000", ("1.30.00", "auto"): None, ("abc", "auto"): None,
    }
    out = values(spark, *[X.parse_amount(F.lit(t), F.lit(h)) for t, h in cases])
    assert [v if v is None else v.normalize() for v in out] == [v and D(v).normalize() for v in cases.values()]


def test_date_reading(spark):
    cases = {
        "24.01.2026": "2026-01-24", "04/25/2026": "2026-04-25", "2026-02-30": None, "January 24, 2026": "2026-01-24",
        "4. September 2025": "2025-09-04", "02 Mai 2026": "2026-05-02", "3 März 2025": "2025-03-03",
    }
    out = spark.createDataFrame([(c,) for c in cases], "raw string").select(X.first_date(F.col("raw")).alias("d")).collect()
    assert [r.d and str(r.d) for r in out] == list(cases.values())
    ambiguous = spark.createDataFrame([("04/05/2026",), ("04/25/2026",), ("04/04/2026",)], "t string").select(
        X.dates(F.col("t"))[0]["ambiguous"].alias("a")
    )
    assert [r.a for r in ambiguous.collect()] == [True, False, False]


def test_text_findings(spark):
    text = (
        "Rechnung vom 24.01.2026\nKunden-USt: DE 123 456 789, ATU12345678, DE123456789\n"
        "Leistung 01.01.2026 - 31.01.2026\n12 % von $5, 1.234,56 EUR, Austria"
    )
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(
        X.vat_ids(F.col("t"), F.lit(None).cast("string")).alias("v"), X.service_period(F.col("t")).alias("p"),
        X.amounts(F.col("t"), F.lit("de")).alias("a"), X.country_in_text(F.col("t")).alias("c"),
        X.number_locale(F.col("t")).alias("l"),
    ).collect()[0]
    assert row.v.all == ["DE123456789", "ATU12345678"] and row.v.customer == "DE123456789"
    assert row.v.others == ["ATU12345678"]
    assert (row.p["from"], row.p["to"]) == (dt.date(2026, 1, 1), dt.date(2026, 1, 31))
    assert [(a.value, a.currency) for a in row.a] == [(D("5.00"), "USD"), (D("1234.56"), "EUR")]
    assert row.c == "AT" and row.l == "de"


def test_printed_rate(spark):
    cases = {
        "using 1 USD = 0.9024 EUR": ("USD", "0.9024"), "1 EUR = 1,25 USD": ("USD", "0.8"), "11 USD = 9 EUR": None,
        "1 USDT = 0,92 EUR": ("USDT", "0.92"), "1 ABC = 2 EUR": None, "nothing": None,
    }
    out = spark.createDataFrame([(t,) for t in cases], "t string").select(printed_rate(F.col("t")).alias("r")).collect()
    assert [r.r and (r.r.currency, r.r.rate_to_eur.normalize()) for r in out] == [v and (v[0], D(v[1]).normalize()) for v in cases.values()]
    assert values(spark, is_iso_currency(F.lit(" usd ")), is_iso_currency(F.lit("BTC"))) == [True, False]


def test_storage_names(spark):
    rows = spark.createDataFrame(
        [("2026-01-24", "Müller & Söhne GmbH", "a/b: c..d", "RE 1"), (None, None, "", None), ("2026-01-24", "c" * 80, "s" * 80, "n" * 60)],
        "d string, c string, s string, n string",
    )
    out = [r.name for r in names.with_storage_name(
        rows, "name", F.col("d").cast("date"), F.col("c"), F.col("s"), F.col("n")
    ).select("name").collect()]
    assert out[0] == "2026_01_24-Mueller-&-Soehne-GmbH_a-b-c.d-RE-1.pdf"
    assert out[1] == "Unknown-Date-Unknown-Company_Unknown-Service-Unknown-Invoice.pdf"
    assert len(out[2]) <= 180 and out[2].endswith(".pdf")
    assert values(spark, names.collision_suffix(F.lit("a.pdf"), F.lit(1)), names.collision_suffix(F.lit("a.pdf"), F.lit(3))) == ["a.pdf", "a-3.pdf"]


def test_verdict_parsing_and_formatting(spark):
    raw = 'ok {"fields": {"invoiceNumber": {"agrees": true, "suggested": null}, "currency": {"agrees": "no"}, "dueDate": {"agrees": false, "suggested": "1.2.2026", "confidence": "high"}}} end'
    df = spark.createDataFrame([(raw,), ("none",), ("{broken",)], "t string").select(verdicts.parse_output(F.col("t")).alias("f"))
    first, second, third = [r.f for r in df.collect()]
    assert set(first) == {"invoiceNumber", "dueDate"} and first["dueDate"].confidence == "high"
    assert second is None and third is None
    same = lambda f, v, s: verdicts.formatting_only(F.lit(f), F.lit(v), F.lit(s))
    assert values(
        spark, same("invoiceNumber", "PJ52-0005", "pj52 0005"), same("netAmountOriginal", "1234.50", "1.234,50 EUR"),
        same("invoiceDate", "2025-10-07", "October 7, 2025"), same("dueDate", "2025-10-07", "07.10.25"),
        same("description", None, "(not extracted)"), same("description", "a", "b"), same("description", "a", None),
    ) == [True, True, True, True, True, False, False]


def test_matches_with_context_take_one_scan(spark):
    """Every match is read with what stands around it, at the text's ends and beside other matches too."""
    texts = ["1.50 € 2,00", "\nvom 01.02.2024/ 31/12/2023 am 13/13/2023 US $3.10 \u0001DE 123 456 789", "x" * 50 + "Datum: 29.02.2023 28.02.2023", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    day = lambda a: [(str(d.date), d.raw, d.before) for d in a]
    got = [r for r, in df.select(X.dates(F.col("t"))).collect()]
    assert day(got[1]) == [("2023-12-31", "31/12/2023", "vom 01.02.2024/ ")]
    assert day(got[2]) == [("2023-02-28", "28.02.2023", ("x" * 50 + "Datum: 29.02.2023 ")[-34:])]
    assert got[0] == got[3] == [] and got[4] is None
    money = [[(str(a.value), a.currency) for a in r] for r, in df.select(X.amounts(F.col("t"), F.lit("auto"))).collect() if r is not None]
    assert money[0] == [("1.50", "EUR"), ("2.00", "EUR")] and ("3.10", "USD") in money[1]
    assert [r for r, in df.select(X.vat_ids(F.col("t"), F.lit(None).cast("string"))["all"]).collect()][1] == ["DE123456789"]
    for read in (X.dates(F.col("t")), X.amounts(F.col("t"), F.lit("auto")), X.vat_ids(F.col("t"), F.lit("x"))):
        plan = df.select(read.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert "regexp_extract_all(" not in plan and plan.count("split(regexp_replace(") == 1


def test_groups_of_matches_take_one_scan(spark):
    t = F.col("t")
    df = spark.createDataFrame([("19 % 1.00 0.19 and 7%, MwSt. 5 %\u0001",), ("01.02.2024 bis zum 03.02.2024",), ("",), (None,)], "t string")
    pattern = P.portable(P.RATE_WORDING)
    got = df.select(X.match_groups(t, pattern, 2), X.matches(t, pattern, 1), X.matches(t, pattern, 2), X.service_period(t).alias("p"), extraction._worded_rate(t).alias("r"))
    rows = got.collect()
    for r in rows:
        assert (None if r[0] is None else [tuple(g) for g in r[0]]) == (None if r[1] is None else list(zip(r[1], r[2])))
    assert (str(rows[1].p["from"]), str(rows[1].p["to"])) == ("2024-02-01", "2024-02-03") and rows[0].p is None and rows[0].r is None
    plan = df.select(extraction._worded_rate(t), extraction.rate_rows(t, F.lit("en")))._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all(" not in plan
    assert extraction._ANY_LABEL.startswith("^(?:")


def test_country_without_regard_to_case(spark):
    """One look at the lower-cased text finds what the rules find without regard to case, letters that fold to ASCII included."""
    texts = ["GERMANY", "nach ÖSTERREICH", "xÖsterreich", "\u0130ndia", "\u017fpain", "\u212aanada", "xspain", "Éire und Deutschland", "u.s.a.", "U.S",
             "tu.s.a", "I\u0307ndia", "Deutschland\u017f", "\u0131ndia", "LËTZEBUERG", "", None]
    t = F.col("t")
    rules = F.coalesce(*[F.when(t.rlike(P.portable(pattern, "iu")), F.lit(code)) for pattern, code in P.COUNTRIES])
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(t, rules, X.country_in_text(t), X.names_country(t)).collect()
    assert [r[2] for r in rows] == [r[1] for r in rows]
    assert [r[3] for r in rows] == [None if r[0] is None else r[1] is not None for r in rows]
    assert {"DE", "AT", "IN", "ES", "CA", "US", "LU"} <= {r[1] for r in rows}


def test_an_answer_is_parsed_once(spark):
    df = spark.createDataFrame([('x {"fields":{"currency":{"agrees":true,"confidence":"low"},"dueDate":{"agrees":"yes"}}}',), ("{}",), ("no",)], "t string")
    read = df.select(verdicts.parse_output(F.col("t")).alias("v"))
    assert [None if r.v is None else {k: tuple(v) for k, v in r.v.items()} for r in read.collect()] == [{"currency": (True, None, "low")}, None, None]
    assert read._jdf.queryExecution().analyzed().toString().lower().count("parse_json") == 1


def test_wording_by_parts_is_the_wording_by_one_pattern(spark):
    """Plain alternatives are looked for byte by byte, patterns only behind the plain text that they need."""
    assert X._alternatives(r"a(?:b|c)|[|]d|e\|f") == [r"a(?:b|c)", "[|]d", r"e\|f"]
    assert [X._needed(p) for p in (r"credits?\b", r"(?<!un)paid\b", r"one[- ]stop", r"x{0,6}", r"\d+")] == ["credit", "paid", "stop", "", ""]
    texts = ["unpaid", "paid", "prepaid.", "§ 19 UStG", "one-stop", "boss", "OSS", "Versand", "credit", "Gutschrifts", "Umsatzsteuer erklärt durch X\nim Lieferland", "§13b", "", None]
    t = F.col("t")
    whole = lambda name: F.coalesce(F.lower(t).rlike(P.portable(P.SIGNALS[name].lower(), "s" if name == "oss" else "")), F.lit(False))
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for row in df.select(F.array(*map(whole, P.SIGNALS)), F.array(*[X.has(t, name) for name in P.SIGNALS])).collect():
        assert row[0] == row[1]
    plan = df.select(X.signals(t))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(t#") == 1


def test_a_label_line_holds_the_rules_that_fit(spark):
    t = F.col("t")
    df = spark.createDataFrame([("Rechnungsnummer: RE-1\nNettobetrag 1,00 EUR\n+19 % USt 0,19\nDate\u0001 paid\nUmsatz",), ("xDatum",), (None,)], "t string")
    rules = extraction._RULES
    rows = df.select(extraction.label_lines(t).alias("l")).collect()
    assert [[(rules[x.rule], x.tag) for x in e.tags] for e in rows[0].l] == [
        [(r"(?i)Rechnungsnummer\b", "Rechnungsnummer")], [(r"(?i)Nettobetrag\b", "Nettobetrag")], [(rules[-6], "+19 % USt")], [(r"(?i)Date\b", "Date")],
    ]
    assert rows[1].l == [] and rows[2].l is None
    # every rule is among those of the letter that its matches begin with
    assert sorted({i for c in (*extraction._INITIALS, "") for i in extraction._rules_of(c)}) == list(range(len(rules)))


def test_lines_are_looked_through_once(spark):
    t, n = F.col("t"), F.col("n")
    df = spark.createDataFrame([("Foo GmbH, Musterweg 1, 10115 Berlin\nBill to\nBar AG\n75001 Paris\nFrance", "Studio"), ("Services\nWeb design", None)], "t string, n string")
    parties = df.select(lines.parties(t, n, extraction._ANY_LABEL).alias("p"))
    plan = parties._jdf.queryExecution().analyzed().toString()
    assert plan.count("auftraggeber") == 1 and plan.count("array_position(") == 2
    assert [(r.p.company, r.p.company_address, r.p.billed, r.p.billed_country) for r in parties.collect()] == [
        ("Foo GmbH", "Musterweg 1, 10115 Berlin", "Bar AG", "FR"), (None, None, None, None),
    ]


def test_dates_of_any_text(spark):
    texts = ["01.02.2024", "13/02/2024", "02/13/2024", "02/03/2024", "2024-02-30", "Feb 3, 2024", "3. März 2024", "1/2", "1.2 2024", "12.13", "3 Foo 2024", "x", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(X.read_date(F.col("t")).alias("d"), verdicts.suggested_date(F.col("t")).alias("s")).collect()
    day = lambda m, d: dt.date(2024, m, d)
    assert [None if r.d is None else (r.d.date, r.d.ambiguous) for r in rows] == [
        (day(2, 1), False), (day(2, 13), False), (day(2, 13), False), (day(3, 2), True), (None, False), (day(2, 3), False), (day(3, 3), False),
        (None, False), (day(2, 1), False), (None, False), (None, False), (None, False), None, None,
    ]
    assert rows[7].s is None and rows[8].s == day(2, 1)
    plan = spark.range(1).select(X.first_date(F.lit("x")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") <= 12
