"""Facts read from one text: numbers, dates, wording, currencies, VAT ids, countries.

All of it is row-local: arrays of matches inside the row, no exploding, no shuffle, no Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxlake.functions import patterns as P
from taxlake.functions.money import round_money

NUMBER = "decimal(24,6)"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of a group, null when there is none."""
    return let(F.regexp_extract(text, pattern, group), lambda found: F.when(found != "", found))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times, also inside array lambdas."""
    return F.transform(F.array(value), body)[0]


#: Characters that mean something in a pattern.
_META = set("\\[](){}.*+?^$|")


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between its outermost ``|``."""
    parts, depth, in_class, escaped = [""], 0, False, False
    for c in pattern:
        if c == "|" and not (depth or in_class or escaped):
            parts.append("")
            continue
        parts[-1] += c
        if not escaped:
            in_class = c == "[" or in_class and c != "]"
            depth += 0 if in_class else (c == "(") - (c == ")")
        escaped = c == "\\" and not escaped
    return parts


def _needed(pattern: str) -> str:
    """The longest plain text that every match of a pattern without outer ``|`` holds, maybe empty."""
    runs, depth, in_class, i = [""], 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if in_class or depth:
            in_class = c == "[" or in_class and c != "]"
            depth += 0 if in_class else (c == "(") - (c == ")")
            i += 1 + (c == "\\")
            continue
        in_class, depth = c == "[", int(c == "(")
        if c in _META:
            if c in "?*{":
                runs[-1] = runs[-1][:-1]
            runs.append("")
            i += 2 if c == "\\" else len(pattern[i:].partition("}")[0]) + 1 if c == "{" else 1
        else:
            runs[-1] += c
            i += 1
    return max(runs, key=len)


def mentions(text: Column, pattern: str, flags: str = "") -> Column:
    """Does a pattern match anywhere in a text?

    Its outer alternatives are looked for one by one: plain text by comparing bytes, which costs a small part of a scan
    by pattern, and a pattern only in texts that hold the longest plain text in it.
    """
    found = []
    for part in _alternatives(pattern):
        if not _META & set(part):
            found.append(text.contains(part))
        else:
            needed, fits = _needed(part), text.rlike(P.portable(part, flags))
            found.append(text.contains(needed) & fits if needed else fits)
    return reduce(Column.__or__, found)


#: Marks around a match and around its context; texts don't keep them while they are read.
_HIT, _PART = "\u0001", "\u0002"


def _marked(text: Column, pattern: str, shown: str) -> Column:
    """What ``shown`` makes of every match, in one scan: array of text."""
    plain = F.when(text.contains(_HIT) | text.contains(_PART), F.translate(text, _HIT + _PART, "\u0003\u0003")).otherwise(text)
    parts = F.split(F.regexp_replace(plain, pattern, f"{_HIT}{shown}{_HIT}"), _HIT)
    return F.filter(parts, lambda _, i: i % 2 == 1)


def match_groups(text: Column, pattern: str, groups: int) -> Column:
    """Groups 1 to ``groups`` of all matches: array<array<text>>, empty text for a group without a match."""
    shown = _PART.join(f"${i}" for i in range(1, groups + 1))
    return F.transform(_marked(text, pattern, shown), lambda h: F.split(h, _PART))


def with_context(text: Column, pattern: str, before: int, after: int = 0) -> Column:
    """All matches with the characters around them: array<struct<raw, before, after>>.

    One scan marks the matches, each with up to ``before`` characters in front and ``after`` behind. The text is
    padded in front, so that the look behind has one length and is tried once for each match.
    """
    pad = "\n" * before
    behind = rf"(?=((?s:.{{0,{after}}})))" if after else "()"
    found = rf"(?=(?:{pattern}))(?<=((?s:.){{{before}}}))({pattern}){behind}"
    return F.transform(
        _marked(F.concat(F.lit(pad), text), found, f"$2{_PART}$1{_PART}$3"),
        lambda h: let(
            F.split(h, _PART),
            lambda p: F.struct(p[0].alias("raw"), F.ltrim(p[1], F.lit("\n")).alias("before"), p[2].alias("after")),
        ),
    )


# --- numbers ---------------------------------------------------------------------------------

def number_locale(text: Column) -> Column:
    """'de', 'en' or 'unknown' by the decimal and grouping marks in use."""
    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    de = count(r"\d,\d{2}(?![\d,.])") + count(r"\d{1,3}(?:\.\d{3})+,\d{2}") * 2
    en = count(r"\d\.\d{2}(?![\d,.])") + count(r"\d{1,3}(?:,\d{3})+\.\d{2}") * 2
    return F.when(de > en, F.lit("de")).when(en > de, F.lit("en")).otherwise(F.lit("unknown"))


_MARKS = P.portable(r"€|\$|£|\bEUR\b|\bUSD\b|\bUSDT\b|\bGBP\b|\bCHF\b", "i")


def parse_amount(raw: Column, locale: Column) -> Column:
    """One money token to decimal; null when it is invalid or ambiguous for the locale."""
    def bare(t: Column) -> Column:
        inner = F.when(t.rlike(r"^\(.*\)$"), F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
        return F.struct(
            t.rlike(r"^\(.*\)$|^[-−]").alias("negative"),
            F.regexp_replace(F.regexp_replace(inner, r"^[-−]", ""), P.portable(r"[\s']+"), "").alias("digits"),
        )

    return let(F.trim(F.regexp_replace(raw, _MARKS, " ")), lambda t: let(bare(t), lambda x: _signed(x, locale)))


def _parse_token(raw: Column, locale: Column) -> Column:
    """``parse_amount`` of a bare token: digits, marks between them and a sign in front, nothing else."""
    negative = raw.startswith("-") | raw.startswith("−")
    digits = F.replace(F.when(negative, F.substring(raw, F.lit(2), F.length(raw))).otherwise(raw), F.lit("'"), F.lit(""))
    return let(F.struct(negative.alias("negative"), digits.alias("digits")), lambda x: _signed(x, locale))


def _signed(x: Column, locale: Column) -> Column:
    """struct(negative, digits) to decimal."""
    nothing = F.lit(None).cast("string")

    def plain(s: Column) -> Column:
        no_dots, no_commas = F.replace(s, F.lit("."), F.lit("")), F.replace(s, F.lit(","), F.lit(""))
        comma_decimal = F.replace(no_dots, F.lit(","), F.lit("."))
        dots_only = (
            F.when(s.rlike(r"^\d+(\.\d{3}){2,}$"), no_dots)
            .when(s.rlike(r"\..*\."), nothing)
            .when(s.rlike(r"^\d{1,3}\.\d{3}$"), F.when(locale == "de", no_dots).when(locale == "en", s))
            .otherwise(s)
        )
        commas_only = (
            F.when(s.rlike(r"^\d+(,\d{3}){2,}$"), no_commas)
            .when(s.rlike(r",.*,"), nothing)
            .when(s.rlike(r"^\d{0,3},\d{3}$"), F.when(locale == "en", no_commas).when(locale == "de", comma_decimal))
            .otherwise(comma_decimal)
        )
        return F.when(
            s.rlike(r"^[\d.,]+$"),
            F.when(s.contains(","), F.when(~s.contains("."), commas_only).when(s.rlike(r",[^.]*$"), comma_decimal).otherwise(no_commas))
            .when(s.contains("."), dots_only)
            .otherwise(s),
        )

    value = let(x["digits"], plain).try_cast(NUMBER)
    return F.when(x["negative"], (value * F.lit(-1)).cast(NUMBER)).otherwise(value)


_TOKEN = r"(?=[-−\d])(?:[-−]?\d[\d.,']*\d|\d)"
_CODE = P.portable(r"\b(EUR|USDT|USD|GBP|CHF)\b")


def _may_name_code(text: Column) -> Column:
    return text.contains("EUR") | text.contains("USD") | text.contains("GBP") | text.contains("CHF")


def _currency_code(raw: Column) -> Column:
    def named(mark: Column) -> Column:
        chain = F
        for symbol, code in P.CURRENCY_SYMBOLS.items():
            chain = chain.when(mark == symbol, F.lit(code))
        return chain.otherwise(mark)

    return let(raw, named)


def amounts(text: Column, locale: Column) -> Column:
    """Money amounts in reading order: array<struct<value, currency>>.

    Dates and percentages are no amounts; a bare integer needs a currency mark next to it.
    """
    hits = with_context(text, _TOKEN, 6, 6)

    def mark(h: Column) -> Column:
        def code(part: Column) -> Column:
            return F.when(_may_name_code(part), first_match(part, _CODE, 1))

        def symbol(part: Column, pattern: str) -> Column:
            return F.when(part.contains("€") | part.contains("$") | part.contains("£"), first_match(part, pattern, 1))

        ahead = F.coalesce(symbol(h["before"], r"([€$£])\s*$"), code(h["before"]))
        behind = F.coalesce(symbol(h["after"], r"^\s*([€$£])"), code(h["after"]))
        return _currency_code(F.coalesce(ahead, behind))

    def read_all(known_locale: Column) -> Column:
        def read(h: Column) -> Column:
            # a token holds neither strokes nor dashes behind its first digit
            day = h["raw"].contains(".") & h["raw"].rlike(r"\d{1,2}\.\d{1,2}\.\d{2,4}")
            possible = ~day & ~(h["after"].contains("%") & h["after"].rlike(r"^\s*%"))
            return F.when(
                possible,
                let(
                    mark(h),
                    lambda currency: F.when(
                        h["raw"].rlike(r"[.,]\d{1,2}$") | currency.isNotNull(),
                        F.struct(
                            round_money(_parse_token(h["raw"], known_locale)).alias("value"), currency.alias("currency")
                        ),
                    ),
                ),
            )

        return F.filter(F.transform(hits, read), lambda a: a["value"].isNotNull())

    return let(locale, read_all)


def decimal_amounts(text: Column, locale: Column) -> Column:
    """Distinct positive amounts printed with two decimals."""
    def read(known_locale: Column) -> Column:
        values = F.transform(
            matches(text, r"(?=[0123456789])" + P.portable(P.DECIMAL_AMOUNT)), lambda t: round_money(_parse_token(t, known_locale))
        )
        return F.array_distinct(F.filter(values, lambda v: v > 0))

    return let(locale, read)


# --- dates -----------------------------------------------------------------------------------

_NUMERIC = r"(?<![\d./])\d{1,2}(?:\.\d{1,2}\.|/\d{1,2}/)\d{4}(?![\d./])"
_ISO = rf"{P.BEGIN}\d{{4}}-\d{{2}}-\d{{2}}{P.END}"
_MONTH_FIRST = rf"{P.BEGIN}(?:{P.MONTH_NAMES})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}{P.END}"
_DAY_FIRST = rf"(?<!\d)\d{{1,2}}\.?\s+(?:{P.MONTH_NAMES})\.?\s+\d{{4}}{P.END}"
# the first look keeps every other position of a text cheap; single letters in it are told by one table
DATE = P.portable(
    rf"(?:(?=[0123456789])(?:{_ISO}|{_NUMERIC}|{_DAY_FIRST})|(?=[JFMASOND]){_MONTH_FIRST})"
)


def _month_number(name: Column) -> Column:
    numbers = F.create_map(*[F.lit(x) for pair in P.MONTH_NUMBERS.items() for x in (pair[0], f"{pair[1]:02d}")])
    return F.try_element_at(numbers, F.lower(F.substring(name, 1, 3)))


def calendar_day(year: Column, month: Column, day: Column) -> Column:
    """A calendar day from digits, null where there is none.

    A month or day out of range is told by comparing: a failed parse costs far more than all the rest.
    """
    def read(d: Column) -> Column:
        possible = (d["month"] >= "01") & (d["month"] <= "12") & (d["day"] >= "01") & (d["day"] <= "31")
        return F.when(possible, F.concat(d["year"], F.lit("-"), d["month"], F.lit("-"), d["day"]).try_cast("date"))

    return let(F.struct(year.alias("year"), F.lpad(month, 2, "0").alias("month"), F.lpad(day, 2, "0").alias("day")), read)


def _day(year: Column, month: Column, day: Column) -> Column:
    """A calendar day in the years 1900-2200, else null."""
    return let(year, lambda y: F.when((y >= "1900") & (y <= "2200"), calendar_day(y, month, day)))


def read_date(token: Column) -> Column:
    """One date token to struct(date, ambiguous): day first, month first when only that works."""
    return let(token, _read_date)


def _read_date(raw: Column) -> Column:
    def numeric(x: Column) -> Column:
        slash = raw.contains("/")
        clash = slash & x["day_first"].isNotNull() & x["month_first"].isNotNull() & (x["day_first"] != x["month_first"])
        return F.struct(
            F.coalesce(x["day_first"], F.when(slash, x["month_first"])).alias("date"),
            F.coalesce(clash, F.lit(False)).alias("ambiguous"),
        )

    def both(p: Column) -> Column:
        return F.struct(_day(p[2], p[1], p[0]).alias("day_first"), _day(p[2], p[0], p[1]).alias("month_first"))

    def plain(day: Column) -> Column:
        return F.struct(day.alias("date"), F.lit(False).alias("ambiguous"))

    year = F.regexp_extract(raw, r"(\d{4})$", 1)
    parts = F.array(*[F.regexp_extract(raw, r"^(\d+)[./](\d+)", i) for i in (1, 2)], year)
    name = F.regexp_extract(raw, r"([A-Za-zä]{3,})", 1)
    day = F.regexp_extract(F.regexp_replace(raw, r"\d{4}$", ""), r"(\d{1,2})", 1)
    return (
        F.when(raw.rlike(r"^\d{1,2}[./]\d"), let(let(parts, both), numeric))
        .when(
            raw.rlike(r"^\d{4}-"),
            plain(_day(F.substring(raw, 1, 4), F.substring(raw, 6, 2), F.substring(raw, 9, 2))),
        )
        .when(raw != "", plain(_day(year, _month_number(name), day)))
    )


def dates(text: Column) -> Column:
    """Dates in reading order: array<struct<date, ambiguous, raw, before>>."""
    read = F.transform(
        with_context(text, DATE, 34),
        lambda h: let(
            read_date(h["raw"]),
            lambda d: F.struct(
                d["date"].alias("date"), d["ambiguous"].alias("ambiguous"), h["raw"].alias("raw"), h["before"].alias("before")
            ),
        ),
    )
    return F.filter(read, lambda d: d["date"].isNotNull())


def first_date(text: Column) -> Column:
    """First readable date of a short text."""
    def first(t: Column) -> Column:
        found = F.transform(matches(t, DATE), lambda r: read_date(r)["date"])
        # every date has four digits in a row
        return F.when(t.rlike(r"\d{4}"), F.try_element_at(F.array_compact(found), F.lit(1)))

    return let(text, first)


_RANGE = rf"({DATE})" + P.portable(r"\s*(?:[-–—]|bis(?: zum)?)\s*") + rf"({DATE})"
_ENGLISH_RANGE = P.portable(
    rf"(?=[JFMASOND]){P.BEGIN}({P.MONTH_NAMES})\.?\s+(\d{{1,2}})(?:,\s*(\d{{4}}))?\s*[–—-]\s*({P.MONTH_NAMES})\.?\s+(\d{{1,2}}),?\s*(\d{{4}})\b"
)
_WHOLE_MONTH = P.portable(rf"(?:services?\s+for|für(?: den Monat)?)\s+({P.MONTH_NAMES})\w*\s+(\d{{4}})", "iu")


def service_period(text: Column) -> Column:
    """struct(from, to): two dates joined by a dash, an English range, or one whole month."""
    pairs = F.filter(
        F.transform(
            match_groups(text, _RANGE, 2),
            lambda p: F.struct(read_date(p[0])["date"].alias("from"), read_date(p[1])["date"].alias("to")),
        ),
        lambda p: p["from"] <= p["to"],
    )
    joined = F.try_element_at(pairs, F.lit(1))

    def english(p: Column) -> Column:
        def read(m: Column) -> Column:
            # the year before the last one where the first month is the later one
            year = p[5].try_cast("int") - F.when(m["start"] > m["end"], 1).otherwise(0)
            start_year = F.when(p[2] != "", p[2]).otherwise(year.cast("string"))
            return F.when(
                m["end"].isNotNull(),
                F.struct(_day(start_year, m["start"], p[1]).alias("from"), _day(p[5], m["end"], p[4]).alias("to")),
            )

        return let(F.struct(_month_number(p[0]).alias("start"), _month_number(p[3]).alias("end")), read)

    def whole(p: Column) -> Column:
        month = _day(p[1], _month_number(p[0]), F.lit("1"))
        return let(month, lambda m: F.when(m.isNotNull(), F.struct(m.alias("from"), F.last_day(m).alias("to"))))

    def groups(pattern: str, n: int) -> Column:
        return F.array(*[F.regexp_extract(text, pattern, i) for i in range(1, n + 1)])

    low = folded(text)
    return F.coalesce(
        joined,
        F.when(text.rlike(_ENGLISH_RANGE), let(groups(_ENGLISH_RANGE, 6), english)),
        F.when(let(low, lambda t: t.contains("service") | t.contains("für")), let(groups(_WHOLE_MONTH, 2), whole)),
    )


# --- wording ---------------------------------------------------------------------------------

def has(text: Column, signal: str) -> Column:
    # lower-casing once is far cheaper than case-insensitive matching at every position
    return let(F.lower(text), lambda low: _has(low, signal))


def _has(low: Column, signal: str) -> Column:
    return F.coalesce(mentions(low, P.SIGNALS[signal].lower(), "s" if signal == "oss" else ""), F.lit(False))


def signals(text: Column) -> Column:
    """Wording flags as one struct; a service needs service words and no goods words."""
    def told(low: Column) -> Column:
        return F.struct(
            *[
                _has(low, name).alias(name)
                for name in ("reverse_charge", "vat_exempt", "small_business", "oss", "paid")
            ],
            (_has(low, "service_words") & ~_has(low, "goods_words")).alias("service_likely"),
        )

    return let(F.lower(text), told)


def looks_unlike_invoice(text: Column, number: Column) -> Column:
    return ~has(text, "invoice_words") | (has(text, "order_words") & number.isNull())


def currency_counts(text: Column) -> Column:
    """Mentions per currency as struct; the asset ticker counts twice."""
    # most texts don't hold most codes
    def sign(mark: str) -> Column:
        return F.when(text.contains(mark), F.regexp_count(text, F.lit(re.escape(mark)))).when(text.isNotNull(), F.lit(0))

    def word(code: str) -> Column:
        # the code is looked for before its edges: most places of a text don't begin with it
        found = F.regexp_count(text, F.lit(P.portable(rf"(?={code})\b{code}\b")))
        return F.when(text.contains(code), found).when(text.isNotNull(), F.lit(0))

    return F.struct(
        (sign("€") + word("EUR")).alias("EUR"),
        (word("USDT") * 2).alias("USDT"),
        (sign("$") + word("USD")).alias("USD"),
        (sign("£") + word("GBP")).alias("GBP"),
        word("CHF").alias("CHF"),
    )


def main_currency(counts: Column) -> Column:
    """Most mentioned currency; the earlier listed one on a tie, null without mentions."""
    ranked = F.array(
        *[
            F.struct(counts[code].alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code"))
            for i, code in enumerate(P.CURRENCY_CODES)
        ]
    )
    return F.array_max(F.filter(ranked, lambda c: c["n"] > 0))["code"]


def stated_currency(text: Column) -> Column:
    code = F.regexp_extract(text, P.portable(P.STATED_CURRENCY, "i"), 1)
    return F.when(code.isin(*P.CURRENCY_CODES), code)


def currency_of_line(line: Column) -> Column:
    symbol = _currency_code(first_match(line, "[€$£]"))
    is_ticker = line.rlike(P.portable(r"\bUSDT\b"))
    return let(
        first_match(line, _CODE, 1),
        lambda code: F.when((code == "USD") & is_ticker, F.lit("USDT")).otherwise(F.coalesce(code, symbol)),
    )


# --- parties ---------------------------------------------------------------------------------

_VAT_ID = r"(?=[DAILEGNF])" + P.portable(P.VAT_ID).replace("(DE", "(?:DE", 1)


def vat_ids(text: Column, own: Column) -> Column:
    """struct(all, customer, others): ids without spaces, distinct, in reading order."""
    spaces = P.portable(r"\s+")
    read = F.transform(
        with_context(text, _VAT_ID, 40),
        lambda h: F.struct(
            F.regexp_replace(h["raw"], spaces, "").alias("id"), F.lower(h["before"]).contains("kunden").alias("customer")
        ),
    )
    mine = F.regexp_replace(F.coalesce(own, F.lit("")), r"\s+", "")

    def split(x: Column) -> Column:
        others = F.filter(x["all"], lambda v: ~v.eqNullSafe(x["customer"]) & (v != mine))
        return F.struct(x["all"].alias("all"), x["customer"].alias("customer"), others.alias("others"))

    def distinct(ids: Column) -> Column:
        marked = F.filter(ids, lambda h: h["customer"])
        return F.struct(
            F.array_distinct(F.transform(ids, lambda h: h["id"])).alias("all"),
            F.try_element_at(F.transform(marked, lambda h: h["id"]), F.lit(1)).alias("customer"),
        )

    return let(read, lambda ids: let(distinct(ids), split))


def country_of_vat_id(vat_id: Column) -> Column:
    """Country of a VAT id; one-stop-shop ids have none, Greece writes EL."""
    prefix = F.upper(F.substring(vat_id, 1, 2))
    code = F.when(prefix == "EL", F.lit("GR")).otherwise(prefix)
    return F.when(code.isin(*P.KNOWN_COUNTRIES), code)


#: Letters outside ASCII that a pattern without regard to case takes for ASCII ones, and these.
_FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")
#: Names of the countries by rule, without their word edges. All rules in one pattern share one pair of edges.
_COUNTRY_NAMES = [re.fullmatch(r"\\b\(?(.*?)\)?\\b", pattern).group(1) for pattern, _ in P.COUNTRIES]
_COUNTRY_LETTERS = "".join(sorted({name[0] for names in _COUNTRY_NAMES for name in names.split("|")}))
_ANY_COUNTRY = f"(?=[{_COUNTRY_LETTERS}])" + P.portable(r"\b(?:" + "|".join(_COUNTRY_NAMES) + r")\b")
#: Single rules look at the first letters of their names first, which keeps most places of a text cheap.
_COUNTRY_RULES = [
    (f"(?=[{''.join(sorted({name[0] for name in names.split('|')}))}])" + P.portable(pattern), code)
    for names, (pattern, code) in zip(_COUNTRY_NAMES, P.COUNTRIES)
]


def folded(text: Column) -> Column:
    """Lower case such that matching it equals matching the text without regard to case."""
    return F.lower(F.translate(text, *_FOLDED))


def names_country(text: Column) -> Column:
    """Does any country rule match?"""
    return folded(text).rlike(_ANY_COUNTRY)


def country_in_text(text: Column) -> Column:
    """First country rule that matches anywhere in a text. One look tells the many texts that name none."""
    def first(low: Column) -> Column:
        chain = F
        for pattern, code in _COUNTRY_RULES:
            chain = chain.when(low.rlike(pattern), F.lit(code))
        return F.when(low.rlike(_ANY_COUNTRY), chain.otherwise(F.lit(None).cast("string")))

    return let(folded(text), first)


def country_of_lines(lines: Column) -> Column:
    """Country of an address, read from its last line upwards; a bare code line counts."""
    found = F.transform(
        F.reverse(lines),
        lambda line: F.coalesce(
            F.when(
                F.regexp_extract(F.trim(line), r"^([A-Z]{2})\.?$", 1).isin(*P.KNOWN_COUNTRIES),
                F.regexp_extract(F.trim(line), r"^([A-Z]{2})\.?$", 1),
            ),
            country_in_text(line),
        ),
    )
    return F.try_element_at(F.array_compact(found), F.lit(1))


#: A legal form, by its first letter first. All of them begin with a letter.
COMPANY_FORM = "(?=[GmAKeUOILCPpSBN])" + P.portable(P.BEGIN + P.LEGAL_FORM.removeprefix(r"\b"))


def has_company_form(name: Column) -> Column:
    return F.coalesce(name.rlike(COMPANY_FORM), F.lit(False))


def payment_status(payment_date: Column, paid_wording: Column) -> Column:
    return F.when(payment_date.isNotNull() | paid_wording, F.lit("paid")).otherwise(F.lit("unknown"))

