"""Format-preserving pseudonyms by keyed Feistel networks (operator 10), in DataFrame functions only.

Validated values are permuted within their own kind, so that a pseudonym is again a valid value of that
kind, equal values get equal pseudonyms in all documents, and only the key leads back:

=========  ==========================================  ============================================
kind       valid when                                  permuted
=========  ==========================================  ============================================
card       13-19 digits, Luhn sum right                all digits but the first; check digit anew
iban       remainder 1 modulo 97                       account part by character class; check anew
phone      ten digits after +1, as (ddd) ddd-dddd, or  the ten digits as one number; those with area
           bare with area and exchange from 200 up     and exchange from 200 up among themselves
phone      other + numbers of 8 to 15 digits           digits after the first two
ip         four octets up to 255                       the 32 bits
ssn        area, group and serial in use               the three as one number
date       a real day of 1800 to 2199                  the day's number within these 400 years
email      one @ and a dotted domain                   letters and digits of the local part
=========  ==========================================  ============================================

Separators, brackets and the written form of a date stay. The kinds are looked for one after the other; a
value that fails the validation of one kind is left to the next ones, and stays as it is if none takes it.
Cards are looked for from every group of digits of a run on, the longest valid one first; an IBAN has the length of
its country, where that is known; a number abroad ends with the last group of digits that keeps it at 15.
Everything is row-local: no shuffle, no state.

Defined results: a null text stays null with 0 values, an empty text stays empty; repeated rows get
equal pseudonyms; every other column is passed on, whatever its name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DAYS = 146_097  # days of any 400 years; 627 * 233

#: Length of an IBAN by country: the registry's fixed values.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK ST TN VG",
    25: "LY PT", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO EG GT HU LB NI PL SV",
    29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}

#: Candidate values of each kind. Fixed values.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IBAN_OF_COUNTRY = r"(?<![A-Za-z0-9])(?:" + "|".join(
    rf"(?:{lands.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, lands in IBAN_LENGTHS.items()
) + r")(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: +1, or bracket and hyphen, mark any ten digits as a number; without them only area and exchange from 200 up do.
NANP = (
    r"\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])(?:1[ .-]?)?\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    r"|(?<![\w+])(?:1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\d)"
)
ABROAD = r"\+[1-9](?:[ .-]?\(?\d{1,4}\)?){2,8}(?!\d)"
IP = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
ISO_DAY = r"(?<![\w-])\d{4}-\d{2}-\d{2}(?!(?!T\d)[\w-])"
WRITTEN_DAY = r"(?<![\w./])\d{1,2}([./])\d{1,2}\1\d{4}(?![\w/]|\.\d)"
#: A run of digit groups of any length, with a sign behind it that would forbid a card.
CARD_RUN = r"(?<![\w.-])\d(?:[ -]?\d){12,}+[\w-]?+"

#: Signs that stand for the values of a kind while the next kinds are looked for; the first one for such signs of the text.
MARKS = [chr(0xE000 + i) for i in range(12)]


def _digest(key: str, tweak: Column, round_: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, round_.cast("string"), half.cast("string")), 256)


def _number(hexadecimal: Column, at: Column, width: int) -> Column:
    return F.conv(F.substr(hexadecimal, at, F.lit(width)), 16, 10).cast("long")


def feistel_pair(high: Column, low: Column, a: int, b: int, key: str, tweak: Column) -> Column:
    """Permute (high, low) of [0, a) x [0, b): rounds add a keyed digest of one half to the other."""
    start = F.struct(high.cast("long").alias("h"), low.cast("long").alias("l"))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        noise = _number(_digest(key, tweak, i, F.when(odd, s["l"]).otherwise(s["h"])), F.lit(1), 12)
        return F.struct(
            F.when(odd, (s["h"] + noise) % a).otherwise(s["h"]).alias("h"),
            F.when(odd, s["l"]).otherwise((s["l"] + noise) % b).alias("l"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def feistel_text(value: Column, key: str, tweak: Column) -> Column:
    """Permute a string within the class of each character: digit, lower or upper letter; others stay."""
    half = (F.length(value) / 2).cast("int")
    start = F.struct(
        F.substr(value, F.lit(1), half).alias("h"), F.substr(value, half + 1, F.length(value) - half).alias("l")
    )

    def moved(c: Column, by: Column) -> Column:
        code = F.ascii(c)
        out = c
        for first, size in ((48, 10), (65, 26), (97, 26)):
            inside = (code >= first) & (code < first + size)
            out = F.when(inside, F.char(((code - first + by) % size + first).cast("int"))).otherwise(out)
        return out

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        target = F.when(odd, s["h"]).otherwise(s["l"])

        def by(noise: Column) -> Column:
            new = F.array_join(F.transform(F.split(target, ""), lambda c, j: moved(c, _number(noise, (j % 15) * 4 + 1, 4))), "")
            return F.struct(
                F.when(odd, new).otherwise(s["h"]).alias("h"), F.when(odd, s["l"]).otherwise(new).alias("l")
            )

        return _let(_digest(key, tweak, i, F.when(odd, s["l"]).otherwise(s["h"])), by)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["h"], s["l"])
    )


def _filled(form: Column, signs: Column) -> Column:
    """``form`` with its letters and digits replaced, in order, by ``signs``."""
    return _woven(F.split(form, "[A-Za-z0-9]", -1), F.split(signs, ""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _part(value: Column, at: int, width: int) -> Column:
    return F.substr(value, F.lit(at), F.lit(width)).cast("long")


def _luhn(digits: Column) -> Column:
    weighted = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, j: F.when(j % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)),
    )
    return F.aggregate(weighted, F.lit(0), lambda s, x: s + x)


def _card(value: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    first = F.substr(digits, F.lit(1), F.lit(1))
    payload = F.concat(first, feistel_text(F.substr(digits, F.lit(2), F.length(digits) - 2), key, F.concat(F.lit("card"), first)))
    check = (F.lit(10) - _luhn(F.concat(payload, F.lit("0"))) % 10) % 10
    return F.when(_luhn(digits) % 10 == 0, _let(F.concat(payload, check.cast("string")), lambda x: _filled(value, x)))


def _mod97(text: Column) -> Column:
    def step(s: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (s * 100 + code - 55) % 97).otherwise((s * 10 + code - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(value: Column, key: str) -> Column:
    plain = F.regexp_replace(value, " ", "")
    land, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain) - 4)
    new = feistel_text(account, key, F.concat(F.lit("iban"), land))
    check = _padded(F.lit(98) - _mod97(F.concat(new, land, F.lit("00"))), 2)
    valid = _mod97(F.concat(account, F.substr(plain, F.lit(1), F.lit(4)))) == 1
    return F.when(valid, _let(F.concat(land, check, new), lambda x: _filled(value, x)))


def _nanp(value: Column, key: str) -> Column:
    """Numbers in the strict range stay in it, however they are written; the others stay outside it."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    ten = F.right(digits, F.lit(10))
    area, exchange, line = _part(ten, 1, 3), _part(ten, 4, 3), _part(ten, 7, 4)
    # 800 areas of 800 exchanges; then 200 areas of all exchanges and 800 areas of 200 exchanges: 60,000 squared
    strict = (area >= 200) & (exchange >= 200)
    inside = feistel_pair(
        (area - 200) * 100 + (exchange - 200) % 100, F.floor((exchange - 200) / 100) * 10_000 + line, 80_000, 80_000,
        key, F.lit("phone"),
    )
    rank = F.when(area < 200, ten.cast("long")).otherwise(2_000_000_000 + (area - 200) * 2_000_000 + exchange * 10_000 + line)
    outside = feistel_pair(F.floor(rank / 60_000), rank % 60_000, 60_000, 60_000, key, F.lit("phone outside"))

    def shown(new: Column) -> Column:
        signs = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), new)
        return _let(signs, lambda x: _filled(value, x))

    def strict_digits(n: Column) -> Column:
        return F.concat(
            _padded(F.floor(n["h"] / 100) + 200, 3),
            _padded(F.floor(n["l"] / 10_000) * 100 + n["h"] % 100 + 200, 3),
            _padded(n["l"] % 10_000, 4),
        )

    def other_digits(n: Column) -> Column:
        def unranked(r: Column) -> Column:
            late = r - 2_000_000_000
            return F.when(r < 2_000_000_000, _padded(r, 10)).otherwise(
                F.concat(_padded(F.floor(late / 2_000_000) + 200, 3), _padded(late % 2_000_000, 7))
            )

        return _let(n["h"] * 60_000 + n["l"], unranked)

    return F.when(strict, _let(_let(inside, strict_digits), shown)).otherwise(_let(_let(outside, other_digits), shown))


def _abroad(value: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    land = F.substr(digits, F.lit(1), F.lit(2))
    new = feistel_text(F.substr(digits, F.lit(3), F.length(digits) - 2), key, F.concat(F.lit("abroad"), land))
    return F.when(F.length(digits).between(8, 15), _let(F.concat(land, new), lambda x: _filled(value, x)))


def _ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, "\\."), lambda x: x.cast("long"))
    new = feistel_pair(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65_536, 65_536, key, F.lit("ip"))


    def shown(n: Column) -> Column:
        return F.concat_ws(".", F.floor(n["h"] / 256), n["h"] % 256, F.floor(n["l"] / 256), n["l"] % 256)

    return F.when(F.array_max(octets) <= 255, _let(new, shown))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = _part(value, 1, 3), _part(value, 5, 2), _part(value, 8, 4)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    new = feistel_pair(rank * 99 + group - 1, serial - 1, 898 * 99, 9_999, key, F.lit("ssn"))

    def shown(n: Column) -> Column:
        back = F.floor(n["h"] / 99) + 1
        back = back + F.when(back >= 666, 1).otherwise(0)
        return F.concat_ws("-", _padded(back, 3), _padded(n["h"] % 99 + 1, 2), _padded(n["l"] + 1, 4))

    return F.when(valid, _let(new, shown))


def _other_day(day: Column, key: str) -> Column:
    """Another day of 1800 to 2199; null outside these years."""
    number = F.datediff(day, F.lit("1800-01-01").cast("date"))
    new = feistel_pair(F.floor(number / 233), number % 233, DAYS // 233, 233, key, F.lit("date"))
    moved = F.date_add(F.lit("1800-01-01").cast("date"), (new["h"] * 233 + new["l"]).cast("int"))
    return F.when(number.between(0, DAYS - 1), moved)


def _iso_day(value: Column, key: str) -> Column:
    return F.date_format(_other_day(F.try_to_date(value, "yyyy-MM-dd"), key), "yyyy-MM-dd")


def _written_day(value: Column, key: str) -> Column:
    """d.m.yyyy with dots; with slashes m/d/yyyy where that is a day, else d/m/yyyy."""
    parts = F.split(value, "[./]")
    sign = F.regexp_extract(value, "[./]", 0)

    def day(d: Column, m: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", parts[2], F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    dots = sign == "."
    american = day(parts[1], parts[0])
    month_first = ~dots & american.isNotNull()
    new = _other_day(F.when(month_first, american).otherwise(day(parts[0], parts[1])), key)
    short = (F.length(parts[0]) == 1) | (F.length(parts[1]) == 1)
    same = F.regexp_extract(value, r"^\d+([./])\d+\1", 1) != ""

    def shown(n: Column) -> Column:
        d, m = (F.when(short, x.cast("string")).otherwise(_padded(x, 2)) for x in (F.dayofmonth(n), F.month(n)))
        first, second = F.when(month_first, m).otherwise(d), F.when(month_first, d).otherwise(m)
        return F.concat(first, sign, second, sign, F.year(n).cast("string"))

    return F.when(same, _let(new, shown))


def _email(value: Column, key: str) -> Column:
    local = F.substring_index(value, "@", 1)
    domain = F.substr(value, F.length(local) + 1, F.length(value) - F.length(local))
    return F.concat(feistel_text(local, key, F.concat(F.lit("email"), F.lower(domain))), domain)


def _pieces(old: Column, new: Column) -> Column:
    return F.array(F.struct(old.alias("old"), new.alias("new")))


def _alone(make: Callable[[Column, str], Column]) -> Callable[[Column, str], Column]:
    """A found value is one piece."""
    return lambda value, key: _pieces(value, make(value, key))


def _abroad_pieces(value: Column, key: str) -> Column:
    """The longest run of whole digit groups with 8 to 15 digits, and what is behind it."""

    def heads(groups: Column) -> Column:
        all_heads = F.transform(
            F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), "")
        )
        return F.get(F.filter(all_heads, lambda h: F.length(F.regexp_replace(h, "[^0-9]", "")).between(8, 15)), F.lit(0))

    def cut(head: Column) -> Column:
        rest = F.substr(value, F.length(head) + 1, F.length(value))
        return F.concat(_pieces(head, _abroad(head, key)), _pieces(rest, F.lit(None).cast("string")))

    groups = F.regexp_extract_all(value, F.lit(r"\+?[ .-]?\(?\d+\)?"), F.lit(0))
    return _let(_let(groups, heads), lambda h: F.when(h.isNull(), _pieces(value, F.lit(None).cast("string"))).otherwise(cut(h)))


def _card_pieces(run: Column, key: str) -> Column:
    """The cards of a run, each from one group of digits to another; at every group the longest valid one."""
    nothing = F.lit(None).cast("string")

    def scanned(groups: Column) -> Column:
        def longest(i: Column) -> Column:
            """The number of groups from ``i`` on that are a card; null if there is none."""
            near = F.slice(groups, i, F.lit(19))

            def valid(near: Column) -> Callable[[Column], Column]:
                def check(n: Column) -> Column:
                    shown = F.array_join(F.slice(near, F.lit(1), n), "")
                    ends = (i + n <= F.size(groups)) | shown.rlike("[0-9]$")
                    size = F.length(shown)  # at most a sign behind every digit
                    return size.between(13, 38) & ends & _let(
                        F.regexp_replace(shown, "[^0-9]", ""),
                        lambda d: F.length(d).between(13, 19) & (_luhn(d) % 10 == 0),
                    )

                return check

            return _let(near, lambda x: F.get(F.filter(F.sequence(F.size(x), F.lit(1), F.lit(-1)), valid(x)), F.lit(0)))

        starts = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: F.struct(i.alias("at"), longest(i).alias("n")))
        none = F.array().cast("array<struct<at:int,n:int>>")

        def step(chosen: Column, x: Column) -> Column:
            last = F.get(chosen, F.size(chosen) - 1)
            return F.when(x["at"] < F.coalesce(last["at"] + last["n"], F.lit(1)), chosen).otherwise(
                F.concat(chosen, F.array(F.struct(x["at"].alias("at"), x["n"].cast("int").alias("n"))))
            )

        def cut(chosen: Column) -> Column:
            def end(k: Column) -> Column:
                before = F.get(chosen, k)
                return F.coalesce(before["at"] + before["n"], F.lit(1))

            def one(x: Column, k: Column) -> Column:
                gap = F.array_join(F.slice(groups, end(k - 1), x["at"] - end(k - 1)), "")
                shown = F.array_join(F.slice(groups, x["at"], x["n"]), "")
                card = F.regexp_extract(shown, "^[0-9].*[0-9]|^[0-9]", 0)
                behind = F.substr(shown, F.length(card) + 1, F.lit(1))
                return F.concat(_pieces(gap, nothing), _pieces(card, _card(card, key)), _pieces(behind, nothing))

            rest = F.array_join(F.slice(groups, end(F.size(chosen) - 1), F.size(groups)), "")
            return F.concat(F.flatten(F.transform(chosen, one)), _pieces(rest, nothing))

        return _let(F.aggregate(F.filter(starts, lambda x: x["n"].isNotNull()), none, step), cut)

    return _let(F.regexp_extract_all(run, F.lit(r"\d+[^\d]?"), F.lit(0)), scanned)


#: In this order; days come before the numbers abroad, which would swallow a day behind them.
KINDS = (
    (EMAIL, _alone(_email)), (IBAN_OF_COUNTRY, _alone(_iban)), (IBAN, _alone(_iban)), (ISO_DAY, _alone(_iso_day)),
    (WRITTEN_DAY, _alone(_written_day)), (NANP, _alone(_nanp)), (ABROAD, _abroad_pieces), (IP, _alone(_ip)),
    (SSN, _alone(_ssn)), (CARD_RUN, _card_pieces),
)


def _woven(gaps: Column, between: Column) -> Column:
    """gap, between, gap, between, ..., gap."""
    return F.array_join(F.flatten(F.zip_with(gaps, between, lambda g, b: F.array(g, F.coalesce(b, F.lit(""))))), "")


def _marked(text: Column, pattern: str, mark: str, pieces: Callable[[Column], Column]) -> Column:
    """(text, new): ``text`` with ``mark`` for every valid value, and what the marks stand for."""

    def replaced(found: Column) -> Column:
        shown = F.transform(found, lambda ps: F.array_join(F.transform(ps, lambda p: F.when(p["new"].isNull(), p["old"]).otherwise(F.lit(mark))), ""))
        new = F.transform(F.filter(F.flatten(found), lambda p: p["new"].isNotNull()), lambda p: p["new"])
        return F.struct(_woven(F.split(text, pattern, -1), shown).alias("text"), new.alias("new"))

    none = F.struct(text.alias("text"), F.array().cast("array<string>").alias("new"))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: pieces(v))
    return F.when(text.rlike(f"[0-9@{MARKS[0]}-{MARKS[-1]}]") & text.rlike(pattern), _let(found, replaced)).otherwise(none)


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in the column ``text``; ``count`` names a column for their number."""
    source = F.col(f"`{text}`")
    state = "state" + "_" * max(len(c) for c in docs.columns)  # longer than any name of the input
    steps = [(f"[{MARKS[0]}-{MARKS[-1]}]", lambda v: _pieces(v, v))]
    steps += [(pattern, partial(make, key=key)) for pattern, make in KINDS]
    kept = [F.col(f"`{c}`") for c in docs.columns]
    # one select a step: nested in one expression, the steps are too deep for the analyser
    work = docs.select(*kept, F.struct(source.alias("text"), F.array().cast("array<array<string>>").alias("new")).alias(state))

    def marked(pattern: str, mark: str, pieces: Callable[[Column], Column]) -> Column:
        def added(s: Column) -> Column:
            return _let(
                _marked(s["text"], pattern, mark, pieces),
                lambda m: F.struct(m["text"].alias("text"), F.concat(s["new"], F.array(m["new"])).alias("new")),
            )

        return _let(F.col(state), added)

    def unmarked(s: Column) -> Column:
        def shown(out: Column, at: Column) -> Column:
            new = F.get(s["new"], at)
            mark = F.get(F.array(*(F.lit(m) for m in MARKS)), at)
            return F.when(F.size(new) == 0, out).otherwise(_woven(F.split(out, mark, -1), new))

        return F.struct(F.aggregate(F.sequence(F.lit(len(steps) - 1), F.lit(0), F.lit(-1)), s["text"], shown).alias("text"), s["new"].alias("new"))

    for mark, (pattern, pieces) in zip(MARKS, steps):
        work = work.select(*kept, marked(pattern, mark, pieces).alias(state))
    work = work.select(*kept, _let(F.col(state), unmarked).alias(state))
    columns = [F.col(state)["text"].alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if count:
        values = F.aggregate(F.slice(F.col(state)["new"], 2, len(steps)), F.lit(0), lambda n, new: n + F.size(new))
        columns.append(values.cast("long").alias(count))
    return work.select(*columns)
