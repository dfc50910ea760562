"""The training-data operators against brute force, round trips and held-out labels, on small rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxlake.llm import (
    decontaminate, fertility, mixing, passages, perspectives, prefix_join, pseudonyms, queries, repeats, url_models, warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


def odd_rows():
    """Null, empty, blank, short, repeated and very long texts, null ids, languages and sources."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.split()
    near[60] = "other"
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(near), "en", "b", 1), (4, None, None, None, None),
        (5, "", "en", "", 0), (6, " \n\t ", "de", "b", 1), (7, "one two", "en", "a", 1), (7, "one two", "en", "a", 1),
        (8, words(rng, 6_000, 50_000), "en", "a", 1), (9, "ab " * 300, "en", "c", 1), (10, words(rng, 200), "fr", "c", 1),
        (None, words(rng, 80), "en", "a", 1), (11, "ÄÖ ünï " + base, "de", "d", 1),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names clash with what the operators work with
    return spark.createDataFrame(odd_rows(), DOCS).withColumn("n", F.lit("x")).withColumn("token", F.lit(1)).withColumn("uid", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text, k):
    found = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < k:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)}


def components_of(texts, k, percent):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and common * 100 >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_prefix_join_families(spark, k, percent):
    rng = random.Random(k)
    texts, doc_id = {}, 0
    for _ in range(5):
        base = words(rng, rng.choice((4, 20, 90)), 300).split()
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(300)}x"
            texts[doc_id] = " ".join(copy + ["tail"] * rng.randrange(2))
            doc_id += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in prefix_join.near_duplicates(df, k, percent).collect()}
    assert got == components_of(texts, k, percent)


def test_prefix_join_odd_rows(docs, empty):
    rows = prefix_join.near_duplicates(docs, 5, 80).collect()
    assert len(rows) == len(odd_rows())
    texts = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    expected = components_of(texts, 5, 80)
    for r in rows:
        assert r.component_id is None if r.doc_id is None else (r.n_shingles, r.component_id) == expected[r.doc_id]
    kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in prefix_join.one_per_group(docs).select("doc_id").collect())
    assert [d for known, d in kept if known] == sorted({c for _, c in expected.values()}) and not kept[0][0]
    assert prefix_join.near_duplicates(empty).count() == 0


def repeats_by_force(texts, length):
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [8_192, 1])
def test_repeats_against_brute_force(spark, hot):
    rng = random.Random(5)
    shared = [words(rng, 70, 9_000) for _ in range(3)]
    texts = [
        None, "", "short", "a" * 900, "ab" * 400, shared[0], shared[0][:199], shared[0][:200] + "é", "ü" * 150 + shared[1],
        shared[1] + "\n" + shared[2] + "\n" + shared[1], words(rng, 300, 9_000), words(rng, 50, 9_000) + shared[2][17:] + "x",
        shared[0][:250] + words(rng, 40, 9_000) + shared[0][250:],
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df, hot=hot, block=600).collect())
    raw = [(t or "").encode() for t in texts]
    expected = repeats_by_force(raw, 200)
    assert got == sorted([(i, *e) for i, e in enumerate(expected)] + [(2, *expected[2])])


def test_repeats_odd_rows(docs, empty):
    rows = repeats.without_repeats(docs).collect()
    assert len(rows) == len(odd_rows()) and repeats.without_repeats(empty).count() == 0
    assert {r.doc_id: r.n_removed for r in rows}[4] == 0


def test_run_length_index_statistics():
    rng = random.Random(1)
    for alphabet in ("ab", "abcdefgh"):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))).encode() for _ in range(12)]
        parts += [parts[0], parts[1] + parts[2]]
        index = repeats.RunLengthIndex(parts)
        assert index.run_lengths.sum() == len(index.text)
        for length in (1, 3, 8):
            flags = index.repeated(length)
            seen = defaultdict(int)
            for p in parts:
                for i in range(len(p) - length + 1):
                    seen[p[i : i + length]] += 1
            for p, begin in zip(parts, index.begins):
                expected = [i + length <= len(p) and seen[p[i : i + length]] > 1 for i in range(len(p))]
                assert flags[begin : begin + len(p)].tolist() == expected


def base_counts(text):
    text = text or ""
    found = SPACE.findall(text)
    triples = defaultdict(list)
    for i in range(len(found) - 2):
        triples[tuple(found[i : i + 3])].append(i)
    covered = {i + j for places in triples.values() if len(places) > 1 for i in places for j in range(3)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return (
        len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


def test_fertility_counts_and_bands(spark, docs, empty):
    rng = random.Random(9)
    plain = "the house is a small dog runs over there with green trees and people walk home after work to rest".split()
    texts = ["Line one #\nline two\nLine one #\n \n| x", "a b c a b c d", "a a a a", "x" * 5_000 + " y", "你好 мир"]
    many = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    many += [(100 + i, " ".join(rng.choice(plain) for _ in range(240)), "en", "s", 1) for i in range(60)]
    many.append((999, " ".join("".join(rng.choice("qxzjkvwQXZJ~") for _ in range(9)) for _ in range(240)), "en", "s", 1))
    rows = {r.doc_id: r for r in fertility.fertility_rules(spark.createDataFrame(many, DOCS)).collect()}
    for doc_id, text, *_ in many:
        r = rows[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert not rows[999].kept and rows[999].chars_per_token < rows[100].chars_per_token
    judged = fertility.fertility_rules(docs).collect()
    assert len(judged) == len(odd_rows()) and fertility.fertility_rules(empty).count() == 0
    assert fertility.passing_rows(docs).columns == docs.columns


MEASURED = (
    "doc_id long, lang string, text_hash long, n_words long, script string, n_tokens long, chars_per_token double, "
    "fallback_share double, token_entropy double, base_failed boolean"
)


def measured(doc_id, text_hash, chars, n_words=150, lang="en", entropy=0.8, failed=False):
    return (doc_id, lang, text_hash, n_words, "latin", n_words, chars, 0.0, entropy, failed)


def test_fertility_bands_count_copies_once(spark):
    rows = [measured(i, i, 4.0 + i / 40) for i in range(40)] + [measured(1_000 + i, 1, 4.025) for i in range(400)]
    kept = fertility.judged(spark.createDataFrame(rows, MEASURED)).where("kept").count()
    assert kept == len(rows)


def test_fertility_bands_for_every_group(spark):
    """Entropy falls by 0.01 from one length class to the next; classes of 128, 181 and 16,384 words are 14, 15 and 28."""
    rows = [measured(i, i, 4.0 + i / 1_000, 150, entropy=0.8 + i / 10_000) for i in range(40)]
    rows += [measured(100 + i, 100 + i, 4.0 + i / 1_000, 200, entropy=0.79 + i / 10_000) for i in range(40)]
    rows += [measured(200 + i, 200 + i, 2.0 + i / 1_000, 150 + i * 10, "fi", 0.8 - i / 1_000) for i in range(25)]
    rows += [
        measured(900, 900, 4.0, 17_000, entropy=0.66), measured(901, 901, 2.0, 17_000, entropy=0.66),
        measured(902, 902, 4.0, 17_000, entropy=0.5), measured(903, 903, 4.0, 150, "fi", 0.8), measured(904, 904, 2.0, 150, "xx"),
        measured(905, 905, 4.0, 150, "xx"), measured(906, 906, 4.0, 150, None, failed=True),
    ]
    out = {r.doc_id: r.kept for r in fertility.judged(spark.createDataFrame(rows, MEASURED)).collect()}
    assert len(out) == len(rows) and all(type(k) is bool for k in out.values())
    assert [i for i in range(900, 907) if out[i]] == [900, 905]
    assert all(out[i] for i in range(200, 225))
    few = fertility.judged(spark.createDataFrame(rows[:3] + rows[-7:-6], MEASURED)).collect()
    assert all(r.kept for r in few)


def test_masks_tolerate_two_replaced_words():
    for pair in itertools.combinations(range(14), 2):
        assert any(
            all(not (c == "1" and at + i in pair) for i, c in enumerate(mask))
            for mask in decontaminate.MASKS for at in range(14 - len(mask) + 1)
        )


def best_stretch(doc, item):
    best = 0
    for shift in range(-len(item) + 1, len(doc)):
        total = 0
        for i, word in enumerate(item):
            if 0 <= shift + i < len(doc):
                total = max(0, total + (1 if doc[shift + i] == word else -decontaminate.PENALTY))
                best = max(best, total)
    return best


def test_decontamination_against_brute_force(spark, docs, empty):
    rng = random.Random(4)
    items = [words(rng, n, 5_000) for n in (14, 40, 25)] + [words(rng, 300, 5_000), None, ""]
    texts = [words(rng, 60, 5_000) for _ in range(6)]
    for i, item in enumerate(items[:4]):
        broken = item.split()
        for at in range(6, len(broken), 9):
            broken[at] = "replaced"
        texts.append(words(rng, 30, 5_000) + " " + item.upper() + ", " + words(rng, 5, 5_000))
        texts.append(" ".join(broken) + " " + words(rng, 10, 5_000))
    texts += [" ".join(items[1].split()[:9]), None, "", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(6, texts[6])], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)) + [(0, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}

    def plain(t):
        return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]

    expected = {
        (d, i) for d, t in enumerate(texts) for i, item in enumerate(items)
        if plain(item) and best_stretch(plain(t), plain(item)) >= min(10, len(plain(item)))
    }
    assert got == expected and len(got) >= 8
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == len(odd_rows())


def test_decontamination_of_short_items(spark):
    rng = random.Random(6)
    han = "水火木金土日月山川田"

    def replaced(text, *at):
        return " ".join("other" if i in at else w for i, w in enumerate(text.split()))

    items = [words(rng, n, 5_000) for n in (14, 15, 17, 3, 12)] + [han]
    texts = [replaced(items[0], 4, 9), replaced(items[1], 5, 10), replaced(items[2], 7, 9, 10), items[3], replaced(items[4], 8), "雨" + han + "風"]
    around = [f"{words(rng, 20, 5_000)} {t}, {words(rng, 20, 5_000)}" for t in texts]
    around += [" ".join(reversed(items[3].split())), " ".join(items[3].split()[:2]), " ".join(items[0].split()[:5]), ""]
    df = spark.createDataFrame(list(enumerate(around)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(0, 0): 8, (1, 1): 9, (2, 2): 8, (3, 3): 3, (4, 4): 9, (5, 5): 10}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark, docs, empty):
    texts = {
        1: "mail ab.25@mail2.example.com, call +1 (522) 555-2427 or 522-555-2427, card 4649240038356417, ip 68.18.101.23.",
        2: "card 4649 2400 3835 6417; wrong 4649240038356418; ip 300.1.1.1; ssn 123-45-6789; +49 30 1234567",
        3: "on 2024-02-29, 29.02.2024, 2/29/2024 and 31.02.2020; DE89370400440532013000, DE89 3704 0044 0532 0130 00",
        4: None, 5: "", 6: "nothing here",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("old", F.lit(1))
    rows = {r.doc_id: r for r in pseudonyms.pseudonymised(df, "key", count="found").collect()}
    assert {d: r.found for d, r in rows.items()} == {1: 5, 2: 3, 3: 5, 4: 0, 5: 0, 6: 0}
    assert rows[4].text is None and rows[5].text == "" and rows[6].text == texts[6]
    one, two, three = rows[1].text, rows[2].text, rows[3].text
    for gone in ("ab.25@", "555-2427", "4649240038356417", "68.18.101.23"):
        assert gone not in one
    card = re.search(r"card (\d{16})", one)[1]
    assert luhn(card) and card[0] == "4" and f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}" in two
    assert "4649240038356418" in two and "300.1.1.1" in two and "31.02.2020" in three
    assert re.search(r"ip (\d+\.){3}\d+\.$", one) and re.search(r"ssn \d{3}-\d\d-\d{4};", two)
    phones = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3})-(\d{3}-\d{4})", one)
    assert phones.group(1, 2) == phones.group(3, 4)
    y, m, d = re.search(r"on (\d{4})-(\d\d)-(\d\d),", three).groups()
    assert f"{d}.{m}.{y}" in three and f"{int(m)}/{int(d)}/{y}" in three
    iban = re.search(r"DE\d{20}", three)[0]
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1 and " ".join(re.findall(".{1,4}", iban)) in three
    other = pseudonyms.pseudonymised(df, "another key").where("doc_id = 1").first().text
    assert other != one
    assert pseudonyms.pseudonymised(empty, "key").count() == 0
    assert pseudonyms.pseudonymised(docs, "key").columns == docs.columns


def test_pseudonyms_of_very_long_values(spark, docs):
    """Whatever a pattern can repeat, tens of thousands of times: no pattern may recurse, nor take quadratic time."""
    n = 40_000
    units = ["a@" + "b." * n + "org", "x@y" + ".z" * n, "a." * n + "@b.de", "1" * n, "1 " * n, "1-" * n, "DE12 " + "3456 " * n, "+1" * n, "+49 " + "1 " * n,
             "(123) 456-7890 " * (n // 15), "1.2.3.4." * (n // 8), "123-45-6789-" * (n // 12), "2024-01-05T" * (n // 11), "@" * n, "\ue001" * n, "a@b.c " * (n // 6)]
    df = spark.createDataFrame(list(enumerate(units)), "doc_id long, text string")
    rows = {r.doc_id: r.text for r in pseudonyms.pseudonymised(df, "key").collect()}
    assert {i: len(t) for i, t in rows.items()} == {i: len(t) for i, t in enumerate(units)}
    assert rows[0] != units[0] and rows[0].endswith("b." * 9 + "org") and rows[1][1:] == units[1][1:]
    odd = df.limit(1).withColumn("__state", F.lit(1)).withColumn("state", F.lit(2))
    assert pseudonyms.pseudonymised(odd, "key").columns == odd.columns


def test_pseudonyms_of_all_numbers_with_one(spark):
    forms = [
        "+1 (017) 555-7713", "+1 (171) 555-2028", "+1 017-555-7713", "+10175557713", "(017) 555-7713", "1 (555) 123-4567",
        "+1 (522) 155-2427", "+1 522 555 242 712",
    ]
    df = spark.createDataFrame(list(enumerate(f"call {x}, now" for x in forms)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymised(df, "key", count="found").collect()}
    new = [rows[i].text[5:-5] for i in range(len(forms))]
    assert all(rows[i].found == 1 for i in rows) and all(a != b for a, b in zip(new, forms))
    assert [re.sub(r"\d", "0", x) for x in new] == [re.sub(r"\d", "0", x) for x in forms]
    assert len({re.sub(r"\D", "", new[i])[-10:] for i in (0, 2, 3, 4)}) == 1
    ids = (F.col("id") * 2_499_983).cast("string")
    many = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("+1"), F.lpad(ids, 10, "0")).alias("text"))
    out = pseudonyms.pseudonymised(many, "key", count="found").collect()
    assert len({r.text for r in out}) == 4_000 and all(r.found == 1 and len(r.text) == 12 for r in out)


def test_pseudonyms_beside_other_values(spark):
    card, spaced, day = "4649240038356417", "4649 2400 3835 6417", "2024-01-05"
    texts = {  # text: what must be gone
        f"{card} 12/27": [card], f"12 {card}": [card], f"{spaced} 123": [spaced], f"{card} {spaced}.": [card, spaced],
        f"{card} 12/27/2024": [card, "12/27/2024"], f"7 {card}-99 8": [card], "1 " * 20_000 + card: [card],
        "ES91 2100 0418 4502 0005 1332 EUR": ["0418 4502 0005 1332"], "BE68 5390 0754 7034 EUR": ["5390 0754 7034"],
        f"+49 30 1234567 {day}": ["30 1234567", day], "+49 30 1234567 29.02.2024": ["30 1234567", "29.02.2024"],
        "+49 30 1234567 123456": ["30 1234567"], f"{day}T12:30:00Z": [day], f"+49 30 1234567 {card}": ["30 1234567", card],
        f"\ue000 {card} \ue00b \ue001 a1@b2.org": [card, "a1@"],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymised(df, "key", count="found").collect()}
    for i, (old, gone) in enumerate(texts.items()):
        new = rows[i].text
        assert not [g for g in gone if g in new] and rows[i].found == len(gone), (old[:60], new[:60])
        assert re.sub("[A-Za-z0-9]", "0", new) == re.sub("[A-Za-z0-9]", "0", old)
    assert rows[7].text.endswith(" EUR") and rows[0].text.endswith(" 12/27") and rows[11].text.endswith(" 123456")
    kept = ["4649240038356417a", "4649240038356418 12", f"{day}Tuesday", f"{day}-1"]
    df = spark.createDataFrame(list(enumerate(kept)), "doc_id long, text string")
    assert [r.text for r in pseudonyms.pseudonymised(df, "key").orderBy("doc_id").collect()] == kept


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(7 * 5).select(
        pseudonyms.feistel_pair(F.col("id") % 7, F.floor(F.col("id") / 7), 7, 5, "k", F.lit("t")).alias("p")
    )
    assert pairs.distinct().count() == 35
    strings = spark.range(100).select(pseudonyms.feistel_text(F.lpad(F.col("id").cast("string"), 2, "0"), "k", F.lit("t")).alias("s"))
    assert sorted(r.s for r in strings.collect()) == [f"{i:02d}" for i in range(100)]


@pytest.mark.parametrize(
    "sizes,weights,block,stretch",
    [
        ({"a": 903, "b": 65, "c": 210, None: 31}, {"a": 0.5, "b": 0.2, "c": 0.2}, 10, 16),
        ({"a": 2600, "b": 65}, {"a": 0.5, "b": 0.5}, 64, 1024),
        ({"a": 700, "b": 1, "c": 650, "d": 3}, {"a": 1 / 3, "b": 1 / 7, "c": 0.5, "d": 0.01}, 7, 8),
        ({f"s{i:02}": 400 if i == 0 else 40 + i for i in range(20)}, None, 8, 32),
    ],
)
def test_mixing_deviates_less_than_a_block(spark, sizes, weights, block, stretch):
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    out = mixing.mixed(df, weights, block_rows=block, stretch=stretch).collect()
    least = min(weights.values()) if weights else None
    target = {s: weights.get(s, least) if weights else n**mixing.TEMPERATURE for s, n in sizes.items()}
    target = {s: w / sum(target.values()) for s, w in target.items()}
    slots = defaultdict(list)
    for r in out:
        slots[r.slot].append(r)
    assert sorted(slots) == list(range(len(slots)))
    had, seen = defaultdict(int), defaultdict(list)
    for t in range(len(slots)):
        # every slot is one full block of one source, and no source is ever a block off its target
        own = {r.source for r in slots[t]}
        assert len(own) == 1 and sorted(r.place for r in slots[t]) == list(range(block))
        had[own.pop()] += 1
        assert all(abs(had[s] - w * (t + 1)) < 1 + 1e-6 for s, w in target.items())
        for r in sorted(slots[t], key=lambda r: r.place):
            seen[r.source].append((r.epoch, r.doc_id))
    for s, n in sizes.items():
        # rounds without gaps: each shows all rows before the next begins
        ids = {i for i, of in rows if of == s}
        assert len(seen[s]) >= n
        for e in range(len(seen[s]) // n):
            part = seen[s][e * n : (e + 1) * n]
            assert {i for _, i in part} == ids and {x for x, _ in part} == {e}
    # the mix is no longer than it must be
    assert any(len(seen[s]) - block < -(-n // block) * block for s, n in sizes.items())


def test_mixing_many_sources_and_long_mixes(spark):
    plan = spark.range(1500).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"), (F.col("id") + 1).alias("weight"), F.lit(1500 * 1501 // 2).cast("long").alias("total")
    )
    length = spark.createDataFrame([(3000,)], "length long")
    had = defaultdict(int)
    for t, r in enumerate(mixing.schedule(mixing.stretches(plan, length)).orderBy("slot").collect()):
        assert (r.slot, r.block) == (t, had[r.name])
        had[r.name] += 1
        if t % 100 == 0 or t > 2990:
            assert all(abs(had[f"s{i}"] - (i + 1) * (t + 1) / 1_125_750) < 1 for i in range(1500))
    # far into a mix of 10^15 slots the windows still hold
    weights = [333_333_333, 1_000_000_000, 7, 1]
    plan = spark.createDataFrame([(f"s{i}", w, sum(weights)) for i, w in enumerate(weights)], "name string, weight long, total long")
    far = 10**15
    ends = mixing.stretches(plan, spark.createDataFrame([(far + 5000,)], "length long"), stretch=far // 4 * 4).collect()
    late = spark.createDataFrame([r for r in ends if r["at"] == far], mixing.stretches(plan, spark.createDataFrame([(far + 5000,)], "length long"), far).schema)
    total = sum(weights)
    for r in mixing.schedule(late).collect():
        w = weights[int(r.name[1:])]
        assert r.block * total // w <= r.slot < -(-(r.block + 1) * total // w)


def test_mixing_odd_rows(spark, docs, empty):
    assert mixing.mixed(docs).select("doc_id", "text").distinct().count() == len({(r[0], r[1]) for r in odd_rows()})
    assert mixing.mixed(empty).count() == 0
    clashing = docs.withColumns({c: F.lit(1) for c in ("rows", "share", "offset", "name", "weight", "bucket", "number", "at", "block", "c0")})
    assert mixing.mixed(clashing).columns == [*clashing.columns, "slot", "place", "epoch"]
    with pytest.raises(ValueError):
        mixing.mixed(docs.withColumn("Slot", F.lit(1)))
    few = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(200)], "doc_id long, source string")
    out = mixing.mixed(few, {"a": 0.5, "b": 0.5}, block_rows=2, max_epochs=4).collect()
    assert max(r.epoch for r in out if r.source == "a") == 3 and len(out) == 24
    # one row for many rounds
    tiny = mixing.mixed(few.where("doc_id = 0 or doc_id > 10"), {"a": 0.99, "b": 0.01}, block_rows=3, stretch=256)
    assert tiny.where("source = 'a'").count() == tiny.where("source = 'a'").select("epoch").distinct().count() > 15_000


def split_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_models_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ("a.example.net", "example.net", "x.org", "b.example.com", "org", "notexample.net", "q.info")
    urls = [
        f"{rng.choice(('http', 'HTTPS'))}://{rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts)}/{rng.choice(('en', 'de', 'fr'))}/{rng.randrange(99)}{rng.choice(('', '?a=1', '#t', '/'))}"
        for _ in range(300)
    ] + [None, "", "no scheme", "http://", "http://net", "http://example.net?x=/en/", "http://a.org/fr/", "http://a.org/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("gram", F.lit(1))
    rows = {r.page_id: r for r in url_models.judged(df).collect()}
    assert len(rows) == len(urls)
    rules = sorted(url_models.RULES, key=lambda r: -len(r[0]))
    counts = {"allow": defaultdict(int), "block": defaultdict(int)}
    own = {}
    for i, url in enumerate(urls):
        host, path = split_by_hand(url)
        fit = next(((r, a) for r, a in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])), None)
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, fit and fit[0])
        assert r.verdict == (fit[1] if fit else ("allow" if r.score >= r.threshold else "block"))
        own[i] = (host + path, fit and fit[1])
    held = {r.s: r.h for r in spark.createDataFrame([(s,) for s, _ in set(own.values())], "s string").select("s", (F.pmod(F.xxhash64("s"), F.lit(url_models.HELD_OUT)) == 0).alias("h")).collect()}
    n = url_models.ORDER
    for s, label in own.values():
        padded = url_models.START * (n - 1) + s + url_models.END
        if label and not held[s]:
            for i in range(len(s) + 1):
                for o in range(1, n + 1):
                    counts[label][padded[i + n - o : i + n]] += 1

    def p(c, gram):
        context = gram[:-1]
        lower = p(c, gram[1:]) if context else 1 / url_models.ALPHABET
        after = [(g, v) for g, v in c.items() if len(g) == len(gram) and g[:-1] == context]
        total = sum(v for _, v in after)
        return (c.get(gram, 0) + len(after) * lower) / (total + len(after)) if total else lower

    for i in (0, 5, 17, 300, 302):
        padded = url_models.START * (n - 1) + own[i][0] + url_models.END
        grams = [padded[k : k + n] for k in range(len(padded) - n + 1)]
        score = sum(math.log(p(counts["allow"], g)) - math.log(p(counts["block"], g)) for g in grams) / len(grams)
        assert abs(score - rows[i].score) < 1e-9
    assert url_models.judged(df.limit(0)).count() == 0


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello ü"), (1, 2, "bob", "Hello ü"), (1, 3, "ann", None),
        (2, 0, None, "x"), (3, 0, "system", "alone"), (None, None, "bob", "lost"), (4, 300, "ann", "late"), (4, 0, "ann", "first"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("x"))
    out = {(r.conv_id, r.perspective): r for r in perspectives.rotated(df).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "bob"), (4, "ann")}
    bob = out[1, "bob"]
    assert bob.text == (
        "<|system|>\nBe kind.<|end|>\n<|user|>\nann: Hi<|end|>\n<|assistant|>\nHello ü<|end|>\n<|assistant|>\nHello ü<|end|>\n<|user|>\nann: <|end|>\n"
    )
    assert [bob.text[m.start : m.end] for m in bob.mask] == ["Hello ü<|end|>\n"] * 2
    ann = out[1, "ann"]
    assert [ann.text[m.start : m.end] for m in ann.mask] == ["Hi<|end|>\n", "<|end|>\n"]
    assert out[4, "ann"].text == "<|assistant|>\nfirst<|end|>\n<|assistant|>\nlate<|end|>\n"
    assert perspectives.rotated(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [None, 7])
def test_perspectives_by_rank(spark, most):
    rng = random.Random(4)
    numbers = [None, None, 0, 1000, 2000, 2000, *range(5_000, 5_300), 10**12]
    rows = [(c, n, rng.choice(("ann", "bob", "system", "eve" if i > 290 else "bob")), f"t{i % 40}") for c in (1, 2) for i, n in enumerate(numbers)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {(r.conv_id, r.perspective, r.piece): (r.n_turns, r.text, [r.text[m.start : m.end] for m in r.mask]) for r in perspectives.rotated(df, most_turns=most).collect()}
    expected = {}
    for c in (1, 2):
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        for start in range(0, len(turns), most or len(turns)):
            piece = turns[start : start + (most or len(turns))]
            for who in {r[2] for r in piece} - {"system"}:
                heads = ["<|system|>\n" if r[2] == "system" else "<|assistant|>\n" if r[2] == who else f"<|user|>\n{r[2]}: " for r in piece]
                text = "".join(h + r[3] + "<|end|>\n" for h, r in zip(heads, piece))
                expected[c, who, start // (most or len(turns))] = (len(piece), text, [r[3] + "<|end|>\n" for r in piece if r[2] == who])
    assert got == expected


def test_perspectives_query_renders_whole_dialogues(spark, tmp_path):
    """More turns than the query once cut at; eve speaks at the end only, and still sees all that came before."""
    rows = [(1, i, "eve" if i > 5_000 else "ann" if i % 2 else "bob", f"t{i}") for i in range(5_003)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.perspective: r for r in queries.QUERIES["op8_perspective_rotation"](spark, str(tmp_path)).collect()}
    assert {who: (r.piece, r.n_turns) for who, r in got.items()} == {who: (0, 5_003) for who in ("ann", "bob", "eve")}
    marks = [tuple(map(int, m.split("-"))) for m in got["eve"].mask.split(",")]
    assert [got["eve"].text[a:b] for a, b in marks] == ["t5001<|end|>\n", "t5002<|end|>\n"]
    assert got["eve"].text.startswith("<|user|>\nbob: t0<|end|>\n<|user|>\nann: t1<|end|>\n")


def test_warc_derivatives_round_trip(spark, tmp_path):
    page = '<html><head><title>T &amp; t</title><script>x("</p>")</script></head><body><p>One<br>two &lt;3</p><!-- no --><a href="/x?a=1&amp;b=2">go</a></body></html>'
    rows = [(1, "http://a.org/", page), (2, None, None), (3, "http://b.org/", ""), (None, "http://c.org/", "<p>é</p>"), (1, "http://a.org/", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(1))
    source = {r.record_id: r for r in warc.responses(df).collect()}
    records = warc.derived(warc.responses(df))
    got = records.collect()
    assert len(got) == 2 * len(rows) and len({r.record_id for r in got}) == 8
    for r in got:
        response = source[r.refers_to]
        assert r.payload_digest == response.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(bytes(response.payload)).digest()).decode()
        assert r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode())
        assert (r.target_uri, r.date) == (response.target_uri, response.date)
    first = {r.record_type: r for r in got if r.page_id == 1}
    assert first["conversion"].block == "T & t\nOne\ntwo <3\ngo"
    assert "title: T & t\r\n" in first["metadata"].block and "outlink: /x?a=1&b=2\r\n" in first["metadata"].block
    assert "http-header: Content-Type: text/html; charset=utf-8\r\n" in first["metadata"].block
    assert first["conversion"].concurrent_to == first["metadata"].record_id
    path = str(tmp_path / "warc")
    warc.write_records(records, path, compression="none")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*")))
    read, at = [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in raw[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        read.append((head["WARC-Record-ID"], head["WARC-Refers-To"], raw[end + 4 : end + 4 + size].decode()))
        assert raw[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        at = end + 8 + size
    assert sorted(read) == sorted((r.record_id, r.refers_to, r.block) for r in got)
    assert warc.derived(warc.responses(df.limit(0))).count() == 0


def test_warc_ids_beside_nulls(spark):
    rows = [(9007199254740993, "a", "x"), (None, "b", "y"), (9007199254740992, "c", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert {r.page_id for r in warc.responses(df).collect()} == {r.page_id for r in warc.derived(warc.responses(df)).collect()} == {r[0] for r in rows}


@pytest.mark.parametrize("unit", ["<!--", "<script>", "<a ", '<a href="', "<title>", "<", "<p x='", "</p"])
def test_warc_page_text_takes_one_scan(unit):
    started = time.perf_counter()
    warc.page_parts("begin" + unit * 100_000 + "end")
    assert time.perf_counter() - started < 5


def test_warc_foreign_records(spark, tmp_path):
    def record(kind, block, *fields):
        head = [f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}"]
        return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    page = "<html><title>Über\n uns</title><p>Gr\u00fc\u00dfe &amp; mehr<td>x<td>y<a class='l' href=/z>z</a>".encode()
    http = b"HTTP/1.1 404 Not Found\r\nserver: nginx\r\nX-Long: one\r\n two\r\nSet-Cookie: a=b\r\n\r\n"
    first = record("response", http + page, "WARC-Record-ID: <urn:uuid:1>", "WARC-Target-URI: http://a.org/\u00e4", "WARC-Date: 2024-01-02T03:04:05Z", "WARC-Payload-Digest: sha1:ABC")
    bare = record("response", b"HTTP/1.0 200 OK\r\n\r\n" + bytes(range(256)), "warc-record-id: <urn:uuid:2>")
    others = record("warcinfo", b"software: x\r\n") + record("request", b"GET / HTTP/1.1\r\n\r\n")
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "plain.warc").write_bytes(others + first + bare)
    (folder / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in (others, first, bare)))
    (folder / "empty.warc").write_bytes(b"")
    got = warc.read_responses(spark, str(folder)).collect()
    assert sorted(r.record_id for r in got) == ["<urn:uuid:1>"] * 2 + ["<urn:uuid:2>"] * 2
    one = next(r for r in got if r.record_id == "<urn:uuid:1>")
    assert (one.target_uri, one.date, one.payload_digest, bytes(one.payload)) == ("http://a.org/ä", "2024-01-02T03:04:05Z", "sha1:ABC", page)
    assert one.block_digest == warc.digest(http + page) and one.http_headers == http.decode()
    two = next(r for r in got if r.record_id == "<urn:uuid:2>")
    assert bytes(two.payload) == bytes(range(256)) and two.payload_digest == warc.digest(bytes(range(256)))
    out = {(r.record_type, r.refers_to): r for r in warc.derived(warc.read_responses(spark, str(folder / "plain.warc"))).collect()}
    assert out["conversion", "<urn:uuid:1>"].block == "Über\nuns\nGrüße & mehr x yz"
    lines = out["metadata", "<urn:uuid:1>"].block.split("\r\n")
    assert lines[:4] == ["http-status: HTTP/1.1 404 Not Found", "http-header: server: nginx", "http-header: X-Long: one two", "http-header: Set-Cookie: a=b"]
    assert "title: Über uns" in lines and "outlink: /z" in lines and out["metadata", "<urn:uuid:1>"].payload_digest == "sha1:ABC"
    # what is written can be read again, also compressed
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write_records(warc.derived(spark.createDataFrame(got, warc.RESPONSES)), path, compression)
        assert warc.read_responses(spark, path).count() == 0
        assert spark.read.option("lineSep", "\r\n\r\nWARC/").text(path).count() == 8


def test_attention_classifier(spark, docs, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = [rng.choice(("green", "house", "tree", "walks", "slowly", "home")) for _ in range(rng.randrange(1, 260))]
        if not good:
            at = rng.randrange(len(text) + 1)
            text[at:at] = ["###", "$$$", "%%%"] * 8
        rows.append((i, " ".join(text)))
        labels.append((i, int(good), None))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = passages.trained(df, marks)
    out = {r.doc_id: r for r in passages.scored(df, model).collect()}
    held = [i for i in out if out[i].held_out]
    assert 60 < len(held) < 140
    assert sum(out[i].predicted == labels[i][1] for i in held) / len(held) >= 0.9
    odd = passages.scored(docs, model).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r.score <= 1 for r in odd)
    assert passages.trained(df, marks.limit(0)) is None
    assert {r.score for r in passages.scored(df, None).limit(3).collect()} == {0.5}
    assert passages.scored(empty, model).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = passages.AttentionModel()
    x, at, y = rng.normal(size=(7, passages.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        h, _, _, e = model.encoded(x)
        total = 0.0
        for a, b, label in zip(at, [3, 4, 7], y):
            weights = np.exp(e[a:b] - e[a:b].max())
            z = weights @ h[a:b] / weights.sum()
            s = 1 / (1 + np.exp(-(z @ model.p["c"] + model.p["d"][0])))
            total -= label * np.log(s) + (1 - label) * np.log(1 - s)
        return total / 3

    for name, g in model.gradients(x, at, y).items():
        place = tuple(0 for _ in g.shape)
        model.p[name][place] += 1e-6
        up = loss()
        model.p[name][place] -= 2e-6
        down = loss()
        model.p[name][place] += 1e-6
        assert abs((up - down) / 2e-6 - g[place]) < 1e-5


def test_long_text_scores_piece_by_piece():
    model = passages.AttentionModel()
    data = np.frombuffer(" ".join(f"word{i}" for i in range(3_000)).encode(), dtype=np.uint8)
    whole = model.score(data)
    old, passages.PIECE = passages.PIECE, 700
    try:
        assert np.allclose(model.score(data), whole)
    finally:
        passages.PIECE = old


def test_benchmark_blocks_run_one_after_the_other(spark, monkeypatch):
    """However many blocks a benchmark has, no plan sends more than one, and the pairs are those of a single block."""
    words = [f"w{i}" for i in range(400)]
    item = lambda i: " ".join(words[i * 20 : i * 20 + 16])
    bench = spark.createDataFrame([(i, item(i)) for i in range(12)] + [(3, item(3)), (50, "w1 w2"), (51, None), (None, item(1))], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"x y {item(2)} z {item(9)}"), (1, f"x y {item(2)} z {item(9)}"), (2, "nothing here"), (3, f"{item(5)} w1 w2"), (4, None), (None, item(0))],
        "doc_id long, text string",
    )
    pairs = lambda: sorted(tuple(r) for r in decontaminate.leaks(docs, bench).collect())
    whole = pairs()
    assert {r[:2] for r in whole} == {(1, 2), (1, 9), (3, 5), (3, 50)}
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    assert pairs() == whole
    assert sorted(str(r) for r in decontaminate.without_leaks(docs, bench).collect()) == ["Row(doc_id=2, text='nothing here')", "Row(doc_id=4, text=None)"]
    plan = decontaminate.leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "Generate" not in plan
