"""The corpus pipeline against decisions made row by row, on rows with null, shared and repeated ids."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from taxlake.llm import decontaminate, fertility, prefix_join, pseudonyms
from taxlake.llm.queries import PSEUDONYM_KEY
from tests.llm.test_operators import DOCS, components_of, words

PASSAGE = "seventeen small foxes ran along the quiet river bank before sunrise and nobody in the old village heard them"


def corpus():
    rng = random.Random(12)
    base = [words(rng, rng.randrange(70, 130), 3_000) for _ in range(60)]
    rows = [(i, t, "en", "hot" if i % 3 else "b", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[7], "en", "hot", 1) for i in range(30)]  # copies
    near = base[9].split()
    near[50] = "changed"
    rows += [(200, " ".join(near), "en", "b", 1), (201, base[11] + " mail me at ann.b@example.org or +1 (212) 555-0187", "en", "b", 1)]
    rows += [(300 + i, f"{base[20 + i]} {PASSAGE} {base[30 + i]}", "en", "c", 1) for i in range(3)]
    # ids shared by a bad and a good text, in each of the stages; rows without an id; repeated rows
    good = [words(rng, 90, 3_000) for _ in range(8)]
    rows += [(400, "too short", "en", "c", 1), (400, good[0], "en", "c", 1)]
    rows += [(401, f"{good[1]} {PASSAGE}", "en", "c", 1), (401, good[2], "en", "c", 1)]
    rows += [(402, base[3], "en", "c", 1), (402, good[3], "en", None, 1), (403, good[4], "en", "c", 1), (403, good[4], "en", "c", 1)]
    rows += [(None, "also short", "en", "c", 1), (None, good[5], "en", "c", 1), (None, f"{good[6]} {PASSAGE}", "en", "c", 1), (None, base[5], "en", "c", 1)]
    rows += [(500, None, "en", "c", 1), (501, "", None, None, None)]
    return rows


def expected(spark, rows):
    """Indices of the rows that the filtering stages keep, each row under an id of its own."""
    tagged = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], DOCS)
    kept = sorted(r.doc_id for r in fertility.fertility_rules(tagged).where("kept").collect())
    texts = {i: rows[i][1] for i in kept}
    groups = {}
    for i, (_, c) in components_of(texts, 5, 80).items():
        groups.setdefault(c, []).append(i)
    return groups


def test_pipeline_by_rows(spark, tmp_path):
    rows = corpus()
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    groups = expected(spark, rows)
    assert sum(len(g) > 1 for g in groups.values()) >= 5
    wanted = set()
    for group in groups.values():
        # the smallest id that no other row has; else any row of the group
        ids = [r[0] for r in rows]
        own = sorted((i for i in group if rows[i][0] is not None and ids.count(rows[i][0]) == 1), key=lambda i: rows[i][0])
        first = own[0] if own else group[0]
        if PASSAGE not in rows[first][1]:
            wanted.add((rows[first][0], rows[first][1]))
    replaced = pseudonyms.pseudonymised(spark.createDataFrame(sorted(wanted, key=str), "doc_id long, text string"), PSEUDONYM_KEY)
    assert {(r.doc_id, r.text) for r in out} == {tuple(r) for r in replaced.collect()}
    assert not any("ann.b@example.org" in r.text or PASSAGE in r.text or "short" in r.text for r in out)
    slots = {}
    for r in out:
        slots.setdefault(r.slot, set()).add((r.source, r.place))
    assert sorted(slots) == list(range(len(slots))) and all(len({s for s, _ in x}) == 1 and len(x) == 64 for x in slots.values())


def test_stages_keep_columns_and_take_nothing(spark):
    rows = spark.createDataFrame(corpus()[:5], DOCS).withColumns({"n": F.lit("x"), "clash_id": F.lit(1), "gone_id": F.lit(2)})
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    for stage in (fertility.passing_rows, prefix_join.one_per_group, lambda d: decontaminate.without_leaks(d, bench)):
        assert stage(rows).columns == rows.columns
        assert stage(rows.where("false")).count() == 0
    assert prefix_join.one_per_group(rows).count() == 5
