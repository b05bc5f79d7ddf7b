"""Substring search through grams against looking at every text."""

import random

from sievewright.operators import substring
from sievewright.plans import corpus


def test_candidates_miss_nothing(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("abCΣσ ", k=rng.randint(0, 12))) for _ in range(300)] + [None, "a", "ab", "ΑΣ", "ΑΣΑ"]
    needles = {0: ["abC"], 1: ["ab"], 2: ["b"], 3: ["a b", "Σ"], 4: ["zzz"], 5: ["zz"], 6: [""], 7: ["abCΣσ a"], 8: ["ΑΣ"], 9: ["abca", "a"]}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    index = substring.gram_index(rows, "id")
    counts = substring.gram_counts(index)
    terms = spark.createDataFrame([(q, t) for q, ts in needles.items() for t in ts], "q int, term string")
    got = {}
    for r in substring.candidates(index, counts, terms, "q", "id").collect():
        got.setdefault(r.q, []).append(r.id)
    for q, ts in needles.items():
        held = {i for i, t in enumerate(texts) if t and all(x.lower().replace("ς", "σ") in t.lower().replace("ς", "σ") for x in ts)} if ts != [""] else set()
        assert held <= set(got.get(q, [])) and len(got.get(q, [])) == len(set(got.get(q, []))), q
    assert set(got.get(4, [])) == set() == set(got.get(5, []))


def test_find_all(spark):
    rows = spark.createDataFrame([("e1", 1, "The quick fox, the end"), ("e2", 2, "quick THE"), ("e3", 3, None), ("e4", 4, "thequick")], "evidence_id string, ord int, text string")
    queries = spark.createDataFrame([(1, "the QUICK"), (2, "of a"), (3, None), (4, "fox zzz"), (5, "the quick")], "query_id long, query string")
    index = substring.gram_index(rows, "evidence_id")
    got = sorted((r.query_id, r.evidence_id, r.hits) for r in substring.find_all(rows, index, substring.gram_counts(index), queries).collect())
    assert got == [(q, e, n) for q in (1, 5) for e, n in (("e1", 3), ("e2", 2), ("e4", 2))]
    plan = substring.find_all(rows, index, substring.gram_counts(index), queries)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_short_passages_are_found_through_grams(spark, tmp_path):
    texts = ["one two three four", "x two", "TWO", "a b", None, "b"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    passages = ["two three four", "two", "b", "TWO", "q"]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, corpus.containing(spark, str(tmp_path)).select("query_id", "idx").collect()))
    assert got == sorted((q, i) for q, p in enumerate(passages) for i, t in enumerate(texts) if t and p in t)


def test_one_reading_finds_what_the_index_finds(spark):
    """Terms across rows, at both ends, overlapping themselves, repeated; null and empty texts, and letters that are lower-cased to ASCII."""
    texts = ["aaaa banana", "nana", "xaaa", "aa", "", None, "Bananas \u0130nk KELVIN \u212aelvin", "na\nna ban", "anana\u00e9banana", "aab"] * 3
    rows = spark.createDataFrame([(f"e{i}", i % 4, t) for i, t in enumerate(texts)], "evidence_id string, ord int, text string").repartition(3)
    queries = spark.createDataFrame([(1, "aaa"), (2, "banana nan"), (3, "ana ana"), (4, "ab"), (5, ""), (6, "kelvin"), (7, "aaa banana"), (8, "zzzz"), (9, "nk kelvin"), (10, "aab")], "query_id long, query string")
    index = substring.gram_index(rows, "evidence_id")
    want = sorted(map(tuple, substring.find_all(rows, index, substring.gram_counts(index), queries).drop("snippet").select("query_id", "ord", "evidence_id", "hits").collect()))
    found = substring.scan_all(rows, queries)
    assert sorted(map(tuple, found.collect())) == want and want
    assert "Exchange" not in substring.scan_all(rows.coalesce(1), queries)._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobinPartitioning", "")
    assert substring.scan_all(rows, queries.where("query_id in (4, 5)")).count() == 0
