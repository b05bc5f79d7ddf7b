"""Generators in the flow, contexts that are kept, ablations, pooled weights, and parts that sessions share."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import ablation, answers, generation, retrieval

CONTEXT = "query_id long, query string, evidence_id string, text string, rank int, score double"


def by_question(prompts):
    out = []
    for p in prompts:
        q = p.rsplit("Question: ", 1)[1]
        if q == "boom":
            raise RuntimeError("no memory")
        out.append({"no": "Not covered by these passages.", "none": None, "low": "unasked"}.get(q, f"{q} [1]."))
    return out


def test_answers_refusals_and_failures(spark):
    asked = [(1, "yes"), (2, "no"), (3, "boom"), (4, "none"), (5, "low"), (6, "gone")]
    questions = spark.createDataFrame(asked, "query_id long, query string")
    context = spark.createDataFrame([(i, q, f"e{r}", f"text {r}", r, 1.0 if q == "low" else 9.0 - r) for i, q in asked if q != "gone" for r in (1, 2)], CONTEXT)
    got = {r.query_id: r for r in generation.answer_questions(questions, context, by_question, 2.0).collect()}
    assert (got[1].answer, got[1].abstained, got[1].reason, got[1].top_score) == ("yes [1].", False, "", 8.0)
    assert got[2].abstained and got[2].answer == "Not covered by these passages." and got[2].reason.startswith("the generator declined")
    assert got[3].abstained and got[3].reason == "the generator failed: RuntimeError: no memory"
    assert got[4].abstained and got[4].reason == "the generator gave no answer"
    assert got[5].abstained and got[5].answer == generation.UNSURE and got[5].reason.startswith("top relevance 1.000")
    assert got[6].abstained and got[6].answer == generation.NOTHING and got[6].reason == "nothing retrieved"
    ignored = {r.query_id: r for r in generation.answer_questions(questions, context, by_question, 2.0, scores_comparable=False).collect()}
    assert ignored[5].answer == "unasked" and not ignored[5].abstained and "ignored" in ignored[5].reason
    cited = answers.tagged(generation.answer_questions(questions, context, by_question, None).where("not abstained"), context)
    assert {r.query_id: r.evidence_id for r in cited.collect()} == {1: "e1"}
    assert generation.answer_questions(questions.limit(0), context, by_question, 2.0).count() == 0


def test_a_generator_is_asked_in_batches():
    sizes = []

    def count(prompts):
        sizes.append(len(prompts))
        if "bad" in prompts:
            raise ValueError("bad")
        return prompts

    assert generation._replies(count, ["a", "bad", "c"]) == [("a", None), (None, "ValueError: bad"), ("c", None)]
    assert sizes == [3, 1, 1, 1]
    assert generation._replies(lambda p: [], ["a"])[0][1].startswith("ValueError")


def situate(prompts):
    if any("raise" in p for p in prompts):
        raise RuntimeError("x")
    return [f'Sure, here: "It is about {p.split(chr(10))[0]}, really. More."' for p in prompts]


def test_contexts_are_generated_once(spark, tmp_path):
    rows = [("k1", "T1", "s", "a" * 700), ("k1", "T1", "s", "a" * 700), ("k2", "T2", None, "b"), ("k3", "T3", "s", "raise")]
    chunks = spark.createDataFrame(rows, "key string, title string, section string, text string")
    cache = f"file://{tmp_path}/contexts"
    prompts = {r.key: r.prompt for r in generation.context_prompts(chunks).collect()}
    assert "a" * 600 in prompts["k1"] and "a" * 601 not in prompts["k1"] and "Section: \n" in prompts["k2"]
    found, new = generation.contextualised(chunks, situate, cache)
    assert new == 2 and {r.key: r.context for r in found.collect()} == {"k1": "It is about Document: T1, really.", "k2": "It is about Document: T2, really."}
    again, new = generation.contextualised(chunks.where("key <> 'k3'"), lambda p: 1 / 0, cache)
    assert new == 0 and again.count() == 2
    more = spark.createDataFrame([("k4", "T4", "s", "c")], "key string, title string, section string, text string")
    found, new = generation.contextualised(chunks.unionByName(more), situate, cache)
    assert new == 1 and found.count() == 3  # k3 raises again and is asked for again
    assert generation.contextualised(chunks.limit(0), situate, f"file://{tmp_path}/none")[1] == 0


def test_pooled_weights(spark):
    rows = [(1, 0, "a", 2.0, 1), (1, 1, "a", 3.0, 1), (1, 2, "a", 99.0, 0), (1, 0, "b", -5.0, 1), (2, 0, "b", 0.5, 1)]
    got = {(r.idx, r.term): r.weight for r in retrieval.pooled(spark.createDataFrame(rows, "idx long, position int, term string, logit double, mask int")).collect()}
    assert got == {(1, "a"): pytest.approx(math.log(4)), (2, "b"): pytest.approx(math.log(1.5))}


def test_learned_sparse_looks_at_the_first_positions(spark):
    def model(rows, key, column):
        return rows.select(key, F.posexplode(T.tokenize(F.col(column))).alias("position", "term")).select("*", F.lit(1.0).alias("logit"), F.lit(1).alias("mask"))

    chunks = spark.createDataFrame([(1, "a b c"), (2, "b c a")], "idx long, text string")
    asked = spark.createDataFrame([(7, "a x")], "query_id long, query string")
    found, weights = retrieval.learned_sparse(chunks, asked, model, 5, positions=2)
    assert [(r.idx, r["rank"]) for r in found.collect()] == [(1, 1)]
    assert sorted((r.idx, r.term) for r in weights.collect()) == [(1, "a"), (1, "b"), (2, "b"), (2, "c")]


def test_settings_side_by_side_are_each_on_its_own(spark):
    rng = random.Random(4)
    texts = {s: [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 9))) for _ in range(n)] for s, n in (("x", 30), ("y", 12))}
    rows = [(s, i, t) for s, every in texts.items() for i, t in enumerate(every)]
    asked = spark.createDataFrame([(1, "a b"), (2, "h"), (3, ""), (4, "zz")], "query_id long, query string")
    found = ablation.keyed_bm25(spark.createDataFrame(rows, "setting string, idx long, text string"), asked, 5)
    got = sorted((r.setting, r.query_id, r["rank"], r.idx, round(r.score, 9)) for r in found.collect())
    want = []
    for s, every in texts.items():
        one = retrieval.bm25(spark.createDataFrame(list(enumerate(every)), "idx long, text string"), asked, 5)
        want += [(s, r.query_id, r["rank"], r.idx, round(r.score, 9)) for r in one.collect()]
    assert got == sorted(want)


def test_scores_of_settings(spark):
    labels = spark.createDataFrame([(1, "e1", 2), (2, "e2", 2)], "query_id long, evidence_id string, gain int")
    results = spark.createDataFrame([("x", 1, "e1", 1), ("x", 2, "e9", 1), ("y", 1, "e9", 1), ("y", 1, "e1", 2), ("y", 2, "e2", 1)], "setting string, query_id long, evidence_id string, rank int")
    questions = spark.createDataFrame([(1, "single_hop"), (2, "single_hop"), (3, "unanswerable")], "query_id long, category string")
    scores = ablation.keyed_scores(results, labels, questions, spark.createDataFrame([("x",), ("y",), ("z",)], "setting string"))
    means = {r.setting: (r.n, r.recall, r.mrr) for r in ablation.keyed_means(scores, questions).collect()}
    assert means == {"x": (2, 0.5, 0.5), "y": (2, 1.0, 0.75), "z": (2, 0.0, 0.0)}


def test_a_second_session_reads_the_first_one_s_parts(spark, tmp_path):
    from sievewright.plans import parts

    for name in parts.TABLES:
        spark.range(30).selectExpr("id AS idx", "id % 3 AS v").write.parquet(f"{tmp_path}/{name}.parquet")
    made = []

    def make(s, d):
        made.append(s)
        return s.read.parquet(f"{d}/documents.parquet").repartition(parts.buckets_of(s, d, ("documents",)), "idx")

    first = parts.part(spark, str(tmp_path), "bucketed", make, ("documents",), by="idx")
    other = spark.newSession()
    again = parts.part(other, str(tmp_path), "bucketed", make, ("documents",), by="idx")
    assert len(made) == 1 and sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    grouped = again.groupBy("idx", "v").count()
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    spark.range(5).selectExpr("id AS idx", "id AS v").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert parts.part(spark, str(tmp_path), "bucketed", make, ("documents",), by="idx").count() == 30 and len(made) == 1  # reads another table
    spark.range(5).selectExpr("id AS idx", "id AS v").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert parts.part(spark, str(tmp_path), "bucketed", make, ("documents",), by="idx").count() == 5 and len(made) == 2
    files, folder = parts._files(spark, parts.scratch.root(spark)), f"{parts.scratch.root(spark)}/parts/bucketed/{parts.hashlib.md5(str(tmp_path).encode()).hexdigest()}"
    assert len(files.listStatus(parts._path(spark, folder))) == 1  # the old state is gone


def test_postings_are_scored_where_they_lie(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"a w{i % 5} {'b ' * (i % 3)}") for i in range(50)] + [(50, ""), (51, None)], "idx long, text string")
    from sievewright.sources import scratch

    posted = scratch.bucketed(retrieval.posted_with_lengths(chunks, 8), "posted", "idx")
    size = retrieval.corpus_size(posted)
    assert tuple(size.first())[0] == 52
    scored = posted.join(F.broadcast(spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "query_id long, term string, idf double")), "term").groupBy("idx", "query_id").agg(F.sum("idf"))
    assert "Exchange hashpartitioning" not in scored._jdf.queryExecution().executedPlan().toString()
    stats = {r.term: r.df for r in retrieval.statistics_of(posted, size).collect()}
    want = {r.term: r.df for r in retrieval.term_statistics(retrieval.postings(chunks), chunks).collect()}
    assert stats == want


def test_grid_writes_neither_chunks_nor_postings(spark, tmp_path, monkeypatch):
    import duckdb

    from sievewright.plans import catalogue
    from sievewright.sources import scratch

    rng = random.Random(9)
    line = lambda n: " ".join(rng.choices([f"w{i}." if i % 5 == 0 else f"w{i}" for i in range(900)], k=n))
    texts = ["\n".join(line(rng.choice([3, 20, 70, 130])) for _ in range(rng.randint(1, 6))) for _ in range(30)] + [None, "", "\ta\xa0b\n"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t[5:60]) for i, t in enumerate(texts[:8])] + [(8, "zz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names, write = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, label: names.extend(df.columns) or write(df, label))
    monkeypatch.setattr(scratch, "bucketed", lambda df, label, by: names.extend(df.columns) or df)
    rows = catalogue.queries()["scored_grid"](spark, str(tmp_path)).collect()
    assert not {"text", "tf"} & set(names)
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    columns = ", ".join(rows[0].__fields__)
    assert sorted(map(tuple, rows)) == sorted(db.execute(f"SELECT {columns} FROM ({catalogue.oracle_sql()['scored_grid']})").fetchall())


def test_settings_of_too_many_asked_terms_meet_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(ablation, "ASKED", 0)
    rng = random.Random(4)
    texts = {s: [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 9))) for _ in range(n)] for s, n in (("x", 30), ("y", 12))}
    rows = [(s, i, t) for s, every in texts.items() for i, t in enumerate(every)]
    asked = spark.createDataFrame([(1, "a b"), (2, "h"), (3, ""), (4, "zz")], "query_id long, query string")
    found = ablation.keyed_bm25(spark.createDataFrame(rows, "setting string, idx long, text string"), asked, 5)
    got = sorted((r.setting, r.query_id, r["rank"], r.idx, round(r.score, 9)) for r in found.collect())
    want = []
    for s, every in texts.items():
        one = retrieval.bm25(spark.createDataFrame(list(enumerate(every)), "idx long, text string"), asked, 5)
        want += [(s, r.query_id, r["rank"], r.idx, round(r.score, 9)) for r in one.collect()]
    assert got == sorted(want)
