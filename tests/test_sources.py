import json

import pytest
from pyspark.sql import functions as F

from sievewright.sources import readers, writers


def write(path, lines):
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def question(i, **more):
    return json.dumps({"id": i, "question": "q", "category": "single_hop", "difficulty": "easy", "required_evidence": [{"doc_id": " D ", "section": "S"}], **more})


def test_questions(spark, tmp_path):
    path = write(tmp_path / "q.jsonl", ["// a comment", "", question("Q1"), question("Q2", retired=True), question("Q3", provenance={"confidence": "low"})])
    rows = readers.questions(spark, path).collect()
    assert [(r.id, r.required, r.confidence) for r in rows] == [("Q1", ["D::S"], "high")]
    assert readers.questions(spark, path, low_confidence=True).count() == 2
    with pytest.raises(ValueError, match=":2: not valid JSON"):
        readers.questions(spark, write(tmp_path / "bad.jsonl", [question("Q1"), "{oops"]))
    with pytest.raises(ValueError, match="no questions"):
        readers.questions(spark, write(tmp_path / "none.jsonl", ["// nothing"]))


def test_chunks_and_registry(spark, tmp_path):
    rows = readers.chunks(spark, write(tmp_path / "c.jsonl", [json.dumps({"chunk_id": "D::S", "doc_id": "D", "section": "S", "text": "t", "metadata": {"order": 3}}), ""]))
    assert rows.first().evidence_id == "D::S" and rows.first().metadata["order"] == 3
    ok = readers.registry(spark, write(tmp_path / "r.csv", ["﻿doc_id,title,url,commencement_date,effective_date", "A,t,https://x.org/a,,2024-05-01", "B,t,https://x.org/b,2024-06-01,", "C,t,https://x.org/c,,"]))
    assert {r.doc_id: str(r.commenced) for r in readers.commencements(ok).collect()} == {"A": "2024-05-01", "B": "2024-06-01", "C": "None"}
    for lines, what in ((["doc_id,title", "A,t"], "lacks url"), (["doc_id,title,url"], "is empty"), (["doc_id,title,url", "A,t,https://x.org", "A,t,https://x.org"], "repeats"), (["doc_id,title,url", "A,t,x"], "absolute")):
        with pytest.raises(ValueError, match=what):
            readers.registry(spark, write(tmp_path / "bad.csv", lines))


def test_cache_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    path, calls = f"{tmp_path}/cache", []

    def compute(new):
        calls.append(sorted(r.key for r in new.collect()))
        return new.withColumn("value", F.upper("key"))

    for _ in range(2):
        assert sorted((r.key, r.value) for r in readers.cached(spark, path, rows, "key", compute).collect()) == [("a", "A"), ("a", "A"), ("b", "B")]
    assert calls == [["a", "b"], []]
    write(tmp_path / "x.html", ["<p>x</p>"])
    got = readers.manifest(spark, f"{tmp_path}/x.html").first()
    assert got.bytes == 8 and len(got.sha256) == 64
    assert readers.html_pages(spark, str(tmp_path)).first().doc_id == "x"


def test_writers(spark):
    rows = spark.createDataFrame([("a|b", 0.5, None)], "name string, x double, y int")
    assert writers.markdown(rows) == "| name | x | y |\n|---|---|---|\n| a\\|b | 0.500 |  |"
    assert json.loads(writers.report(rows)) == [{"name": "a|b", "x": 0.5, "y": None}]
    cited = spark.createDataFrame([(1, [("e", "secret")])], "query_id long, citations array<struct<evidence_id: string, excerpt: string>>")
    assert "secret" not in str(writers.redact(cited).collect())
    with pytest.raises(ValueError):
        writers.redact(cited.withColumn("excerpt", F.lit("x")))


def test_missing_files_and_pages(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.json_lines(spark, f"file://{tmp_path}/none.jsonl", "a int")
    assert readers.json_lines(spark, f"file://{tmp_path}/none.jsonl", "a int", missing_ok=True).count() == 0
    (tmp_path / "r.csv").write_text("doc_id,title\na,x\na,y\n")
    assert readers.registry_rows(spark, f"file://{tmp_path}/r.csv").count() == 2
    pages = spark.createDataFrame([("a", "<p>")], "doc_id string, html string")
    assert [r.doc_id for r in readers.missing_pages(pages, spark.createDataFrame([("a",), ("b",)], "doc_id string")).collect()] == ["b"]


def test_unreadable_cache_is_made_anew(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "key int, text string")
    compute = lambda new: new.selectExpr("key", "upper(text) as value")
    path = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert {r.value for r in readers.cached(spark, path, rows, "key", compute).collect()} == {"A", "B"}
    for f in (tmp_path / "cache").glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "cache").glob(".*.crc"):
        f.unlink()
    assert {r.value for r in readers.cached(spark, path, rows, "key", compute).collect()} == {"A", "B"}


def test_corpus_digest(spark):
    rows = spark.createDataFrame([(str(i), f"t{i}") for i in range(50)], "id string, text string")
    digest = readers.corpus_digest(rows, "id", "text")
    assert digest == readers.corpus_digest(rows.repartition(7), "id", "text") != readers.corpus_digest(rows.where("id <> '7'"), "id", "text")
    assert digest != readers.corpus_digest(rows.withColumn("text", F.when(F.col("id") == "3", "x").otherwise(F.col("text"))), "id", "text")


def test_line_numbers_of_split_files(spark, tmp_path):
    for name, n in (("a", 3_000), ("b", 1), ("c", 700)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i} {'x' * (i % 50)}\n" for i in range(1, n + 1)))
    (tmp_path / "d.txt").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = readers.numbered_lines(spark, f"file://{tmp_path}").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 3_701
    assert all(r.value.split()[0] == f"{r.file[-5]}{r.line}" for r in rows)


def test_bad_chunk_is_named_by_its_line(spark, tmp_path):
    ok = json.dumps({"chunk_id": "D::S", "doc_id": "D", "section": "S", "text": "t"})
    with pytest.raises(ValueError, match=r"c\.jsonl:4: not valid JSON"):
        readers.chunks(spark, write(tmp_path / "c.jsonl", [ok, "", ok, "{", ok, "["]))
    with pytest.raises(ValueError, match="holds no chunks"):
        readers.chunks(spark, write(tmp_path / "e.jsonl", ["", " "]))
    records = readers.json_records(spark, write(tmp_path / "r.jsonl", ['{"a": 1}', "# x", '{"a": "no"}', "{}"]), "a int", comments="#").orderBy("line").collect()
    assert [(r.line, r.record.a, r.bad) for r in records] == [(1, 1, None), (3, None, '{"a": "no"}'), (4, None, None)]


def test_catalogue_with_quotes_and_lines_in_a_field(spark, tmp_path):
    path = write(tmp_path / "r.csv", ["doc_id,title,url", 'A,"a ""quoted"", title",https://x.org/a', 'B,"two', 'lines",https://x.org/b'])
    assert {r.doc_id: r.title for r in readers.registry(spark, path).collect()} == {"A": 'a "quoted", title', "B": "two\nlines"}
