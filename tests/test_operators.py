"""Operators on small fixtures with known results."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sievewright.functions import lists
from sievewright.functions import text as T
from sievewright.operators import answers, blocked, curation, ingest, metrics, obligation, references, retrieval, statistics, temporal, windows
from sievewright.sources import scratch


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("x")).first().x


LABELS = {
    "Article (3): Effective Risk Management System": "Article 3", "Article (1)": "Article 1", "Article 2 Scope of Application": "Article 2", "Article (10): Actuarial Function": "Article 10",
    "3.1 The Board": "3.1", "6.1.6 Something Specific": "6.1.6", "1. Definitions": "1", "Chapter Two: Electronic Insurance Strategy": "Chapter Two", "Appendix (1)": "Appendix 1",
    "Appendix 1 Financial Statement Forms": "Appendix 1", "Schedule No. (1)": "Schedule 1", "Annex A": "Annex A", "Section (2) Regulations Pertinent to the Solvency Margin": "Section 2",
    "Definitions": "Definitions", "General Provisions": "General Provisions", "Article (007)": "Article 7",
}


def test_section_labels(spark):
    rows = spark.createDataFrame(list(LABELS.items()), "heading string, label string")
    assert rows.where(T.section_label(F.col("heading")) != F.col("label")).count() == 0


def test_text_scalars(spark):
    assert one(spark, T.tokenize(F.col("a")), a="Étre Article 5(2)") == ["tre", "article", "5", "2"]
    assert one(spark, T.word_count(F.col("a")), a="a b  c\n") == 3
    assert one(spark, T.clean(F.col("a")), a=" ‘x’  ﬁ\n\n\n\ny ") == "'x' fi\n\ny"
    assert one(spark, T.normalise_date(F.col("a")), a=" 3/12/2024 ") == "2024-12-03"
    assert one(spark, T.normalise_date(F.col("a")), a="2024-12-03") == ""
    assert one(spark, T.normalise_status(F.col("a")), a="In-Force") == "in_force"
    assert one(spark, T.normalise_status(F.col("a")), a="Under Review") == "under_review"
    assert one(spark, T.instructions(F.col("a"))["passage"], a="intfloat/e5-base") == "passage: "
    assert one(spark, T.instructions(F.col("a"))["query"], a="unknown") == ""
    assert one(spark, T.clean_context(F.col("a")), a='Sure! Here it is: "This section covers the board. More"') == "This section covers the board."
    assert one(spark, T.indexable_text(F.col("t"), F.col("s"), F.col("h"), F.col("d")), t="x", s="S", h="S", d="D") == "D\nS\nS\nx"
    assert one(spark, T.indexable_text(F.col("t"), F.col("s"), F.col("h"), F.col("d")), t="x", s="S", h="H", d="H") == "S\nH\nx"
    assert one(spark, T.citable(F.col("a")), a=" false ") is False and one(spark, T.citable(F.col("a")), a="") is True


def test_sentence_of_401_characters(spark):
    sentence = "x" * 400 + "."
    assert one(spark, T.clean_context(F.col("a")), a=f"{sentence} More") == "x" * 400
    assert one(spark, T.clean_context(F.col("a"), whole=True), a=f"{sentence} More") == sentence
    assert one(spark, T.clean_context(F.col("a"), whole=True), a="y" * 500) == "y" * 400


def page(*parts):
    return "<div class='field--name-body'></div>" + "".join(f"<h2 class='page-title'>{h}</h2>" + (f"<div class='field--name-body'><p>{b}</p></div>" if b else "") for h, b in parts)


def parse(spark, *parts):
    blocks = ingest.html_blocks(spark.createDataFrame([("d", page(*parts))], "doc_id string, html string"))
    return ingest.sections(blocks).orderBy("order").collect()


def test_html_walk(spark):
    rows = parse(spark, ("The Law", "recitals"), ("Definitions", ""), ("Article (1)", "terms"), ("Article (2)", "more"))
    assert [(r.section, r.section_title) for r in rows] == [("Preamble", "The Law"), ("Article 1", "Definitions"), ("Article 2", "Article (2)")]
    rows = parse(spark, ("The Law", "x"), ("Section (1)", ""), ("Article (1)", "a"), ("Section (2)", ""), ("Article (1)", "b"))
    assert [r.section for r in rows] == ["Preamble", "Section 1, Article 1", "Section 2, Article 1"]
    rows = parse(spark, ("The Law", "x"), ("Definitions", "a"), ("Definitions", "b"))
    assert [r.section for r in rows] == ["Preamble", "Definitions", "Definitions (2)"] and rows[2].duplicate_label
    assert [r.section for r in parse(spark, ("Chapter One", ""), ("Article (1)", "a"))] == ["Chapter One, Article 1"]
    pages = spark.createDataFrame([("n", "<p>no</p>")], "doc_id string, html string")
    blocks = ingest.html_blocks(pages)
    assert [r.warning for r in ingest.parse_warnings(pages, blocks, ingest.sections(blocks)).collect()] == ["no headings"]


def chunked(spark, text, budget, overlap):
    rows = spark.createDataFrame([("d::s", "d", "s", text)], "chunk_id string, doc_id string, section string, text string")
    return ingest.chunk_sections(rows, budget, overlap).orderBy("part").collect()


def test_chunking(spark):
    assert [tuple(r) for r in chunked(spark, "a b c", 10, 0)] == [("d::s", "d", "s", "a b c", 0, 1)]
    lines = "\n".join(" ".join(f"w{i}_{j}" for j in range(30)) for i in range(40))
    rows = chunked(spark, lines, 120, 20)
    assert all(len(r.text.split()) <= 150 for r in rows) and {r.parts for r in rows} == {len(rows)} and rows[0].chunk_id == "d::s#1"
    assert rows[1].text.split()[:20] == rows[0].text.split()[-20:]
    assert " ".join(r.text for r in chunked(spark, lines, 120, 0)).split() == lines.split()
    long = " ".join("word " * 49 + "end." for _ in range(10))
    assert len(chunked(spark, long, 100, 0)) == 5
    for bad in ((0, 0), (100, 100), (100, -1)):
        with pytest.raises(ValueError):
            ingest.chunk_sections(spark.createDataFrame([], "chunk_id string, doc_id string, section string, text string"), *bad)


def plain_windows(paragraphs, budget, overlap):
    """Windows by the stream of words since the last paragraph above the budget."""
    out, stream, at = [], [], 0
    count = lambda p: len(p.split())
    while at < len(paragraphs):
        if count(paragraphs[at]) > budget:
            held = []
            for s in re.split(r"(?<=[.;:])\s+", paragraphs[at]):
                if held and sum(map(count, held)) + count(s) > budget:
                    out.append(" ".join(held))
                    held = []
                held.append(s)
            out.append(" ".join(held))
            stream, at = [], at + 1
            continue
        tail = stream[len(stream) - min(overlap, len(stream)) :]
        taken, size = [paragraphs[at]], len(tail) + count(paragraphs[at])
        while at + len(taken) < len(paragraphs) and count(paragraphs[at + len(taken)]) <= budget and size + count(paragraphs[at + len(taken)]) <= budget:
            size += count(paragraphs[at + len(taken)])
            taken.append(paragraphs[at + len(taken)])
        out.append("\n".join(([" ".join(tail)] if tail else []) + taken))
        stream += " ".join(taken).split()
        at += len(taken)
    return out


@pytest.mark.parametrize("budget,overlap", [(10, 0), (10, 3), (10, 9), (25, 12)])
def test_windows_against_a_plain_version(budget, overlap):
    rng = random.Random(budget + overlap)
    rows = [[" ".join(rng.choice(["a", "b.", "c;", "d"]) for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 30, 60]))) for _ in range(rng.randint(0, 15))] for _ in range(200)]
    assert windows.windows(rows, budget, overlap) == [plain_windows(p, budget, overlap) for p in rows]
    assert windows.windows([], budget, overlap) == []


def test_words_and_paragraphs_as_the_column_functions_have_them(spark):
    rng = random.Random(2)
    blanks = [*windows.SPACE, "\x1c", "\x1f", "\u200b", "\n\n", "\n \n"]
    texts = ["", "a", *("".join(rng.choice(["w", "x.", "é", rng.choice(blanks)]) for _ in range(rng.randint(1, 40))) for _ in range(400))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r for r in rows.select("i", T.word_count(F.col("t")).alias("n"), T.paragraphs(F.col("t")).alias("p"), T.clause_sentences(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n, got[i].p, got[i].s) == (len(windows.words(t)), windows.paragraphs(t), windows._CLAUSE.split(t)), repr(t)


def test_chunk_grid_reads_once_and_equals_single_settings(spark):
    rng = random.Random(8)
    texts = [None, "", "\n\n", *("\n".join(" ".join(rng.choice(["a", "b.", "c;"]) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))) for _ in range(40))]
    rows = spark.createDataFrame([(f"d{i}::s", f"d{i}", "s", t) for i, t in enumerate(texts)], "chunk_id string, doc_id string, section string, text string").repartition(3)
    settings = [(10, 0), (10, 3), (30, 12)]
    grid = ingest.chunk_grid(rows, settings)
    assert grid.select("doc_id").where("doc_id = 'd0'").count() == 0  # a null text has no chunk
    for budget, overlap in settings:
        one = ingest.chunk_sections(rows, budget, overlap)
        assert sorted(map(tuple, grid.where((F.col("budget") == budget) & (F.col("overlap") == overlap)).drop("budget", "overlap").collect())) == sorted(map(tuple, one.collect()))
        for i, t in enumerate(texts[1:], 1):
            want = [t] if len(t.split()) <= budget else plain_windows(t.split("\n"), budget, overlap)
            assert [r.text for r in one.where(f"doc_id = 'd{i}'").orderBy("part").collect()] == want


CORPUS = [(0, "The board sets the risk appetite."), (1, "Paid up capital of the company."), (2, "The actuarial function reports.")]


def ranking(spark, queries, k=3):
    chunks = spark.createDataFrame(CORPUS, "idx long, text string")
    questions = spark.createDataFrame(queries, "query_id long, query string")
    return [(r.query_id, r.idx, r["rank"]) for r in retrieval.bm25(chunks, questions, k).orderBy("query_id", "rank").collect()]


def test_bm25_order_ties_and_padding(spark):
    assert ranking(spark, [(1, "risk appetite board")])[0] == (1, 0, 1)
    assert ranking(spark, [(1, "capital")]) == [(1, 1, 1), (1, 0, 2), (1, 2, 3)]
    assert ranking(spark, [(1, "nothing here")]) == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]
    assert ranking(spark, [(1, "...")]) == []


def test_bm25_against_a_plain_version(spark):
    import re

    docs = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in CORPUS}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    query = "the board the capital"
    want = {i: sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in query.split()) for i, d in docs.items()}
    got = retrieval.bm25(spark.createDataFrame(CORPUS, "idx long, text string"), spark.createDataFrame([(1, query)], "query_id long, query string"), 3)
    assert {r.idx: pytest.approx(r.score) for r in got.collect()} == want


def test_fusion(spark):
    rows = lambda ids: spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "query_id long, idx long, rank int")
    got = retrieval.fuse([rows([1, 2]), rows([3, 2])], 10).orderBy("rank").collect()
    assert [r.idx for r in got] == [2, 1, 3] and got[0].score == pytest.approx(2 / 62)
    assert retrieval.fuse([rows([1]), rows([1])], 1).first().score == pytest.approx(2 / 61)
    for bad in (([rows([1])], 10, 60), ([rows([1])] * 2, 10, 0)):
        with pytest.raises(ValueError):
            retrieval.fuse(*bad)


def test_expansion(spark):
    chunks = spark.createDataFrame([(1, "D::1"), (2, "D::2"), (3, "D::3"), (4, "D::4"), (5, "D::4")], "idx long, evidence_id string")
    found = spark.createDataFrame([(1, 2, 0.9, 1), (1, 1, 0.5, 2)], "query_id long, idx long, score double, rank int")
    edges = spark.createDataFrame([("D::2", "D::3"), ("D::4", "D::2"), ("D::2", "D::1")], "source string, target string")
    got = [(r.idx, r["rank"], r.added, round(r.score, 3)) for r in retrieval.expand(found, chunks, edges, 20).orderBy("rank").collect()]
    assert got == [(2, 1, False, 0.9), (1, 2, False, 0.5), (3, 3, True, 0.899), (4, 4, True, 0.898), (5, 5, True, 0.897)]
    assert retrieval.expand(found, chunks, edges, 20, cap=1).where("added").count() == 1
    assert retrieval.expansion_size(found, chunks, edges).first().n == 2


def test_feedback_and_rewrites(spark):
    chunks = spark.createDataFrame([(0, "The actuary reviews technical provisions annually within 2024 insurance")], "idx long, text string")
    questions = spark.createDataFrame([(1, "technical review")], "query_id long, query string")
    base = spark.createDataFrame([(1, 0, 1.0, 1)], "query_id long, idx long, score double, rank int")
    terms = retrieval.feedback_terms(base, chunks, questions)
    assert {r.term for r in terms.collect()} == {"actuary", "reviews", "annually"}
    assert retrieval.feedback_rewrite(terms, questions).first().retrieval_query == "technical review actuary annually reviews"
    for gen, want in ((lambda q: F.lit(None).cast("string"), "technical review"), (lambda q: F.lit("  "), "technical review"), (lambda q: F.lit(" a \n b "), "technical review a b")):
        assert retrieval.generated_rewrite(questions, gen).first().retrieval_query == want


def scored(spark, retrieved, required, k, helpful=()):
    results = spark.createDataFrame([(1, e, r) for r, e in enumerate(retrieved, 1)], "query_id long, evidence_id string, rank int")
    labels = spark.createDataFrame([(1, e, 2) for e in required] + [(1, e, 1) for e in helpful], "query_id long, evidence_id string, gain int")
    return metrics.score(results, labels, spark.createDataFrame([(1,)], "query_id long"), (k,)).first()


def test_metrics(spark):
    assert scored(spark, ["A", "N", "N"], ["A", "B"], 5).recall == 0.5
    assert scored(spark, ["N", "M", "O", "P", "A"], ["A"], 3).recall == 0.0 and scored(spark, ["N", "M", "O", "P", "A"], ["A"], 5).recall == 1.0
    cut = scored(spark, ["A", "A", "A", "B"], ["A", "B"], 3)
    assert (cut.recall, cut.precision, cut.full_recall) == (0.5, 1.0, 0.0) and scored(spark, ["A", "A", "A", "B"], ["A", "B"], 4).full_recall == 1.0
    assert scored(spark, ["N", "M", "A"], ["A", "B"], 5).mrr == pytest.approx(1 / 3)
    assert scored(spark, ["N", "A"], ["A"], 5).ndcg == pytest.approx((2 / math.log2(3)) / 2)
    none = scored(spark, ["N"], [], 5)
    assert (none.recall, none.full_recall, none.mrr, none.ndcg) == (1.0, 1.0, 0.0, 0.0)
    assert scored(spark, ["H", "A"], ["A"], 5, ["H"]).ndcg == pytest.approx((1 + 2 / math.log2(3)) / (2 + 1 / math.log2(3)))


def test_statistics(spark):
    values = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "key long, value double")
    b = statistics.bootstrap(values, "s", 200).first()
    assert b.low <= b["mean"] <= b.high and b["mean"] == pytest.approx(1.0)
    same = statistics.paired(values, values, "s", 50).first()
    assert (same["mean"], same.differs) == (0.0, "no")
    s = spark.createDataFrame([(True, 3.0), (True, 1.0), (False, 1.0), (False, 0.0)], "positive boolean, score double")
    assert statistics.auc(s).first().auc == pytest.approx(3.5 / 4)
    curve = statistics.abstention_curve(spark.createDataFrame([(True, 1.634), (False, 0.5)], "answerable boolean, score double")).orderBy("threshold").collect()
    assert [tuple(r) for r in curve] == [(0.5, 1, 0), (1.63, 1, 0)]
    assert statistics.upper_median(spark.createDataFrame([(1,), (2,), (None,), (3,), (10,), (3,)], "x int"), "x", "m").first().m == 3
    runs = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "config string, value double")
    assert tuple(statistics.spread(runs).first()) == (0.25, 0.75, 0.5)
    each = statistics.combined(spark.createDataFrame([(1, 2.0, 3.0)], "key int, relevance double, scope double"))
    assert {r.strategy: r.score for r in each.collect()} == {"relevance": 2.0, "scope": 3.0, "sum": 5.0, "min": 2.0}


def resolve(spark, text, section="Article 2", title="Some Regulation", others=("Article 3", "Article 4", "Article 13")):
    rows = [("D1", section, text, title)] + [("D1", s, "x", title) for s in others]
    out = references.resolved(spark.createDataFrame(rows, "doc_id string, section string, text string, doc_title string"))
    return sorted((r.target.split("::")[1] if r.target else None, r.outcome) for r in out.collect())


def test_references(spark):
    assert resolve(spark, "as directed in Article (3)") == [("Article 3", "intra")]
    assert resolve(spark, "Articles (3) to (4)") == [("Article 3", "intra"), ("Article 4", "intra")]
    assert resolve(spark, "Sub-Article (11) of Article (13)") == [("Article 13", "intra")]
    assert resolve(spark, "Article (3) and 4 years") == [("Article 3", "intra")]
    assert [o for _, o in resolve(spark, "Article (3) of the Central Bank Law")] == ["external"]
    assert [o for _, o in resolve(spark, "See Article (99).")] == ["unresolved"]
    assert [o for _, o in resolve(spark, "of this Article (3)")] == ["self"]
    assert [o for _, o in resolve(spark, "Article (3) of the Other Code")] == ["other_instrument"]
    assert [o for _, o in resolve(spark, "Article (3), then Article (3)")] == ["duplicate", "intra"]
    assert resolve(spark, "Article (10) of Chapter II", "Section 1, Article 2", others=("Section 2, Article 10", "Section 1, Article 10")) == [("Section 2, Article 10", "intra")]
    assert resolve(spark, "Article (10)", "Section 1, Article 2", others=("Section 2, Article 10", "Section 1, Article 10")) == [("Section 1, Article 10", "intra")]


def test_numbers_of_a_mention(spark):
    rows = [("D1", "Article 1", "Articles (2), (3) and (4); Articles (5) to (8), (7) & (30); Articles (9) to (60); Article 12.3 and 3 years; Articles (4) to (2)", "T")]
    found = references.mentions(spark.createDataFrame(rows, "doc_id string, section string, text string, doc_title string"))
    assert [r.number for r in found.orderBy("seq").collect()] == [2, 3, 4, 5, 6, 7, 8, 30, 9, 60, 12, 4, 2]


@pytest.mark.parametrize("text,kind,more", [
    ("Article (3) of Section 2", "plain", {"division": 2}), ("Article (3) of Chapter IV of this Regulation", "here", {"division": 4}), ("Article (3) of Part XIX", "plain", {"division": None}),
    ("Article (3) of the Financial Regulations", "alias", {"alias": "INS-FIN-001"}), ("Article (3) of the Standards", "named", {"role": "standards"}), ("Article (3) of the Regulation", "named", {"role": "regulation"}),
    ("Article (3) of these Rules", "other", {}), ("this Article (3)", "self", {}), ("Article (3) of this Article", "self", {}), ("Article (3) of Federal Law", "external", {}), ("Article (3) herein of this Law", "here", {}), ("Article (3)", "plain", {}),
])
def test_meanings_of_a_mention(spark, text, kind, more):
    r = references.mentions(spark.createDataFrame([("D", "S", text)], "doc_id string, section string, text string")).first()
    assert r.kind == kind and all(r[k] == v for k, v in more.items()), r


def test_audit_and_required_edges(spark):
    edges = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(9)], "source string, target string")
    got = references.audit(edges, 4, "s").collect()
    assert len(got) == 4 and got == references.audit(edges.repartition(3), 4, "s").collect() != references.audit(edges, 4, "t").collect()
    labels = spark.createDataFrame([("a1",), ("b2",), ("z",), ("a1",)], "evidence_id string")
    assert tuple(references.with_edges(labels, references.adjacency(edges)).first()) == (3, 2)


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_reach_is_that_of_every_walk(spark, monkeypatch, crowd):
    for name, size in (("CROWDED", crowd), ("NODES", 3), ("KEYS", 2)):
        monkeypatch.setattr(references, name, size)
    rng = random.Random(crowd)
    pairs = {(f"n{rng.randrange(40)}", f"n{rng.choice([0, 1, rng.randrange(40)])}") for _ in range(45)}
    near = {(a, b) for a, b in pairs | {(b, a) for a, b in pairs} if a != b}
    seeds = [(f"k{i}", f"n{i % 40}") for i in range(50)] + [("k1", "n7"), ("k1", "n7"), ("k2", "nowhere")]
    wanted = {}
    for key, node in seeds:
        at = {node}
        for hop in (1, 2, 3):
            at = {b for a, b in near if a in at}
            for n in at:
                wanted[key, n] = min(hop, wanted.get((key, n), hop))
    got = references.reachable(spark.createDataFrame(sorted(near), "node string, neighbour string"), spark.createDataFrame(seeds, "key string, node string"), 3).collect()
    assert len(got) == len(wanted) and {(r.key, r.node): r.hop for r in got} == wanted


def test_reach_over_a_crowded_node_is_not_written_row_by_row(spark, monkeypatch):
    leaves, rows, written = [f"leaf{i}" for i in range(100)], [], scratch.written

    def counted(df, label):
        out = written(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(scratch, "written", counted)
    near = [(a, "hub") for a in leaves] + [("hub", a) for a in leaves]
    out = references.reachable(spark.createDataFrame(near, "node string, neighbour string"), spark.createDataFrame([(a, a) for a in leaves], "key string, node string"), 3)
    assert out.count() == 100 * 101 and sum(rows) < 2000


def test_companions(spark):
    rows = [("R", "Article 1", "Article (2) of the Standards", "Risk Regulation for Insurers"), ("S", "Article 2", "Article (2) of the Standards, and Article (1) of the Regulation", "Risk Standards for Insurers")]
    out = references.resolved(spark.createDataFrame(rows, "doc_id string, section string, text string, doc_title string"))
    assert sorted((r.source, r.target, r.outcome) for r in out.collect()) == [("R::Article 1", "S::Article 2", "cross"), ("S::Article 2", "R::Article 1", "cross"), ("S::Article 2", "S::Article 2", "self")]


def test_obligation(spark):
    for passage, want in (("The insurer may not act", ["prohibitive"]), ("It shall report and may delay", ["mandatory", "permissive"]), ("It should act", ["advisory"]), ("Nothing", ["none"])):
        assert one(spark, obligation.forces(F.col("a")), a=passage) == want
    for claim, source, want in (("must act", "shall act", "preserved"), ("may act", "shall act", "weakened"), ("must act", "may act", "strengthened"), ("acts", "shall act", "no_force")):
        assert one(spark, obligation.drift(F.col("c"), F.col("s")), c=claim, s=source) == want
    pairs = spark.createDataFrame([("must act", "shall act"), ("may act", "shall act"), ("", "x")], "claim string, source string")
    assert obligation.fidelity(pairs).first().fidelity == 0.5 and obligation.fidelity(pairs.where("false")).first().fidelity == 1.0


def test_forces_with_and_without_the_stems(spark):
    def plain(p):
        rest = F.regexp_replace(p, lists.FORCES["prohibitive"], " ")
        found = F.array_compact(F.array(F.when(p.rlike(lists.FORCES["prohibitive"]), "prohibitive"), *(F.when(rest.rlike(lists.FORCES[f]), f) for f in lists.FORCE_ORDER[1:4])))
        return F.when(F.size(found) == 0, F.array(F.lit("none"))).otherwise(found)

    rng = random.Random(6)
    words = ["SHALL", "\u017fhall", "not", "must", "may", "mayor", "can", "cannot", "no", "one", "is", "\u0131s", "are", "requ\u0130red", "to", "permitted", "has", "have", "should", "best", "practice", "at", "its", "discretion", "ought", "allowed", "the", "prohibited", "as\u212a"]
    texts = [None, "", *(" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(1_500))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", obligation.forces(F.col("t")).alias("a"), plain(F.col("t")).alias("b"))
    assert not [r for r in rows.collect() if r.a != r.b]


def test_temporal(spark):
    known = spark.createDataFrame([("a", "2022-12-30"), ("b", "2026-09-14"), ("c", None), ("d", "2026-09-11")], "doc_id string, commenced string").withColumn("commenced", F.to_date("commenced"))
    rows = spark.createDataFrame([(1, d, r) for r, d in enumerate("abcdbz", 1)], "query_id long, doc_id string, rank int")
    got = temporal.exposure(rows, known, "2026-09-11").first()
    assert (got.premature, got.unknown, got.clean, got.first_premature_rank) == (2, 2, False, 2)
    for date, want in (("2026-09-01", "false"), ("2026-08-24", "true"), ("", "true"), ("soon", "true")):
        assert one(spark, temporal.labelling_eligible(F.col("a"), "2026-08-24"), a=date) == want


CLAIMS = {"It must act [1].": [("It must act", [1])], "[1] It must act": [("It must act", [1])], "A [1][2]. B [1, 3]": [("A", [1, 2]), (". B", [1, 3])], "no tags": [], "[7]": [("", [7])]}


def test_answers(spark):
    for answer, want in CLAIMS.items():
        assert answers.claims_of(answer) == want
    context = spark.createDataFrame([(1, "q", "D::1", "The board shall approve the strategy annually.", 1, 8.0), (1, "q", "D::2", "Capital is paid.", 2, 2.0)], "query_id long, query string, evidence_id string, text string, rank int, score double")
    questions = spark.createDataFrame([(1,), (2,)], "query_id long")
    decide = lambda t: {r.query_id: r.abstained for r in answers.decide(questions, context, t).collect()}
    assert decide(8.0) == {1: True, 2: True} and decide(7.9) == {1: False, 2: True} and decide(None) == {1: False, 2: True}
    tagged = spark.createDataFrame([(1, "The board shall approve the strategy [1]. Invented words entirely elsewhere [2] and [9]")], "query_id long, answer string")
    cites = answers.tagged(tagged, context)
    assert [(r.n, r.evidence_id) for r in cites.orderBy("n").collect()] == [(1, "D::1"), (2, "D::2")]
    flags = spark.createDataFrame([(1, False), (2, True)], "query_id long, abstained boolean")
    got = {r.query_id: tuple(r)[1:] for r in answers.validate(cites, context, flags).collect()}
    assert got == {1: (2, 1.0, 0.5, 0.0), 2: (0, 1.0, 1.0, 1.0)}
    assert answers.over_attributed(tagged).first().over is False
    best = answers.best_passage(F.col("p"), F.col("q"), 400, 1)
    assert one(spark, best, p="First thing. The board approves; Last.", q="which board") == "The board approves;"


def test_curation(spark):
    schema = "id string, minutes double, confidence string, category string, required_evidence array<struct<doc_id: string, section: string, why: string>>"
    e = [("d", "s", "")]
    rows = spark.createDataFrame([("a", 3.0, "high", "single_hop", e), ("b", 0.0, None, "unanswerable", e), ("c", 1.0, "low", "single_hop", [])], schema)
    got = {r.id: r.b for r in rows.select("id", curation.blocking_reasons().alias("b")).collect()}
    assert got["a"] == [] and len(got["b"]) == 3 and got["c"] == ["no evidence"]
    assert [(r.id, r.new_id) for r in curation.promote(rows, spark.createDataFrame([("Q007",)], "id string")).collect()] == [("a", "Q008")]
    sections = spark.createDataFrame([("d", s, i) for i, s in enumerate(["r", "s", "t"])], "doc_id string, section string, ord int")
    for seed in "123456":
        for r in curation.corrupt(rows, sections, seed).collect():
            assert r.how in ("add", "swap", "spurious") and (r.how == "spurious" or r.replacement in ("d::r", "d::t"))
    key = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", False)], "id string, corrupted boolean")
    verdicts = spark.createDataFrame([("a", "broken"), ("c", "sound"), ("d", "broken")], "id string, verdict string")
    assert tuple(curation.control_score(key, verdicts).first()) == (1, 1, 1, 1)


def test_planting_and_spurious_sections(spark):
    schema = "id string, minutes double, confidence string, category string, question string, required_evidence array<struct<doc_id: string, section: string, why: string>>"
    rows = spark.createDataFrame([(f"q{i}", 1.0, "high", "single_hop" if i % 3 else "unanswerable", "x", [("d1", "s2", "")] if i % 3 else []) for i in range(12)], schema)
    sections = spark.createDataFrame([(f"d{i}", f"s{j}", j) for i in range(50) for j in range(6)], "doc_id string, section string, ord int")
    planted = curation.plant(rows, sections, "s", 8).collect()
    assert len(planted) == 8 and sum(r.corrupted for r in planted) == 4 and sorted(r.place for r in planted) == list(range(1, 9))
    assert sorted(planted) == sorted(curation.plant(rows.repartition(3), sections.repartition(2), "s", 8).collect())
    with pytest.raises(ValueError):
        curation.plant(rows, sections, "s", 13)
    drawn = {r.spurious for r in curation.spurious_sections(rows.where("category = 'unanswerable'").select("id"), sections, "s").collect()}
    assert len(drawn) > 1 and drawn <= {f"d{i}::s{j}" for i in range(50) for j in range(6)}


def test_reviews(spark):
    schema = "id string, category string, question string, required_evidence array<struct<doc_id: string, section: string, why: string>>"
    items = spark.createDataFrame([("Q001", "single_hop", "a", [("d", "s1", "w")]), ("Q002", "cross_section", "b", [("d", "s1", ""), ("x", "s9", "")]), ("Q003", "unanswerable", "c", [])], schema)
    rows = spark.createDataFrame([("d", 1, "s1", "d::s1", "t1"), ("d", 2, "s2", "d::s2", "t2")], "doc_id string, ord int, section string, evidence_id string, text string")
    seen = {(r.id, r.n): (r.exists, r.text) for r in curation.review(items, rows).collect()}
    assert seen == {("Q001", 0): (True, "t1"), ("Q002", 0): (True, "t1"), ("Q002", 1): (False, "this section does not exist in the corpus")}
    marks = lambda group, *a: sorted((r.id, r.doc_id or "", r.section or "", r.cited) for r in curation.recheck(items, rows, group, *a).collect())
    assert marks("multiple") == [("Q002", "d", "s1", True), ("Q002", "d", "s2", False), ("Q002", "x", "", False)]
    assert marks("unanswerable") == [("Q003", "", "", False)] and marks("cites", "d::s1")[:2] == [("Q001", "d", "s1", True), ("Q001", "d", "s2", False)]
    asked = spark.createDataFrame([("q001",), (" Q002 ",), ("q9",)], "asked string")
    found = {r.asked: (r.id, r.origin) for r in curation.look_up(asked, items.where("id = 'Q001'"), items).collect()}
    assert found == {"q001": ("Q001", "draft"), " Q002 ": ("Q002", "question"), "q9": (None, None)}


def test_bounds_and_prompts(spark):
    for q, k in (("four", 5), ("x" * 501, 5), ("fine question", 0), ("fine question", 21)):
        with pytest.raises(ValueError):
            answers.check_bounds(q, k)
        assert one(spark, answers.within_bounds(F.col("q"), F.col("k")), q=q, k=k) is False
    answers.check_bounds("fine question", 20)
    assert one(spark, answers.within_bounds(F.col("q"), F.col("k")), q="fine question", k=20) is True
    ctx = spark.createDataFrame([(1, "why?", "b" * 800, 2), (1, "why?", "first", 1)], "query_id int, query string, text string, rank int")
    assert answers.prompts(ctx, "P {passages} Q {question}!").first().prompt == f"P [1] first\n\n[2] {'b' * 700} Q why?!"


def test_rewritten_retrieval_reranks_by_the_question(spark):
    chunks = spark.createDataFrame([(0, "alpha beta"), (1, "gamma delta alpha"), (2, "gamma gamma")], "idx long, text string")
    rewrites = spark.createDataFrame([(1, "alpha beta", "gamma gamma gamma")], "query_id long, query string, retrieval_query string")
    got = retrieval.rewritten(rewrites, lambda q, k: retrieval.bm25(chunks, q, k), chunks, retrieval.lexical_pair, 3, 3).orderBy("rank").collect()
    assert [r.idx for r in got] == [0, 1, 2] and got[0].score == 100.0
    assert tuple(retrieval.unchanged_rewrites(rewrites).first()) == (1, 0)


def test_a_generator_that_raises_leaves_the_question(spark):
    def generate(q):
        if "bad" in q:
            raise RuntimeError("no model")
        return f" about {q} "

    asked = spark.createDataFrame([(1, "good"), (2, "bad one")], "query_id long, query string")
    got = {r.query_id: r.retrieval_query for r in retrieval.generated_rewrite(asked, retrieval.guarded(generate)).collect()}
    assert got == {1: "good about good", 2: "bad one"}


def test_timed(spark):
    chunks = spark.createDataFrame(CORPUS, "idx long, text string")
    found, ms = retrieval.timed(lambda q, k: retrieval.bm25(chunks, q, k), spark.createDataFrame([(1, "risk")], "query_id long, query string"), 2)
    assert found.count() == 2 and ms > 0
    rows, told = retrieval.measured([("twice", lambda t: t.unionByName(t)), ("none", lambda t: t.where("idx < 0"))], chunks)
    assert [(t["stage"], t["rows"]) for t in told] == [("twice", 6), ("none", 0)] and all(t["ms"] > 0 for t in told) and rows.count() == 0


def test_document_before_the_section(spark):
    assert one(spark, T.doc_prefix(F.col("a")), a="INS-1::Article 2::x") == "INS-1" and one(spark, T.doc_prefix(F.col("a")), a="INS-1") == "INS-1"


def test_running_sums(spark):
    rows = [(i / 7, i % 3, 1) for i in range(200)]
    got = statistics.running(spark.createDataFrame(rows, "v double, a int, b int").repartition(5), "v", "a", "b").orderBy("v").collect()
    assert [(r.upto_a, r.upto_b) for r in got] == [(sum(x[1] for x in rows[: i + 1]), i + 1) for i in range(200)]
    assert statistics.running(spark.createDataFrame([], "v double, a int"), "v", "a").count() == 0
    none = statistics.auc(spark.createDataFrame([], "positive boolean, score double")).first()
    assert tuple(none) == (0, 0, None)


def test_encoder_slot(spark):
    chunks = spark.createDataFrame([(0, "aab"), (1, "bbb"), (2, None)], "idx long, text string")
    encode = lambda t: F.array(F.regexp_count(t, F.lit("a")), F.regexp_count(t, F.lit("b")))
    got = retrieval.dense(chunks, spark.createDataFrame([(1, "b")], "query_id long, query string"), encode, 2).orderBy("rank").collect()
    assert [(r.idx, round(r.score, 3)) for r in got] == [(1, 1.0), (0, 0.447)]


def nearest(v, x, k):
    return [r[0] for r in sorted(v, key=lambda r: (-sum(a * b for a, b in zip(x, r[1])), r[0]))[:k]]


@pytest.mark.parametrize("pack,group,product", [(blocked.PACK, blocked.GROUP, blocked.PRODUCT), (40, 120, 50)])
def test_vector_top_in_one_block_and_in_many(spark, monkeypatch, pack, group, product):
    monkeypatch.setattr(blocked, "PACK", pack)
    rng = random.Random(1)
    v = [(i, [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(300)]
    q = [(i, [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(25)]
    vectors = spark.createDataFrame([*v, (999, None)], "idx long, v array<float>").where("v is not null").repartition(5)
    queries = spark.createDataFrame(q, "query_id long, q array<float>").repartition(3)
    sides = blocked.packed(vectors, blocked.of_arrays("idx", "v"), pack), blocked.packed(queries, blocked.of_arrays("query_id", "q"), pack)
    got = {}
    for r in retrieval.rank_rows(blocked.best_products(*sides, 7, group, product), 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.idx
    assert {i: [g[k] for k in range(1, 8)] for i, g in got.items()} == {i: nearest(v, x, 7) for i, x in q}


def test_vector_top_without_rows_and_without_cross_join(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "idx long, v array<double>")
    q = spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], "query_id long, q array<double>")
    top = retrieval.vector_top(v, q, 3)
    assert [(r.query_id, r.idx, r.score, r["rank"]) for r in top.collect()] == [(7, 1, 3.0, 1)]
    plan = top._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Broadcast" not in plan
    assert retrieval.vector_top(v.limit(0), q, 3).count() == 0 and retrieval.vector_top(v, q.limit(0), 3).count() == 0


def test_hashed_dense_against_a_plain_version(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdef", k=rng.randint(0, 6))) for _ in range(80)]
    asked = {1: "a b c", 2: "f", 3: ""}

    def unit(t, dims=8):
        out = [0.0] * dims
        for w in t.split():
            out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims] += 1
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out

    chunks = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    got = retrieval.hashed_dense(chunks, spark.createDataFrame(list(asked.items()), "query_id long, query string"), 9, 8).orderBy("query_id", "rank").collect()
    want = []
    for q, text in asked.items():
        scored = [(round(sum(a * b for a, b in zip(unit(text), unit(t))), 9), -i) for i, t in enumerate(texts)]
        want += [(q, k, -i, s) for k, (s, i) in enumerate(sorted([x for x in scored if x[0] > 0], reverse=True)[:9], 1)]
    assert [(r.query_id, r["rank"], r.idx, round(r.score, 9)) for r in got] == want


def plain_draws(seed, n, r):
    return [int(hashlib.md5(f"{seed}:{r}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(1, n + 1)]


@pytest.mark.parametrize("piece", [statistics.DRAWS, 7])
def test_bootstraps_against_plain_versions(spark, monkeypatch, piece):
    monkeypatch.setattr(statistics, "DRAWS", piece)
    rng = random.Random(3)
    values = [(i, rng.random()) for i in range(40)]
    table = spark.createDataFrame(values, "key long, value double").repartition(4)
    means, _ = statistics.bootstrap_means(table, "s", 60)
    want = {r: sum(values[j][1] for j in plain_draws("s", 40, r)) / 40 for r in range(1, 61)}
    assert {r["round"]: pytest.approx(r["mean"]) for r in means.collect()} == want
    ends = sorted(want.values())
    got = statistics.bootstrap(table, "s", 60).first()
    assert (got.n, got.low, got.high) == (40, pytest.approx(ends[1]), pytest.approx(ends[57]))
    scores = [(i, i % 3 == 0, float(rng.randint(0, 4))) for i in range(30)]
    p, u = ([s for _, f, s in scores if f == flag] for flag in (True, False))
    aucs = statistics.bootstrap_aucs(spark.createDataFrame(scores, "key long, positive boolean, score double"), "s", 20)
    for r in aucs.collect():
        a, b = [p[j] for j in plain_draws("s:p", len(p), r["round"])], [u[j] for j in plain_draws("s:u", len(u), r["round"])]
        assert r.auc == pytest.approx(sum((x > y) + 0.5 * (x == y) for x in a for y in b) / (len(a) * len(b)))
    assert aucs.count() == 20
    none = statistics.bootstrap(table.where("false"), "s", 5).first()
    assert none.n is None and none.low is None
    assert statistics.bootstrap_aucs(spark.createDataFrame([(1, True, 1.0)], "key long, positive boolean, score double"), "s", 5).count() == 0


def test_rounds_of_a_bootstrap_are_dealt_over_tasks(spark):
    table = statistics.placed(spark.createDataFrame([(i, float(i)) for i in range(50)], "key long, value double"))
    each = statistics.drawn(table, "s", 1_000)
    sizes = each.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) <= 2 * 50_000 / 8


def test_promotion_numbers_over_ranges(spark):
    drafts = spark.createDataFrame([(f"d{i:03}", 1.0, "high", "single_hop", ["e"]) for i in range(200)], "id string, minutes double, confidence string, category string, required_evidence array<string>").repartition(6)
    out = curation.promote(drafts, spark.createDataFrame([("Q041",), ("X9",)], "id string"))
    assert {r.id: r.new_id for r in out.collect()} == {f"d{i:03}": f"Q{42 + i:03}" for i in range(200)}


def test_page_facts_and_carried_columns(spark):
    page = "<body class='x page-node-77 y'><main><h1>T</h1>\n<p>C 25/2022</p>\n<p>Effective from 3/12/2024</p>Status: In-Force<br></main><a href='/en/rulebook/banking'>b</a><a href='/f/conduct.pdf'>c</a><a href='/en_net_file_store/a_77.pdf'>p</a></body>"
    bare = "<html><p>Effective from 2024</p><a href='x.pdf'>x</a></html>"
    got = {r.doc_id: r for r in ingest.page_facts(spark.createDataFrame([("a", page), ("b", bare), ("c", None)], "doc_id string, html string"), base="https://h").collect()}
    assert tuple(got["a"])[1:] == ("77", "C 25/2022", "2024-12-03", "in_force", "banking", "https://h/en_net_file_store/a_77.pdf", [])
    assert got["b"].problems == ["the body names no node", "not a date: 2024", "no link to a section of the rulebook", "PDFs, but none of the file store"]
    rows = ingest.carry(spark.createDataFrame([("a", "s", "old"), ("z", "t", "old")], "doc_id string, section string, title string"), spark.createDataFrame([("a", "T", None)], "doc_id string, title string, url string"), ("title", "url"))
    assert sorted(map(tuple, rows.collect())) == [("a", "s", "T", ""), ("z", "t", "", "")]


def test_shared_parts_follow_their_input(spark, tmp_path):
    from sievewright.plans import parts

    for name in parts.TABLES:
        spark.range(3).write.parquet(f"{tmp_path}/{name}.parquet")
    made = []

    def make(s, d):
        made.append(d)
        return s.read.parquet(f"{d}/documents.parquet")

    assert [parts.part(spark, str(tmp_path), "p", make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert parts.part(spark, str(tmp_path), "p", make).count() == 5 and len(made) == 2


def test_vector_queries_meet_all_rows(spark, tmp_path):
    from sievewright.plans import catalogue

    rows = [(i, [float((i * 37) % 101), float((i * 53) % 89), 1.0], i % 3) for i in range(250)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in catalogue.queries()["vector_topk"](spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.idx))
    dot = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1]))
    best = {q: sorted((i for i in range(250) if i != q), key=lambda i: (-dot(q, i), i))[:10] for q in (0, 100, 200)}
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == best
    share = {r.query_id: r.share for r in catalogue.queries()["vector_label_recall"](spark, str(tmp_path)).collect()}
    assert share == {q: round(sum(i % 3 == q % 3 for i in x) / 10, 6) for q, x in best.items()}


def test_weighed_postings(spark, monkeypatch):
    """Common terms go to the postings, rarer ones are dealt: together they are a plain join, and asked terms score as over all weights."""
    monkeypatch.setattr(retrieval, "COMMON", 2)
    texts = ["a b c", "a a b", "a d", "", "e a b b"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    posted = retrieval.posted_with_lengths(chunks)
    stats = retrieval.statistics_of(posted, retrieval.corpus_size(posted))
    plain = posted.where("term is not null").join(stats, "term").select("idx", "term", (F.log1p("tf") * F.col("idf")).alias("weight"))
    got = retrieval.weighed(posted, stats)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    asked = spark.createDataFrame([(1, "a", 2.0), (1, "e", 1.0), (2, "c", 1.0), (2, "zz", 1.0)], "query_id long, term string, weight double")
    rows = lambda df: sorted((r.query_id, r.idx, round(r.score, 9), r["rank"]) for r in df.collect())
    assert rows(retrieval.sparse_of(posted, stats, asked, 3)) == rows(retrieval.sparse(plain, asked, 3))
    monkeypatch.setattr(retrieval, "COMMON", 1)
    # postings of the common term aren't dealt by term
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_content_tokens_look_stopwords_up(spark):
    """In order, each once; no search through the list of stopwords for every token."""
    rows = spark.createDataFrame([("The board SHALL the board report", ), ("a an of", ), (None, )], "a string").coalesce(1).select(T.content_tokens(F.col("a"), ("the", "shall")).alias("t"))
    assert [r.t for r in rows.collect()] == [["board", "report"], [], None]
    assert "array_contains" not in rows._jdf.queryExecution().analyzed().toString()


def test_windows_are_handed_on_by_few_millions_of_characters():
    """Large texts of one Arrow batch aren't cut all at once; what comes out is the same."""
    import pyarrow as pa

    from sievewright.operators import windows

    texts = [("word%d " % i) * 150_000 for i in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(list("abcd")), pa.array(texts)], names=["key", "text"])
    made = list(windows.cut_batches(["key"], [(1_000_000, 0)])(iter([batch])))
    assert len(made) == 2 and [k for m in made for k in m.column("key").to_pylist()] == list("abcd")
    assert [t for m in made for t in m.column("text").to_pylist()] == texts


def test_scores_as_products_are_a_plain_join_and_sum(spark, monkeypatch):
    """Several pieces, blocks of questions and cuts; the k best of each task are among the rows, with the sums of a join, zero weights too."""
    from sievewright.operators import scored

    monkeypatch.setattr(scored, "ROWS", 40)
    monkeypatch.setattr(scored, "CELLS", 30)
    monkeypatch.setattr(scored, "QUESTIONS", 2)
    monkeypatch.setattr(scored, "HELD", 10)
    rng = random.Random(5)
    for low in (1, -1):
        held = {(i, t): rng.choice((low, 0, 1, 2)) if low < 0 else rng.randint(1, 3) for i in range(60) for t in rng.sample("abcdefg", 3)}
        asked = {(q, t): float(rng.randint(1, 2)) for q in range(1, 6) for t in rng.sample("abcdefgz", 2)}
        weights = spark.createDataFrame([(i, t, float(w)) for (i, t), w in held.items()], "idx long, term string, weight double")
        questions = spark.createDataFrame([(q, t, w) for (q, t), w in asked.items()], "query_id long, term string, weight double")
        want = {}
        for (q, t), w in asked.items():
            for i in range(60):
                if (i, t) in held:
                    want[q, i] = want.get((q, i), 0.0) + w * held[i, t]
        best = {(q, i): r for q in range(1, 6) for r, (_, i) in enumerate(sorted((-s, i) for (p, i), s in want.items() if p == q)[:4], 1)}
        got = retrieval.sparse(weights, questions, 4).collect()
        assert {(r.query_id, r.idx): r["rank"] for r in got} == best
        assert all(r.score == want[r.query_id, r.idx] for r in got)


def test_scores_leave_a_task_as_its_best_only(spark):
    """No row for each pair of a question and a chunk is grouped: the sums are a product where the postings lie."""
    chunks = spark.createDataFrame([(i, f"a b{i % 3}") for i in range(30)], "idx long, text string")
    asked = spark.createDataFrame([(1, "a b1"), (2, "b2")], "query_id long, query string")
    posted = retrieval.posted_with_lengths(chunks, 4)
    plan = posted._jdf.queryExecution().executedPlan().toString()
    # the text is dealt, not its tokens
    assert plan.index("regexp_extract_all") < plan.index("Exchange")
    found = retrieval.hashed_dense(chunks, asked, 3, posted=posted)
    assert "MapInArrow" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "packed" not in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.hashed_dense(chunks, asked, 3).collect()))


def test_what_a_model_makes_of_a_text_stays_in_its_task(spark):
    def model(rows, key, column):
        return rows.select(key, F.posexplode(T.tokenize(F.col(column))).alias("position", "term")).select("*", F.lit(1.0).alias("logit"), F.lit(1).alias("mask"))

    chunks = spark.createDataFrame([(1, "a b c"), (2, "b c a")], "idx long, text string")
    _, weights = retrieval.learned_sparse(chunks, spark.createDataFrame([(7, "a x")], "query_id long, query string"), model, 5, partitions=4)
    assert weights._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_ways_without_a_negative_have_no_row(spark, tmp_path):
    """Where every passage stands in a document there is nothing to compare, and the SQL gives no row."""
    import duckdb

    from sievewright.plans import flows

    docs = [(i, "web", "en", 20, f"alpha w{i} beta gamma\nline two w{i}\nthree.") for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for passages, n in (([(1, "alpha w1 beta"), (2, "w3 beta gamma")], 0), ([(1, "alpha w1 beta"), (2, "nowhere w3 beta")], 4)):
        spark.createDataFrame(passages, "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        db = duckdb.connect()
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        want = sorted(db.execute(flows.all_sql()["scope_strategies"]).fetchall())
        assert len(want) == n and sorted(map(tuple, flows.scope_strategies(spark, str(tmp_path)).collect())) == want


def test_title_overlap_cuts_each_text_twice(spark, tmp_path):
    from sievewright.plans import catalogue

    rows = [(1, "One two.\nthree two"), (2, "same words. same words\nx"), (3, None), (4, ""), (5, "all gone\nand a b c d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["title_overlap"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2
    assert {r.doc_id: r.mode for r in got.collect()} == {1: "page", 2: "entire_section", 3: "page", 4: "page", 5: "entire_section"}


@pytest.mark.parametrize("name", ["chunk_sections", "chunk_overlap"])
def test_window_queries_read_white_space_as_their_sql(spark, tmp_path, name):
    import duckdb

    from sievewright.plans import catalogue

    long = ["w " * 50 + "x. " + "y " * 50 + "z;\t" + "v " * 90] * 2
    texts = [None, "", " ", "\n", "a b\n", "\ta b", "a\xa0b\x0bc d", "w " * 120 + "\n", "\xa0 " * 121, "\r\n\t\r\n".join(long), "\n\xa0\n".join(long), "\n\t\n".join(long), "\x1e ".join(long), ("w " * 130 + ".\r\n") * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue.queries()[name](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, rows)) == sorted(db.execute(catalogue.oracle_sql()[name]).fetchall())


def test_hops_hold_few_rows_of_a_pack_at_once(spark):
    """All rows that a packed row is exploded into are held before the first goes on."""
    assert references.NODES * references.KEYS <= 1 << 15
