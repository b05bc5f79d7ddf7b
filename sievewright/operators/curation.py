"""Keeping labels sound: validation, promotion of drafts, controls with planted errors, coverage, registry upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists, text
from .statistics import running, upper_median

#: How a question may have come about.
SOURCES = ["hand_written", "derived_from_document_structure", "llm_drafted_human_verified"]


def _rule(items: DataFrame, when: Column, kind: str, message: Column | str) -> DataFrame:
    return items.where(F.coalesce(when, F.lit(False))).select("id", F.lit(kind).alias("level"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def evidence_rows(items: DataFrame) -> DataFrame:
    """id, doc_id, section, scored: required evidence is scored, helpful evidence isn't."""
    each = lambda c, scored: items.select("id", F.explode(c).alias("e")).select("id", "e.doc_id", "e.section", F.lit(scored).alias("scored"))
    return each("required_evidence", True).unionByName(each("helpful_evidence", False))


def validate(items: DataFrame, registry: DataFrame, corpus: DataFrame | None) -> DataFrame:
    """id, level (error or warning), message. Without a corpus (None) its check is left out.

    items (id, question, category, difficulty, required_evidence, helpful_evidence, source, minutes);
    registry (doc_id, labelling_eligible); corpus (evidence_id).
    """
    n = F.coalesce(F.size("required_evidence"), F.lit(0))
    docs = F.size(F.array_distinct(F.transform("required_evidence", lambda e: e["doc_id"])))
    out = [
        items.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0").select("id", F.lit("error").alias("level"), F.lit("duplicate id").alias("message")),
        *(_rule(items, F.col(c).isNull(), "error", f"missing required field {c}") for c in ("question", "category", "difficulty", "required_evidence")),
        _rule(items, ~F.col("category").isin(*lists.CATEGORIES, "temporal"), "error", "unknown category"),
        _rule(items, ~F.col("difficulty").isin(lists.DIFFICULTIES), "error", "unknown difficulty"),
        _rule(items, ~F.col("source").isin(SOURCES), "error", "unknown source"),
        _rule(items, (F.col("category") == "unanswerable") & (n > 0), "error", "unanswerable with evidence"),
        _rule(items, ~F.col("category").eqNullSafe("unanswerable") & (n == 0), "error", "no evidence"),
        _rule(items, F.col("category").isin("cross_section", "cross_document") & (n < 2), "warning", "fewer than two sections"),
        _rule(items, (F.col("category") == "cross_document") & (docs < 2), "warning", "one document only"),
        _rule(items, F.col("minutes") > 20, "warning", "took over 20 minutes"),
    ]
    evidence = evidence_rows(items)
    out.append(evidence.join(registry.select("doc_id"), "doc_id", "left_anti").select("id", F.lit("error").alias("level"), F.lit("document not in the registry").alias("message")))
    out.append(_rule(evidence, F.coalesce("section", F.lit("")) == "", "error", "evidence without a section"))
    named = evidence.where("section <> ''")
    barred = registry.where(~text.citable(F.col("labelling_eligible"))).select("doc_id")
    out.append(named.where("scored").join(barred, "doc_id", "left_semi").select("id", F.lit("error").alias("level"), F.lit("document not eligible").alias("message")))
    if corpus is not None:
        key = named.withColumn("evidence_id", F.concat_ws("::", "doc_id", "section"))
        out.append(key.join(corpus.select("evidence_id"), "evidence_id", "left_anti").select("id", F.lit("error").alias("level"), F.lit("section not in the corpus").alias("message")))
    every = out[0]
    for rows in out[1:]:
        every = every.unionByName(rows)
    return every


def blocking_reasons() -> Column:
    """Why a draft (minutes, confidence, category, required_evidence) can't be promoted yet; empty if it can."""
    n = F.coalesce(F.size("required_evidence"), F.lit(0))
    none = F.col("category").eqNullSafe("unanswerable")
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.col("minutes") > 0, F.lit(False)), "not verified by a human"),
        F.when(~F.coalesce(F.col("confidence").isin(lists.CONFIDENCES), F.lit(False)), "confidence is unset"),
        F.when(none & (n > 0), "unanswerable with evidence"),
        F.when(~none & (n == 0), "no evidence"),
    ))


def promote(drafts: DataFrame, questions: DataFrame) -> DataFrame:
    """Drafts without blocking reasons, with the next ids Q### in the order of the drafts' own ids."""
    last = questions.agg(F.coalesce(F.max(F.regexp_extract("id", r"^Q(\d+)$", 1).try_cast("int")), F.lit(0)).alias("last"))
    ready = drafts.where(F.size(blocking_reasons()) == 0).withColumn("ready", F.lit(1))
    numbered = running(ready, "id", "ready").crossJoin(F.broadcast(last))  # one row
    return numbered.withColumn("new_id", F.format_string("Q%03d", F.col("last") + F.col("upto_ready"))).drop("ready", "upto_ready", "last")


def neighbours(rows: DataFrame) -> DataFrame:
    """rows (doc_id, section, ord) with previous and next section."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    return rows.select("doc_id", "section", F.lag("section").over(w).alias("previous"), F.lead("section").over(w).alias("next"))


def _number(text_: Column, n: Column) -> Column:
    """A number from 0 to n - 1 from the md5 of a text: the same in any engine."""
    return F.pmod(F.conv(F.substring(F.md5(text_), 1, 8), 16, 10).cast("long"), n)


#: Sections in a bucket that a drawn section is looked for in, about.
BUCKET = 64


def spurious_sections(questions: DataFrame, rows: DataFrame, seed: str) -> DataFrame:
    """questions (id) -> id, spurious: a section of the corpus, drawn for each by hashes of the seed, the id and the section.

    Sections are dealt into buckets, a question draws a bucket, and in it the section of the least hash. An empty bucket
    gives the first section of the corpus.
    """
    every = rows.select(F.concat_ws("::", "doc_id", "section").alias("evidence_id"))
    buckets = every.agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count(F.lit(1)) / BUCKET)).alias("buckets"), F.min("evidence_id").alias("first"))
    dealt = every.crossJoin(F.broadcast(buckets)).select("evidence_id", _number(F.col("evidence_id"), F.col("buckets")).alias("bucket"))
    asked = questions.crossJoin(F.broadcast(buckets)).select("id", "first", _number(F.concat_ws(":", F.lit(seed), "id", F.lit("bucket")), F.col("buckets")).alias("bucket"))
    mark = F.md5(F.concat_ws(":", F.lit(seed), "id", "evidence_id"))
    drawn = asked.join(dealt, "bucket", "left").groupBy("id").agg(F.min_by("evidence_id", F.struct(mark, "evidence_id")).alias("drawn"), F.first("first").alias("first"))
    return drawn.select("id", F.coalesce("drawn", "first").alias("spurious"))


def plant(items: DataFrame, rows: DataFrame, seed: str, size: int) -> DataFrame:
    """id, place, corrupted, how, evidence_id, replacement: a blind sample of `size` questions in an order that tells nothing.

    The sample is the questions of the least hash. Of these the first half that can be broken are, the others stay sound.
    Raises ValueError where there are fewer questions than `size`.
    """
    mark = lambda tag: F.md5(F.concat_ws(":", F.lit(seed), F.lit(tag), "id"))
    sample = items.orderBy(mark("sample"), "id").limit(size)
    if sample.count() < size:
        raise ValueError(f"fewer than {size} questions")
    # a sample is small by its nature, so its order may be one window
    broken = corrupt(sample, rows, seed).join(sample.select("id", mark("sample").alias("m")), "id")
    broken = broken.withColumn("n", F.row_number().over(Window.orderBy("m", "id"))).where(F.col("n") <= size // 2).select("id", "how", "evidence_id", "replacement")
    out = sample.select("id").join(broken, "id", "left").withColumn("place", F.row_number().over(Window.orderBy(mark("shuffle"), "id")))
    return out.select("id", "place", F.col("how").isNotNull().alias("corrupted"), F.coalesce("how", F.lit("")).alias("how"), "evidence_id", "replacement")


def review(items: DataFrame, rows: DataFrame) -> DataFrame:
    """id, n, doc_id, section, why, exists, text: the required evidence of each question with what stands there; rows (evidence_id, text)."""
    each = items.select("id", F.posexplode("required_evidence").alias("n", "e")).select("id", "n", "e.doc_id", "e.section", "e.why", F.concat_ws("::", "e.doc_id", "e.section").alias("evidence_id"))
    found = each.join(rows.select("evidence_id", "text").withColumn("exists", F.lit(True)), "evidence_id", "left")
    return found.select("id", "n", "doc_id", "section", "why", F.coalesce("exists", F.lit(False)).alias("exists"), F.coalesce("text", F.lit("this section does not exist in the corpus")).alias("text"))


def recheck(items: DataFrame, rows: DataFrame, group: str, evidence: str | None = None) -> DataFrame:
    """id, doc_id, ord, section, cited: every section of each document that a question of the group cites, cited ones marked.

    group is unanswerable, multiple (two required sections or more) or cites (those that cite the section `evidence`).
    Questions that cite nothing come with one row of nulls.
    """
    key = F.transform("required_evidence", lambda e: F.concat_ws("::", e["doc_id"], e["section"]))
    wanted = {"unanswerable": F.col("category") == "unanswerable", "multiple": F.size("required_evidence") >= 2, "cites": F.array_contains(key, F.lit(evidence))}[group]
    chosen = items.where(wanted).select("id", key.alias("keys"), F.array_distinct(F.transform("required_evidence", lambda e: e["doc_id"])).alias("docs"))
    docs = chosen.select("id", "keys", F.explode_outer("docs").alias("doc_id"))
    marked = docs.join(rows.select("doc_id", "ord", "section"), "doc_id", "left")
    return marked.select("id", "doc_id", "ord", "section", F.coalesce(F.array_contains("keys", F.concat_ws("::", "doc_id", "section")), F.lit(False)).alias("cited"))


def look_up(asked: DataFrame, drafts: DataFrame, questions: DataFrame) -> DataFrame:
    """asked (asked) -> asked, id, origin, question: the item of that id in any case, among the drafts first, then the questions."""
    every = drafts.select("id", "question", F.lit(0).alias("p")).unionByName(questions.select("id", "question", F.lit(1).alias("p")))
    best = every.groupBy(F.lower("id").alias("key")).agg(F.min(F.struct("p", "id", "question")).alias("b"))
    found = asked.withColumn("key", F.lower(F.trim("asked"))).join(best, "key", "left")
    return found.select("asked", F.col("b.id").alias("id"), F.when(F.col("b.p") == 0, "draft").when(F.col("b.p") == 1, "question").alias("origin"), F.col("b.question").alias("question"))


def counters(findings: DataFrame, items: DataFrame) -> DataFrame:
    """One row: items, errors, warnings, median_minutes (the upper one) of a validation; findings (level), items (minutes)."""
    found = findings.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return items.agg(F.count(F.lit(1)).alias("items")).crossJoin(found).crossJoin(upper_median(items, "minutes", "median_minutes"))


def corrupt(items: DataFrame, rows: DataFrame, seed: str) -> DataFrame:
    """id, how, evidence_id, replacement: one way to break each question's labels, drawn by a hash of seed and id.

    drop takes a required section away (of two or more), add puts in the neighbour of one, swap replaces one by its
    neighbour. Questions without evidence get a section of the corpus (spurious). Those that can't be broken are left out.
    """
    draw = lambda tag, n: _number(F.concat_ws(":", F.lit(seed), "id", F.lit(tag)), n)
    n = F.size("required_evidence")
    ways = F.when(n >= 2, F.array(*map(F.lit, ("drop", "add", "swap")))).when(n == 1, F.array(F.lit("add"), F.lit("swap"))).otherwise(F.array(F.lit("spurious")))
    picked = items.select("id", "required_evidence", F.get(ways, draw("how", F.size(ways)).cast("int")).alias("how"), F.when(n > 0, F.get("required_evidence", draw("which", F.greatest(n, F.lit(1))).cast("int"))).alias("e"))
    near = neighbours(rows)
    used = F.transform(F.filter("required_evidence", lambda x: x["doc_id"] == F.col("e.doc_id")), lambda x: x["section"])
    joined = picked.join(near, (F.col("e.doc_id") == near.doc_id) & (F.col("e.section") == near.section), "left")
    options = F.filter(F.array_compact(F.array("previous", "next")), lambda o: ~F.array_contains(used, o))
    joined = joined.withColumn("options", options)
    choice = F.when(F.col("how").isin("add", "swap"), F.get("options", draw("option", F.greatest(F.size("options"), F.lit(1))).cast("int")))
    out = joined.withColumn("choice", choice).select("id", "how", "e", "choice").join(spurious_sections(items.where(F.size("required_evidence") <= 0).select("id"), rows, seed), "id", "left")
    out = out.where(~F.col("how").isin("add", "swap") | F.col("choice").isNotNull())
    evidence = F.when(F.col("how") != "spurious", F.concat_ws("::", "e.doc_id", "e.section"))
    replacement = F.when(F.col("how") == "spurious", F.col("spurious")).when(F.col("choice").isNotNull(), F.concat_ws("::", "e.doc_id", "choice"))
    return out.select("id", "how", evidence.alias("evidence_id"), replacement.alias("replacement"))


def control_score(key: DataFrame, verdicts: DataFrame) -> DataFrame:
    """key (id, corrupted), verdicts (id, verdict) -> caught, missed, false_alarm, correct_pass; no verdict is not a catch."""
    v = key.join(verdicts, "id", "left").select("corrupted", F.coalesce("verdict", F.lit("")).alias("v"))
    broken, sound = F.col("corrupted"), ~F.col("corrupted")
    return v.agg(F.count_if(broken & (F.col("v") == "broken")).alias("caught"), F.count_if(broken & (F.col("v") != "broken")).alias("missed"), F.count_if(sound & (F.col("v") != "sound")).alias("false_alarm"), F.count_if(sound & (F.col("v") == "sound")).alias("correct_pass"))


def coverage(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """evidence_id, questions (ids, sorted) for every section of the corpus; n is 0 for those outstanding."""
    used = labels.groupBy("evidence_id").agg(F.array_sort(F.collect_set("query_id")).alias("ids"))
    return rows.select("evidence_id").distinct().join(used, "evidence_id", "left").select("evidence_id", F.array_join(F.transform(F.coalesce("ids", F.array().cast("array<bigint>")), lambda x: x.cast("string")), ",").alias("questions"), F.coalesce(F.size("ids"), F.lit(0)).alias("n"))


def mix_gap(have: DataFrame, target: DataFrame) -> DataFrame:
    """category, have, target, gap."""
    return target.join(have, "category", "left").select("category", F.coalesce("have", F.lit(0)).alias("have"), "target", (F.col("target") - F.coalesce("have", F.lit(0))).alias("gap"))


def fill(old: DataFrame, new: DataFrame, key: str, columns: list[str], force: bool = False) -> DataFrame:
    """old with blank values (all, if forced) taken from new where new has one."""
    joined = old.join(new.select(key, *(F.col(c).alias(f"new_{c}") for c in columns)), key, "left")
    for c in columns:
        fresh, kept = F.nullif(F.trim(f"new_{c}"), F.lit("")), F.nullif(F.trim(c), F.lit(""))
        joined = joined.withColumn(c, F.coalesce(fresh, kept, F.lit("")) if force else F.coalesce(kept, fresh, F.lit(""))).drop(f"new_{c}")
    return joined


def fetch_mode(title: Column, heading: Column, least: float = 0.8) -> Column:
    """entire_section where the page's heading has most of the title's words, else page."""
    return mode_of(text.overlap_share(F.array_distinct(text.tokenize(title)), F.array_distinct(text.tokenize(heading))), least)


def mode_of(share: Column, least: float = 0.8) -> Column:
    """The mode by the share of the title's words that the heading has."""
    return F.when(share >= least, "entire_section").otherwise("page")


def failure_counts(causes: DataFrame, questions: DataFrame) -> DataFrame:
    """cause, category, n: how often each cause is met in each category; category `all` is the sum. questions (query_id, category)."""
    joined = causes.join(questions.select("query_id", "category"), "query_id")
    each = F.explode(F.array(F.col("category"), F.lit("all")))
    return joined.select("cause", each.alias("category")).groupBy("cause", "category").agg(F.count(F.lit(1)).alias("n"))


def failures(missed: DataFrame, found: DataFrame, questions: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, evidence_id, cause for each missed required section.

    matched_twin: a found section of the same label in another document of the same group; same_label: of another group;
    same_document; lexical_gap: under a tenth of the question's words are in the missed text; else no_signal.
    rows (evidence_id, doc_id, section, group, text).
    """
    info = rows.select("evidence_id", "doc_id", "section", "group", "text")
    m = missed.join(info, "evidence_id").join(questions.select("query_id", "query"), "query_id")
    f = found.select("query_id", "evidence_id").join(info.drop("text"), "evidence_id").select("query_id", F.col("doc_id").alias("fd"), F.col("section").alias("fs"), F.col("group").alias("fg")).distinct()
    twins = m.select("query_id", "evidence_id", "doc_id", "section", "group").join(f, (m.query_id == f.query_id) & (F.col("section") == F.col("fs")) & (F.col("doc_id") != F.col("fd"))).groupBy(m.query_id, "evidence_id").agg(F.max(F.col("group") == F.col("fg")).alias("matched"))
    same = m.select("query_id", "evidence_id", "doc_id").join(f.select("query_id", F.col("fd").alias("doc_id")).distinct(), ["query_id", "doc_id"], "left_semi").select("query_id", "evidence_id", F.lit(True).alias("same"))
    j = m.join(twins, ["query_id", "evidence_id"], "left").join(same, ["query_id", "evidence_id"], "left")
    share = text.overlap_share(text.content_tokens(F.col("query"), lists.FAILURE_STOPWORDS), text.content_tokens(F.col("text"), lists.FAILURE_STOPWORDS))
    cause = F.when(F.col("matched"), "matched_twin").when(F.col("matched").isNotNull(), "same_label").when(F.col("same"), "same_document").when(share < 0.10, "lexical_gap").otherwise("no_signal")
    return j.select("query_id", "evidence_id", cause.alias("cause"))
