"""Cited answers: the best passage of a section, extractive answers with abstention, tagged answers, and their checks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists, text


def best_passage(passage: Column, question: Column, most: int = 400, sentences: int = 3) -> Column:
    """The sentences that share most content tokens with the question, in the order of the text, cut at `most` characters."""
    wanted = text.content_tokens(question)
    scored = F.transform(text.answer_sentences(passage), lambda s, i: F.struct((-F.size(F.array_intersect(text.content_tokens(s), wanted))).alias("o"), i.alias("i"), s.alias("s")))
    kept = F.transform(F.slice(F.array_sort(scored), 1, sentences), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))
    joined = F.array_join(F.transform(F.array_sort(kept), lambda x: x["s"]), " ")
    cut = F.regexp_replace(F.substring(joined, 1, most), r"(?U)\s+\z", "")
    return F.when(F.size(text.answer_sentences(passage)) == 0, F.substring(passage, 1, most)).otherwise(cut)


def extractive(context: DataFrame, citations: int = 3, most: int = 400) -> DataFrame:
    """context (query_id, query, evidence_id, text, rank) -> query_id, n, evidence_id, quote: the first chunk of each of the first sections."""
    first = context.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "evidence_id").orderBy("rank"))).where("r = 1")
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("n") <= citations)
    return first.select("query_id", "n", "evidence_id", best_passage(F.col("text"), F.col("query"), most).alias("quote"))


def decide(questions: DataFrame, context: DataFrame, threshold: float | None, scores_comparable: bool = True) -> DataFrame:
    """query_id, abstained, reason, top_score. At or below the threshold a question is declined; None never declines.

    Where scores can't be compared between questions the threshold is ignored, and the reason says so.
    """
    top = context.groupBy("query_id").agg(F.min_by("score", "rank").alias("top_score"))
    rows = questions.select("query_id").join(top, "query_id", "left")
    if threshold is None or not scores_comparable:
        low = F.lit(False)
        otherwise = F.lit("") if scores_comparable or threshold is None else F.lit("threshold ignored: scores are not comparable")
    else:
        low, otherwise = F.coalesce(F.col("top_score") <= threshold, F.lit(False)), F.lit("")
    none = F.col("top_score").isNull()
    said = F.when(none, "nothing retrieved").when(low, F.format_string("top relevance %.3f at or below threshold %.3f", F.col("top_score"), F.lit(threshold or 0.0))).otherwise(otherwise)
    return rows.select("query_id", (none | low).alias("abstained"), said.alias("reason"), "top_score")


def validate(citations: DataFrame, context: DataFrame, questions: DataFrame, min_overlap: int = 4, ratio: float = 0.0, source: str = "last") -> DataFrame:
    """query_id, citations, grounded, supported, abstained for questions (query_id, abstained).

    A citation is grounded if its section is in the context, and supported if its quote stands in that section's
    text or shares enough content tokens with it. Of several chunks of a section the last is looked at, or any.
    """
    available = context.select("query_id", "evidence_id", "text", "rank")
    if source == "last":
        available = available.groupBy("query_id", "evidence_id").agg(F.max_by("text", "rank").alias("text"))
    quoted, held = text.content_tokens(F.col("quote")), text.content_tokens(F.col("text"))
    needed = F.greatest(F.least(F.lit(min_overlap), F.size(quoted)), F.bround(F.lit(ratio) * F.size(quoted)).cast("int"))
    quote = text.strip(F.col("quote"))
    verbatim = (quote != "") & F.col("text").contains(quote)
    supported = F.col("text").isNotNull() & (F.size(quoted) > 0) & (verbatim | (F.size(F.array_intersect(quoted, held)) >= needed))
    checked = citations.join(available, ["query_id", "evidence_id"], "left").groupBy("query_id", "n").agg(F.max(F.col("text").isNotNull()).alias("g"), F.max(F.coalesce(supported, F.lit(False))).alias("s"))
    per = checked.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.count_if("g").alias("g"), F.count_if("s").alias("s"))
    rows = questions.select("query_id", "abstained").join(per, "query_id", "left")
    share = lambda x: F.when(F.col("abstained"), 1.0).when(F.col("c").isNull(), 0.0).otherwise(F.col(x) / F.col("c"))
    n = F.when(F.col("abstained"), 0).otherwise(F.coalesce("c", F.lit(0)))
    return rows.select("query_id", n.cast("long").alias("citations"), share("g").alias("grounded"), share("s").alias("supported"), F.col("abstained").cast("double").alias("abstained"))


_NUMBERS = r"\d+(?:\s*[,;]\s*\d+)*"
_CLUSTER = re.compile(rf"\[{_NUMBERS}\](?:\s*\[{_NUMBERS}\])*")


def claims_of(answer: str) -> list[tuple[str, list[int]]]:
    """(claim, numbers) of each run of citation tags: the text before it, or the text after it where nothing is before."""
    runs = [(m.start(), m.end()) for m in _CLUSTER.finditer(answer)]
    edges = [0, *(e for _, e in runs)]
    out = []
    for i, (start, end) in enumerate(runs):
        after = runs[i + 1][0] if i + 1 < len(runs) else len(answer)
        claim = answer[edges[i] : start].strip() or answer[end:after].strip()
        out.append((claim, list(dict.fromkeys(map(int, re.findall(r"\d+", answer[start:end]))))))
    return out


def claims(answers: DataFrame) -> DataFrame:
    """answers (query_id, answer) -> query_id, n, claim, numbers."""

    def run(frames):
        for pdf in frames:
            rows = [(q, n, c, x) for q, a in zip(pdf["query_id"], pdf["answer"]) for n, (c, x) in enumerate(claims_of(a or ""))]
            yield pd.DataFrame(rows, columns=["query_id", "n", "claim", "numbers"])

    return answers.select("query_id", "answer").mapInPandas(run, "query_id long, n int, claim string, numbers array<int>")


def tagged(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Citations of tagged answers: query_id, n, evidence_id, quote (the claim). Refusals have none.

    Numbers that name no passage are dropped; a section is cited once, by its first claim; empty claims are dropped.
    """
    told = answers.where(~F.lower("answer").startswith(lists.REFUSAL))
    each = claims(told).where("claim <> ''").select("query_id", "n", "claim", F.posexplode("numbers").alias("at", "rank"))
    met = each.join(context.select("query_id", "rank", "evidence_id"), ["query_id", "rank"])
    first = met.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "evidence_id").orderBy("n", "at"))).where("r = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("n", "at"))
    return first.select("query_id", place.alias("n"), "evidence_id", F.col("claim").alias("quote"))


#: How a generator is asked; the passages are numbered, and the numbers are what answers cite.
PROMPT = "Answer from the numbered passages only, and put the numbers of the passages used behind each sentence, as in [1] or [2][3]. If they don't answer the question, reply: Not covered by these passages.\n\n{passages}\n\nQuestion: {question}"


def prompts(context: DataFrame, template: str = PROMPT, most: int = 700) -> DataFrame:
    """context (query_id, query, text, rank) -> query_id, prompt: the passages by rank, numbered and cut."""
    passage = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.regexp_replace(F.substring("text", 1, most), r"(?U)\s+\z", ""))
    packed = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", passage.alias("passage")))).alias("p"), F.first("query").alias("query"))
    before, rest = template.split("{passages}")
    between, after = rest.split("{question}")
    joined = F.array_join(F.transform("p", lambda x: x["passage"]), "\n\n")
    return packed.select("query_id", F.concat(F.lit(before), joined, F.lit(between), F.col("query"), F.lit(after)).alias("prompt"))


def claim_sources(citations: DataFrame, context: DataFrame) -> DataFrame:
    """query_id, evidence_id, claim, source: each cited claim that isn't blank with the text it cites; of several chunks of a section the last."""
    texts = context.groupBy("query_id", "evidence_id").agg(F.max_by("text", "rank").alias("source"))
    named = citations.where(text.strip(F.col("quote")) != "").select("query_id", "evidence_id", F.col("quote").alias("claim"))
    return named.join(texts, ["query_id", "evidence_id"])


def citation_means(checked: DataFrame, over: DataFrame) -> DataFrame:
    """answers, n, grounded, supported: means over cited answers, all of them and apart by whether they over-attribute.

    checked (query_id, citations, grounded, supported), over (query_id, over).
    """
    cited = checked.where("citations > 0").join(over, "query_id")
    kinds = F.explode(F.array(F.lit("all"), F.when(F.col("over"), "over_attributed").otherwise("one_source")))
    return cited.select("grounded", "supported", kinds.alias("answers")).groupBy("answers").agg(F.count(F.lit(1)).alias("n"), F.avg("grounded").alias("grounded"), F.avg("supported").alias("supported"))


def within_bounds(question: Column, k: Column, characters=(5, 500), results=(1, 20)) -> Column:
    """Whether a request may be asked: the length of its question and the number of results."""
    return F.coalesce(F.char_length(question).between(*characters) & k.between(*results), F.lit(False))


def check_bounds(question: str, k: int, characters=(5, 500), results=(1, 20)) -> None:
    """The same for one request, as an error."""
    if not characters[0] <= len(question) <= characters[1]:
        raise ValueError(f"a question has {characters[0]} to {characters[1]} characters")
    if not results[0] <= k <= results[1]:
        raise ValueError(f"k is {results[0]} to {results[1]}")


def over_attributed(answers: DataFrame) -> DataFrame:
    """query_id, over: any claim with more than one number."""
    return answers.select("query_id").join(claims(answers).groupBy("query_id").agg(F.max(F.size("numbers") > 1).alias("o")), "query_id", "left").select("query_id", F.coalesce("o", F.lit(False)).alias("over"))
