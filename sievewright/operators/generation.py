"""Generators in the flow: prompts in Arrow batches, their answers and refusals, and contexts that are generated once.

A generator is a function from a list of prompts to a list of texts (None where it has none). It is called for a batch; where that
raises, for each prompt of the batch alone, so that one bad prompt costs no other its answer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lists, text
from ..sources import scratch
from . import answers

Generate = Callable[[list[str]], list[str | None]]

NOTHING = "The corpus holds no material that answers this question."
UNSURE = "The corpus doesn't seem to hold material that answers this question: nothing that was found is relevant enough."
#: Prompts that a generator gets at a time.
BATCH = 64


def _replies(generate: Generate, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(text, error) of each prompt."""
    try:
        found = generate(prompts)
        if len(found) != len(prompts):
            raise ValueError("a generator returns as many texts as it is given prompts")
        return [(t, None) for t in found]
    except Exception as e:  # whatever a model raises, the other prompts go on
        if len(prompts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [r for p in prompts for r in _replies(generate, [p])]


def generated(prompts: DataFrame, key: str, generate: Generate, batch: int = BATCH) -> DataFrame:
    """prompts (key, prompt) -> key, reply: a struct of answer, refusal and error, of which at most one isn't null."""
    kind = prompts.schema[key].dataType.simpleString()
    reply = pa.struct([("answer", pa.string()), ("refusal", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                out = []
                for found, error in _replies(generate, [p or "" for p in part.column("prompt").to_pylist()]):
                    refused = found is not None and found.lower().startswith(lists.REFUSAL)
                    out.append({"answer": None if refused else found, "refusal": found if refused else None, "error": error})
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(out, reply)], names=[key, "reply"])

    return prompts.select(key, "prompt").mapInArrow(run, f"{key} {kind}, reply struct<answer: string, refusal: string, error: string>")


def answer_questions(questions: DataFrame, context: DataFrame, generate: Generate, threshold: float | None, scores_comparable: bool = True, passages: int = 4, template: str = answers.PROMPT) -> DataFrame:
    """query_id, answer, abstained, reason, top_score.

    Questions that `answers.decide` declines never reach the generator. A generator may decline on its own account: its refusal stays the
    answer, and the reason says whose it is. One that raises or gives nothing abstains, too, with its error as the reason.
    """
    decided = scratch.written(answers.decide(questions, context, threshold, scores_comparable), "decided")
    open_ = decided.where("not abstained").select("query_id")
    asked = answers.prompts(context.where(F.col("rank") <= passages).join(open_, "query_id", "left_semi"), template)
    replies = generated(asked, "query_id", generate)
    rows = decided.join(replies, "query_id", "left")
    reply, none = F.col("reply"), F.col("reply.answer").isNull()
    said = F.when(F.col("abstained"), F.when(F.col("reason") == "nothing retrieved", NOTHING).otherwise(UNSURE)).otherwise(F.coalesce(reply["answer"], reply["refusal"], F.lit("")))
    why = (
        F.when(F.col("abstained"), F.col("reason")).when(reply["refusal"].isNotNull(), "the generator declined: the passages don't answer the question")
        .when(reply["error"].isNotNull(), F.concat(F.lit("the generator failed: "), reply["error"])).when(none, "the generator gave no answer").otherwise(F.col("reason"))
    )
    return rows.select("query_id", said.alias("answer"), (F.col("abstained") | none).alias("abstained"), why.alias("reason"), "top_score")


#: How a context is asked for; the section is cut, as its opening tells its subject.
CONTEXT_PROMPT = "Document: {title}\nSection: {section}\n\n{text}\n\nIn one short sentence, say what this section is about and whom it concerns, so that it can be told from the others of its document."
CONTEXT_CHARS = 600


def context_prompts(chunks: DataFrame, template: str = CONTEXT_PROMPT, most: int = CONTEXT_CHARS) -> DataFrame:
    """chunks (key, title, section, text) -> key, prompt."""
    made: list = []
    for n, part in enumerate(template.replace("{title}", "\0title\0").replace("{section}", "\0section\0").replace("{text}", "\0text\0").split("\0")):
        made.append(F.lit(part) if n % 2 == 0 else F.substring("text", 1, most) if part == "text" else F.coalesce(F.col(part), F.lit("")))
    return chunks.select("key", F.concat(*made).alias("prompt"))


def kept_contexts(chunks: DataFrame, cache: str) -> DataFrame:
    """key, context of the cache: whole batches only, each of which was written aside and moved into place."""
    spark = chunks.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in files.listStatus(path) if s.getPath().getName().startswith("batch-")] if files.exists(path) else []
    schema = "key string, context string"
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def contextualised(chunks: DataFrame, generate: Generate, cache: str) -> tuple[DataFrame, int]:
    """chunks (key, title, section, text) -> key, context for all their keys, and how many were generated for that.

    Keys that the cache (a folder that all executors see) has aren't generated again, and equal keys only once. New contexts are a batch
    of their own: a lost task is run again, a lost driver leaves the cache as it was. A prompt that raised isn't kept, so that it is asked
    again; one whose answer is empty is. If two writers make the same key, the least context counts.
    """
    spark = chunks.sparkSession
    keys = chunks.groupBy("key").agg(*(F.min(c).alias(c) for c in ("title", "section", "text")))
    missing = keys.join(kept_contexts(chunks, cache).select("key"), "key", "left_anti")
    made = generated(context_prompts(missing), "key", generate).where("reply.error is null")
    said = F.coalesce(text.clean_context(F.coalesce("reply.answer", "reply.refusal")), F.lit(""))
    aside, name = f"{cache}/_new-{uuid.uuid4().hex}", f"batch-{uuid.uuid4().hex}"
    made.select("key", said.alias("context")).write.parquet(aside)
    new = spark.read.parquet(aside).count()
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(cache).getFileSystem(spark._jsc.hadoopConfiguration())
    if new:
        files.rename(path(aside), path(f"{cache}/{name}"))
    else:
        files.delete(path(aside), True)
    contexts = kept_contexts(chunks, cache).groupBy("key").agg(F.min("context").alias("context"))
    return contexts.join(keys.select("key"), "key", "left_semi"), new
