"""Substring search for many queries at once, through an index of three-character grams.

A text is listed under every gram that it holds, lower-cased; the gram at its last places is shorter. What holds a term holds all of
its grams, so of a query's grams the few that stand in the fewest texts are met with the index, texts that have all of these are
candidates, and only candidates are looked at. A term of one or two characters has no gram of its own: where a query has nothing
else, the grams that begin with it take its place.

Nothing holds an empty term or a null text. Queries and texts come out as often as they came in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a gram, and the grams of a query that are met with the index.
GRAM, MET = 3, 4


def folded(value: Column) -> Column:
    """Lower case, character by character: the form of the final sigma would depend on its place."""
    return F.translate(F.lower(value), "ς", "σ")


def _grams(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({t[i : i + GRAM] for i in range(len(t))}) for t in batch.column("folded").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.list_(pa.string()))], names=[key, "grams"])

    return run


def gram_index(rows: DataFrame, key: str, column: str = "text") -> DataFrame:
    """gram, key: under which grams a text is listed."""
    texts = rows.where(F.col(column).isNotNull()).select(key, folded(F.col(column)).alias("folded"))
    lists = texts.mapInArrow(_grams(key), f"{key} {rows.schema[key].dataType.simpleString()}, grams array<string>")
    return lists.select(F.explode("grams").alias("gram"), key)


def gram_counts(index: DataFrame) -> DataFrame:
    """gram, n: how many texts a gram stands in."""
    return index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def _grams_of(term: Column) -> Column:
    places = F.when(F.length(term) >= GRAM, F.sequence(F.lit(1), F.length(term) - (GRAM - 1)))
    return F.coalesce(F.transform(places, lambda i: F.substring(term, i, F.lit(GRAM))), F.array().cast("array<string>"))


def candidates(index: DataFrame, counts: DataFrame, terms: DataFrame, by: str, key: str) -> DataFrame:
    """terms (by, term) -> by, key: texts that may hold all terms of a query `by`; none is missing."""
    each = terms.select(by, folded(F.col("term")).alias("term")).where("term <> ''").distinct()
    grams = each.select(by, F.explode(_grams_of(F.col("term"))).alias("gram")).distinct()
    # a gram that the index doesn't have is the rarest of all
    sized = grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = sized.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("n", "gram"))).where(F.col("r") <= MET)
    asked = rarest.groupBy(by).agg(F.count(F.lit(1)).alias("asked"))
    met = rarest.select(by, "gram").join(index, "gram").groupBy(by, key).agg(F.count(F.lit(1)).alias("met"))
    full = met.join(asked, by).where("met = asked").select(by, key)
    # queries of short terms only, by their longest
    short = each.join(asked.select(by), by, "left_anti").groupBy(by).agg(F.max_by("term", F.length("term")).alias("term"))
    heads = F.explode(F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda n: F.substring("gram", F.lit(1), n))).alias("term")
    begins = counts.select("gram", heads).distinct().join(short, "term")
    return full.unionByName(begins.select(by, "gram").join(index, "gram").select(by, key).distinct())


def find_all(rows: DataFrame, index: DataFrame, counts: DataFrame, queries: DataFrame, key: str = "evidence_id", least: int = 3) -> DataFrame:
    """rows (key, ord, text), queries (query_id, query) -> query_id, ord, key, hits, snippet: rows that hold every term of a query.

    Terms are runs of a-z and 0-9 of `least` characters or more; hits count them all. Queries without such a term find nothing.
    """
    wanted = F.filter(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= least)
    asked = queries.select("query_id", wanted.alias("terms")).where(F.size("terms") > 0)
    near = candidates(index, counts, asked.select("query_id", F.explode("terms").alias("term")), "query_id", key)
    met = near.join(asked, "query_id").join(rows.select(key, "ord", F.lower("text").alias("low")), key)
    holds = F.forall("terms", lambda t: F.col("low").contains(t))
    count = lambda t: ((F.length("low") - F.length(F.replace(F.col("low"), t, F.lit("")))) / F.length(t)).cast("long")
    hits = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + count(t))
    first = F.get("terms", 0)  # of letters and digits only, so it is a pattern as it stands
    snippet = F.trim(F.regexp_substr(F.col("low"), F.concat(F.lit(".{0,90}"), first, F.lit(".{0,110}"))))
    return met.where(holds).select("query_id", "ord", key, hits.alias("hits"), snippet.alias("snippet"))


#: Queries that are sent to every task, which then reads its texts once for all of them.
SCANNED = 100_000
#: Classes of bytes: 1 to 36 for a-z and 0-9, 0 for all others; the class of three bytes is below CLASSES ** 3, which fits two bytes.
CLASSES = 37
_CLASS = np.zeros(256, np.uint16)
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = np.arange(1, CLASSES)


def _code(a, b, c):
    return (a * CLASSES + b) * CLASSES + c


def _places(data: np.ndarray, starts: np.ndarray, terms: list[bytes]):
    """Terms of a-z and 0-9 (three or more) with the texts that hold them and how often, without overlaps; texts lie in data between starts."""
    padded = np.concatenate([data, np.zeros(max(map(len, terms)), np.uint8)])
    kind = _CLASS[padded]
    code = _code(kind[:-2], kind[1:-1], kind[2:])
    heads: dict[int, list[bytes]] = {}
    for t in terms:
        heads.setdefault(int(_code(*map(int, _CLASS[np.frombuffer(t[:3], np.uint8)]))), []).append(t)
    wanted = np.zeros(CLASSES**3, bool)
    wanted[list(heads)] = True
    at = np.flatnonzero(wanted[code])
    at = at[np.argsort(code[at], kind="stable")]
    met = code[at]
    for head, some in heads.items():
        a, b = np.searchsorted(met, (head, head + 1))
        for t in some:
            p = at[a:b]
            for i in range(GRAM, len(t)):
                p = p[padded[p + i] == t[i]]
            if not len(p):
                continue
            row = np.searchsorted(starts, p, "right") - 1
            row = row[p + len(t) <= starts[row + 1]]
            rows, n = np.unique(row, return_counts=True)
            if any(t.startswith(t[i:]) for i in range(1, len(t))):  # it may overlap itself
                n = np.array([data[starts[r] : starts[r + 1]].tobytes().count(t) for r in rows], np.int64)
            if len(rows):
                yield t, rows, n


def _scanned(queries: list[tuple[int, list[bytes]]], key: str):
    terms = sorted({t for _, every in queries for t in every})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column("low").cast(pa.large_binary())
            _, offsets, data = low.buffers()
            starts = np.frombuffer(offsets, np.int64)[low.offset : low.offset + len(low) + 1]
            if not len(low) or starts[-1] == starts[0]:
                continue
            held = {t: (rows, n) for t, rows, n in _places(np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0], terms)}
            out: list[list] = [[], [], []]
            for query_id, every in queries:
                if not all(t in held for t in every):
                    continue
                rows = held[every[0]][0]
                for t in every[1:]:
                    rows = np.intersect1d(rows, held[t][0], assume_unique=True)
                if len(rows):
                    hits = sum(held[t][1][np.searchsorted(held[t][0], rows)] for t in every)
                    for c, v in zip(out, (np.full(len(rows), query_id), rows, hits)):
                        c.append(v)
            if out[0]:
                ids, rows, hits = (np.concatenate(c) for c in out)
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("ord").take(taken), batch.column(key).take(taken), pa.array(hits)], names=["query_id", "ord", key, "hits"])

    return run


def scan_all(rows: DataFrame, queries: DataFrame, key: str = "evidence_id") -> DataFrame | None:
    """As find_all with terms of three characters or more, without index and snippets: every text is read once, for all queries. None for more than SCANNED queries.

    Terms are met by their first three bytes; texts don't leave their task, and nothing is shuffled.
    """
    wanted = F.filter(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= GRAM)
    told = queries.select(F.col("query_id").cast("long"), wanted.alias("terms")).where(F.size("terms") > 0).limit(SCANNED + 1).collect()
    if len(told) > SCANNED:
        return None
    kinds = f"query_id long, ord {rows.schema['ord'].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, hits long"
    texts = rows.where("text is not null").select(key, "ord", F.lower("text").alias("low"))
    if not told:
        return rows.sparkSession.createDataFrame([], kinds)
    return texts.mapInArrow(_scanned([(r[0], [t.encode() for t in r[1]]) for r in told], key), kinds)
