"""Text scalars as column functions. Only NFKC, which Spark lacks, runs in an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lists


def tokenize(text: Column) -> Column:
    """All runs of a-z and 0-9 of the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(text: Column, stopwords=lists.ANSWER_STOPWORDS) -> Column:
    """The set of tokens of over two characters that aren't stopwords."""
    stop = F.array(*map(F.lit, stopwords))
    # a set difference looks each token up, where a search in the list would pass by all stopwords
    return F.array_except(F.filter(tokenize(text), lambda t: F.length(t) > 2), stop)


def overlap_share(wanted: Column, found: Column) -> Column:
    """Share of wanted that found has; 0 if wanted is empty."""
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, found)) / F.size(wanted))


def word_count(text: Column, plain: bool = False) -> Column:
    """Words parted by Unicode white space; with `plain` by the white space of SQL's regular expressions, which has no vertical tab either."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[^\t\n\f\r ]+" if plain else r"(?U)\S+"), F.lit(0)))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean(text: Column) -> Column:
    """NFKC, plain quotes, blanks collapsed, at most one empty line, ends trimmed."""
    t = F.translate(nfkc(text), "’‘“”", "''\"\"")
    t = F.regexp_replace(t, "[ \t ]+", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return strip(t)


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def section_label(heading: Column) -> Column:
    """The identifier that a heading is cited by; headings without one stay as they are."""
    def got(pattern: str, group: int) -> Column:
        return F.regexp_extract(heading, "(?i)" + pattern, group)

    number = F.regexp_replace(got(lists.ARTICLE, 1), "^0+(?=.)", "")
    forms = (
        (lists.ARTICLE, F.concat(F.lit("Article "), number)),
        (lists.LETTERED, F.concat_ws(" ", F.initcap(got(lists.LETTERED, 1)), got(lists.LETTERED, 2))),
        (lists.DIVISION, F.concat_ws(" ", F.initcap(got(lists.DIVISION, 1)), F.initcap(got(lists.DIVISION, 2)))),
        (lists.DOTTED, got(lists.DOTTED, 1)),
        (lists.FLAT, got(lists.FLAT, 1)),
    )
    return F.coalesce(*(F.when(heading.rlike("(?i)" + pattern), label) for pattern, label in forms), heading)


def is_container(heading: Column) -> Column:
    return heading.rlike("(?i)" + lists.CONTAINER)


def indexable_text(text: Column, title: Column, heading: Column, doc_title: Column | None = None) -> Column:
    """Non-empty parts by line; the document's title is left out where it equals the section's title or heading."""
    blank = lambda c: F.nullif(c, F.lit(""))
    parts = [blank(title), blank(heading), blank(text)]
    if doc_title is not None:
        same = (doc_title == F.coalesce(title, F.lit(""))) | (doc_title == F.coalesce(heading, F.lit("")))
        parts.insert(0, F.when(~same, blank(doc_title)))
    return F.concat_ws("\n", *parts)


def paragraphs(text: Column) -> Column:
    """Split on blank lines, or on lines where that gives one part; stripped, without empty ones."""
    kept = lambda parts: F.filter(F.transform(parts, strip), lambda p: p != "")
    blocks = kept(F.split(text, r"(?U)\n\s*\n"))
    return F.when(F.size(blocks) > 1, blocks).otherwise(kept(F.split(text, "\n")))


def clause_sentences(text: Column) -> Column:
    """Split after . ; : where white space follows."""
    return F.split(text, r"(?U)(?<=[.;:])\s+")


def answer_sentences(text: Column) -> Column:
    """Split after . ; where white space follows, and at new lines; stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.;])\s+|\n+"), strip), lambda s: s != "")


def normalise_date(raw: Column) -> Column:
    """D/M/YYYY as YYYY-MM-DD without a check of the range, else empty."""
    pattern = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    part = lambda i: F.regexp_extract(strip(raw), pattern, i)
    iso = F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))
    return F.when(strip(raw).rlike(pattern), iso).otherwise("")


def normalise_status(raw: Column) -> Column:
    low = F.lower(strip(raw))
    out = F.replace(low, F.lit(" "), F.lit("_"))
    for known, value in lists.STATUSES.items():
        out = F.when(low == known, value).otherwise(out)
    return out


def instructions(model: Column) -> Column:
    """struct(query, passage): the prefixes of the first model name that fits, else empty."""
    pair = lambda q, p: F.struct(F.lit(q).alias("query"), F.lit(p).alias("passage"))
    out = pair("", "")
    for prefix, query, passage in reversed(lists.INSTRUCTIONS):
        out = F.when(model.startswith(prefix), pair(query, passage)).otherwise(out)
    return out


def clean_context(text: Column, whole: bool = False) -> Column:
    """One sentence of generated context: no preamble, no quotes, at most 400 characters; with `whole` a sentence of 400 keeps its stop, the 401st."""
    t = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    t = F.regexp_replace(t, "(?i)" + lists.PREAMBLE, "")
    for quote in ('"', "'"):
        t = F.regexp_replace(strip(t), f"^{quote}+|{quote}+$", "")
    t = strip(t)
    first = F.regexp_extract(t, lists.FIRST_SENTENCE, 1)
    cut = strip(F.substring(t, 1, 400))
    return F.when(first != "", first if whole else strip(F.substring(first, 1, 400))).otherwise(cut)


def clean_passage(text: Column) -> Column:
    """Generated passage: white space collapsed and stripped."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def fingerprint(*parts: Column, size: int = 64) -> Column:
    """sha-256 over the parts with a zero byte between, first `size` hex digits."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, size)


def excerpt(quote: Column, most: int = 320) -> Column:
    return F.regexp_replace(F.substring(quote, 1, most), r"(?U)\s+\z", "")


def doc_prefix(evidence_id: Column) -> Column:
    return F.substring_index(evidence_id, "::", 1)


def citable(flag: Column) -> Column:
    """Only the word false, trimmed, makes a section not citable."""
    return ~F.coalesce(strip(flag) == "false", F.lit(False))
