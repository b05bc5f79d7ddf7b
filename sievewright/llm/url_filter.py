"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled table of URLs (a parameter, of at most MOST_LABELLED rows), by
full-batch gradient descent from zero, so it is the same each time. N-grams of the host and of the path are hashed apart,
into SLOTS slots by md5, which any SQL engine has. Scoring is DataFrame functions only.

LABELLED names hosts by the categories of web filters and directories, in the same forms for both classes, and none of them shares a part
with a host of the tables that the queries run on; so the default knows little of those, and whoever has labels gives a table.

A null url, or one without `://`, has an empty host and path, meets no rule and is judged on no n-gram (the bias). A score of
exactly 0 blocks. Urls of any length are judged as a whole, each n-gram once. Each row is judged alone: repeated rows come out repeated, an empty table gives an empty one, and of the table's columns only
page_id and url are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, SIZES = 2_048, (3, 4)
EPOCHS, RATE, DECAY = 300, 0.5, 1e-3

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: Category names as web filters and directories use them, to block and to allow. No part of a host of the tables stands among them.
CATEGORIES = {
    True: (
        "aggressive", "alcohol", "costtraps", "cryptojacking", "dating", "drugs", "fortunetelling", "gambling", "hacking", "lingerie", "malware", "phishing",
        "piracy", "porn", "redirector", "ringtones", "spyware", "stalkerware", "tobacco", "violence", "warez", "weapons",
    ),
    False: (
        "automobile", "banking", "biology", "business", "celebrity", "chat", "clothing", "computers", "cooking", "education", "family", "finance", "fitness", "football",
        "forum", "games", "government", "hardware", "health", "hobby", "homestyle", "hospitals", "humor", "internet", "investing", "jobsearch", "kids", "library", "maps",
        "media", "medicine", "military", "movies", "museum", "music", "newspapers", "outdoors", "physics", "podcasts", "politics", "psychology", "radio", "recreation",
        "reference", "religion", "science", "shopping", "society", "software", "sports", "television", "travel", "weather", "webmail",
    ),
}
#: Labelled URLs that the model is trained from by default: true for those to block. Both classes have the same forms.
LABELLED = tuple(
    (form.format(name), block)
    for block, names in CATEGORIES.items()
    for name in names
    for form in ("https://www.{}.com/", "http://{}-online.net/index.html", "https://my{}.info/2024/05/item?id=7")
)
#: Rows of a labelled table at most.
MOST_LABELLED = 10_000


def labelled_rows(table: DataFrame) -> tuple[tuple[str | None, bool], ...]:
    """A table (url, block boolean) as rows for the training, in an order of their own; too many are an error."""
    rows = table.select("url", "block").limit(MOST_LABELLED + 1).collect()
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"the labelled table holds more than {MOST_LABELLED} rows")
    return tuple(sorted(((r.url, bool(r.block)) for r in rows), key=lambda r: (r[0] or "", r[1])))


def parse(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, on the driver."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    return host.translate({c: c + 32 for c in range(65, 91)}), rest[:end]


def slots(host: str, path: str) -> set[int]:
    out = set()
    for mark, text in (("h", f"^{host}$" if host else ""), ("p", f"{path}$" if path else "")):
        for n in SIZES:
            for i in range(len(text) - n + 1):
                out.add(int(hashlib.md5(f"{mark}{text[i : i + n]}".encode()).hexdigest()[:8], 16) % SLOTS)
    return out


def train(labelled=LABELLED) -> tuple[float, list[float]]:
    """Bias and weights."""
    rows = [(sorted(slots(*parse(u))), 1.0 if y else 0.0) for u, y in labelled]
    bias, weights = 0.0, [0.0] * SLOTS
    for _ in range(EPOCHS):
        gradient, of_bias = [DECAY * w for w in weights], 0.0
        for idx, y in rows:
            z = bias + sum(weights[i] for i in idx) / math.sqrt(len(idx) or 1)
            d = (1 / (1 + math.exp(-z)) - y) / len(rows)
            of_bias += d
            for i in idx:
                gradient[i] += d / math.sqrt(len(idx))
        bias -= RATE * of_bias
        weights = [w - 20 * RATE * g for w, g in zip(weights, gradient)]
    return round(bias, 9), [round(w, 9) for w in weights]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _slots(mark: str, text: Column, size: int) -> Column:
    gram = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(mark), text.substr(i, F.lit(size)))), 1, 8), 16, 10).cast("long") % SLOTS
    last = F.char_length(text) - (size - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), gram)).otherwise(F.array().cast("array<bigint>"))


def score(host: Column, path: Column, model: tuple[float, list[float]]) -> Column:
    """Log-odds of blocking."""
    bias, weights = model
    table = F.expr(f"array({', '.join(f'{w!r}D' for w in weights)})")
    framed = ((("h", F.when(host == "", "").otherwise(F.concat(F.lit("^"), host, F.lit("$"))))), ("p", F.when(path == "", "").otherwise(F.concat(path, F.lit("$")))))
    idx = F.array_distinct(F.concat(*(_slots(mark, text, n) for mark, text in framed for n in SIZES)))
    found = F.transform(F.array(idx), lambda x: F.aggregate(x, F.lit(0.0), lambda a, i: a + F.get(table, i.cast("int"))) / F.sqrt(F.greatest(F.size(x), F.lit(1)).cast("double")))
    return F.lit(bias) + F.element_at(found, 1)


def by_length(rules=RULES) -> list[tuple[str, str, str]]:
    """Longest first."""
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, score (log-odds of blocking by the method).

    labelled is a table (url, block) or its rows.
    """
    labelled = labelled_rows(labelled) if isinstance(labelled, DataFrame) else labelled
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(by_length(rules)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    out = out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), score(host, path, train(labelled)).alias("score"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0, "block").otherwise("allow")).alias("verdict"), "score")


def judge_sql(rules=RULES, labelled=LABELLED) -> str:
    """The query in DuckDB SQL: page_id, host, path, rule, verdict."""
    bias, weights = train(labelled)
    grams = " UNION ".join(
        f"SELECT page_id, (('0x' || substr(md5('{mark}' || substr({text}, i, {n})), 1, 8))::BIGINT) % {SLOTS} AS slot FROM (SELECT page_id, {text}, unnest(range(1, greatest(length({text}) - {n} + 2, 1))) AS i FROM framed)"
        for mark, text in (("h", "fh"), ("p", "fp")) for n in SIZES
    )
    rule = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for h, p, _ in by_length(rules))
    ruled = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}'" for h, p, v in by_length(rules))
    return f"""
    WITH parsed AS (
      SELECT page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
      FROM pages),
    framed AS (SELECT page_id, CASE WHEN host = '' THEN '' ELSE '^' || host || '$' END AS fh, CASE WHEN path = '' THEN '' ELSE path || '$' END AS fp FROM parsed),
    slots AS ({grams}),
    scored AS (SELECT page_id, sum(([{', '.join(map(repr, weights))}])[slot + 1]) / sqrt(count(*)) AS z FROM slots GROUP BY page_id)
    SELECT page_id, host, path, CASE {rule} END AS rule,
      coalesce(CASE {ruled} END, CASE WHEN {bias!r} + coalesce(z, 0) >= 0 THEN 'block' ELSE 'allow' END) AS verdict
    FROM parsed LEFT JOIN scored USING (page_id)"""
