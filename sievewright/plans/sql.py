"""DuckDB SQL for the registered queries, written on its own and not derived from their plans."""

from __future__ import annotations

from ..functions import lists

TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def tok(x: str) -> str:
    return TOK.format(x)


def content(x: str, words=lists.ANSWER_STOPWORDS) -> str:
    return f"list_distinct(list_filter({tok(x)}, lambda t: length(t) > 2 AND NOT list_contains({_list(words)}, t)))"


def share(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"


USELESS = sorted({*lists.FEEDBACK_STOPWORDS, *lists.FEEDBACK_NOISE})


def ranked(scored: str, k: int, ties: str = "idx") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {ties}) AS rank FROM ({scored})) WHERE rank <= {k}"


BM25 = """
  SELECT query_id, idx, sum(q.n * w.weight) AS score FROM qterms q JOIN bm25w w USING (term) GROUP BY ALL"""


def padded(k: int) -> str:
    """Unmatched chunks in corpus order behind the matched ones."""
    return f"""
  SELECT query_id, idx, coalesce(s.score, 0.0) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s.score, 0.0), 9) DESC, idx) AS rank
  FROM questions CROSS JOIN (SELECT idx FROM chunks) LEFT JOIN bm25s s USING (query_id, idx)
  WHERE len({tok('query')}) > 0 QUALIFY rank <= {k}"""


BASE = f"""WITH RECURSIVE
secs AS (SELECT doc_id::VARCHAR AS doc_id, n AS ord, 'P' || n AS section, doc_id || '::P' || n AS evidence_id, p[n] AS text, source FROM
  (SELECT doc_id, source, p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents))),
chunks AS (SELECT doc_id AS idx, md5(text) AS evidence_id, text, source FROM documents),
questions AS (SELECT item_id AS query_id, text AS query FROM benchmark),
posted AS (SELECT idx, term, count(*) AS tf FROM (SELECT idx, unnest({tok('text')}) AS term FROM chunks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
raws AS (SELECT term, df, ln((SELECT count(*) FROM chunks) - df + 0.5) - ln(df + 0.5) AS raw FROM dfs),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws),
lens AS (SELECT idx, len({tok('text')}) AS dl FROM chunks),
bm25w AS (SELECT idx, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM lens))) AS weight FROM posted JOIN stats USING (term) JOIN lens USING (idx)),
qterms AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest({tok('query')}) AS term FROM questions) GROUP BY ALL),
bm25s AS ({BM25}),
lex AS MATERIALIZED ({padded(100)}),
lex10 AS (SELECT * FROM lex WHERE rank <= 10),
hv AS (SELECT idx, (('0x' || substr(md5(term), 1, 8))::BIGINT) % 256 AS dim, sum(tf)::DOUBLE AS n FROM posted GROUP BY ALL),
hvn AS (SELECT idx, dim, n / sqrt(sum(n * n) OVER (PARTITION BY idx)) AS weight FROM hv),
hq AS (SELECT query_id, (('0x' || substr(md5(term), 1, 8))::BIGINT) % 256 AS dim, sum(n)::DOUBLE AS n FROM qterms GROUP BY ALL),
hqn AS (SELECT query_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS weight FROM hq),
dense AS MATERIALIZED ({ranked("SELECT query_id, idx, sum(a.weight * b.weight) AS score FROM hqn a JOIN hvn b USING (dim) GROUP BY query_id, idx", 100)}),
dense10 AS (SELECT * FROM dense WHERE rank <= 10),
fusedall AS (SELECT query_id, idx, sum(1.0 / (60 + rank)) AS score, min(rank) AS best_rank FROM (SELECT query_id, idx, rank FROM lex UNION ALL SELECT query_id, idx, rank FROM dense) GROUP BY ALL),
fused50 AS MATERIALIZED ({ranked("SELECT * FROM fusedall", 50, "best_rank, idx")}),
fused AS (SELECT query_id, idx, score, rank FROM fused50 WHERE rank <= 10),
rerankall AS (SELECT query_id, idx, f.rank AS pool_rank, list_distinct({tok('query')}) AS qt, list_distinct({tok('c.text')}) AS ct FROM fused50 f JOIN questions USING (query_id) JOIN chunks c USING (idx)),
rerank AS ({ranked(f"SELECT query_id, idx, pool_rank, 100.0 * {share('qt', 'ct')} AS score FROM rerankall", 10, "pool_rank")}),
inside AS MATERIALIZED (SELECT query_id, idx FROM questions, chunks WHERE contains(text, query)),
labelled AS (SELECT query_id, evidence_id, max(gain) AS gain FROM (
  SELECT query_id, evidence_id, 2 AS gain FROM inside JOIN chunks USING (idx) UNION ALL
  SELECT query_id, evidence_id, 1 FROM inside i JOIN chunks c ON c.idx = i.idx + 1) GROUP BY ALL),
cats AS (SELECT query_id, query, CASE WHEN count(idx) = 0 THEN 'unanswerable' WHEN count(idx) = 1 THEN 'single_hop' ELSE 'cross_document' END AS category FROM questions LEFT JOIN inside USING (query_id) GROUP BY ALL),
refs AS (SELECT doc_id, CASE doc_id WHEN '4' THEN 'INS-FIN-001' WHEN '5' THEN 'INS-FIN-002' WHEN '13' THEN 'INS-TAK-013' ELSE doc_id END AS name, 'Article ' || ord AS section, ord, (doc_id::BIGINT + ord) % 7 + 1 AS a, (doc_id::BIGINT + ord * 3) % 9 AS form, text FROM secs),
docedges AS (SELECT DISTINCT c.evidence_id AS source, d.evidence_id AS target FROM chunks c JOIN chunks d ON d.idx = c.idx + 1 WHERE c.evidence_id <> d.evidence_id),
docnear AS (SELECT source AS node, target AS neighbour FROM docedges UNION SELECT target, source FROM docedges),
"""


def scores(name: str, found: str) -> str:
    """A CTE `name` of the metrics of the ranked table `found` at 1, 3, 5 and 10."""
    return f"""
{name}_r AS (SELECT f.query_id, c.evidence_id, f.rank FROM {found} f JOIN chunks c USING (idx)),
{name}_t AS (SELECT query_id, k, evidence_id, min(rank) AS rank FROM {name}_r, (SELECT unnest([1, 3, 5, 10]) AS k) WHERE rank <= k GROUP BY ALL),
{name}_p AS (SELECT t.*, row_number() OVER (PARTITION BY query_id, k ORDER BY rank) AS place, coalesce(gain, 0) AS gain FROM {name}_t t LEFT JOIN labelled USING (query_id, evidence_id)),
{name}_g AS (SELECT query_id, k, count(*) AS n, count_if(gain = 2) AS hits, sum(gain / log2(place + 1)) AS dcg, min(CASE WHEN gain = 2 THEN place END) AS first FROM {name}_p GROUP BY ALL),
{name}_l AS (SELECT query_id, count_if(gain = 2) AS required, list_sort(list(gain), 'DESC') AS gains FROM labelled GROUP BY query_id),
{name}_x AS (SELECT q.query_id, kk.k, coalesce(required, 0) AS required, coalesce(hits, 0) AS hits, coalesce(n, 0) AS n, coalesce(dcg, 0.0) AS dcg,
    coalesce(list_sum(list_transform(gains[1:kk.k], lambda g, i: g / log2(i + 1))), 0.0) AS ideal
  FROM questions q CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k) kk LEFT JOIN {name}_l USING (query_id) LEFT JOIN {name}_g g ON g.query_id = q.query_id AND g.k = kk.k),
{name}_m AS (SELECT query_id, 1.0 / first AS mrr FROM {name}_g WHERE k = 10),
{name} AS (SELECT query_id, k,
    CASE WHEN required = 0 THEN 1.0 ELSE hits::DOUBLE / required END AS recall, CASE WHEN n = 0 THEN 0.0 ELSE hits::DOUBLE / n END AS precision,
    CASE WHEN required = 0 OR hits = required THEN 1.0 ELSE 0.0 END AS full_recall, CASE WHEN ideal = 0 THEN 0.0 ELSE dcg / ideal END AS ndcg, coalesce(mrr, 0.0) AS mrr
  FROM {name}_x LEFT JOIN {name}_m USING (query_id)),"""


M = ("recall", "precision", "full_recall", "ndcg", "mrr")
MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in M)


#: Rounds of a bootstrap.
ROUNDS = 10_000


def draw(seed: str, n: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || r || ':' || i), 1, 8))::BIGINT) % {n}"


def boot(values: str, seed: str, rounds: int = ROUNDS) -> str:
    """Interval of the mean of `values` (key, value)."""
    return f"""
vs AS ({values}),
vv AS (SELECT list(value ORDER BY key) AS v, count(*) AS n FROM vs),
rr AS (SELECT unnest(range(1, {rounds} + 1)) AS r),
ms AS (SELECT r, list_sum(list_transform(range(1, n + 1), lambda i: v[({draw(seed, 'n')}) + 1])) / n AS mean FROM vv, rr),
bs AS (SELECT list_sort(list(mean)) AS s FROM ms)
SELECT n, round(list_sum(v) / n, 6) AS mean, round(s[{int(0.025 * rounds) + 1}], 6) AS low, round(s[{int(0.975 * rounds)}], 6) AS high"""


SCORECARD = f"""SELECT category, k, n, {', '.join(M)} FROM (
  SELECT category, k, count(*) AS n, {MEANS} FROM s JOIN cats USING (query_id) GROUP BY ALL UNION ALL
  SELECT 'all', k, count(*), {MEANS} FROM s GROUP BY k)"""

TOP = "tops AS (SELECT query_id AS key, category <> 'unanswerable' AS answerable, round(max(score), 9) AS score FROM lex10 JOIN cats USING (query_id) GROUP BY query_id, category)"
CONTEXT = "ctx AS (SELECT f.query_id, f.idx, f.rank, f.score, c.evidence_id, c.text, q.query FROM lex10 f JOIN chunks c USING (idx) JOIN questions q USING (query_id))"
SENT = "list_filter(list_transform(string_split_regex(regexp_replace({0}, '([.;])\\s+', concat('\\1', chr(30)), 'g'), '[\\x1e\\n]+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"
FIRSTS = "firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, evidence_id ORDER BY rank) AS r FROM ctx) WHERE r = 1 QUALIFY n <= 3)"
QUOTES = f"""sents AS (SELECT query_id, n, evidence_id, text, s[i] AS sent, i, len(list_intersect({content('s[i]')}, {content('query')})) AS o FROM (SELECT *, {SENT.format('text')} AS s FROM firsts) x, unnest(range(1, len(s) + 1)) AS u(i)),
kept AS (SELECT * FROM sents QUALIFY row_number() OVER (PARTITION BY query_id, n ORDER BY o DESC, i) <= 3),
quotes AS (SELECT query_id, n, evidence_id, rtrim(substr(string_agg(sent, ' ' ORDER BY i), 1, 400)) AS quote FROM kept GROUP BY ALL)"""

RESOLVED = """
docs_ AS (SELECT DISTINCT doc_id::BIGINT AS d FROM refs),
alln AS (SELECT doc_id, name, section, ord, form, a AS number FROM refs UNION ALL SELECT doc_id, name, section, ord, form, a + u FROM refs, (SELECT unnest([1, 2]) AS u) WHERE form = 0),
aim AS (SELECT *, CASE WHEN form = 8 THEN CASE WHEN doc_id IN ('5', '13') THEN '5' ELSE '4' END WHEN form = 6 AND doc_id::BIGINT % 2 = 0 AND doc_id::BIGINT + 1 IN (SELECT d FROM docs_) THEN (doc_id::BIGINT + 1)::VARCHAR ELSE doc_id END AS at FROM alln),
res AS (SELECT x.name || '::' || x.section AS source, x.number, CASE WHEN r.section IS NOT NULL THEN r.name || '::Article ' || x.number END AS target,
  CASE WHEN form = 2 THEN 'external' WHEN form = 3 THEN 'self' WHEN form = 4 THEN 'other_instrument' WHEN r.section IS NULL THEN 'unresolved'
    WHEN x.at = x.doc_id AND r.ord = x.ord THEN 'self' WHEN x.at = x.doc_id THEN 'intra' ELSE 'cross' END AS outcome
  FROM aim x LEFT JOIN (SELECT doc_id, name, section, ord FROM refs) r ON r.doc_id = x.at AND r.ord = x.number),
edges AS (SELECT DISTINCT source, target, number, outcome = 'cross' AS cross_document FROM res WHERE outcome IN ('intra', 'cross')),
near AS (SELECT source AS node, target AS neighbour FROM edges UNION SELECT target, source FROM edges)"""

def _modal(shift: int) -> str:
    forms = "['The company shall report', 'The company shall not report', 'The company may report', 'The company should report', 'The company reports']"
    return f"{forms}[((doc_id + doc_id // {shift}) % 5)::INTEGER + 1]"


FORCE = ["mandatory", "prohibitive", "permissive", "advisory", "none"]
RANKS = "CASE {} WHEN 'prohibitive' THEN 1 WHEN 'mandatory' THEN 2 WHEN 'permissive' THEN 3 WHEN 'advisory' THEN 4 ELSE 5 END"


def _force(shift: int) -> str:
    return f"{_list(FORCE)}[((doc_id + doc_id // {shift}) % 5)::INTEGER + 1]"


DRIFT = f"CASE WHEN c = 'none' THEN 'no_force' WHEN c = s THEN 'preserved' WHEN {RANKS.format('c')} < {RANKS.format('s')} THEN 'strengthened' ELSE 'weakened' END"
DATED = "dates AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN DATE '2024-01-01' + (doc_id % 60)::INTEGER END AS commenced FROM documents), judged AS (SELECT query_id, doc_id, rank, commenced <= DATE '2024-02-01' AS in_force FROM (SELECT query_id, idx AS doc_id, rank FROM lex10) LEFT JOIN dates USING (doc_id)), exposed AS (SELECT query_id, count_if(NOT in_force) AS premature, count_if(in_force IS NULL) AS unknown, count_if(NOT in_force) = 0 AS clean, coalesce(min(CASE WHEN NOT in_force THEN rank END), 0) AS first_premature_rank FROM judged GROUP BY query_id)"

ITEMS = """items AS (SELECT item_id AS i, 'Q' || lpad((CASE WHEN item_id % 13 = 0 THEN 1 ELSE item_id END)::VARCHAR, 3, '0') AS id, text AS question,
  ['single_hop', 'cross_document', 'cross_section', 'unanswerable', 'odd'][(item_id % 5)::INTEGER + 1] AS category,
  CASE WHEN item_id % 8 = 0 THEN 'huge' ELSE 'easy' END AS difficulty, CASE WHEN item_id % 10 = 0 THEN 'guessed' ELSE 'hand_written' END AS source, (item_id * 3) % 26 AS minutes,
  CASE WHEN item_id % 4 <> 0 THEN 'high' END AS confidence,
  {'d': ((item_id * 7919) % many)::VARCHAR, 's': 'P' || (item_id % 4)} AS e1, {'d': (((item_id + item_id % 2) * 7919) % many)::VARCHAR, 's': CASE WHEN item_id % 9 = 0 THEN '' ELSE 'P1' END} AS e2 FROM benchmark, (SELECT count(*) + count(*) // 10 AS many FROM documents)),
ev AS (SELECT *, CASE WHEN i % 5 = 3 THEN CASE WHEN i % 2 = 0 THEN [] ELSE [e1] END WHEN i % 5 = 0 THEN [e1] ELSE [e1, e2] END AS e FROM items),
each AS (SELECT i, id, unnest(e) AS x FROM ev),
reg AS (SELECT doc_id::VARCHAR AS doc_id, doc_id % 10 = 0 AS barred FROM documents)"""

ROWS = "rows_ AS (SELECT evidence_id, (idx // 10)::VARCHAR AS doc_id, 'P' || (idx % 10) AS section, source AS grp, text FROM (SELECT evidence_id, min(idx) AS idx FROM chunks GROUP BY evidence_id) JOIN (SELECT idx, text, source FROM chunks) USING (idx))"


LONGS = {
    "answerable_scorecard": ["n"], "improved_worsened": ["improved", "worsened", "unchanged"], "auc": ["n_positive", "n_negative"], "abstention_curve": ["declined_ok", "declined_wrong"],
    "config_grid": ["split"], "premise": ["linked"], "ceiling": ["reached"], "obligation_fidelity": ["preserved", "strengthened", "weakened", "no_force"],
    "temporal_exposure": ["premature", "unknown", "first_premature_rank"], "exposure_by_category": ["affected", "at_rank_1"], "control_score": ["caught", "missed", "false_alarm", "correct_pass"],
}


def chunking(budget: int) -> str:
    """Greedy windows without overlap, one unit (paragraph, or sentence of an overlong one) after the other."""
    return """WITH RECURSIVE p0 AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS a,
        list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS b, len(regexp_extract_all(text, '\\S+')) AS words FROM documents),
      p AS (SELECT doc_id, CASE WHEN len(a) > 1 THEN a ELSE b END AS v, words FROM p0),
      units AS (SELECT doc_id, i, w, big, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS u FROM (
        SELECT doc_id, i, j, len(regexp_extract_all(s, '\\S+')) AS w, big FROM (
          SELECT doc_id, i, big, unnest(range(1, len(ss) + 1)) AS j, unnest(ss) AS s FROM (
            SELECT doc_id, i, len(regexp_extract_all(v[i], '\\S+')) > @ AS big, CASE WHEN len(regexp_extract_all(v[i], '\\S+')) > @ THEN string_split(regexp_replace(v[i], '([.;:])\\s+', concat('\\1', chr(30)), 'g'), chr(30)) ELSE [v[i]] END AS ss
            FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM p WHERE words > @))))),
      walk AS (
        SELECT doc_id, u, i, big, w AS size, 1 AS part FROM units WHERE u = 1
        UNION ALL
        SELECT n.doc_id, n.u, n.i, n.big,
          CASE WHEN (n.big OR k.big) AND n.i <> k.i OR k.size + n.w > @ THEN n.w ELSE k.size + n.w END,
          CASE WHEN (n.big OR k.big) AND n.i <> k.i OR k.size + n.w > @ THEN k.part + 1 ELSE k.part END
        FROM walk k JOIN units n ON n.doc_id = k.doc_id AND n.u = k.u + 1),
      parts AS (SELECT doc_id, part, max(size) AS words FROM walk GROUP BY ALL)
      SELECT doc_id || '::P#' || part AS chunk_id, doc_id::VARCHAR AS doc_id, part, max(part) OVER (PARTITION BY doc_id) AS parts, words FROM parts
      UNION ALL SELECT doc_id || '::P', doc_id::VARCHAR, 0, 1, words FROM p WHERE words <= @""".replace("@", str(budget))


PRF = f"""fw AS (SELECT DISTINCT query_id, idx, unnest({tok('text')}) AS term FROM lex JOIN chunks USING (idx) WHERE rank <= 3),
      fk AS (SELECT query_id, term, count(*) AS n FROM fw WHERE length(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+') AND NOT list_contains({_list(USELESS)}, term) AND NOT EXISTS (SELECT 1 FROM qterms t WHERE t.query_id = fw.query_id AND t.term = fw.term) GROUP BY ALL),
      ft AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS place FROM fk QUALIFY place <= 8)"""


def all_sql() -> dict[str, str]:
    s = "SELECT query_id, idx, rank, round(score, 6) AS score FROM "
    both = scores("s", "lex10") + scores("f", "fused")
    q: dict[str, str] = {}
    q["tokenize_stats"] = f"SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, list_max(list_transform(t, lambda x: length(x))) AS longest FROM (SELECT doc_id, {tok('text')} AS t FROM documents)"
    q["content_token_sets"] = f"SELECT doc_id, len(a) AS answer_tokens, len(b) AS failure_tokens, round({share('a', 'b')}, 6) AS share FROM (SELECT doc_id, {content('text')} AS a, {content('text', lists.FAILURE_STOPWORDS)} AS b FROM documents)"
    words = "len(regexp_extract_all(text, '\\S+'))"
    q["word_counts_census"] = BASE + f"""w AS (SELECT doc_id, ord, evidence_id, {words} AS words FROM secs), d AS (SELECT doc_id, sum(words) AS words FROM w GROUP BY doc_id)
      SELECT count(DISTINCT doc_id) AS documents, count(*) AS sections, count(*) AS chunks, sum(words)::BIGINT AS words, count_if(words > 40)::BIGINT AS over_budget,
        list_sort(list(words))[count(*) // 2 + 1] AS upper_median_words, max(words) AS max_words, count(*) - count(DISTINCT evidence_id) AS duplicate_ids, (SELECT count(*) FROM d WHERE words < 50) AS placeholders, count_if(ord % 7 <> 0)::BIGINT AS numbered, count_if(ord % 7 = 0)::BIGINT AS prose FROM w"""
    q["document_stats"] = BASE + f"x AS (SELECT 1) SELECT doc_id, count(*) AS sections, sum({words})::BIGINT AS words FROM secs GROUP BY doc_id"
    q["placeholder_documents"] = q["document_stats"] + f" HAVING sum({words}) < 50"
    q["paragraph_explode"] = f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS a,
        list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS b FROM documents),
      c AS (SELECT doc_id, CASE WHEN len(a) > 1 THEN a ELSE b END AS v FROM p)
      SELECT doc_id, n - 1 AS n, md5(v[n]) AS digest, length(v[n]) AS chars FROM (SELECT *, unnest(range(1, len(v) + 1)) AS n FROM c)"""
    q["sentence_split"] = f"""SELECT doc_id, len(string_split(regexp_replace(text, '([.;:])\\s+', concat('\\1', chr(30)), 'g'), chr(30))) AS clauses, len(s) AS sentences, md5(array_to_string(s, '|')) AS digest
      FROM (SELECT doc_id, text, {SENT.format('text')} AS s FROM documents)"""
    q["chunk_sections"] = chunking(120)
    q["config_grid"] = " UNION ALL ".join(f"SELECT {n}::BIGINT AS budget, count(*) AS chunks, count_if(part > 0) AS split FROM ({chunking(n)})" for n in (60, 120, 240))
    q["keyword_find"] = BASE + """x AS (SELECT ord, evidence_id, lower(text) AS low FROM secs WHERE contains(lower(text), 'the') AND contains(lower(text), 'and'))
      SELECT ord, evidence_id, (length(low) - length(replace(low, 'the', ''))) // 3 + (length(low) - length(replace(low, 'and', ''))) // 3 AS hits, trim(regexp_extract(low, '.{0,90}the.{0,110}')) AS snippet FROM x"""
    q["table_of_contents"] = BASE + "x AS (SELECT 1) SELECT doc_id, ord, section, length(text) AS chars FROM secs"
    q["section_lookup"] = BASE + "x AS (SELECT 1) SELECT doc_id, section, md5(text) AS digest FROM secs WHERE doc_id = '7' AND lower(section) = 'p1'"
    q["section_labels"] = """WITH f AS (SELECT doc_id, (doc_id % 30 + 1)::VARCHAR AS n FROM documents)
      SELECT doc_id, i AS n, CASE i WHEN 0 THEN 'Article ' || n WHEN 1 THEN 'Article ' || n WHEN 2 THEN n WHEN 3 THEN '6.' || n || '.1' WHEN 4 THEN 'Appendix ' || n WHEN 5 THEN 'Schedule ' || n WHEN 6 THEN 'Chapter ' || n WHEN 7 THEN 'Part Two' ELSE 'General Provisions ' || n END AS label, i IN (6, 7) AS container
      FROM f, (SELECT unnest(range(0, 9)) AS i)"""
    q["dates_and_statuses"] = """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '' ELSE printf('%04d-%02d-%02d', doc_id % 9 + 2018, doc_id % 12 + 1, doc_id % 28 + 1) END AS date FROM documents)
      SELECT doc_id, date, ['in_force', 'in_force', 'repealed', 'superseded', 'not_yet_in_force', 'under_review'][(doc_id % 6)::INTEGER + 1] AS status, CASE WHEN try_cast(date AS DATE) > DATE '2021-06-15' THEN 'false' ELSE 'true' END AS eligible FROM d"""
    q["fingerprints"] = "SELECT doc_id, substr(sha256(source || chr(0) || doc_id || chr(0) || text), 1, 32) AS key, length(rtrim(substr(text, 1, 320), ' ' || chr(10))) AS excerpt_chars FROM documents"
    q["title_switch"] = """SELECT doc_id, md5(CASE WHEN source = title THEN '' ELSE source || chr(10) END || title || chr(10) || lang || chr(10) || text) AS with_title, md5(title || chr(10) || lang || chr(10) || text) AS without_title
      FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS title FROM documents)"""
    q["context_join"] = """WITH k AS (SELECT text FROM documents WHERE md5(text) < 'c' GROUP BY ALL),
      c AS (SELECT text, regexp_replace(text || ' and so on. More', '\\s+', ' ', 'g') AS raw FROM k),
      d AS (SELECT text, regexp_replace(trim(raw), '^["'']+|["'']+$', '', 'g') AS t FROM c),
      e AS (SELECT text, CASE WHEN regexp_extract(t, '^(.{20,400}?[.!?])(\\s|$)', 1) <> '' THEN regexp_extract(t, '^(.{20,400}?[.!?])(\\s|$)', 1) ELSE rtrim(substr(t, 1, 400)) END AS ctx FROM d)
      SELECT doc_id, md5(CASE WHEN coalesce(ctx, '') = '' THEN '' ELSE ctx || chr(10) END || text) AS digest FROM documents LEFT JOIN e USING (text)"""
    q["duplicate_texts"] = "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1"
    q["cache_migration"] = "SELECT min(doc_id) AS key, max(doc_id) AS value FROM documents GROUP BY text HAVING count(*) = 1"
    q["scope_profiles"] = BASE + "x AS (SELECT doc_id, string_agg(CASE WHEN section IN ('P1', 'P3') THEN text END, ' ' ORDER BY ord) AS p, max(source) AS t FROM secs GROUP BY doc_id) SELECT doc_id, md5(coalesce(nullif(substr(p, 1, 1400), ''), t)) AS digest FROM x"
    q["postings"] = BASE + "x AS (SELECT 1) SELECT idx, term, tf FROM posted"
    q["term_statistics"] = BASE + "x AS (SELECT 1) SELECT term, df, round(idf, 6) AS idf FROM stats"
    q["bm25_topk"] = BASE + f"x AS (SELECT 1) {s} lex10"
    q["bm25_depth_100"] = BASE + f"x AS (SELECT 1) {s} lex"
    q["hashed_dense_topk"] = BASE + f"x AS (SELECT 1) {s} dense10"
    vec = ranked("SELECT q.vec_id AS query_id, e.vec_id AS idx, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id", 10)
    q["vector_topk"] = f"{s} ({vec})"
    q["vector_label_recall"] = f"SELECT query_id, round(avg((a.label = b.label)::INTEGER), 6) AS share FROM ({vec}) v JOIN embeddings a ON a.vec_id = v.idx JOIN embeddings b ON b.vec_id = v.query_id GROUP BY query_id"
    q["rrf_fusion"] = BASE + f"x AS (SELECT 1) {s} fused"
    q["lexical_rerank"] = BASE + f"x AS (SELECT 1) {s} rerank"
    q["sparse_topk"] = BASE + "w AS (SELECT idx, term, ln(1 + tf) * idf AS weight FROM posted JOIN stats USING (term)) " + s + "(" + ranked("SELECT query_id, idx, sum(n * weight) AS score FROM qterms JOIN w USING (term) GROUP BY ALL", 10) + ")"
    prf = PRF
    q["prf_terms"] = BASE + prf + " SELECT query_id, term, n, place FROM ft"
    q["prf_rewrite"] = BASE + prf + " SELECT query_id, query, concat_ws(' ', query, string_agg(term, ' ' ORDER BY place)) AS retrieval_query FROM questions LEFT JOIN ft USING (query_id) GROUP BY query_id, query"
    q["generated_rewrite"] = "SELECT item_id AS query_id, text AS query, CASE WHEN length(text) % 3 = 0 THEN text ELSE text || ' ' || trim(regexp_replace('  ' || substr(text, 1, 30) || ' ' || chr(10) || ' x ', '\\s+', ' ', 'g')) END AS retrieval_query FROM benchmark"
    q["gold_evidence"] = BASE + "x AS (SELECT 1) SELECT query_id, evidence_id, gain FROM labelled"
    q["question_categories"] = BASE + "x AS (SELECT 1) SELECT category, count(*) AS n FROM cats GROUP BY category"
    q["metrics_per_question"] = BASE + scores("s", "lex10") + f"x AS (SELECT 1) SELECT query_id, k, {', '.join(f'round({m}, 6) AS {m}' for m in M)} FROM s"
    q["retrieval_scorecard"] = BASE + scores("s", "lex10") + "x AS (SELECT 1) " + SCORECARD
    q["fusion_scorecard"] = BASE + scores("s", "fused") + "x AS (SELECT 1) " + SCORECARD
    q["answerable_scorecard"] = BASE + scores("s", "lex10") + "x AS (SELECT 1) SELECT k, count_if(category <> 'unanswerable') AS n, " + ", ".join(f"round(coalesce(avg({m}) FILTER (category <> 'unanswerable'), 0), 6) AS {m}" for m in M) + ", round(coalesce(avg(precision) FILTER (category = 'unanswerable'), 0), 6) AS noise FROM s JOIN cats USING (query_id) GROUP BY k"
    q["paired_bootstrap"] = BASE + both + boot("SELECT s.query_id AS key, f.mrr - s.mrr AS value FROM s JOIN f USING (query_id, k) WHERE k = 10", "20260101:bm25:rrf:mrr") + ", CASE WHEN s[251] <= 0 AND s[9750] >= 0 THEN 'no' ELSE 'yes' END AS differs FROM vv, bs"
    q["bootstrap_mean"] = BASE + scores("s", "lex10") + boot("SELECT query_id AS key, mrr AS value FROM s WHERE k = 10", "20260101:bm25:mrr") + " FROM vv, bs"
    q["improved_worsened"] = BASE + both + "x AS (SELECT s.mrr AS a, f.mrr AS b FROM s JOIN f USING (query_id, k) WHERE k = 10) SELECT count_if(b > a) AS improved, count_if(b < a) AS worsened, count_if(a = b) AS unchanged FROM x"
    q["auc"] = BASE + TOP + " SELECT count_if(answerable) AS n_positive, count_if(NOT answerable) AS n_negative, (SELECT round(avg(CASE WHEN a.score > u.score THEN 1.0 WHEN a.score = u.score THEN 0.5 ELSE 0.0 END), 6) FROM tops a, tops u WHERE a.answerable AND NOT u.answerable) AS auc FROM tops"
    d2 = lambda tag, n: f"(('0x' || substr(md5('20260101:{tag}:' || r || ':' || i), 1, 8))::BIGINT) % {n}"
    q["auc_bootstrap"] = BASE + TOP + f""", sides AS (SELECT list(score ORDER BY key) FILTER (answerable) AS p, list(score ORDER BY key) FILTER (NOT answerable) AS u FROM tops),
      rs AS (SELECT unnest(range(1, 4001)) AS r), ps AS (SELECT r, unnest(list_transform(range(1, len(p) + 1), lambda i: p[({d2('p', 'len(p)')}) + 1])) AS a FROM sides, rs),
      us AS (SELECT r, unnest(list_transform(range(1, len(u) + 1), lambda i: u[({d2('u', 'len(u)')}) + 1])) AS b FROM sides, rs),
      au AS (SELECT r, avg(CASE WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0.0 END) AS auc FROM ps JOIN us USING (r) GROUP BY r), l AS (SELECT list_sort(list(auc)) AS s FROM au)
      SELECT round(s[101], 6) AS low, round(s[3900], 6) AS high FROM l"""
    q["abstention_curve"] = BASE + TOP + " SELECT threshold, count_if(NOT answerable AND score <= threshold) AS declined_ok, count_if(answerable AND score <= threshold) AS declined_wrong FROM (SELECT DISTINCT round(score, 2) AS threshold FROM tops), tops GROUP BY threshold"
    q["score_spread"] = BASE + TOP + " SELECT answerable, count(*) AS n, round(min(score), 6) AS low, round(median(score), 6) AS middle, round(max(score), 6) AS high FROM tops GROUP BY answerable"
    q["worst_unanswerable"] = BASE + TOP + " SELECT key, answerable, round(score, 6) AS score FROM tops WHERE NOT answerable ORDER BY tops.score DESC, key LIMIT 5"
    q["abstention_correct"] = BASE + TOP + " SELECT query_id, ((SELECT count(*) FROM labelled l WHERE l.query_id = q.query_id AND gain = 2) > 0) = (coalesce((SELECT arg_min(score, rank) FROM lex10 l WHERE l.query_id = q.query_id), 0) > 60) AS correct FROM questions q"
    q["interaction_2x2"] = BASE + both + scores("d", "dense10") + scores("r", "rerank") + "m AS (SELECT (SELECT avg(mrr) FROM s WHERE k = 10) AS b, (SELECT avg(mrr) FROM d WHERE k = 10) AS x, (SELECT avg(mrr) FROM f WHERE k = 10) AS y, (SELECT avg(mrr) FROM r WHERE k = 10) AS z) SELECT round(b, 6) AS base, round(x - b, 6) AS first_effect, round(y - b, 6) AS second_effect, round(z - b, 6) AS both_effect, round(z - b - (x - b + (y - b)), 6) AS interaction FROM m"
    q["reference_edges"] = BASE + RESOLVED + " SELECT source, target, number, cross_document FROM edges"
    q["reference_census"] = BASE + RESOLVED + " SELECT outcome, count(*) AS n FROM res GROUP BY outcome UNION ALL SELECT 'mentions', count(*) FROM res"
    q["adjacency"] = BASE + RESOLVED + " SELECT node, neighbour FROM near"
    q["hops"] = BASE + RESOLVED + """, walk AS (SELECT name AS key, neighbour AS node, 1 AS hop FROM refs JOIN near ON node = name || '::' || section WHERE ord = 1
        UNION SELECT w.key, n.neighbour, w.hop + 1 FROM walk w JOIN near n ON n.node = w.node WHERE w.hop < 3)
      SELECT key, node, min(hop) AS hop FROM walk GROUP BY ALL"""
    q["premise"] = BASE + "p AS (SELECT a.query_id, a.evidence_id AS a, b.evidence_id AS b FROM labelled a JOIN labelled b USING (query_id) WHERE a.evidence_id < b.evidence_id) SELECT query_id, count(*) AS pairs, count_if(EXISTS (SELECT 1 FROM docnear n WHERE n.node = p.a AND n.neighbour = p.b)) AS linked FROM p GROUP BY query_id"
    q["ceiling"] = BASE + """fd AS (SELECT DISTINCT query_id, evidence_id FROM lex JOIN chunks USING (idx) WHERE rank = 1),
      mi AS (SELECT query_id, evidence_id FROM labelled EXCEPT SELECT * FROM fd),
      walk AS (SELECT query_id, neighbour AS node, 1 AS hop FROM fd JOIN docnear ON node = evidence_id UNION SELECT w.query_id, n.neighbour, w.hop + 1 FROM walk w JOIN docnear n ON n.node = w.node WHERE w.hop < 3),
      wm AS (SELECT query_id, node AS evidence_id, min(hop) AS met FROM walk GROUP BY ALL)
      SELECT hop, count_if(met <= hop) AS reached, count(*) AS missed FROM mi LEFT JOIN wm USING (query_id, evidence_id), (SELECT unnest([1, 2, 3]) AS hop) GROUP BY hop"""
    expand = """exn AS (SELECT t.query_id, c.evidence_id AS source, t.score, t.rank FROM lex10 t JOIN chunks c USING (idx)),
      exl AS (SELECT e.query_id, n.neighbour AS target, arg_min(e.score, e.rank) AS score, min(e.rank) AS rank FROM exn e JOIN docnear n ON n.node = e.source
        ANTI JOIN exn p ON p.query_id = e.query_id AND p.source = n.neighbour GROUP BY ALL),
      exc AS (SELECT l.*, c.n, coalesce(sum(c.n) OVER (PARTITION BY query_id ORDER BY rank, target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM exl l JOIN (SELECT evidence_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.evidence_id = l.target),
      exa AS (SELECT query_id, c.idx, score, before + row_number() OVER (PARTITION BY query_id, target ORDER BY c.idx) AS place FROM exc JOIN chunks c ON c.evidence_id = target WHERE before < 15)"""
    q["graph_expand"] = BASE + expand + """ SELECT query_id, idx, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY added, seq) AS rank, added FROM (
        SELECT query_id, idx, score, rank AS seq, false AS added FROM lex10 UNION ALL SELECT query_id, idx, score - 0.001 * place, place, true FROM exa)"""
    q["expansion_size"] = BASE + """t AS (SELECT DISTINCT query_id, evidence_id FROM lex JOIN chunks USING (idx) WHERE rank <= 20),
      n AS (SELECT query_id, neighbour FROM t JOIN docnear ON node = evidence_id EXCEPT SELECT * FROM t)
      SELECT query_id, (SELECT count(*) FROM n WHERE n.query_id = u.query_id) AS n FROM (SELECT DISTINCT query_id FROM t) u"""
    q["extractive_answer"] = BASE + f"{CONTEXT}, {FIRSTS}, {QUOTES} SELECT query_id, n, evidence_id, md5(quote) AS digest, length(quote) AS chars FROM quotes"
    q["answer_decisions"] = BASE + "t AS (SELECT query_id, arg_min(score, rank) AS top FROM lex10 GROUP BY query_id) SELECT query_id, top IS NULL OR top <= 60 AS abstained, round(top, 6) AS top_score FROM questions LEFT JOIN t USING (query_id)"
    q["citation_validity"] = BASE + f"""{CONTEXT}, {FIRSTS}, {QUOTES}, last AS (SELECT query_id, evidence_id, arg_max(text, rank) AS text FROM ctx GROUP BY ALL),
      dec AS (SELECT query_id, coalesce((SELECT arg_min(score, rank) FROM lex10 l WHERE l.query_id = q.query_id), 0) <= 60 AS abstained FROM questions q),
      chk AS (SELECT query_id, len({content('quote')}) > 0 AND (contains(text, quote) OR len(list_intersect({content('quote')}, {content('text')})) >= least(4, len({content('quote')}))) AS ok FROM quotes JOIN last USING (query_id, evidence_id)),
      agg AS (SELECT query_id, count(*) AS c, count_if(ok) AS k FROM chk GROUP BY query_id)
      SELECT query_id, CASE WHEN abstained THEN 0 ELSE coalesce(c, 0) END AS citations, CASE WHEN abstained THEN 1.0 WHEN c IS NULL THEN 0.0 ELSE 1.0 END AS grounded, CASE WHEN abstained THEN 1.0 WHEN c IS NULL THEN 0.0 ELSE round(k / c, 6) END AS supported, abstained::INTEGER::DOUBLE AS abstained FROM dec LEFT JOIN agg USING (query_id)"""
    q["over_attribution"] = """WITH h AS (SELECT item_id AS query_id, item_id % 5 AS kind, substr(text, 1, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b FROM benchmark),
      made AS (SELECT query_id, CASE WHEN kind = 0 THEN 'Not covered by these passages.' WHEN kind < 3 THEN a || ' [1]. And ' || b || ' [2].' ELSE a || ' [1]. And ' || b || ' [2][3]. None [99]. [4, 5] after the tag' END AS answer FROM h),
      runs AS (SELECT query_id, unnest(regexp_extract_all(answer, '(\\[[0-9]+([ ]*[,;][ ]*[0-9]+)*\\][ ]*)+')) AS run FROM made)
      SELECT query_id, coalesce(max(len(list_distinct(regexp_extract_all(run, '[0-9]+')))) > 1, false) AS over FROM made LEFT JOIN runs USING (query_id) GROUP BY query_id"""
    q["obligation_drift"] = f"SELECT doc_id, c AS claim_force, s AS source_forces, {DRIFT} AS drift FROM (SELECT doc_id, {_force(1000003)} AS c, {_force(5)} AS s FROM documents)"
    q["obligation_fidelity"] = f"WITH d AS (SELECT {DRIFT} AS d FROM (SELECT {_force(1000003)} AS c, {_force(5)} AS s FROM documents)) SELECT count_if(d = 'preserved') AS preserved, count_if(d = 'strengthened') AS strengthened, count_if(d = 'weakened') AS weakened, count_if(d = 'no_force') AS no_force, round(count_if(d = 'preserved') / count_if(d <> 'no_force'), 6) AS fidelity FROM d"
    q["in_force"] = BASE + DATED + " SELECT query_id, doc_id, rank, in_force FROM judged"
    q["temporal_exposure"] = BASE + DATED + " SELECT * FROM exposed"
    q["exposure_by_category"] = BASE + DATED + " SELECT category, count(*) AS n, count_if(premature > 0) AS affected, count_if(first_premature_rank = 1) AS at_rank_1 FROM exposed JOIN cats USING (query_id) GROUP BY category"
    q["validator_errors"] = BASE + ITEMS + """, v AS (
      SELECT id, 'error' AS level, 'duplicate id' AS message FROM items GROUP BY id HAVING count(*) > 1 UNION ALL
      SELECT id, 'error', 'unknown category' FROM items WHERE category = 'odd' UNION ALL SELECT id, 'error', 'unknown difficulty' FROM items WHERE difficulty = 'huge' UNION ALL
      SELECT id, 'error', 'unknown source' FROM items WHERE source = 'guessed' UNION ALL SELECT id, 'error', 'unanswerable with evidence' FROM ev WHERE category = 'unanswerable' AND len(e) > 0 UNION ALL
      SELECT id, 'error', 'no evidence' FROM ev WHERE category <> 'unanswerable' AND len(e) = 0 UNION ALL
      SELECT id, 'warning', 'fewer than two sections' FROM ev WHERE category IN ('cross_section', 'cross_document') AND len(e) < 2 UNION ALL
      SELECT id, 'warning', 'one document only' FROM ev WHERE category = 'cross_document' AND e1.d = e2.d UNION ALL
      SELECT id, 'warning', 'took over 20 minutes' FROM items WHERE minutes > 20 UNION ALL
      SELECT id, 'error', 'document not in the registry' FROM each WHERE x.d NOT IN (SELECT doc_id FROM reg) UNION ALL
      SELECT id, 'error', 'evidence without a section' FROM each WHERE x.s = '' UNION ALL
      SELECT id, 'error', 'document not eligible' FROM each WHERE x.s <> '' AND x.d IN (SELECT doc_id FROM reg WHERE barred) UNION ALL
      SELECT id, 'error', 'section not in the corpus' FROM each WHERE x.s <> '' AND x.d || '::' || x.s NOT IN (SELECT evidence_id FROM secs))
      SELECT id, level, message, count(*) AS n FROM v GROUP BY ALL"""
    q["promotion_gate"] = BASE + ITEMS + """ SELECT question, concat_ws('; ', CASE WHEN minutes <= 0 THEN 'not verified by a human' END, CASE WHEN confidence IS NULL THEN 'confidence is unset' END,
      CASE WHEN category = 'unanswerable' AND len(e) > 0 THEN 'unanswerable with evidence' END, CASE WHEN category <> 'unanswerable' AND len(e) = 0 THEN 'no evidence' END) AS reasons FROM ev"""
    q["promoted"] = BASE + ITEMS + """, r AS (SELECT md5(question) AS id FROM ev WHERE minutes > 0 AND confidence IS NOT NULL AND (category = 'unanswerable') = (len(e) = 0))
      SELECT id, 'Q' || lpad(((SELECT coalesce(max(regexp_extract(i.id, '^Q(\\d+)$', 1)::INTEGER), 0) FROM items i WHERE minutes < 9) + row_number() OVER (ORDER BY id))::VARCHAR, 3, '0') AS new_id FROM r"""
    q["control_score"] = "WITH k AS (SELECT toxic = 1 AS bad, CASE WHEN md5(doc_id::VARCHAR) >= '2' THEN CASE WHEN quality = 1 THEN 'sound' ELSE 'broken' END ELSE '' END AS v FROM labels) SELECT count_if(bad AND v = 'broken') AS caught, count_if(bad AND v <> 'broken') AS missed, count_if(NOT bad AND v <> 'sound') AS false_alarm, count_if(NOT bad AND v = 'sound') AS correct_pass FROM k"
    q["coverage"] = BASE + "u AS (SELECT evidence_id, string_agg(query_id::VARCHAR, ',' ORDER BY query_id) AS questions, count(*) AS n FROM labelled WHERE gain = 2 GROUP BY evidence_id) SELECT evidence_id, coalesce(questions, '') AS questions, coalesce(n, 0) AS n FROM (SELECT DISTINCT evidence_id FROM chunks) LEFT JOIN u USING (evidence_id)"
    q["mix_gap"] = BASE + "t AS (SELECT * FROM (VALUES ('single_hop', 20), ('cross_document', 10), ('unanswerable', 15), ('comparative', 5)) v(category, target)), h AS (SELECT category, count(*) AS have FROM cats GROUP BY category) SELECT category, coalesce(have, 0) AS have, target, target - coalesce(have, 0) AS gap FROM t LEFT JOIN h USING (category)"
    ft = lambda x: content(x, lists.FAILURE_STOPWORDS)
    q["failure_taxonomy"] = BASE + ROWS + f""", fd AS (SELECT DISTINCT query_id, evidence_id FROM lex10 JOIN chunks USING (idx)), mi AS (SELECT query_id, evidence_id FROM labelled EXCEPT SELECT * FROM fd),
      m AS (SELECT mi.query_id, r.*, query FROM mi JOIN rows_ r USING (evidence_id) JOIN questions USING (query_id)), fr AS (SELECT fd.query_id, r.* FROM fd JOIN rows_ r USING (evidence_id))
      SELECT query_id, evidence_id, CASE
        WHEN EXISTS (SELECT 1 FROM fr WHERE fr.query_id = m.query_id AND fr.section = m.section AND fr.doc_id <> m.doc_id AND fr.grp = m.grp) THEN 'matched_twin'
        WHEN EXISTS (SELECT 1 FROM fr WHERE fr.query_id = m.query_id AND fr.section = m.section AND fr.doc_id <> m.doc_id) THEN 'same_label'
        WHEN EXISTS (SELECT 1 FROM fr WHERE fr.query_id = m.query_id AND fr.doc_id = m.doc_id) THEN 'same_document'
        WHEN {share(ft('query'), ft('text'))} < 0.1 THEN 'lexical_gap' ELSE 'no_signal' END AS cause FROM m"""
    q["registry_fill"] = """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS old, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS new FROM documents)
      SELECT doc_id, CASE WHEN old <> '' THEN old ELSE new END AS filled, CASE WHEN new <> '' THEN new ELSE old END AS forced FROM d"""
    q["title_overlap"] = f"SELECT doc_id, round({share('a', 'b')}, 6) AS share, CASE WHEN {share('a', 'b')} >= 0.8 THEN 'entire_section' ELSE 'page' END AS mode FROM (SELECT doc_id, list_distinct({tok("regexp_replace(text, '\\n[^\\n]*$', '')")}) AS a, list_distinct({tok("regexp_replace(text, '^[^.]*\\.', '')")}) AS b FROM documents)"
    q["demo_export"] = BASE + """g AS (SELECT query_id, evidence_id FROM labelled WHERE gain = 2), h AS (SELECT DISTINCT query_id, evidence_id FROM lex10 JOIN chunks USING (idx)), t AS (SELECT query_id, max(score) AS top FROM lex10 GROUP BY query_id)
      SELECT query_id, count(g.evidence_id) AS required, count(h.evidence_id) AS found, count(g.evidence_id) = count(h.evidence_id) AS complete, any_value(coalesce(top <= 60, true)) AS would_decline
      FROM questions LEFT JOIN t USING (query_id) LEFT JOIN g USING (query_id) LEFT JOIN h USING (query_id, evidence_id) GROUP BY query_id"""
    # sums and conditional counts are wider than longs there
    for name, columns in LONGS.items():
        q[name] = f"SELECT * REPLACE ({', '.join(f'{c}::BIGINT AS {c}' for c in columns)}) FROM ({q[name]})"
    return q
