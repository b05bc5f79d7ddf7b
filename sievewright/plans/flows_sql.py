"""DuckDB SQL for the queries of `flows`, and for those of the catalogue that need more than a line."""

from __future__ import annotations

from ..operators.answers import PROMPT
from .sql import BASE, CONTEXT, ITEMS, M, PRF, RESOLVED, content, ranked, scores, share, tok
from .sql import all_sql as catalogue_sql

SEED = "7"
REWRITTEN = f"""{PRF},
rq AS (SELECT query_id, query, concat_ws(' ', query, string_agg(term, ' ' ORDER BY place)) AS rquery FROM questions LEFT JOIN ft USING (query_id) GROUP BY query_id, query),
rterms AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest({tok('rquery')}) AS term FROM rq) GROUP BY ALL),
rbm AS (SELECT query_id, idx, sum(q.n * w.weight) AS score FROM rterms q JOIN bm25w w USING (term) GROUP BY ALL),
rlex AS MATERIALIZED (SELECT query_id, idx, coalesce(b.score, 0.0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(b.score, 0.0), 9) DESC, idx) AS rank
  FROM rq CROSS JOIN (SELECT idx FROM chunks) LEFT JOIN rbm b USING (query_id, idx) WHERE len({tok('rquery')}) > 0 QUALIFY rank <= 50),
rrall AS (SELECT query_id, idx, f.rank AS pool_rank, list_distinct({tok('query')}) AS qt, list_distinct({tok('c.text')}) AS ct FROM rlex f JOIN questions USING (query_id) JOIN chunks c USING (idx)),
rre AS MATERIALIZED ({ranked(f"SELECT query_id, idx, pool_rank, 100.0 * {share('qt', 'ct')} AS score FROM rrall", 10, "pool_rank")}),
"""
SPARSE = "sw AS (SELECT idx, term, ln(1 + tf) * idf AS weight FROM posted JOIN stats USING (term))"
LETTERS = "['e', 't', 'a', 'o', 'i', 'n', 's', 'h', 'r', 'd', 'l', 'u']"
STRIPPED = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
#: Claims of the made answers: query_id, n, pos, rank (the number cited), claim.
CLAIMS = f"""halves AS (SELECT query_id, query_id % 5 AS kind, substr(query, 1, length(query) // 2) AS a, substr(query, length(query) // 2 + 1) AS b FROM questions),
cl AS (SELECT query_id, n, pos, number AS rank, {STRIPPED.format("CASE n WHEN 0 THEN a WHEN 1 THEN '. And ' || b WHEN 2 THEN '. None' ELSE '.' END")} AS claim
  FROM halves JOIN (VALUES (false, 0, 0, 1), (false, 1, 0, 2), (true, 0, 0, 1), (true, 1, 0, 2), (true, 1, 1, 3), (true, 2, 0, 99), (true, 3, 0, 4), (true, 3, 1, 5)) v(mixed, n, pos, number) ON mixed = (kind > 2) WHERE kind > 0),
met AS (SELECT cl.*, c.evidence_id FROM cl JOIN lex10 l USING (query_id, rank) JOIN chunks c USING (idx) WHERE claim <> ''),
cited AS (SELECT query_id, evidence_id, claim, row_number() OVER (PARTITION BY query_id ORDER BY n, pos) AS n
  FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY query_id, evidence_id ORDER BY n, pos) = 1))"""
LAST = "last AS (SELECT query_id, evidence_id, arg_max(text, rank) AS text FROM ctx GROUP BY ALL)"
NAMED = "it AS (SELECT md5(question) AS id, category, minutes, e, len(e) AS n FROM ev)"


def number(text: str, n: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT) % ({n})"


def draw(tag: str, n: str) -> str:
    return number(f"'{SEED}:' || id || ':{tag}'", n)


#: Broken labels of the questions in `it`.
CORRUPT = f"""{NAMED},
many AS (SELECT greatest(1, count(*) // 64) AS buckets, min(evidence_id) AS first FROM secs),
dealt AS (SELECT evidence_id, {number('evidence_id', 'buckets')} AS bucket FROM secs, many),
asked AS (SELECT id, first, {draw('bucket', 'buckets')} AS bucket FROM it, many WHERE n = 0),
odd AS (SELECT id, coalesce(arg_min(evidence_id, md5('{SEED}:' || id || ':' || evidence_id)), any_value(first)) AS odd FROM asked LEFT JOIN dealt USING (bucket) GROUP BY id),
way AS (SELECT id, e, n, CASE WHEN n >= 2 THEN ['drop', 'add', 'swap'][{draw('how', '3')} + 1] WHEN n = 1 THEN ['add', 'swap'][{draw('how', '2')} + 1] ELSE 'spurious' END AS how,
  CASE WHEN n > 0 THEN e[{draw('which', 'greatest(n, 1)')} + 1] END AS x FROM it),
beside AS (SELECT doc_id, section, lag(section) OVER w AS prev, lead(section) OVER w AS next FROM secs WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
opt AS (SELECT w.*, list_filter([prev, next], lambda o: o IS NOT NULL AND NOT list_contains(list_transform(list_filter(e, lambda y: y.d = x.d), lambda y: y.s), o)) AS options
  FROM way w LEFT JOIN beside b ON b.doc_id = x.d AND b.section = x.s),
cho AS (SELECT *, CASE WHEN how IN ('add', 'swap') THEN options[{draw('option', 'greatest(len(options), 1)')} + 1] END AS choice FROM opt),
broken AS (SELECT id, how, CASE WHEN how <> 'spurious' THEN x.d || '::' || x.s END AS evidence_id, CASE WHEN how = 'spurious' THEN odd WHEN choice IS NOT NULL THEN x.d || '::' || choice END AS replacement
  FROM cho LEFT JOIN odd USING (id) WHERE how NOT IN ('add', 'swap') OR choice IS NOT NULL)"""


def overlapping(budget: int, overlap: int, column: str = "md5(text) AS digest") -> str:
    """Greedy windows that repeat the last words of the one before."""
    return """WITH RECURSIVE p0 AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS a,
        list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS b, len(regexp_extract_all(text, '\\S+')) AS words FROM documents),
      p AS (SELECT doc_id, text, CASE WHEN len(a) > 1 THEN a ELSE b END AS v, words FROM p0),
      para AS (SELECT doc_id, i, v[i] AS s, len(regexp_extract_all(v[i], '\\S+')) AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM p WHERE words > @B)),
      walk AS (
        SELECT doc_id, i, n, 1 AS part, 0 AS carry, n AS held, CASE WHEN n > @B THEN 0 ELSE n END AS stretch, 0 AS before, n > @B AS big FROM para WHERE i = 1
        UNION ALL
        SELECT q.doc_id, q.i, q.n, k.part + (q.n > @B OR k.big OR k.held + q.n > @B)::INTEGER,
          CASE WHEN q.n > @B OR NOT (k.big OR k.held + q.n > @B) THEN 0 ELSE least(@O, k.stretch) END,
          CASE WHEN q.n <= @B AND NOT (k.big OR k.held + q.n > @B) THEN k.held + q.n WHEN q.n > @B THEN q.n ELSE least(@O, k.stretch) + q.n END,
          CASE WHEN q.n > @B THEN 0 ELSE k.stretch + q.n END, k.before + k.n, q.n > @B
        FROM walk k JOIN para q ON q.doc_id = k.doc_id AND q.i = k.i + 1),
      sent AS (SELECT doc_id, part, j, ss[j] AS s, len(regexp_extract_all(ss[j], '\\S+')) AS n FROM (
        SELECT *, unnest(range(1, len(ss) + 1)) AS j FROM (SELECT w.doc_id, part, string_split(regexp_replace(s, '([.;:])\\s+', concat('\\1', chr(30)), 'g'), chr(30)) AS ss FROM walk w JOIN para USING (doc_id, i) WHERE big))),
      cut AS (
        SELECT doc_id, part, j, s, n AS held, 1 AS piece FROM sent WHERE j = 1
        UNION ALL
        SELECT q.doc_id, q.part, q.j, q.s, CASE WHEN k.held + q.n > @B THEN q.n ELSE k.held + q.n END, k.piece + (k.held + q.n > @B)::INTEGER FROM cut k JOIN sent q ON q.doc_id = k.doc_id AND q.part = k.part AND q.j = k.j + 1),
      whole AS (SELECT doc_id, part, string_agg(s, chr(10) ORDER BY i) AS body, arg_min(carry, i) AS carry, arg_min(before, i) AS before FROM walk JOIN para USING (doc_id, i) WHERE NOT big GROUP BY ALL),
      every AS (
        SELECT doc_id, part, 1 AS piece, CASE WHEN carry > 0 THEN array_to_string(regexp_extract_all(array_to_string(v, chr(10)), '\\S+')[before - carry + 1 : before], ' ') || chr(10) || body ELSE body END AS text FROM whole JOIN p USING (doc_id)
        UNION ALL SELECT doc_id, part, piece, string_agg(s, ' ' ORDER BY j) FROM cut GROUP BY ALL),
      placed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, piece) AS part, count(*) OVER (PARTITION BY doc_id) AS parts, text FROM every)
      SELECT doc_id || '::P#' || part AS chunk_id, doc_id::VARCHAR AS doc_id, part, parts, @C FROM placed
      UNION ALL SELECT doc_id || '::P', doc_id::VARCHAR, 0, 1, @C FROM p WHERE words <= @B""".replace("@C", column).replace("@B", str(budget)).replace("@O", str(overlap))


def all_sql() -> dict[str, str]:
    done = catalogue_sql()
    both = scores("s", "lex10") + REWRITTEN + scores("w", "rre")
    x = "x AS (SELECT 1)"
    q: dict[str, str] = {}
    q["chunk_overlap"] = overlapping(120, 20)
    q["html_sections"] = BASE + f"""hd AS (SELECT doc_id, ord, text, ord % 6 AS k, replace(['Chapter (%d)', 'Article (%d): Rule', 'Definitions', 'Scope of %d', 'Article (%d)', 'General'][ord % 6 + 1], '%d', ord::VARCHAR) AS heading, ord % 6 IN (0, 3) OR {STRIPPED.format('text')} = '' AS empty FROM secs),
      pl AS (SELECT *, coalesce(last_value(CASE WHEN empty AND k = 0 THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chapter,
        lag(CASE WHEN empty AND k <> 0 THEN heading END) OVER (PARTITION BY doc_id ORDER BY ord) AS pending FROM hd),
      lb AS (SELECT *, CASE WHEN ord = 1 THEN 'Preamble' ELSE CASE WHEN chapter > 0 THEN 'Chapter ' || chapter || ', ' ELSE '' END || CASE k WHEN 1 THEN 'Article ' || ord WHEN 4 THEN 'Article ' || ord ELSE heading END END AS label FROM pl WHERE NOT empty),
      sn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY ord) AS seen FROM lb)
      SELECT doc_id, label || CASE WHEN seen > 1 THEN ' (' || seen || ')' ELSE '' END AS section, CASE WHEN ord = 1 THEN heading ELSE coalesce(pending, heading) END AS section_title,
        CASE WHEN chapter > 0 THEN 'Chapter (' || chapter || ')' ELSE '' END AS parent_heading, ord - 1 AS "order", seen > 1 AS duplicate_label, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM sn"""
    q["claims_parse"] = BASE + CLAIMS + " SELECT query_id, n, length(claim) AS chars, string_agg(rank::VARCHAR, ',' ORDER BY pos) AS numbers FROM cl GROUP BY query_id, n, claim"
    q["tagged_citations"] = BASE + CLAIMS + " SELECT query_id, n, evidence_id, length(claim) AS chars FROM cited"
    q["corrupted_labels"] = BASE + ITEMS + ", " + CORRUPT + " SELECT id, how, evidence_id, replacement FROM broken"
    q["rewritten_retrieval"] = BASE + REWRITTEN + x + " SELECT query_id, idx, rank, round(score, 6) AS score FROM rre"
    q["rewrite_before_after"] = BASE + both + x + " SELECT category, count(*) AS n, round(avg(s.mrr), 6) AS before, round(avg(w.mrr), 6) AS after FROM s JOIN w USING (query_id, k) JOIN cats USING (query_id) WHERE k = 10 GROUP BY category"
    q["moved_questions"] = BASE + scores("s", "lex10") + scores("d", "dense10") + x + " SELECT query_id AS key, round(s.mrr, 6) AS before, round(d.mrr, 6) AS after FROM s JOIN d USING (query_id, k) WHERE k = 10 AND s.mrr <> d.mrr"
    q["unchanged_rewrites"] = "SELECT count(*) AS n, count_if(length(text) % 3 = 0)::BIGINT AS unchanged FROM benchmark"
    letters = lambda prefix, c: f"list_transform({LETTERS}, lambda c: (length(lower('{prefix}' || {c})) - length(replace(lower('{prefix}' || {c}), c, '')))::DOUBLE)"
    unit = "list_transform(v, lambda y: y / sqrt(list_dot_product(v, v)))"
    q["encoded_topk"] = BASE + f"cv AS (SELECT idx, {letters('passage: ', 'text')} AS v FROM chunks), qv AS (SELECT query_id, {letters('query: ', 'query')} AS v FROM questions), cu AS (SELECT idx, {unit} AS v FROM cv), qu AS (SELECT query_id, {unit} AS v FROM qv) SELECT query_id, idx, rank, round(score, 6) AS score FROM ({ranked('SELECT query_id, idx, list_dot_product(qu.v, cu.v) AS score FROM qu, cu', 10)})"
    q["instruction_prefixes"] = "SELECT item_id AS query_id, md5(CASE item_id % 6 WHEN 0 THEN 'Represent this sentence for searching relevant passages: ' WHEN 1 THEN 'query: ' WHEN 2 THEN 'query: ' ELSE '' END || text) AS as_query, md5(CASE WHEN item_id % 6 IN (1, 2) THEN 'passage: ' ELSE '' END || text) AS as_passage FROM benchmark"
    q["sparse_expansion"] = BASE + SPARSE + " SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY round(weight, 9) DESC, term) AS place, term, round(weight, 6) AS weight FROM sw WHERE weight > 0 QUALIFY place <= 12"
    q["nonzero_terms"] = BASE + SPARSE + " SELECT (SELECT count(*) FROM chunks) AS chunks, round(count_if(weight > 0) / (SELECT count(*) FROM chunks), 6) AS mean_terms FROM sw"
    q["expansion_summary"] = f"SELECT count(*) AS n, round(avg(n), 6) AS mean, list_sort(list(n))[count(*) // 2 + 1] AS middle, max(n) AS most, count_if(n = 0)::BIGINT AS none FROM ({done['expansion_size']})"
    q["carried_columns"] = BASE + """reg AS (SELECT doc_id::VARCHAR AS doc_id, 'Title of ' || source AS title, 'https://x.org/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN 'C 1/2024' ELSE '' END AS code, 'in_force' AS status, '2024-01-02' AS effective_date FROM documents WHERE md5(text) < 'e')
      SELECT doc_id, ord, coalesce(r.title, '') AS title, coalesce(url, '') AS url, coalesce(code, '') AS code, coalesce(status, '') AS status, coalesce(effective_date, '') AS effective_date FROM secs LEFT JOIN reg r USING (doc_id)"""
    q["page_facts"] = """SELECT page_id::VARCHAR AS doc_id, page_id::VARCHAR AS node_id, 'C ' || (page_id % 12 + 1) || '/2024' AS code, '2024-03-' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') AS effective_date, 'in_force' AS status,
      CASE WHEN page_id % 3 <> 0 THEN 'insurance' ELSE '' END AS rulebook_section, CASE WHEN page_id % 4 <> 0 THEN 'https://x.org/en_net_file_store/doc_' || page_id || '.PDF' ELSE '' END AS pdf_url,
      concat_ws('; ', CASE WHEN page_id % 3 = 0 THEN 'no link to a section of the rulebook' END, CASE WHEN page_id % 4 = 0 THEN 'PDFs, but none of the file store' END) AS problems FROM pages"""
    q["sections_in_order"] = BASE + x + " SELECT doc_id, string_agg(section, ',' ORDER BY ord) AS sections FROM secs GROUP BY doc_id"
    scope = f"""pr AS (SELECT doc_id, coalesce(nullif(substr(string_agg(CASE WHEN section IN ('P1', 'P3') THEN text END, ' ' ORDER BY ord), 1, 1400), ''), max(source)) AS profile FROM secs GROUP BY doc_id),
      sq AS (SELECT query_id, query, category <> 'unanswerable' AS positive, coalesce(score, 0.0) AS relevance, list_distinct({tok('query')}) AS qt, list_distinct({tok("coalesce(profile, '')")}) AS pt
        FROM cats LEFT JOIN (SELECT query_id, idx, score FROM lex WHERE rank = 1) l USING (query_id) LEFT JOIN pr ON pr.doc_id = l.idx::VARCHAR),
      sc AS (SELECT query_id, positive, relevance, 100.0 * {share('qt', 'pt')} AS scope FROM sq)"""
    q["scope_scores"] = BASE + scope + " SELECT query_id, positive, round(relevance, 6) AS relevance, round(scope, 6) AS scope FROM sc"
    ways = {"relevance": "relevance", "scope": "scope", "sum": "relevance + scope", "min": "least(relevance, scope)"}
    q["scope_strategies"] = BASE + scope + ", st AS (" + " UNION ALL ".join(f"SELECT '{k}' AS strategy, positive, round({v}, 9) AS score FROM sc" for k, v in ways.items()) + ") SELECT a.strategy, round(avg(CASE WHEN a.score > u.score THEN 1.0 WHEN a.score = u.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM st a JOIN st u ON a.strategy = u.strategy AND a.positive AND NOT u.positive GROUP BY a.strategy"
    before, rest = PROMPT.replace("'", "''").split("{passages}")
    between = rest.removesuffix("{question}")
    q["numbered_prompts"] = BASE + CONTEXT + f", pm AS (SELECT query_id, '{before}' || string_agg('[' || rank || '] ' || regexp_replace(substr(text, 1, 700), '\\s+$', ''), chr(10) || chr(10) ORDER BY rank) || '{between}' || any_value(query) AS prompt FROM ctx WHERE rank <= 4 GROUP BY query_id) SELECT query_id, md5(prompt) AS digest, length(prompt) AS chars FROM pm"
    q["claim_sources"] = BASE + f"{CONTEXT}, {CLAIMS}, {LAST} SELECT query_id, evidence_id, md5(claim) AS claim, md5(text) AS source FROM cited JOIN last USING (query_id, evidence_id)"
    words, found = content("claim"), content("text")
    q["citation_means"] = BASE + f"""{CONTEXT}, {CLAIMS}, {LAST},
      chk AS (SELECT query_id, len({words}) > 0 AND (contains(text, claim) OR len(list_intersect({words}, {found})) >= greatest(least(4, len({words})), round_even(0.6 * len({words}), 0))) AS ok FROM cited JOIN last USING (query_id, evidence_id)),
      per AS (SELECT query_id, count_if(ok) / count(*) AS supported FROM chk GROUP BY query_id),
      kinds AS (SELECT 'all' AS answers, supported FROM per UNION ALL SELECT CASE WHEN query_id % 5 > 2 THEN 'over_attributed' ELSE 'one_source' END, supported FROM per)
      SELECT answers, count(*) AS n, 1.0::DOUBLE AS grounded, round(avg(supported), 6) AS supported FROM kinds GROUP BY answers"""
    q["threshold_ignored"] = BASE + x + " SELECT query_id, f.query_id IS NULL AS abstained, CASE WHEN f.query_id IS NULL THEN 'nothing retrieved' ELSE 'threshold ignored: scores are not comparable' END AS reason FROM questions LEFT JOIN (SELECT DISTINCT query_id FROM fused) f USING (query_id)"
    q["question_bounds"] = "SELECT conv_id, turn, coalesce(length(text) BETWEEN 5 AND 500 AND turn BETWEEN 1 AND 20, false) AS allowed FROM conversations"
    q["required_with_edges"] = BASE + "rq AS (SELECT DISTINCT evidence_id FROM labelled WHERE gain = 2) SELECT count(*) AS required, count_if(evidence_id IN (SELECT node FROM docnear))::BIGINT AS with_edge FROM rq"
    q["edge_audit"] = BASE + RESOLVED + f" SELECT source, target, number FROM edges ORDER BY md5('{SEED}:' || source || ':' || target), source, target LIMIT 20"
    q["evidence_review"] = BASE + ITEMS + f""", {NAMED}, each_ AS (SELECT id, u - 1 AS n, e[u] AS x FROM it, unnest(range(1, len(e) + 1)) AS t(u))
      SELECT id, n, x.d AS doc_id, x.s AS section, s.evidence_id IS NOT NULL AS exists, md5(coalesce(s.text, 'this section does not exist in the corpus')) AS digest FROM each_ LEFT JOIN secs s ON s.evidence_id = x.d || '::' || x.s"""
    q["label_recheck"] = BASE + ITEMS + f""", {NAMED}, chosen AS (SELECT id, e, n FROM it WHERE n >= 2 OR category = 'unanswerable'),
      docs_ AS (SELECT DISTINCT id, e, unnest(list_transform(e, lambda y: y.d)) AS doc_id FROM chosen WHERE n > 0 UNION ALL SELECT id, e, NULL FROM chosen WHERE n = 0)
      SELECT id, d.doc_id, ord, section, coalesce(list_contains(list_transform(e, lambda y: y.d || '::' || y.s), d.doc_id || '::' || section), false) AS cited FROM docs_ d LEFT JOIN secs s ON s.doc_id = d.doc_id"""
    q["item_lookup"] = BASE + ITEMS + """, named AS (SELECT md5(question) AS id, md5(question) AS question, CASE WHEN minutes < 9 THEN 'draft' ELSE 'question' END AS origin FROM items),
      asked AS (SELECT upper(id) AS asked FROM named UNION ALL SELECT ' ' || id FROM named UNION ALL SELECT 'x' || id FROM named)
      SELECT asked, id, origin, question FROM asked LEFT JOIN named ON id = lower(trim(asked))"""
    sample = CORRUPT.replace(NAMED, "it AS (SELECT md5(question) AS id, category, minutes, e, len(e) AS n FROM ev ORDER BY md5('" + SEED + ":sample:' || md5(question)), md5(question) LIMIT 10)")
    q["planted_sample"] = BASE + ITEMS + ", " + sample + f""", half AS (SELECT * FROM broken ORDER BY md5('{SEED}:sample:' || id), id LIMIT 5)
      SELECT id, row_number() OVER (ORDER BY md5('{SEED}:shuffle:' || id), id) AS place, h.id IS NOT NULL AS corrupted, coalesce(how, '') AS how, evidence_id, replacement FROM it LEFT JOIN half h USING (id)"""
    findings = done["validator_errors"]
    q["validator_counters"] = f"SELECT (SELECT count(*) FROM benchmark) AS items, sum(n) FILTER (level = 'error')::BIGINT AS errors, sum(n) FILTER (level = 'warning')::BIGINT AS warnings, (SELECT list_sort(list(((item_id * 3) % 26)::DOUBLE))[count(*) // 2 + 1] FROM benchmark) AS median_minutes FROM ({findings})"
    systems = both + scores("d", "dense10") + scores("f", "fused") + scores("r", "rerank")
    means = ", ".join(f"round(avg({m}), 6) AS {m}" for m in M)
    grid = " UNION ALL ".join(f"SELECT '{name}' AS system, {means} FROM {t} WHERE k = 10" for name, t in (("lexical", "s"), ("dense", "d"), ("fused", "f"), ("reranked", "r"), ("rewritten", "w")))
    q["system_grid"] = BASE + systems + x + " " + grid
    q["system_spread"] = BASE + systems + f"g AS ({grid}) SELECT min(mrr) AS low, max(mrr) AS high, round(max(mrr) - min(mrr), 6) AS spread FROM g"
    q["failure_counts"] = BASE + f"fc AS ({done['failure_taxonomy']}), fx AS (SELECT cause, category FROM fc JOIN cats USING (query_id) UNION ALL SELECT cause, 'all' FROM fc) SELECT cause, category, count(*) AS n FROM fx GROUP BY ALL"
    q["completeness"] = BASE + "hit AS (SELECT DISTINCT query_id, evidence_id FROM lex10 JOIN chunks USING (idx)), per AS (SELECT query_id, count(*) AS n, count(h.evidence_id) AS m FROM labelled l LEFT JOIN hit h USING (query_id, evidence_id) WHERE gain = 2 GROUP BY query_id) SELECT CASE WHEN m = n THEN 'complete' WHEN m > 0 THEN 'partial' ELSE 'total_miss' END AS outcome, count(*) AS n FROM per GROUP BY ALL"
    q["keyword_finds"] = BASE + f"""kq AS (SELECT query_id, list_filter({tok("concat_ws(' ', substr(t[3], 1, 5), substr(t[5], 1, 4))")}, lambda w: length(w) > 2) AS ws FROM (SELECT query_id, {tok('query')} AS t FROM questions)),
      kl AS (SELECT evidence_id, ord, lower(text) AS low FROM secs)
      SELECT query_id, ord, evidence_id, list_sum(list_transform(ws, lambda w: (length(low) - length(replace(low, w, ''))) // length(w)))::BIGINT AS hits
      FROM kq JOIN kl ON len(list_filter(ws, lambda w: contains(low, w))) = len(ws) WHERE len(ws) > 0"""
    pairs = f"SELECT query_id, idx, f.rank AS pool_rank, list_distinct({tok('query')}) AS qt, list_distinct({tok('c.text')}) AS ct FROM ml f JOIN questions USING (query_id) JOIN chunks c USING (idx)"
    best = ranked(f"SELECT query_id, idx, pool_rank, 100.0 * {share('qt', 'ct')} AS score FROM ({pairs})", 10, "pool_rank")
    q["measured_stages"] = BASE + f"""ml AS (SELECT * FROM lex WHERE rank <= 50), mr AS ({best})
      SELECT 'search' AS stage, count(*) AS rows, true AS timed FROM ml UNION ALL SELECT 'rerank', count(*), true FROM mr UNION ALL SELECT 'evidence', count(DISTINCT (query_id, evidence_id)), true FROM mr JOIN chunks USING (idx)"""
    q |= generated_sql()
    q |= grid_sql()
    return q


def generated_sql() -> dict[str, str]:
    """Replies of the stand-in generators, told from the lengths of questions and prompts."""
    from ..operators import generation

    n = "length(query)"
    fixed = len(generation.CONTEXT_PROMPT.format(title="", section="", text=""))
    size = f"({fixed} + length(source) + length(lang) + least(600, length(text)))"
    return {
        "generated_answers": BASE + f"""{CONTEXT},
      tp AS (SELECT query_id, arg_min(score, rank) AS top FROM ctx GROUP BY query_id),
      rp AS (SELECT query_id, query, top, top IS NULL AS none, coalesce(top <= 60.0, false) AS low,
        CASE WHEN {n} % 7 = 0 THEN 'error' WHEN {n} % 5 = 0 THEN 'refusal' WHEN {n} % 11 = 0 THEN 'nothing' ELSE 'answer' END AS kind FROM questions LEFT JOIN tp USING (query_id)),
      ct AS (SELECT query_id, count(DISTINCT evidence_id) AS citations FROM ctx WHERE rank <= 2 GROUP BY query_id)
      SELECT query_id, none OR low OR kind <> 'answer' AS abstained,
        CASE WHEN none THEN 'nothing retrieved' WHEN low THEN 'top relevance # at or below threshold #' WHEN kind = 'error' THEN 'the generator failed: ValueError: # characters'
          WHEN kind = 'refusal' THEN 'the generator declined: the passages don''t answer the question' WHEN kind = 'nothing' THEN 'the generator gave no answer' ELSE '' END AS reason,
        md5(CASE WHEN none THEN '{generation.NOTHING}' WHEN low THEN '{generation.UNSURE.replace("'", "''")}' WHEN kind = 'refusal' THEN 'Not covered by these passages, sorry.' WHEN kind = 'answer' THEN substr(query, 1, 20) || ' [1]. ' || substr(query, 21, 20) || ' [2].' ELSE '' END) AS answer,
        CASE WHEN none OR low OR kind <> 'answer' THEN 0 ELSE citations END AS citations
      FROM rp LEFT JOIN ct USING (query_id)""",
        "contextual_chunks": f"SELECT doc_id, md5(CASE WHEN {size} % 13 = 0 THEN '' ELSE source || ' speaks of ' || lang || ', at ' || {size} || ' characters.' || chr(10) END || text) AS digest FROM documents",
    }


def grid_sql() -> dict[str, str]:
    """The scored grid, a setting after the other, and the pooled weights."""
    settings = ((60, 0), (120, 20), (240, 0), (1_000_000, 0))
    cut = " UNION ALL ".join(f"SELECT '{b}-{o}' AS setting, {b} AS budget, {o} AS overlap, doc_id::BIGINT AS doc, part, text FROM ({overlapping(b, o, 'text')})" for b, o in settings)
    found = "".join(f"g{i} AS (SELECT query_id, doc AS idx, rank FROM gr WHERE setting = '{b}-{o}')," + scores(f"m{i}", f"g{i}") for i, (b, o) in enumerate(settings))
    means = " UNION ALL ".join(f"SELECT '{b}-{o}' AS setting, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(full_recall), 6) AS full_recall, round(avg(mrr), 6) AS mrr FROM m{i} JOIN cats USING (query_id) WHERE k = 10 AND category <> 'unanswerable'" for i, (b, o) in enumerate(settings))
    grid = BASE + f"""gc AS MATERIALIZED ({cut}),
      gp AS (SELECT setting, doc, part, term, count(*) AS tf FROM (SELECT setting, doc, part, unnest({tok('text')}) AS term FROM gc) GROUP BY ALL),
      gl AS (SELECT setting, doc, part, len({tok('text')}) AS dl FROM gc), gz AS (SELECT setting, count(*) AS chunks, avg(dl) AS avgdl FROM gl GROUP BY setting),
      gd AS (SELECT setting, term, ln(chunks - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT setting, term, count(*) AS df FROM gp GROUP BY ALL) JOIN gz USING (setting)),
      gi AS (SELECT setting, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY setting) ELSE raw END AS idf FROM gd),
      gs AS (SELECT setting, query_id, doc, part, sum(n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qterms JOIN gi USING (term) JOIN gp USING (setting, term) JOIN gl USING (setting, doc, part) JOIN gz USING (setting) GROUP BY ALL),
      gr AS MATERIALIZED (SELECT setting, query_id, doc, row_number() OVER (PARTITION BY setting, query_id ORDER BY round(coalesce(score, 0.0), 9) DESC, doc, part) AS rank
        FROM questions CROSS JOIN gl LEFT JOIN gs USING (setting, query_id, doc, part) WHERE len({tok('query')}) > 0 QUALIFY rank <= 10),
      {found} gm AS ({means}),
      gn AS (SELECT setting, budget::BIGINT AS budget, overlap::BIGINT AS overlap, count(*) AS chunks, count_if(part > 0)::BIGINT AS from_splits, count_if(part = 1)::BIGINT AS split FROM gc GROUP BY ALL)
      SELECT * FROM gn JOIN gm USING (setting)"""
    logits = lambda rows, key, column: f"""SELECT {key}, position, t AS term, length(t) - 3.0 AS logit FROM {rows}_t UNION ALL SELECT {key}, position, substr(t, 1, 4) || '*', (length(t) - 5) / 2.0 FROM {rows}_t"""
    tokens = lambda rows, key, column: f"{rows}_t AS (SELECT * FROM (SELECT {key}, unnest({tok(column)}) AS t, unnest(range(len({tok(column)}))) AS position FROM {rows}) WHERE position < 512)"
    pooled = lambda rows, key, column: f"{tokens(rows, key, column)}, {rows}_w AS (SELECT {key}, term, max(ln(1 + greatest(logit, 0))) AS weight FROM ({logits(rows, key, column)}) GROUP BY ALL HAVING weight > 0)"
    chunks, questions = pooled("chunks", "idx", "text"), pooled("questions", "query_id", "query")
    top = ranked("SELECT query_id, idx, sum(q.weight * c.weight) AS score FROM questions_w q JOIN chunks_w c USING (term) GROUP BY query_id, idx", 10)
    return {
        "scored_grid": grid,
        "learned_sparse_topk": BASE + f"{chunks}, {questions} SELECT query_id, idx, rank, round(score, 6) AS score FROM ({top})",
        "learned_sparse_weights": BASE + f"{chunks} SELECT idx, count(*) AS terms, round(sum(weight), 6) AS mass, arg_min(term, (-round(weight, 9), term)) AS heaviest FROM chunks_w GROUP BY idx",
    }
