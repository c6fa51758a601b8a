"""SQL counterparts (DuckDB) of the driver queries, written from the rules, not from the plans."""

from __future__ import annotations

from checks.inputs import ZONES
from parchment import dims
from parchment.functions.text import STOPWORDS
from parchment.functions.text import FOLLOW_UP_START, FOLLOW_UP_WORDS, SUMMARY_WORDS

ORACLES: dict[str, str] = {}


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _texts(values) -> str:
    return "(" + _list(values)[1:-1] + ")"


# --- words ---------------------------------------------------------------------------------------

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def trim_(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def decomposed(x: str) -> str:
    """Lower-case Latin text with every accent replaced by a gap after its letter."""
    return f"strip_accents(regexp_replace(lower({x}), '([àáâãäåçèéêëìíîïñòóôõöùúûüýÿ])', '\\1 ', 'g'))"


def stem(w: str) -> str:
    base = f"regexp_extract({w}, '^(.{{3,}}?)(ations|ation|ings|ing|ies|ied|ed|es|s|ly)$', 1)"
    doubled = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$"
    return (
        f"(CASE WHEN length({w}) <= 4 OR regexp_matches({w}, '[0-9]') OR {base} = '' THEN {w} "
        f"WHEN substr({w}, length({base}) + 1) IN ('ies', 'ied') THEN {base} || 'y' "
        f"WHEN regexp_matches({base}, '{doubled}') THEN left({base}, -1) ELSE {base} END)"
    )


def words(x: str) -> str:
    return (
        f"list_filter(regexp_extract_all({decomposed(x)}, '[\\p{{L}}\\p{{N}}]+'), "
        f"lambda w: NOT list_contains({_list(STOPWORDS)}, w) AND (length(w) >= 2 OR regexp_matches(w, '[0-9]')))"
    )


def tokens_(x: str) -> str:
    return f"list_transform({words(x)}, lambda w: {stem('w')})"


def match_form(x: str) -> str:
    plain = f"translate(strip_accents(regexp_replace(lower({x}), '([àáâãäåçèéêëìíîïñòóôõöùúûüýÿ])', '\\1§', 'g')), '‘’‚‛“”„‟‐‑‒–—―', '''''''''\"\"\"\"------')"
    return f"trim(regexp_replace(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}%.,''\"\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def haystack(x: str) -> str:
    return f"regexp_replace({match_form(x)}, '[\"'']', '', 'g')"


# --- pages and documents -------------------------------------------------------------------------

PAGES = f"""pages_ AS (
  SELECT doc_id, lang, source, p AS page, substr(t, (p - 1) * 3000 + 1, 3000) AS text
  FROM (SELECT *, unnest(range(1, CAST(ceil(length(t) / 3000.0) AS BIGINT) + 1)) AS p
        FROM (SELECT doc_id, lang, source, {trim_('text')} AS t FROM documents)))"""

ORACLES["paginate"] = f"WITH {PAGES} SELECT doc_id, page, length(text) AS chars, md5(text) AS digest FROM pages_"
TOTALS = "totals_ AS (SELECT doc_id, count(*) AS page_count, CAST(sum(length(text)) AS BIGINT) AS char_count FROM pages_ GROUP BY doc_id HAVING sum(length(text)) > 0)"
ORACLES["document_totals"] = f"WITH {PAGES}, {TOTALS} SELECT * FROM totals_"
ORACLES["combine_documents"] = f"""WITH {PAGES}
  SELECT source, count(DISTINCT doc_id) AS files, count(*) AS page_count, CAST(sum(length(text)) AS BIGINT) AS char_count,
    CASE WHEN count(DISTINCT doc_id) = 1 THEN CAST(min(doc_id) AS VARCHAR) ELSE count(DISTINCT doc_id) || ' documents' END AS filename
  FROM pages_ GROUP BY source"""
ORACLES["page_cleanup"] = f"""WITH l AS (SELECT doc_id, replace(text, chr(10), ' ' || chr(9) || repeat(chr(10), 4)) AS t FROM documents),
  c AS (SELECT doc_id, {trim_("regexp_replace(regexp_replace(t, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM l)
  SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM c"""
ORACLES["latest_copy"] = """WITH d AS (SELECT source || '/' || lang || '/' || (n_chars % 10) AS filename, doc_id, n_chars FROM documents),
  added AS (SELECT * FROM d WHERE doc_id % 2 = 1)
  SELECT * FROM added UNION ALL
  SELECT * FROM d WHERE doc_id % 2 = 0 AND filename NOT IN (SELECT filename FROM added)"""
ORACLES["merged_pages"] = f"""WITH {PAGES}, n AS (SELECT source, count(DISTINCT doc_id) AS files FROM pages_ GROUP BY source)
  SELECT source, doc_id, page, CASE WHEN files > 1 THEN CAST(doc_id AS VARCHAR) END AS file, md5(text) AS digest FROM pages_ JOIN n USING (source)"""
ORACLES["extraction_plan"] = """SELECT conv_id, turn, w <> 1 AS figures, w IN (1, 2, 3, 5) AS facts,
    ['amount,date', 'amount,percent,duration,date', 'amount', 'amount,percent,duration,date', 'duration', 'amount,percent,duration,date'][w + 1] AS kinds
  FROM (SELECT conv_id, turn, (conv_id + turn) % 6 AS w FROM conversations WHERE role = 'user') WHERE w <> 5
  UNION ALL SELECT conv_id, turn, false, true, 'amount,percent,duration,date' FROM conversations WHERE role = 'user' AND (conv_id + turn) % 6 = 5"""
ORACLES["without_reasoning"] = """SELECT conv_id, turn, md5(CASE (conv_id + turn) % 3 WHEN 0 THEN ltrim(text) WHEN 1 THEN '' ELSE text || ' <think>x</think>' END) AS digest FROM conversations"""
ORACLES["live_subscriptions"] = """SELECT event_id, event_id % 9 <> 0 AND event_type IN ('signup', 'purchase', 'view') AS live FROM events"""
ORACLES["upsert_delete"] = """WITH d AS (SELECT source || '/' || lang AS id, doc_id AS updated_at, n_chars FROM documents)
  SELECT id, max(updated_at) AS updated_at, arg_max(n_chars, updated_at) AS n_chars FROM d
  WHERE NOT id LIKE '%/es' GROUP BY id"""
ORACLES["sealed_records"] = """SELECT conv_id || ':' || turn AS id, turn AS updated_at, role, md5(text) AS digest FROM conversations"""

# --- words, headings, passages -------------------------------------------------------------------

ORACLES["tokens"] = f"""WITH t AS (SELECT doc_id, unnest({words('text')}) AS w FROM documents)
  SELECT doc_id, {stem('w')} AS term, count(*) AS tf FROM t GROUP BY ALL"""
ORACLES["term_stats"] = f"""WITH t AS (SELECT doc_id, {tokens_('text')} AS ts FROM documents),
  n AS (SELECT count(*) AS chunks, avg(len(ts)) AS avg_len FROM t),
  d AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(ts) AS term FROM t) GROUP BY term)
  SELECT term, df, chunks, round(avg_len, 6) AS avg_len, round(ln(1 + (chunks - df + 0.5) / (df + 0.5)), 6) AS idf FROM d, n"""
ORACLES["normalized_text"] = f"SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, {match_form('text')} AS t FROM documents)"
ORACLES["fingerprint"] = f"""WITH {PAGES} SELECT doc_id, left(sha256(string_agg(text, chr(10) ORDER BY page)), 16) AS fingerprint FROM pages_ GROUP BY doc_id"""

H1 = r"(?i)^(?:section|clause|article|schedule|annex|appendix|part|chapter)\s+[\w.]+\b.{0,80}$"
H2 = r"^\d+(?:\.\d+){0,3}[.)]?\s+[A-Z][^.!?]{0,80}$"
H3 = r"^[A-Z][A-Z0-9 ,&/''()\-]{3,70}$"


def heading(x: str) -> str:
    found = " OR ".join(f"regexp_matches({x}, '{h}')" for h in (H1, H2, H3))
    return f"(CASE WHEN length({x}) BETWEEN 3 AND 100 AND ({found}) THEN regexp_replace({x}, '\\s+', ' ', 'g') END)"


CONTRACT = """contract AS (SELECT o_custkey AS doc_id, o_orderkey AS page,
  CASE o_orderpriority WHEN '1-URGENT' THEN '1. Urgent Orders' || chr(10) WHEN '2-HIGH' THEN 'Section 2 High Orders' || chr(10)
    WHEN '3-MEDIUM' THEN 'MEDIUM ORDERS' || chr(10) ELSE '' END
  || 'The Customer shall pay £' || format('{:,.2f}', o_totalprice) || ' within thirty (30) days of '
  || strftime(o_orderdate, '%-d %B %Y') || '. Late sums bear interest at ' || (o_custkey % 7 + 1)
  || '.5% per year after ' || (o_orderkey % 24 + 1) || ' months.' AS text FROM orders)"""
CONTRACT_HEADS = f"""heads AS (SELECT doc_id, page, text, {heading("string_split(text, chr(10))[1]")} AS heading FROM contract)"""
ORACLES["headings"] = f"WITH {CONTRACT}, {CONTRACT_HEADS} SELECT doc_id, page, heading FROM heads WHERE heading IS NOT NULL"
ORACLES["section_carry"] = f"""WITH {CONTRACT}, {CONTRACT_HEADS} SELECT doc_id, page,
  last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section_in FROM heads"""


def chunk_ctes(pages: str) -> str:
    """chunks_(doc_id, page, chunk_idx, section, text) of a page table, step by step."""
    return f"""
  paras AS (SELECT doc_id, page, unnest(ps) AS para, generate_subscripts(ps, 1) AS pi
            FROM (SELECT doc_id, page, regexp_split_to_array(text, '\\n\\s*\\n') AS ps FROM {pages})),
  lines_ AS (SELECT doc_id, page, pi, li, {trim_('line')} AS line
            FROM (SELECT doc_id, page, pi, unnest(ls) AS line, generate_subscripts(ls, 1) AS li
                  FROM (SELECT *, string_split(para, chr(10)) AS ls FROM paras))),
  full_ AS (SELECT *, {heading('line')} AS heading, row_number() OVER (PARTITION BY doc_id, page, pi ORDER BY li) AS nth
            FROM lines_ WHERE line <> ''),
  blocked AS (SELECT *, sum(CASE WHEN nth = 1 OR heading IS NOT NULL THEN 1 ELSE 0 END)
                OVER (PARTITION BY doc_id, page ORDER BY pi, li) AS block FROM full_),
  blocks AS (SELECT doc_id, page, block, string_agg(line, ' ' ORDER BY pi, li) AS text, max(heading) AS heading
             FROM blocked GROUP BY doc_id, page, block),
  sectioned AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, block) AS section FROM blocks),
  segs AS (SELECT *, regexp_extract_all(text, '[^.!?;]+[.!?;]*') AS sg FROM sectioned),
  pieces AS (SELECT doc_id, page, block, section, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM (
      SELECT *, CASE WHEN length(text) <= 1200 THEN [text] WHEN len(sg) = 0 THEN [{trim_('text')}] ELSE
        list_filter(list_transform(list_filter(range(1, len(sg) + 1), lambda i: i = len(sg) OR regexp_matches(sg[i + 1], '^\\s')),
          lambda i: {trim_('sg[i]')}), lambda s: s <> '') END AS ps FROM segs)),
  wrapped AS (SELECT doc_id, page, block, section, k, w, substr(piece, w * 1200 + 1, 1200) AS text FROM (
      SELECT *, unnest(range(0, CAST(ceil(length(piece) / 1200.0) AS BIGINT))) AS w FROM pieces)),
  units AS (SELECT *, length(text) AS len, row_number() OVER (PARTITION BY doc_id, page ORDER BY block, k, w) AS n FROM wrapped),
  walk AS (
    WITH RECURSIVE r AS (
      SELECT doc_id, page, n, 1 AS chunk, false AS repeated, len + 1 AS size, section, len AS prev FROM units WHERE n = 1
      UNION ALL
      SELECT doc_id, page, n, chunk + CASE WHEN flush THEN 1 ELSE 0 END, flush AND rep,
             CASE WHEN NOT flush THEN size WHEN rep THEN prev ELSE 0 END + len + 1,
             CASE WHEN flush THEN new_section ELSE section END, len
      FROM (SELECT u.doc_id, u.page, u.n, r.chunk, r.size, r.section, r.prev, u.len, u.section AS new_section,
                   (r.size + u.len > 900 OR u.section IS DISTINCT FROM r.section) AS flush,
                   (u.section IS NOT DISTINCT FROM r.section AND r.prev <= 250) AS rep
            FROM r JOIN units u ON u.doc_id = r.doc_id AND u.page = r.page AND u.n = r.n + 1))
    SELECT * FROM r),
  members AS (SELECT doc_id, page, chunk, n, section FROM walk
              UNION ALL SELECT doc_id, page, chunk, n - 1, NULL FROM walk WHERE repeated),
  chunks_ AS (SELECT m.doc_id, m.page, m.chunk, max(m.section) AS section, string_agg(u.text, ' ' ORDER BY m.n) AS text,
                row_number() OVER (PARTITION BY m.doc_id ORDER BY m.page, m.chunk) - 1 AS chunk_idx
              FROM members m JOIN units u ON u.doc_id = m.doc_id AND u.page = m.page AND u.n = m.n
              GROUP BY m.doc_id, m.page, m.chunk)"""


DOC_CHUNKS = f"{PAGES}, {chunk_ctes('pages_')}"
ORACLES["chunks"] = f"WITH {DOC_CHUNKS} SELECT doc_id, chunk_idx, page, section, length(text) AS chars, md5(text) AS digest FROM chunks_"
ORACLES["contract_chunks"] = f"WITH {CONTRACT}, {chunk_ctes('contract')} SELECT doc_id, chunk_idx, page, section, md5(text) AS digest FROM chunks_"

# --- search --------------------------------------------------------------------------------------


def bm25_ctes(passages: str, keys: str, queries: str, limit: int = 20) -> str:
    """hits(query_id, keys, score, lexical_rank), cov(query_id, …) over passages(keys, text)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    akeys = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
  tok AS MATERIALIZED (SELECT {keys}, {tokens_('text')} AS ts FROM {passages}),
  lens AS (SELECT {keys}, len(ts) AS len FROM tok),
  n AS (SELECT count(*) AS chunks, avg(len) AS avg_len FROM lens),
  tfs AS (SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest(ts) AS term FROM tok) GROUP BY ALL),
  dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
  qt AS MATERIALIZED (SELECT DISTINCT query_id, unnest({tokens_('text')}) AS term FROM {queries}),
  qw AS (SELECT query_id, term, coalesce(df, 0) AS df, chunks, avg_len, ln(1 + (chunks - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf
         FROM qt LEFT JOIN dfs USING (term), n),
  scored AS (SELECT query_id, {akeys}, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
             FROM tfs a JOIN lens b ON {on} JOIN qw USING (term) GROUP BY ALL),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {keys}) AS lexical_rank FROM scored WHERE score > 0)
           WHERE lexical_rank <= {limit})"""


BENCH = "bench AS (SELECT item_id AS query_id, text FROM benchmark)"
BM25 = f"{BENCH}, {DOC_CHUNKS}, {bm25_ctes('chunks_', 'doc_id, chunk_idx', 'bench')}"
ORACLES["bm25_topk"] = f"WITH {BM25} SELECT query_id, doc_id, chunk_idx, round(score, 5) AS score, lexical_rank FROM hits"
ORACLES["indexed_search"] = ORACLES["bm25_topk"]
WORDINGS = ["urgent interest", "sums of high orders", "medium orders per year", "pay urgent sums late"]
WEIGHTED = f"""{CONTRACT}, {chunk_ctes('contract')},
  weighted AS (SELECT doc_id, chunk_idx, CASE WHEN section IS NULL THEN text ELSE repeat(section || chr(10), 3) || text END AS text FROM chunks_),
  bench AS (SELECT item_id AS query_id, {_list(WORDINGS)}[item_id % {len(WORDINGS)} + 1] AS text FROM benchmark), {bm25_ctes('weighted', 'doc_id, chunk_idx', 'bench')}"""
ORACLES["heading_weighted_search"] = f"WITH {WEIGHTED} SELECT query_id, doc_id, chunk_idx, round(score, 5) AS score, lexical_rank FROM hits"
ORACLES["query_coverage"] = f"""WITH {BM25} SELECT query_id, coalesce(matched_terms, 0) AS matched_terms, coalesce(query_terms, 0) AS query_terms,
  round(coalesce(share, 0), 6) AS weighted_coverage, chunk_count
  FROM bench LEFT JOIN (SELECT query_id, count(*) FILTER (df > 0) AS matched_terms, count(*) AS query_terms,
    coalesce(sum(idf) FILTER (df > 0), 0) / sum(idf) AS share, max(chunks) AS chunk_count FROM qw GROUP BY query_id) USING (query_id)"""

VEC = """q_ AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM benchmark JOIN embeddings ON item_id = vec_id),
  sims AS (SELECT query_id, vec_id AS doc_id, round(sim, 9) AS similarity, sim FROM (
    SELECT query_id, vec_id, list_dot_product(q, CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(q, q)) *
      sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS sim FROM q_, embeddings)),
  vtop AS (SELECT * FROM (SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS semantic_rank FROM sims)
           WHERE semantic_rank <= 20),
  vstats AS (SELECT query_id, count(*) AS n, max(sim) AS best, avg(sim) AS mean, stddev_pop(sim) AS std FROM sims GROUP BY query_id)"""
ORACLES["vector_topk"] = f"WITH {VEC} SELECT query_id, doc_id, round(similarity, 5) AS similarity, semantic_rank FROM vtop"
ORACLES["vector_zscore"] = f"""WITH {VEC} SELECT query_id, n, round(best, 5) AS best, round(mean, 5) AS mean, round(std, 5) AS std,
  round(CASE WHEN std > 1e-6 THEN (best - mean) / std ELSE 0 END, 5) AS z FROM vstats"""
FUSED = f"""{BENCH}, {bm25_ctes('documents', 'doc_id', 'bench')}, {VEC},
  fused AS (SELECT coalesce(h.query_id, v.query_id) AS query_id, coalesce(h.doc_id, v.doc_id) AS doc_id, coalesce(score, 0) AS lexical, similarity AS semantic,
      lexical_rank, semantic_rank, round(coalesce(1.0 / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + semantic_rank), 0), 12) AS rrf
    FROM hits h FULL JOIN vtop v ON h.query_id = v.query_id AND h.doc_id = v.doc_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, coalesce(lexical_rank, semantic_rank + 20)) AS rrf_rank FROM fused),
  placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, rrf_rank) AS lp,
      row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC NULLS LAST, rrf_rank) AS sp FROM ranked),
  final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY least(
      CASE WHEN lexical > 0 AND lp <= 3 THEN 2 * lp - 1 ELSE 9999 END, CASE WHEN semantic IS NOT NULL AND sp <= 3 THEN 2 * sp ELSE 9999 END, 1000 + rrf_rank)) AS final_rank FROM placed)"""
ORACLES["hybrid_rrf"] = f"WITH {FUSED} SELECT query_id, doc_id, round(rrf, 9) AS rrf, rrf_rank FROM ranked"
ORACLES["guaranteed_order"] = f"WITH {FUSED} SELECT query_id, doc_id, final_rank FROM final"
ORACLES["budget_pick"] = f"""WITH RECURSIVE {FUSED},
  costed AS (SELECT query_id, doc_id, final_rank, CAST(ceil(length(text) / 3.0) AS BIGINT) + 16 AS cost, row_number() OVER (PARTITION BY query_id ORDER BY final_rank) AS r FROM final JOIN documents USING (doc_id)),
  walk AS (SELECT query_id, doc_id, final_rank, r, cost <= 1500 AS took, CASE WHEN cost <= 1500 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 1500 THEN 1 ELSE 0 END AS held
           FROM costed WHERE r = 1
    UNION ALL SELECT c.query_id, c.doc_id, c.final_rank, c.r, w.held < 6 AND w.used + c.cost <= 1500,
      w.used + CASE WHEN w.held < 6 AND w.used + c.cost <= 1500 THEN c.cost ELSE 0 END,
      w.held + CASE WHEN w.held < 6 AND w.used + c.cost <= 1500 THEN 1 ELSE 0 END
    FROM walk w JOIN costed c ON c.query_id = w.query_id AND c.r = w.r + 1)
  SELECT query_id, doc_id, final_rank, 'S' || held AS source_id FROM walk WHERE took"""
ORACLES["spread_sample"] = f"""WITH RECURSIVE {DOC_CHUNKS},
  cc AS (SELECT doc_id, chunk_idx, CAST(ceil(length(text) / 3.0) AS BIGINT) + 16 AS cost FROM chunks_),
  st AS (SELECT doc_id, count(*) AS n, greatest(1, least(count(*), 8, CAST(floor(1500 / avg(cost)) AS BIGINT))) AS k FROM cc GROUP BY doc_id),
  want AS (SELECT DISTINCT doc_id, CASE WHEN k = 1 THEN 0 ELSE CAST(floor(i * (n - 1) / (k - 1.0) + 0.5) AS BIGINT) END AS chunk_idx FROM (SELECT *, unnest(range(0, k)) AS i FROM st)),
  s AS (SELECT doc_id, chunk_idx, cost, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS r FROM want JOIN cc USING (doc_id, chunk_idx)),
  walk2 AS (SELECT doc_id, chunk_idx, r, cost <= 1500 AS took, CASE WHEN cost <= 1500 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 1500 THEN 1 ELSE 0 END AS held FROM s WHERE r = 1
    UNION ALL SELECT s.doc_id, s.chunk_idx, s.r, w.used + s.cost <= 1500, w.used + CASE WHEN w.used + s.cost <= 1500 THEN s.cost ELSE 0 END, w.held + CASE WHEN w.used + s.cost <= 1500 THEN 1 ELSE 0 END
    FROM walk2 w JOIN s ON s.doc_id = w.doc_id AND s.r = w.r + 1)
  SELECT doc_id, chunk_idx, 'S' || held AS source_id FROM walk2 WHERE took"""
ORACLES["indexed_vector_topk"], ORACLES["indexed_vector_zscore"] = ORACLES["vector_topk"], ORACLES["vector_zscore"]
SUMMARY_RE = r"(?i)\b" + SUMMARY_WORDS + r"\b"
ORACLES["abstain_or_sample"] = f"""WITH {DOC_CHUNKS},
  asked AS (SELECT conv_id || ':' || turn AS query_id, conv_id AS doc_id, text FROM conversations WHERE role = 'user' AND conv_id IN (SELECT doc_id FROM documents)),
  dt AS (SELECT DISTINCT doc_id, unnest({tokens_('text')}) AS term FROM chunks_),
  nn AS (SELECT doc_id, count(*) AS n FROM chunks_ GROUP BY doc_id),
  qt AS (SELECT DISTINCT query_id, doc_id, unnest({tokens_('text')}) AS term FROM asked),
  c AS (SELECT q.query_id, count(d.term) AS matched, count(*) AS total FROM qt q LEFT JOIN dt d ON d.doc_id = q.doc_id AND d.term = q.term GROUP BY q.query_id),
  j AS (SELECT a.query_id, a.doc_id, coalesce(matched, 0) AS matched_terms, coalesce(total, 0) AS query_terms, n AS chunk_count, regexp_matches(text, '{SUMMARY_RE}') AS s
        FROM asked a JOIN nn USING (doc_id) LEFT JOIN c USING (query_id))
  SELECT query_id, doc_id, matched_terms, query_terms, chunk_count, CASE WHEN s THEN 'summary' WHEN query_terms > 0 AND matched_terms = 0 AND chunk_count >= 12 THEN 'abstain'
    WHEN matched_terms > 0 THEN 'search' ELSE 'sample' END AS mode FROM j"""
def _under_budget(name: str, rows: str, key: str, most: int, budget: str = "1500") -> str:
    """Recursive walk over ``rows`` (key, r, chunk_idx, cost and a ``budget`` column, if it is one) that takes what fits."""
    limit = budget if budget.isdigit() else f"c.{budget}"
    fits = f"w.held < {most} AND w.used + c.cost <= {limit}"
    return f"""{name} AS (SELECT {key}, chunk_idx, r, cost <= {limit} AS took, CASE WHEN cost <= {limit} THEN cost ELSE 0 END AS used, CASE WHEN cost <= {limit} THEN 1 ELSE 0 END AS held FROM {rows} c WHERE r = 1
    UNION ALL SELECT c.{key}, c.chunk_idx, c.r, {fits}, w.used + CASE WHEN {fits} THEN c.cost ELSE 0 END, w.held + CASE WHEN {fits} THEN 1 ELSE 0 END
    FROM {name} w JOIN {rows} c ON c.{key} = w.{key} AND c.r = w.r + 1)"""


CITE = r"(?i)\[~?((?:S\d+)(?:\s*[,;&]\s*(?:and\s+)?~?S?\d+)*)\]"


def strip_cites(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{CITE}', '', 'g'), '[ \\t]+([.,;!?])', '\\1', 'g')"


QA = """qa AS (SELECT a.conv_id * 1000 + a.turn AS id, a.text AS question, b.text AS answer,
    CASE WHEN coalesce(l.quality, 1) = 1 THEN 'up' ELSE 'down' END AS rating, CASE WHEN a.conv_id % 2 = 0 THEN 'Corrected answer.' END AS correction
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
  LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON l.doc_id = a.conv_id WHERE a.role = 'user')"""
ORACLES["similar_examples"] = f"""WITH {QA},
  ok AS (SELECT id, ceil(length(question) / 3.0) + ceil(length(approved) / 3.0) + 8 AS cost, list_distinct({tokens_('question')}) AS b FROM
    (SELECT *, CASE WHEN rating = 'down' THEN correction ELSE {strip_cites('answer')} END AS approved FROM qa WHERE rating = 'up' OR correction IS NOT NULL)),
  qs AS (SELECT conv_id * 1000 + turn AS question_id, list_distinct({tokens_('text')}) AS a FROM conversations WHERE role = 'user'),
  sc AS (SELECT question_id, id, CAST(cost AS INTEGER) AS cost, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS similarity FROM qs, ok WHERE len(a) > 0 AND len(b) > 0 AND cost <= 220),
  r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, id) AS rank FROM sc WHERE similarity >= 0.2),
  f AS (SELECT * FROM r WHERE rank = 1),
  s AS (SELECT r.*, row_number() OVER (PARTITION BY r.question_id ORDER BY r.rank) AS k FROM r JOIN f USING (question_id) WHERE r.rank > 1 AND r.cost + f.cost <= 220)
  SELECT question_id, id, 1 AS place, round(similarity, 6) AS similarity, cost FROM f
  UNION ALL SELECT question_id, id, 2, round(similarity, 6), cost FROM s WHERE k = 1"""

# --- personal data -------------------------------------------------------------------------------

# type, priority, pattern, validity of v (its digits: d). IBAN, NI and SSN follow the same scheme.
DIGITS = "regexp_replace(v, '\\D', '', 'g')"
REPEATED = f"{DIGITS} <> repeat(left({DIGITS}, 1), length({DIGITS}))"
LUHN = (
    f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN (length({DIGITS}) - i) % 2 = 1 THEN "
    f"CASE WHEN 2 * CAST({DIGITS}[i] AS INT) > 9 THEN 2 * CAST({DIGITS}[i] AS INT) - 9 ELSE 2 * CAST({DIGITS}[i] AS INT) END "
    f"ELSE CAST({DIGITS}[i] AS INT) END)) % 10 = 0"
)
IBAN_CODE = "upper(regexp_replace(v, '\\s+', '', 'g'))"
IBAN_OK = (
    f"length({IBAN_CODE}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr({IBAN_CODE}, 5) || left({IBAN_CODE}, 4), ''), "
    "lambda ch: CASE WHEN ch >= 'A' THEN 1000 + ascii(ch) - 55 ELSE ascii(ch) - 48 END)), "
    "lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END) = 1"
)
PHONE_OK = f"length({DIGITS}) BETWEEN 10 AND 15 AND {REPEATED}"
DETECTORS = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "true"),
    ("iban", r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?\b", IBAN_OK),
    ("card", r"\b(?:\d[ -]?){12,18}\d\b", f"length({DIGITS}) BETWEEN 13 AND 19 AND {LUHN} AND {REPEATED}"),
    ("uk_ni", r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b",
     "left(v, 2) NOT IN ('BG', 'GB', 'NK', 'KN', 'TN', 'NT', 'ZZ')"),
    ("us_ssn", r"\b\d{3}-\d{2}-\d{4}\b",
     "left(v, 3) NOT IN ('000', '666') AND left(v, 1) <> '9' AND substr(v, 5, 2) <> '00' AND substr(v, 8) <> '0000'"),
    ("phone", r"\+\d{1,3}(?:[\s.-]?\(?\d{1,4}\)?){2,5}\b", PHONE_OK),
    ("phone", r"(?:\(\d{3,5}\)\s?|\b0[1-9]\d{1,3}[\s.-]?|\b\d{3}[.-])\d{3,4}[\s.-]?\d{3,4}\b", PHONE_OK),
    ("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
     "len(list_filter(string_split(v, '.'), lambda o: CAST(o AS INT) <= 255 AND CAST(CAST(o AS INT) AS VARCHAR) = o)) = 4"),
]


def span_cte(name: str, table: str, keys: str, pattern: str) -> str:
    """name(keys, v, s, e): matches of a pattern with 0-based positions."""
    return f"""{name} AS (SELECT {keys}, m[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {keys}, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM {table})))"""


def pii_ctes(table: str, keys: str) -> str:
    """pii_(keys, type, s, e, value): valid hits, each detector after the ones before it."""
    on = " AND ".join(f"t.{k.strip()} = h.{k.strip()}" for k in keys.split(","))
    parts, taken = [], None
    for i, (kind, pattern, valid) in enumerate(DETECTORS):
        parts.append(span_cte(f"d{i}", table, keys, pattern))
        kept = f"SELECT {keys}, '{kind}' AS type, CAST(s AS BIGINT) AS s, CAST(s + length(v) AS BIGINT) AS e, v AS value FROM d{i} h WHERE {valid}"
        if taken:
            kept += f" AND NOT EXISTS (SELECT 1 FROM {taken} t WHERE {on} AND h.s < t.e AND h.s + length(h.v) > t.s)"
            kept = f"SELECT * FROM {taken} UNION ALL ({kept})"
        parts.append(f"t{i} AS MATERIALIZED ({kept})")
        taken = f"t{i}"
    return ",\n  ".join(parts) + f", pii_ AS (SELECT * FROM {taken})"


PII = f"{PAGES}, {pii_ctes('pages_', 'doc_id, page')}"
ORACLES["pii_hits"] = f"WITH {PII} SELECT doc_id, page, type, s AS start_at, e AS end_at, value FROM pii_"
ORACLES["pii_counts"] = f"WITH {PII} SELECT doc_id, type, count(*) AS findings FROM pii_ GROUP BY GROUPING SETS ((doc_id, type), (doc_id))"
MASK = """(left(value, least(2, length(value) // 4)) || regexp_replace(substr(value, least(2, length(value) // 4) + 1, length(value) - 2 * least(2, length(value) // 4)), '[A-Za-z0-9]', '•', 'g')
  || right(value, least(2, length(value) // 4)))"""
ORACLES["pii_report"] = f"""WITH {PII},
  pg AS (SELECT doc_id, type, string_agg(CAST(page AS VARCHAR), ', ' ORDER BY page) AS pages FROM (SELECT DISTINCT doc_id, type, page, dense_rank() OVER (PARTITION BY doc_id, type ORDER BY page) AS n FROM pii_) WHERE n <= 8 GROUP BY ALL),
  ex AS (SELECT doc_id, type, string_agg({MASK}, ', ' ORDER BY page, s) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY page, s) AS n FROM pii_) WHERE n <= 2 GROUP BY ALL)
  SELECT doc_id, type, count(*) AS findings, any_value(pages) AS pages, any_value(examples) AS examples FROM pii_ JOIN pg USING (doc_id, type) JOIN ex USING (doc_id, type) GROUP BY doc_id, type
  UNION ALL SELECT doc_id, NULL, 0, NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pii_)"""
REDACTED = f"""{PII},
  cuts AS (SELECT p.doc_id, p.page, p.text, h.type, h.s, h.e, lag(h.e, 1, 0) OVER (PARTITION BY p.doc_id, p.page ORDER BY h.s) AS prev FROM pages_ p JOIN pii_ h USING (doc_id, page)),
  red AS (SELECT p.doc_id, p.page, CASE WHEN count(c.s) = 0 THEN any_value(p.text) ELSE
      string_agg(substr(c.text, c.prev + 1, c.s - c.prev) || '[' || upper(c.type) || ' REDACTED]', '' ORDER BY c.s) || substr(any_value(p.text), max(c.e) + 1) END AS text
    FROM pages_ p LEFT JOIN cuts c USING (doc_id, page) GROUP BY p.doc_id, p.page)"""
ORACLES["pii_redacted"] = f"WITH {REDACTED} SELECT doc_id, page, length(text) AS chars, md5(text) AS digest FROM red"
ORACLES["redacted_copies"] = f"""WITH {REDACTED}, j AS (SELECT doc_id, string_agg('--- Page ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS text FROM red GROUP BY doc_id)
  SELECT doc_id, length(text) AS chars, md5(text) AS digest FROM j"""

# --- figures -------------------------------------------------------------------------------------

MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"
UNIT = r"(?:business\s+|calendar\s+|working\s+)?(?:days?|weeks?|months?|years?|hours?)"
FIGURES = [
    ("amount", r"(?i)[£$€]\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:million|billion|bn|m|k)\b)?"),
    ("amount", r"(?i)\b\d[\d,]*(?:\.\d+)?\s?(?:GBP|USD|EUR|pounds|dollars|euros)\b"),
    ("percent", r"(?i)\b\d+(?:\.\d+)?\s?(?:%|per\s?cent\b)"),
    ("duration", rf"(?i)\b(?:[a-z]+(?:-[a-z]+)?\s)?\(\d+\)\s*{UNIT}"),
    ("duration", rf"(?i)\b\d+\s*{UNIT}\b"),
    ("date", rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTHS}\s+\d{{4}}\b"),
    ("date", rf"(?i)\b{MONTHS}\s+\d{{1,2}},?\s+\d{{4}}\b"),
]


def figure_ctes(table: str, keys: str) -> str:
    """figs(keys, kind, v, s, e, context): of overlapping matches the longest, else the earlier pattern.

    In these texts no chain of three overlapping matches occurs, so comparing pairs is enough.
    """
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    parts = [span_cte(f"f{i}", table, keys, p) for i, (_, p) in enumerate(FIGURES)]
    union = " UNION ALL ".join(
        f"SELECT {keys}, '{k}' AS kind, {i} AS p, v, CAST(s AS BIGINT) AS s, CAST(s + length(v) AS BIGINT) AS e FROM f{i}" for i, (k, _) in enumerate(FIGURES)
    )
    before = r"[^0-9]\.\s"
    return ",\n  ".join(parts) + f""",
  allf AS MATERIALIZED ({union}),
  longest AS (SELECT * FROM allf a WHERE NOT EXISTS (SELECT 1 FROM allf b WHERE {on} AND a.s < b.e AND a.e > b.s AND (a.s, a.p) <> (b.s, b.p)
     AND (b.e - b.s > a.e - a.s OR (b.e - b.s = a.e - a.s AND b.p < a.p)))),
  {span_cte('stops', table, keys, before)},
  figs AS (SELECT l.*, regexp_replace({trim_("substr(t.text, from_ + 1, coalesce(to_, length(t.text)) - from_)")}, '^\\d+(?:\\.\\d+)*\\.?\\s+([A-Z])', '\\1') AS context
    FROM (SELECT a.*, (SELECT CAST(coalesce(max(b.s + 3), 0) AS BIGINT) FROM stops b WHERE {on} AND b.s + 1 < a.s) AS from_,
           (SELECT CAST(min(b.s + 2) AS BIGINT) FROM stops b WHERE {on} AND b.s + 1 >= a.e) AS to_ FROM longest a) l JOIN {table} t USING ({keys}))"""


FIG = f"{CONTRACT}, {CONTRACT_HEADS}, {figure_ctes('contract', 'doc_id, page')}"
FIRSTS = """firsts AS (SELECT doc_id, page, s, kind, trim(v) AS value, context FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(v)), lower(context) ORDER BY page, s) AS k FROM figs) WHERE k = 1),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, s) AS n FROM firsts)"""
ORACLES["figure_candidates"] = f"WITH {FIG}, {FIRSTS} SELECT doc_id, 'C' || n AS candidate_id, kind, value, 'S' || page AS source_id, context FROM numbered WHERE n <= 24"
ORACLES["figure_rows"] = f"""WITH {FIG}, {FIRSTS},
  sec AS (SELECT doc_id, page, coalesce(heading, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS section FROM heads),
  lab AS (SELECT *, trim(regexp_replace(coalesce(section, ''), '(?i)^(?:section|clause|article)?\\s*\\d+(?:\\.\\d+)*[.)]?\\s*', '')) AS h FROM numbered JOIN sec USING (doc_id, page) WHERE n <= 40),
  sen AS (SELECT *, CASE WHEN h <> '' AND starts_with(context, h) THEN trim(substr(context, length(h) + 1), {BLANKS}) ELSE context END AS sentence FROM lab),
  cut AS (SELECT *, greatest(0, greatest(0, instr(sentence, value) - 1) - (110 - length(value)) // 2) AS b FROM sen)
  SELECT doc_id, n, CASE kind WHEN 'percent' THEN 'percentage' ELSE kind END AS category,
    CASE WHEN h <> '' THEN h ELSE array_to_string(regexp_split_to_array(sentence, '\\s+')[1:6], ' ') END AS label, value, 'S' || page AS source,
    CASE WHEN length(sentence) <= 110 THEN sentence ELSE (CASE WHEN b > 0 THEN '…' ELSE '' END) || trim(substr(sentence, b + 1, 110), {BLANKS}) || (CASE WHEN b + 110 < length(sentence) THEN '…' ELSE '' END) END AS context
  FROM cut"""
DENSITY = (
    r"(?i)[£$€]\s?\d|\d+(?:\.\d+)?\s?%|\b\d{1,2}(?:st|nd|rd|th)?\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b"
    r"|\b(?:19|20)\d{2}\b|\(\d+\)\s*(?:days?|weeks?|months?|years?|hours?)|\b\d+\s*(?:days?|weeks?|months?|years?|hours?)\b"
)
ORACLES["extraction_batches"] = f"""WITH RECURSIVE {BM25},
  rk AS (SELECT doc_id, chunk_idx, min(lexical_rank) AS fr FROM hits GROUP BY ALL),
  pool AS (SELECT * FROM (SELECT doc_id, chunk_idx, CAST(ceil(length(text) / 3.0) AS BIGINT) + 16 AS cost,
     row_number() OVER (PARTITION BY doc_id ORDER BY regexp_matches(text, '{DENSITY}') DESC, fr ASC NULLS LAST, chunk_idx) AS position FROM chunks_ LEFT JOIN rk USING (doc_id, chunk_idx)) WHERE position <= 12),
  bw AS (SELECT doc_id, chunk_idx, position, 1 AS batch, 1 AS held, cost AS used FROM pool WHERE position = 1
    UNION ALL SELECT p.doc_id, p.chunk_idx, p.position, b.batch + CASE WHEN b.held >= 6 OR b.used + p.cost > 2000 THEN 1 ELSE 0 END,
      CASE WHEN b.held >= 6 OR b.used + p.cost > 2000 THEN 1 ELSE b.held + 1 END, CASE WHEN b.held >= 6 OR b.used + p.cost > 2000 THEN p.cost ELSE b.used + p.cost END
    FROM bw b JOIN pool p ON p.doc_id = b.doc_id AND p.position = b.position + 1)
  SELECT doc_id, chunk_idx, position, batch, 'S' || position AS source_id FROM bw"""

# An altered sum is one pound more. It is supported by a page that happens to hold that sum, which
# can only be a page of the same customer with exactly that price.
ITEMS = """items AS (SELECT o_custkey AS doc_id, o_orderkey AS item_no, 'Sum ' || (o_orderkey % 2) AS label,
    '£' || format('{:,.2f}', CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END) AS value,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS cited FROM orders),
  held AS (SELECT i.*, coalesce(max(CASE WHEN o.o_orderkey = cited THEN cited END), min(o.o_orderkey)) AS holder FROM items i
    LEFT JOIN orders o ON o.o_custkey = i.doc_id AND '£' || format('{:,.2f}', o.o_totalprice) = i.value GROUP BY ALL),
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label, value, coalesce(holder, -1) ORDER BY item_no) AS k FROM held) WHERE k = 1)"""
ORACLES["verified_items"] = f"""WITH {ITEMS} SELECT doc_id, item_no, label, value, CASE WHEN holder IS NULL THEN 's' || cited ELSE 'S' || holder END AS source,
  holder IS NOT NULL AS verified, CASE WHEN holder IS NULL THEN 'value not found in any source' END AS problem FROM kept"""
ORACLES["extraction_status"] = f"""WITH {ITEMS}, t AS (SELECT doc_id, count(*) AS rows_, count(*) FILTER (holder IS NULL) AS unverified, coalesce(string_agg(DISTINCT 'S' || holder, ',' ORDER BY 'S' || holder), '') AS cited FROM kept GROUP BY doc_id)
  SELECT c_custkey AS doc_id, coalesce(rows_, 0) AS rows, coalesce(unverified, 0) AS unverified, coalesce(cited, '') AS cited,
    CASE WHEN unverified > 0 THEN 'warning' WHEN rows_ > 0 THEN 'grounded' ELSE 'abstained' END AS status FROM customer LEFT JOIN t ON doc_id = c_custkey"""
ORACLES["allowed_labels"] = f"""WITH {ITEMS} SELECT i.doc_id, i.item_no, o.o_orderkey IS NOT NULL AS allowed FROM items i LEFT JOIN orders o ON o.o_custkey = i.doc_id AND o.o_orderkey = i.cited"""

# --- answers -------------------------------------------------------------------------------------

# The answers are made of two sentences, so the expected outcome follows from the order's numbers.
ANSWERS = """facts AS (SELECT o_orderkey AS answer_id, o_orderkey % 11 = 0 AS abst, o_orderkey % 5 = 0 AS wrong, o_orderkey % 7 = 0 AS s9, o_orderkey % 7 <> 0 AND o_orderkey % 3 = 0 AS bare,
    '£' || format('{:,.2f}', CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END) AS sum_ FROM orders),
  plain AS (SELECT *, CASE WHEN abst THEN 'abstained' WHEN s9 OR bare OR wrong THEN 'warning' ELSE 'grounded' END AS status,
    CASE WHEN abst OR s9 OR bare THEN '' ELSE 'S1' END AS cited,
    CASE WHEN abst THEN '' ELSE array_to_string(list_filter([CASE WHEN s9 THEN 'invalid-citation:S9' END, CASE WHEN s9 OR bare THEN 'no-citation' END, CASE WHEN wrong THEN 'unsupported-number:' || sum_ END], lambda x: x IS NOT NULL), ';') END AS issues FROM facts)"""
ORACLES["citation_check"] = f"WITH {ANSWERS} SELECT answer_id, status, cited, issues FROM plain"
# "Late sums bear interest." (late, sum, bear, interest: all in the source) is always attributed;
# the first sentence only when it carries no label of its own.
ORACLES["grounded_answers"] = f"""WITH {ANSWERS} SELECT answer_id,
    CASE WHEN abst THEN 'abstained' WHEN s9 OR wrong THEN 'warning' ELSE 'grounded' END AS status,
    CASE WHEN abst THEN '' ELSE 'S1' END AS cited, CASE WHEN NOT abst AND (s9 OR bare) THEN 'S1' ELSE '' END AS auto_cited,
    CASE WHEN abst THEN '' ELSE array_to_string(list_filter([CASE WHEN s9 THEN 'invalid-citation:S9' END, CASE WHEN wrong THEN 'unsupported-number:' || sum_ END], lambda x: x IS NOT NULL), ';') END AS issues,
    '' AS unsupported,
    CASE WHEN abst THEN 'The document does not mention the amount.' ELSE 'The Customer shall pay ' || sum_ || ' within thirty (30) days'
      || CASE WHEN s9 THEN ' [S9]' WHEN bare THEN ' [~S1]' ELSE ' [S1]' END || '. Late sums bear interest [~S1].' END AS content FROM plain"""
# Every page of a nation against every sentence of its answer; the second piece carries its own label.
ORACLES["pooled_answers"] = f"""WITH {CONTRACT}, src AS (SELECT c_nationkey AS answer_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY page) AS nr, text FROM contract JOIN customer ON c_custkey = doc_id),
  facts AS (SELECT answer_id, min_by(text, nr) AS first, max(CASE WHEN nr = 2 THEN text END) AS second, max_by(text, nr) AS last, {haystack("string_agg(text, chr(10) ORDER BY nr)")} AS hay,
    list(regexp_extract(text, '£([0-9,.]+[0-9])', 1)) AS prices FROM src GROUP BY answer_id),
  made AS (SELECT *, regexp_extract(first, 'after ([0-9]+) months', 1) AS months, substr(replace(coalesce(second, ''), chr(10), ' '), 1, 22) AS head,
    CASE WHEN answer_id % 5 = 0 THEN '9,000,000.00' ELSE regexp_extract(last, '£([0-9,.]+[0-9])', 1) END AS price FROM facts),
  sent AS (SELECT answer_id, unnest([1, 3, 4, 5]) AS k, unnest(['The pages say "per year after ' || months || ' months', 'The Customer shall pay £' || price || ' in the end', 'It says "the customer never pays anything at all"', 'Ships sail across seven oceans']) AS s,
    unnest([months, replace(price, ',', ''), NULL, NULL]) AS fig FROM made),
  sw AS MATERIALIZED (SELECT *, list_distinct({tokens_('s')}) AS w FROM sent),
  pw AS MATERIALIZED (SELECT answer_id, nr, list_distinct({tokens_('text')}) AS w, list_transform(regexp_extract_all(text, '[0-9][0-9,]*(\\.[0-9]+)?%?'), lambda x: replace(x, ',', '')) AS figs FROM src),
  best AS (SELECT answer_id, k, s, max(nr) AS nr FROM (SELECT answer_id, k, s, CASE WHEN score >= 0.6 THEN nr END AS nr FROM (SELECT a.answer_id, k, s, nr,
      len(list_intersect(a.w, b.w)) / len(a.w) + CASE WHEN list_contains(b.figs, fig) THEN 0.25 ELSE 0 END AS score FROM sw a JOIN pw b USING (answer_id))
    QUALIFY row_number() OVER (PARTITION BY answer_id, k ORDER BY score DESC, nr) = 1) GROUP BY ALL),
  part AS (SELECT m.*, [b.nr FOR b IN bs] AS won, list_transform(bs, lambda b: CASE WHEN b.nr IS NULL THEN b.s || '.' ELSE b.s || ' [~S' || b.nr || '].' END) AS said, list_filter(bs, lambda b: b.nr IS NULL) AS lost,
    list_filter(bs, lambda b: b.nr IS NOT NULL AND b.nr <> 1) AS auto FROM made m JOIN (SELECT answer_id, list(struct_pack(k := k, s := s, nr := nr) ORDER BY k) AS bs FROM best GROUP BY answer_id) USING (answer_id)),
  nrs AS (SELECT answer_id, string_agg(nr, ',' ORDER BY k) AS ids FROM (SELECT answer_id, 'S' || nr AS nr, min(k) AS k FROM best WHERE nr <> 1 GROUP BY ALL) GROUP BY answer_id),
  quo AS (SELECT answer_id, unnest(['per year after ' || months || ' months. ' || head, 'the customer never pays anything at all']) AS q, unnest([1, 2]) AS o, hay FROM made),
  bad AS (SELECT answer_id, string_agg('unverified-quote:' || left(q, 80), ';' ORDER BY o) AS x FROM quo WHERE NOT contains(hay, {haystack('q')}) GROUP BY answer_id)
  SELECT answer_id, 'warning' AS status, concat_ws(',', 'S1', ids) AS cited, coalesce(ids, '') AS auto_cited,
    concat_ws(';', x, CASE WHEN NOT list_contains(prices, price) THEN 'unsupported-number:£' || price END, CASE WHEN len(lost) > 0 THEN 'unsupported-sentence:' || len(lost) END) AS issues,
    array_to_string([l.s || '.' FOR l IN lost[1:3]], '|') AS unsupported,
    said[1] || ' ' || head || '" [S1]. ' || said[2] || ' ' || said[3] || ' ' || said[4] AS content
  FROM part LEFT JOIN nrs USING (answer_id) LEFT JOIN bad USING (answer_id)"""
ORACLES["quote_support"] = f"""WITH d AS MATERIALIZED (SELECT doc_id, {haystack('text')} AS h FROM documents),
  w AS (SELECT item_id, text, regexp_split_to_array(text, '\\s+') AS w FROM benchmark),
  v AS (SELECT item_id, 'whole' AS variant, text FROM w
    UNION ALL SELECT item_id, 'altered', array_to_string([CASE WHEN i = 6 THEN 'changed' ELSE w[i] END FOR i IN range(1, len(w) + 1)], ' ') FROM w
    UNION ALL SELECT item_id, 'cut', array_to_string(w[4:(len(w) - 3)], ' ') FROM w
    UNION ALL SELECT item_id, 'short', array_to_string(w[1:(item_id % 3 + 1)], ' ') FROM w),
  q AS MATERIALIZED (SELECT item_id, variant, q, string_split(q, ' ') AS w FROM (SELECT item_id, variant, {haystack('text')} AS q FROM v) WHERE trim(q) <> ''),
  g AS MATERIALIZED (SELECT *, [array_to_string(w[i:(i + 3)], ' ') FOR i IN range(1, len(w) - 2)] AS parts FROM q)
  SELECT item_id, variant, doc_id FROM g, d WHERE contains(h, q) OR (len(parts) > 0 AND len(list_filter(parts, lambda x: contains(h, x))) / len(parts) >= 0.9)"""
ORACLES["relevance"] = f"""WITH {VEC}, p AS (SELECT a.vec_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
      * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
  , s AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN sim ELSE 1.0 END AS sim FROM p)
  SELECT vec_id, round(sim, 5) AS similarity, CASE WHEN best > 0 AND sim / best < 0.95 THEN round(sim / best, 2) + 0.0 END AS off_topic FROM s JOIN vstats ON query_id = vec_id"""
ORACLES["off_topic_answers"] = f"""SELECT answer_id, CASE WHEN off_topic IS NOT NULL AND status <> 'abstained' THEN 'warning' ELSE status END AS status,
  CASE WHEN off_topic IS NULL OR status = 'abstained' THEN issues ELSE concat_ws(';', nullif(issues, ''), 'off-topic:' || off_topic) END AS issues
  FROM ({ORACLES['grounded_answers']}) LEFT JOIN ({ORACLES['relevance']}) ON vec_id = answer_id"""

# --- checklists ----------------------------------------------------------------------------------

ORACLES["checklist_choice"] = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'hipaa_baa' ELSE 'gdpr_art28' END AS checklist FROM documents"""
GDPR = [i for i in dims.CHECKLIST_ITEMS if i[0] == "gdpr_art28"]
ITEM_ROWS = ", ".join(f"({pos}, '{item}', {_list(terms)}, '{q}')" for _, pos, item, terms, q in GDPR)
AGREEMENTS = """agr AS (SELECT o_custkey AS doc_id, o_orderkey AS chunk_idx, ['The processor acts on documented instructions of the controller',
    'Personal data breaches are notified without undue delay within 24 hours', 'Personnel authorised to process are bound by confidentiality',
    'Data is deleted or returned at the end of services', 'The weather is fine and lunch is served'][o_orderkey % 5 + 1] || ' under order ' || o_orderkey || '.' AS text FROM orders)"""
EVIDENCE = f"""{AGREEMENTS}, ci(position, item_id, must, query) AS (VALUES {ITEM_ROWS}),
  tk AS MATERIALIZED (SELECT doc_id, chunk_idx, {tokens_('text')} AS ts FROM agr),
  tot AS (SELECT doc_id, count(*) AS n, avg(len(ts)) AS al FROM tk GROUP BY doc_id),
  tf AS (SELECT doc_id, chunk_idx, len, term, count(*) AS tf FROM (SELECT doc_id, chunk_idx, len(ts) AS len, unnest(ts) AS term FROM tk) GROUP BY ALL),
  df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
  it AS (SELECT DISTINCT item_id, position, unnest({tokens_('query')}) AS term FROM ci),
  sc AS (SELECT doc_id, item_id, position, chunk_idx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 9) AS score
    FROM tf JOIN df USING (doc_id, term) JOIN it USING (term) JOIN tot USING (doc_id) GROUP BY ALL),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, chunk_idx) AS lexical_rank FROM sc) WHERE lexical_rank <= 3),
  lab AS (SELECT doc_id, chunk_idx, row_number() OVER (PARTITION BY doc_id ORDER BY first, chunk_idx) AS nr FROM (SELECT doc_id, chunk_idx, min(position * 100 + lexical_rank) AS first FROM top GROUP BY ALL)),
  ev AS (SELECT doc_id, item_id, position, chunk_idx, nr, lexical_rank, score, text, must FROM top JOIN lab USING (doc_id, chunk_idx) JOIN agr USING (doc_id, chunk_idx) JOIN (SELECT item_id, must FROM ci) USING (item_id))"""
ORACLES["checklist_evidence"] = f"WITH {EVIDENCE} SELECT doc_id, item_id, chunk_idx, 'S' || nr AS source_id, lexical_rank, round(score, 5) AS score FROM ev"
# The quote is the whole best passage: found unless "99 more" was added (a figure no source has);
# a passage is held by itself only, because it names its order.
VERDICTS = f"""{EVIDENCE},
  ve AS (SELECT doc_id, item_id, nr, must, CASE WHEN doc_id % 11 = 0 THEN 'not_found' WHEN doc_id % 13 = 0 THEN 'partial' ELSE 'addressed' END AS status,
      CASE WHEN doc_id % 7 = 0 THEN 'no evidence quoted' WHEN doc_id % 5 = 0 THEN 'quoted evidence not found in the sources'
        WHEN len(list_filter(must, lambda m: contains(lower(text), m))) = 0 THEN 'evidence does not mention ' || array_to_string(list_transform(must, lambda m: '“' || m || '”'), ' or ') END AS problem
    FROM ev WHERE lexical_rank = 1),
  vd AS (SELECT doc_id, item_id, CASE WHEN status = 'not_found' THEN status WHEN problem IS NULL THEN status ELSE 'unverified' END AS verdict,
      CASE WHEN status = 'not_found' OR doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'none' ELSE 'S' || nr END AS source, CASE WHEN status <> 'not_found' THEN problem END AS problem FROM ve)"""
ORACLES["finding_verdicts"] = f"WITH {VERDICTS} SELECT doc_id, item_id, verdict, source, problem FROM vd"
ORACLES["compliance_summary"] = f"""WITH {VERDICTS} SELECT doc_id, count(*) FILTER (verdict = 'addressed') AS addressed, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'not_found') AS not_found,
    count(*) FILTER (verdict = 'unverified') AS unverified, count(*) FILTER (verdict = 'error') AS error, count(*) AS checked,
    coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (verdict IN ('addressed', 'partial')), '') AS cited, 8 - count(*) AS not_run,
    CASE WHEN count(*) FILTER (verdict IN ('unverified', 'error')) > 0 THEN 'warning' ELSE 'grounded' END AS status FROM vd GROUP BY doc_id"""
ORACLES["eval_compliance"] = f"""WITH {VERDICTS}, k AS (SELECT c_custkey AS doc_id, position, item_id, (c_custkey + position) % 2 = 0 AS present FROM customer, ci),
  j AS (SELECT k.*, verdict FROM k LEFT JOIN vd USING (doc_id, item_id))
  SELECT item_id, count(*) FILTER (CASE WHEN present THEN verdict IN ('addressed', 'partial') ELSE verdict IN ('not_found', 'unverified') END) AS correct,
    count(*) FILTER (NOT present AND verdict IN ('addressed', 'partial')) AS false_positives, count(*) AS checks FROM j GROUP BY item_id"""

# --- conversations -------------------------------------------------------------------------------

FOLLOW = rf"(?i)^\s*{FOLLOW_UP_START}\b|\b{FOLLOW_UP_WORDS}\b"
ORACLES["previous_question"] = f"""WITH p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM conversations)
  SELECT conv_id, turn, md5(coalesce(prev, '')) AS previous, coalesce(prev, '') <> '' AND (regexp_matches(text, '{FOLLOW}') OR len({words('text')}) <= 1) AS extended FROM p"""


def plan_ctes(window: int, with_document: bool) -> str:
    """One plan per user turn; ``kept`` has the turns of each, by the question's place ``pos``."""
    most = 2 if with_document else 10**6
    budget = f"{window} - 768 - 96 - 300 - CAST(ceil(length(text) / 3.0) AS BIGINT)"
    share = "floor(budget * 0.25)" if with_document else "budget"
    return f"""cl AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN {strip_cites('text')} ELSE text END AS text FROM conversations WHERE coalesce(text, '') <> ''),
  pl AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM cl),
  cur AS (SELECT conv_id, turn, pos, text AS question, {budget} AS budget FROM pl WHERE role = 'user'),
  sp AS (SELECT c.conv_id, c.turn, c.pos, c.pos - p.pos AS age, p.role, p.text, budget, sum(CAST(ceil(length(p.text) / 3.0) AS BIGINT) + 4) OVER (PARTITION BY c.conv_id, c.pos ORDER BY p.pos DESC) AS spent
    FROM cur c JOIN pl p ON p.conv_id = c.conv_id AND p.pos < c.pos AND p.pos >= c.pos - {most}),
  kept AS (SELECT * FROM sp WHERE spent <= {share}),
  plan_ AS (SELECT conv_id, turn, question, budget, CAST(coalesce(k, 0) AS BIGINT) AS kept_turns, pos - coalesce(k, 0) AS dropped_turns, CAST(greatest(0, budget - coalesce(u, 0) - 40) AS BIGINT) AS source_budget, budget < 0 AS too_long
    FROM cur LEFT JOIN (SELECT conv_id, turn, count(*) AS k, max(spent) AS u FROM kept GROUP BY ALL) USING (conv_id, turn))"""


ORACLES["history_plan"] = f"WITH {plan_ctes(4096, True)} SELECT * EXCLUDE (question) FROM plan_"
ORACLES["history_plan_free"] = f"WITH {plan_ctes(2048, False)} SELECT * EXCLUDE (question) FROM plan_"
# Searched with the question before where it reads like a follow-up, under the plan's own budget.
ORACLES["question_sources"] = f"""WITH RECURSIVE {DOC_CHUNKS}, {plan_ctes(4096, True)},
  prv AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM conversations),
  asked AS (SELECT conv_id || ':' || turn AS query_id, conv_id AS doc_id, question AS text, source_budget AS b,
      CASE WHEN coalesce(prev, '') <> '' AND (regexp_matches(question, '{FOLLOW}') OR len({words('question')}) <= 1) THEN question || chr(10) || prev ELSE question END AS q
    FROM plan_ JOIN (SELECT * FROM prv WHERE role = 'user') USING (conv_id, turn) WHERE NOT too_long AND conv_id IN (SELECT doc_id FROM chunks_)),
  tok AS MATERIALIZED (SELECT doc_id, chunk_idx, {tokens_("CASE WHEN section IS NULL THEN text ELSE repeat(section || chr(10), 3) || text END")} AS ts FROM chunks_ WHERE doc_id IN (SELECT doc_id FROM asked)),
  n AS (SELECT doc_id, count(*) AS chunks, avg(len(ts)) AS avg_len FROM tok GROUP BY doc_id),
  tfs AS (SELECT doc_id, chunk_idx, len, term, count(*) AS tf FROM (SELECT doc_id, chunk_idx, len(ts) AS len, unnest(ts) AS term FROM tok) GROUP BY ALL),
  dfs AS (SELECT doc_id, term, count(*) AS df FROM tfs GROUP BY ALL),
  qt AS (SELECT DISTINCT query_id, doc_id, unnest({tokens_('q')}) AS term FROM asked),
  cov AS (SELECT query_id, count(df) AS matched, count(*) AS total FROM qt LEFT JOIN dfs USING (doc_id, term) GROUP BY query_id),
  sc AS (SELECT query_id, doc_id, chunk_idx, round(sum(ln(1 + (chunks - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / greatest(avg_len, 1e-9)))), 9) AS score
    FROM qt JOIN dfs USING (doc_id, term) JOIN tfs USING (doc_id, term) JOIN n USING (doc_id) GROUP BY ALL),
  modes AS (SELECT query_id, doc_id, CASE WHEN regexp_matches(text, '{SUMMARY_RE}') THEN 'summary'
      WHEN coalesce(total, 0) > 0 AND matched = 0 AND chunks >= 12 THEN 'abstain' ELSE 'search' END AS mode, b FROM asked JOIN n USING (doc_id) LEFT JOIN cov USING (query_id)),
  cost AS (SELECT doc_id, chunk_idx, CAST(ceil(length(text) / 3.0) AS BIGINT) + 16 AS cost FROM chunks_),
  ranked AS (SELECT query_id, chunk_idx, cost, b, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_idx) AS r FROM sc WHERE score > 0)
    JOIN cost USING (doc_id, chunk_idx) JOIN (SELECT query_id, b FROM modes WHERE mode = 'search') USING (query_id) WHERE r <= 20),
  {_under_budget('got', 'ranked', 'query_id', 6, 'b')},
  picked AS (SELECT query_id, chunk_idx, 'S' || held AS source_id FROM got WHERE took),
  rest AS (SELECT query_id, doc_id, b FROM modes WHERE mode <> 'abstain' AND query_id NOT IN (SELECT query_id FROM picked)),
  st AS (SELECT query_id, doc_id, b, n, greatest(1, least(n, 8, CAST(floor(b / mean) AS BIGINT))) AS k FROM rest JOIN (SELECT doc_id, count(*) AS n, avg(cost) AS mean FROM cost GROUP BY doc_id) USING (doc_id)),
  want AS (SELECT DISTINCT query_id, doc_id, b, CASE WHEN k = 1 THEN 0 ELSE CAST(floor(i * (n - 1) / (k - 1.0) + 0.5) AS BIGINT) END AS chunk_idx FROM (SELECT *, unnest(range(0, k)) AS i FROM st)),
  even AS (SELECT query_id, chunk_idx, cost, b, row_number() OVER (PARTITION BY query_id ORDER BY chunk_idx) AS r FROM want JOIN cost USING (doc_id, chunk_idx)),
  {_under_budget('walk2', 'even', 'query_id', 8, 'b')},
  src AS (SELECT query_id, chunk_idx, source_id FROM picked UNION ALL SELECT query_id, chunk_idx, 'S' || held FROM walk2 WHERE took)
  SELECT m.query_id, m.doc_id, CASE WHEN mode = 'search' AND rest.query_id IS NOT NULL THEN 'sample' ELSE mode END AS mode, chunk_idx, source_id
  FROM modes m LEFT JOIN rest ON rest.query_id = m.query_id LEFT JOIN src ON src.query_id = m.query_id"""
ORACLES["prompt_table"] = f"""WITH RECURSIVE {DOC_CHUNKS}, {plan_ctes(4096, True)},
  ask AS (SELECT conv_id, turn, source_budget AS b FROM plan_ WHERE NOT too_long),
  cc AS (SELECT doc_id AS conv_id, chunk_idx, page, section, text, CAST(ceil(length(text) / 3.0) AS BIGINT) + 16 AS cost FROM chunks_),
  sizes_ AS (SELECT conv_id, turn, b, count(*) AS n, greatest(1, least(count(*), 8, CAST(floor(b / avg(cost)) AS BIGINT))) AS k FROM ask JOIN cc USING (conv_id) GROUP BY conv_id, turn, b),
  want AS (SELECT DISTINCT conv_id, turn, b, CASE WHEN k = 1 THEN 0 ELSE CAST(floor(i * (n - 1) / (k - 1.0) + 0.5) AS BIGINT) END AS chunk_idx FROM (SELECT *, unnest(range(0, k)) AS i FROM sizes_)),
  steps AS (SELECT conv_id, turn, b, chunk_idx, cost, row_number() OVER (PARTITION BY conv_id, turn ORDER BY chunk_idx) AS r FROM want JOIN cc USING (conv_id, chunk_idx)),
  sampled AS (SELECT conv_id, turn, chunk_idx, r, cost <= b AS took, CASE WHEN cost <= b THEN cost ELSE 0 END AS used, CASE WHEN cost <= b THEN 1 ELSE 0 END AS held FROM steps WHERE r = 1
    UNION ALL SELECT s.conv_id, s.turn, s.chunk_idx, s.r, w.used + s.cost <= b, w.used + CASE WHEN w.used + s.cost <= b THEN s.cost ELSE 0 END, w.held + CASE WHEN w.used + s.cost <= b THEN 1 ELSE 0 END
    FROM sampled w JOIN steps s ON s.conv_id = w.conv_id AND s.turn = w.turn AND s.r = w.r + 1),
  blk AS (SELECT conv_id, turn, string_agg('[S' || held || '] (' || concat_ws(' · ', 'p. ' || page, section) || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_idx) AS src
    FROM sampled JOIN cc USING (conv_id, chunk_idx) WHERE took GROUP BY ALL),
  hist AS (SELECT conv_id, turn, string_agg(role || ': ' || text, chr(10) || '---' || chr(10) ORDER BY age DESC) AS h, count(*) AS k FROM kept GROUP BY ALL)
  SELECT conv_id, turn, 2 + coalesce(k, 0) AS messages, md5(concat_ws(chr(10) || '---' || chr(10), 'system: Answer from the sources.' || coalesce(chr(10) || chr(10) || 'SOURCES:' || chr(10) || chr(10) || src || chr(10) || chr(10) || 'END OF SOURCES', ''), h, 'user: ' || question)) AS digest
  FROM plan_ LEFT JOIN blk USING (conv_id, turn) LEFT JOIN hist USING (conv_id, turn) WHERE NOT too_long"""
ORACLES["prompts_with_examples"] = f"""WITH {plan_ctes(2048, False)}, {QA},
  ex AS ({ORACLES['similar_examples']}),
  blk AS (SELECT question_id, string_agg('Q: ' || question || chr(10) || 'A: ' || CASE WHEN rating = 'down' THEN correction ELSE {strip_cites('answer')} END, chr(10) || chr(10) ORDER BY place) AS b
    FROM ex JOIN qa USING (id) GROUP BY question_id),
  hist AS (SELECT conv_id, turn, string_agg(role || ': ' || text, chr(10) || '---' || chr(10) ORDER BY age DESC) AS h, count(*) AS k FROM kept GROUP BY ALL)
  SELECT conv_id, turn, 2 + coalesce(k, 0) AS messages, md5(concat_ws(chr(10) || '---' || chr(10), 'system: Answer briefly.' || coalesce(chr(10) || chr(10) || 'EXAMPLES' || chr(10) || chr(10) || b || chr(10) || chr(10) || 'END OF EXAMPLES', ''), h, 'user: ' || question)) AS digest
  FROM plan_ LEFT JOIN blk ON question_id = conv_id * 1000 + turn LEFT JOIN hist USING (conv_id, turn) WHERE NOT too_long"""
ORACLES["latest_threads"] = """WITH t AS (SELECT conv_id AS id, CASE WHEN conv_id % 3 > 0 THEN 'w' || (conv_id % 3) ELSE 'default' END AS workspace, arg_min(text, turn) AS f, max(turn) AS updated_at FROM conversations GROUP BY conv_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY updated_at DESC, id DESC) AS n FROM t)
  SELECT workspace, id, CASE WHEN length(f) > 40 THEN left(f, 40) || '…' ELSE f END AS title, updated_at FROM r WHERE n = 1"""
ORACLES["deleted_threads"] = """SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')"""

# --- feedback ------------------------------------------------------------------------------------

RATED = f"""ev AS (SELECT user_id || ':' || (event_id % 4) AS id, event_id, ts, CASE event_type WHEN 'click' THEN 'up' ELSE 'down' END AS rating, {_list([*dims.REASONS, 'bogus'])}[event_id % 7 + 1] AS reason,
    CASE WHEN event_id % 2 = 0 THEN 'corrected by ' || user_id END AS corr, CASE WHEN event_id % 5 = 0 THEN 'extract' ELSE 'qa' END AS intent, 'question ' || (event_id % 4) AS question, 'answer ' || event_id || ' [S1].' AS answer, 'doc' || (user_id % 3) AS doc
  FROM events WHERE event_type IN ('click', 'error')),
  num AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS n FROM ev),
  walkf AS (WITH RECURSIVE r AS (SELECT id, event_id, n, rating AS state FROM num WHERE n = 1
      UNION ALL SELECT x.id, x.event_id, x.n, CASE WHEN x.rating = 'up' AND r.state = 'up' THEN NULL ELSE x.rating END FROM r JOIN num x ON x.id = r.id AND x.n = r.n + 1) SELECT * FROM r),
  fs AS (SELECT e.id, e.event_id, e.rating, CASE WHEN e.rating = 'down' AND reason <> 'bogus' THEN reason ELSE '' END AS reasons, CASE WHEN e.rating = 'down' THEN coalesce(corr, '') ELSE '' END AS correction, intent, question, answer, doc
    FROM walkf w JOIN ev e USING (id, event_id) WHERE state IS NOT NULL AND n = (SELECT max(n) FROM num m WHERE m.id = w.id))"""
ORACLES["feedback_state"] = f"WITH {RATED} SELECT id, event_id, rating, reasons, correction FROM fs"
ORACLES["feedback_totals"] = f"WITH {RATED} SELECT count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down, count(*) FILTER (correction <> '') AS corrected FROM fs"
ORACLES["eval_candidates"] = f"WITH {RATED} SELECT doc, question AS q, correction AS expect, reasons, answer AS rejected_answer FROM fs WHERE rating = 'down' AND correction <> '' AND intent = 'qa'"
ORACLES["feedback_export"] = f"WITH {RATED} SELECT id, correction || ' mail [EMAIL REDACTED]' AS correction FROM fs"

# --- metrics and quotas --------------------------------------------------------------------------


def _pick(values, by: str) -> str:
    return f"{_list(values)}[{by} % {len(values)} + 1]"


METRIC = f"""me AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'feedback' ELSE 'answer' END AS kind, {_pick(dims.INTENTS, 'event_id')} AS intent, {_pick(dims.STATUSES, 'user_id')} AS status,
    [{_pick(dims.ISSUE_KINDS, 'event_id')}, {_pick(dims.ISSUE_KINDS, 'user_id')}] AS issues, CASE event_type WHEN 'click' THEN {_pick(dims.RATINGS, 'event_id')} END AS rating,
    CASE event_type WHEN 'click' THEN [{_pick(dims.REASONS, 'event_id')}] ELSE [] END AS reasons, CAST(floor(value * 100) AS BIGINT) AS latency_ms,
    CASE WHEN event_id % 17 = 0 THEN 'unknown field' WHEN event_id % 11 = 0 THEN 'intent' WHEN event_id % 23 = 0 THEN 'status' WHEN event_id % 19 = 0 THEN 'issues' WHEN event_id % 13 = 0 THEN 'model'
      WHEN floor(value * 100) NOT BETWEEN 0 AND 3600000 THEN 'latency_ms' WHEN event_id % 29 = 0 THEN 'tokens_per_sec' END AS problem FROM events),
  ok AS (SELECT * FROM me WHERE problem IS NULL)"""
ORACLES["metric_accept_reject"] = f"WITH {METRIC} SELECT event_id, problem FROM me"
ANSWERED = "SELECT intent, status, count(*) AS answers, CAST(trunc(avg(latency_ms)) AS BIGINT) AS avg_latency_ms FROM ok WHERE kind = 'answer' GROUP BY intent, status"
RATINGS_ = "SELECT intent, rating, count(*) AS ratings FROM ok WHERE kind = 'feedback' GROUP BY intent, rating"
DOWN = "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM ok WHERE kind = 'feedback' AND rating = 'down') GROUP BY reason"
ISSUES_ = "SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM ok WHERE kind = 'answer') GROUP BY issue"
ORACLES["metric_answers"] = f"WITH {METRIC} {ANSWERED}"
ORACLES["metric_ratings"] = f"WITH {METRIC} {RATINGS_}"
ORACLES["metric_histograms"] = f"WITH {METRIC} SELECT 'reason' AS kind, reason AS item, n FROM ({DOWN}) UNION ALL SELECT 'issue', issue, n FROM ({ISSUES_})"
ORACLES["metric_summary"] = f"""WITH {METRIC} SELECT 'events' AS section, NULL AS intent, NULL AS item, count(*) AS n, NULL AS avg_latency_ms FROM ok
  UNION ALL SELECT 'answers', intent, status, answers, avg_latency_ms FROM ({ANSWERED}) UNION ALL SELECT 'feedback', intent, rating, ratings, NULL FROM ({RATINGS_})
  UNION ALL SELECT 'down_reasons', NULL, reason, n, NULL FROM ({DOWN}) UNION ALL SELECT 'issues', NULL, issue, n, NULL FROM ({ISSUES_})"""
ORACLES["built_events"] = """SELECT event_id, CASE event_type WHEN 'click' THEN 'feedback' ELSE 'answer' END AS kind,
  CASE WHEN event_id % 3 = 0 THEN 'chat' WHEN event_id % 3 = 1 THEN 'qa' WHEN user_id % 2 = 0 THEN 'qa' ELSE 'chat' END AS intent, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE 'warning' END AS status,
  'off-topic,no-citation' AS issues, 'Modelv1' || (user_id % 3) AS model, CAST(greatest(0, least(3600000, floor((value - 10) * 100000 + 0.5))) AS BIGINT) AS latency_ms,
  round(greatest(0, least(10000, value * 1000)), 3) AS tokens_per_sec, CASE event_type WHEN 'click' THEN 'up' END AS rating, CASE event_type WHEN 'click' THEN 'wrong' ELSE '' END AS reasons FROM events"""
# Offsets of the four zones in January; the unknown one counts as UTC.
DATED = """dated AS (SELECT event_id, ts, user_id, CAST(ts + CASE user_id % 4 WHEN 1 THEN INTERVAL 14 HOUR WHEN 2 THEN INTERVAL (-11) HOUR ELSE INTERVAL 0 HOUR END AS DATE) AS day FROM events)"""
USAGE = "SELECT user_id, CAST(day AS VARCHAR) AS day, count(*) AS messages FROM dated GROUP BY user_id, day"
ORACLES["daily_usage"] = f"WITH {DATED} {USAGE}"
ORACLES["quota_decisions"] = f"""WITH {DATED}, n AS (SELECT *, CASE WHEN user_id % 4 <> 3 THEN user_id % 4 + 1 END AS lim, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS n FROM dated)
  SELECT event_id, lim IS NULL OR n <= lim AS accepted, CASE WHEN lim IS NULL THEN n ELSE least(n, lim) END AS used, CASE WHEN lim IS NOT NULL THEN greatest(0, lim - least(n, lim)) END AS left_today,
    CASE WHEN lim IS NOT NULL THEN greatest(0, lim - least(n, lim)) <= 3 END AS warn FROM n"""
PRICED = [f"{plan}_{interval}ly" for plan, interval, _ in dims.PRICES] + ["unlisted"]
LIMIT = "CASE plan WHEN 'free' THEN 1 WHEN 'pro' THEN 3 END"
ORACLES["quota_plan_changes"] = f"""WITH RECURSIVE {DATED},
  sn AS (SELECT event_id, ts, user_id, 'sub_' || user_id || '_' || (event_id % 3) AS sub,
    CASE WHEN event_type IN ('signup', 'purchase', 'view') THEN CASE split_part({_list(PRICED)}[event_id % {len(PRICED)} + 1], '_', 1) WHEN 'unlisted' THEN NULL ELSE split_part({_list(PRICED)}[event_id % {len(PRICED)} + 1], '_', 1) END END AS plan FROM events),
  hd AS (SELECT *, last_value(CASE WHEN plan IS NOT NULL THEN sub END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM sn),
  ch AS (SELECT user_id, ts, event_id, coalesce(plan, 'free') AS plan FROM hd WHERE plan IS NOT NULL OR sub = held),
  un AS (SELECT user_id, ts, event_id, 1 AS kind, NULL::VARCHAR AS plan, day FROM dated UNION ALL SELECT user_id, ts, event_id, 0, plan, NULL::DATE FROM ch),
  ms AS (SELECT * FROM (SELECT *, coalesce(last_value(plan IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, kind, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'free') AS now FROM un) WHERE kind = 1),
  nb AS (SELECT event_id, user_id, day, {LIMIT.replace("plan", "now")} AS lim, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS n FROM ms),
  wq AS (SELECT event_id, user_id, day, n, lim, lim IS NULL OR 0 < lim AS accepted, CASE WHEN lim IS NULL OR 0 < lim THEN 1 ELSE 0 END AS used FROM nb WHERE n = 1
    UNION ALL SELECT x.event_id, x.user_id, x.day, x.n, x.lim, x.lim IS NULL OR w.used < x.lim, w.used + CASE WHEN x.lim IS NULL OR w.used < x.lim THEN 1 ELSE 0 END
    FROM wq w JOIN nb x ON x.user_id = w.user_id AND x.day = w.day AND x.n = w.n + 1)
  SELECT event_id, lim AS "limit", accepted, used FROM wq"""
ORACLES["rate_limited"] = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  r AS (SELECT event_id, user_id, n, true AS accepted, [ts] AS held FROM e WHERE n = 1
    UNION ALL SELECT event_id, user_id, n, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, ts) ELSE live END FROM (
      SELECT e.event_id, e.user_id, e.n, e.ts, list_filter(r.held, lambda h: e.ts - h <= INTERVAL 6 HOUR) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
  SELECT event_id, accepted FROM r"""

# --- accounts ------------------------------------------------------------------------------------

PLAN_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v)) for v in p) + ")" for p in dims.PLANS)
ENTITLED = f"""pl(plan, daily_messages, documents, max_documents, max_document_pages, large_models, save_history, passphrase_lock, pii_scan, pii_redaction, checklists) AS (VALUES {PLAN_ROWS}),
  acc AS (SELECT c_custkey AS user_id, c_name AS display_name, ['free', 'pro', 'business', 'enterprise', 'free'][c_nationkey % 5 + 1] AS plan,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'sme' WHEN 'MACHINERY' THEN 'enterprise' WHEN 'AUTOMOBILE' THEN 'founder' ELSE 'personal' END AS kind FROM customer),
  base AS (SELECT *, CASE plan WHEN 'free' THEN ['personal'] WHEN 'pro' THEN {_list(dims.BROWSER_TYPES)} ELSE {_list(dims.USER_TYPES)} END AS b FROM acc),
  ent AS (SELECT base.* EXCLUDE (b, kind), pl.* EXCLUDE (plan), array_to_string(CASE WHEN list_contains(b, kind) THEN b ELSE list_append(b, kind) END, ',') AS workspaces FROM base JOIN pl USING (plan))"""
ORACLES["entitlements"] = f"WITH {ENTITLED} SELECT user_id, plan, daily_messages, max_documents, max_document_pages, large_models, checklists, workspaces FROM ent"
ORACLES["entitlement_gates"] = f"""WITH {PAGES}, {TOTALS}, {ENTITLED}, o AS (SELECT doc_id % 150 AS user_id, doc_id, page_count, row_number() OVER (PARTITION BY doc_id % 150 ORDER BY doc_id) AS n FROM totals_)
  SELECT user_id, doc_id, CASE WHEN NOT documents THEN 'documents need an account' WHEN n > max_documents THEN 'too many documents' WHEN page_count > max_document_pages THEN 'too many pages' END AS reason FROM o JOIN ent USING (user_id)"""
ORACLES["feature_gates"] = f"""WITH {ENTITLED} SELECT user_id, list_contains(string_split(workspaces, ','), 'sme') AS workspace_allowed, user_id % 2 <> 0 OR large_models AS model_allowed,
  user_id % 3 <> 0 OR checklists AS checklist_allowed FROM ent"""
ORACLES["account_summary"] = f"""WITH {DATED}, {ENTITLED}, u AS (SELECT user_id, count(*) AS m FROM dated WHERE day = DATE '2024-01-10' GROUP BY user_id)
  SELECT user_id, display_name, plan, coalesce(m, 0) AS used_today, CASE WHEN daily_messages IS NOT NULL THEN greatest(0, daily_messages - coalesce(m, 0)) END AS left_today FROM ent LEFT JOIN u USING (user_id)"""
KEYS = [f"{p}_{i}ly" for p, i, _ in dims.PRICES] + ["unlisted"]
ORACLES["subscription_state"] = f"""WITH RECURSIVE s AS (SELECT user_id, event_id, ts, 'sub_' || user_id || '_' || (event_id % 3) AS sub, CASE event_type WHEN 'signup' THEN 'trialing' WHEN 'purchase' THEN 'active' WHEN 'view' THEN 'past_due' WHEN 'click' THEN 'canceled' ELSE 'unpaid' END AS st,
    {_list(KEYS)}[event_id % {len(KEYS)} + 1] AS k, ts + INTERVAL 30 DAY AS pe, event_id % 4 = 0 AS ca, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  l AS (SELECT *, st IN ('trialing', 'active', 'past_due') AND k <> 'unlisted' AS live FROM s),
  r AS (SELECT user_id, 0::BIGINT AS n, 'free' AS plan, NULL::VARCHAR AS sub, NULL::VARCHAR AS st, NULL::VARCHAR AS iv, NULL::TIMESTAMP AS pe, false AS ca FROM (SELECT DISTINCT user_id FROM l)
    UNION ALL SELECT l.user_id, l.n, CASE WHEN skip THEN plan WHEN live THEN split_part(k, '_', 1) ELSE 'free' END, CASE WHEN skip THEN osub WHEN live THEN l.sub END, CASE WHEN skip THEN ost ELSE l.st END,
      CASE WHEN skip THEN oiv WHEN live THEN left(split_part(k, '_', 2), -2) END, CASE WHEN skip THEN ope WHEN live THEN l.pe END, CASE WHEN skip THEN oca WHEN live THEN l.ca ELSE false END
    FROM (SELECT l.*, r.plan, r.sub AS osub, r.st AS ost, r.iv AS oiv, r.pe AS ope, r.ca AS oca, NOT l.live AND r.sub IS NOT NULL AND r.sub <> l.sub AS skip FROM r JOIN l ON l.user_id = r.user_id AND l.n = r.n + 1) l)
  SELECT user_id AS customer_id, plan, sub AS subscription_id, st AS status, iv AS interval, pe AS renews_at, ca AS cancel_at_period_end FROM r WHERE n = (SELECT max(n) FROM l WHERE l.user_id = r.user_id)"""
ORACLES["valid_sessions"] = """SELECT o_orderkey AS request_id, o_custkey AS user_id FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1998-01-01'"""
ORACLES["live_links"] = """WITH t AS (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'verify' ELSE 'reset' END AS purpose, event_id, ts FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, purpose ORDER BY ts DESC, event_id DESC) AS n FROM t)
  SELECT user_id, purpose, event_id AS token_id FROM r WHERE n = 1 AND event_id % 5 <> 0 AND ts + INTERVAL 12 DAY > TIMESTAMP '2024-01-20'"""
ORACLES["erasure"] = f"WITH {DATED}, {ENTITLED} {USAGE.replace('FROM dated', 'FROM dated WHERE user_id NOT IN (SELECT user_id FROM ent WHERE plan = $$free$$)')}"
ORACLES["account_checks"] = """SELECT c_custkey AS user_id, 'user' || (c_custkey // 2) || CASE WHEN c_custkey % 9 = 0 THEN ' at x.org' ELSE '@x.org' END AS email,
  CASE WHEN c_custkey % 9 = 0 THEN 'email' WHEN c_custkey % 20 < 10 THEN 'password' WHEN c_nationkey = 3 THEN 'user_type' END AS problem FROM customer"""
ORACLES["account_uniqueness"] = """SELECT 'user' || (c_custkey // 3) || '@x.org' AS email, count(*) AS accounts, min(c_custkey) AS user_id FROM customer GROUP BY 1 HAVING count(*) > 1"""

# --- intents -------------------------------------------------------------------------------------

GRAMS = r"""wd AS (SELECT conv_id * 1000 + turn AS key, role AS label, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM conversations),
  gr AS (SELECT key, label, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM wd),
  tc AS (SELECT key, label, term, count(*) AS tf FROM gr GROUP BY ALL),
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM wd)) / (1 + count(*))) + 1 AS idf FROM tc GROUP BY term),
  rw AS (SELECT key, label, term, (1 + ln(tf)) * idf AS raw FROM tc JOIN idf USING (term)),
  ft AS (SELECT key, label, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)) AS weight FROM rw)"""
ORACLES["intent_features"] = f"WITH {GRAMS} SELECT key, term, round(weight, 6) AS weight FROM ft"
ORACLES["intent_scores"] = f"""WITH {GRAMS}, cf AS (SELECT term, label, sum(weight) AS c FROM ft GROUP BY ALL), cl(label, b) AS (VALUES ('assistant', 0.0), ('system', 0.1), ('user', 0.2)),
  z AS (SELECT f.key, cl.label, b + coalesce(sum(f.weight * cf.c), 0) AS z FROM ft f JOIN cl ON true LEFT JOIN cf ON cf.term = f.term AND cf.label = cl.label GROUP BY f.key, cl.label, b),
  p AS (SELECT key, label, exp(z) / sum(exp(z)) OVER (PARTITION BY key) AS p FROM z)
  SELECT key, round(max(p) FILTER (label = 'assistant'), 5) AS assistant, round(max(p) FILTER (label = 'system'), 5) AS system, round(max(p) FILTER (label = 'user'), 5) AS user FROM p GROUP BY key"""
ORACLES["router_held_out"] = "SELECT count(*) AS texts, true AS accurate FROM documents WHERE lang IS NOT NULL AND doc_id % 4 = 0"
ROUTED = f"""nn AS (SELECT *, conv_id + turn AS n FROM conversations WHERE role = 'user'),
  pp AS (SELECT *, n * 3 % 10 + 1.0 AS compliance, n * 7 % 10 + 1.0 AS extract, (n * 11 % 10 + 1.0) * 2 AS general, n * 9 % 10 + 1.0 AS qa, n % 10 + 1.0 AS summary FROM nn),
  pr AS (SELECT conv_id, turn, n, text, [compliance / t, extract / t, general / t, qa / t, summary / t] AS p FROM (SELECT *, CAST(compliance + extract + general + qa + summary AS DOUBLE) AS t FROM pp)),
  tp AS (SELECT *, ['compliance', 'extract', 'general', 'qa', 'summary'][list_position(p, list_max(p))] AS top, list_max(p) AS c,
      regexp_matches(CASE WHEN n % 4 = 0 THEN 'overview' ELSE text END, '{SUMMARY_RE}') AS s FROM pr),
  routed AS (SELECT conv_id, turn, CASE WHEN conv_id % 6 = 0 THEN 'chat' WHEN s AND top IN ('qa', 'summary') THEN 'summary' WHEN top = 'general' AND c >= 0.5 AND n % 5 / 10.0 < 0.15 THEN 'general' WHEN top = 'general' OR c < 0.45 THEN 'qa' ELSE top END AS intent,
    round(CASE WHEN conv_id % 6 = 0 THEN 1 WHEN s AND top IN ('qa', 'summary') THEN greatest(c, p[5]) WHEN top = 'general' AND NOT (c >= 0.5 AND n % 5 / 10.0 < 0.15) THEN p[4] ELSE c END, 6) AS confidence,
    CASE WHEN conv_id % 6 = 0 THEN 'no document loaded' WHEN s AND top IN ('qa', 'summary') THEN 'summary phrasing' WHEN top = 'general' AND c >= 0.5 AND n % 5 / 10.0 < 0.15 THEN 'unrelated to the document'
      WHEN top = 'general' THEN 'possibly general, but shares vocabulary with the document' WHEN c < 0.45 THEN 'low confidence for ' || top ELSE 'router' END AS reason FROM tp)"""
ORACLES["routed_messages"] = f"WITH {ROUTED} SELECT conv_id, turn, intent, confidence, reason FROM routed"

# --- evaluation ----------------------------------------------------------------------------------

RECALL = f"""{BENCH}, {DOC_CHUNKS}, {bm25_ctes('chunks_', 'doc_id, chunk_idx', 'bench', 6)},
  hit AS (SELECT b.query_id, coalesce(bool_or(contains(regexp_replace(c.text, '\\s+', ' ', 'g'), regexp_replace(b.text, '\\s+', ' ', 'g'))), false) AS hit
    FROM bench b LEFT JOIN hits h USING (query_id) LEFT JOIN chunks_ c USING (doc_id, chunk_idx) GROUP BY b.query_id)"""
ORACLES["eval_recall"] = f"WITH {RECALL} SELECT count(*) AS questions, count(*) FILTER (hit) AS hits, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS recall FROM hit"
ORACLES["eval_misses"] = f"WITH {RECALL} SELECT query_id FROM hit WHERE NOT hit"
ORACLES["eval_routing"] = f"""WITH {ROUTED} SELECT count(*) AS questions, count(*) FILTER (intent = CASE WHEN conv_id % 2 = 0 THEN 'qa' ELSE 'general' END) AS correct,
  count(*) FILTER (intent = 'general' AND conv_id % 2 = 0) AS leaks FROM routed"""
ORACLES["eval_extraction"] = """SELECT o_orderkey AS question, '£' || format('{:,.2f}', o_totalprice) AS value, true AS found FROM orders UNION ALL SELECT o_orderkey, '£' || format('{:,.2f}', o_totalprice + 1), false FROM orders"""
ORACLES["eval_answers"] = f"""WITH {ANSWERS} SELECT count(*) AS answers, count(*) FILTER (NOT abst AND NOT wrong) AS correct, count(*) FILTER (status = 'grounded') AS grounded,
  count(*) FILTER (NOT abst) AS leaked FROM plain"""
ORACLES["eval_unrelated"] = f"WITH {ANSWERS} SELECT answer_id % 4 = 0 OR status <> 'grounded' AS ok, count(*) AS answers FROM plain GROUP BY 1"
ORACLES["eval_regressions"] = """WITH t AS (SELECT event_type AS metric, count(*) AS value FROM events GROUP BY 1), m AS (SELECT avg(value) AS mean FROM t)
  SELECT metric, value, round(mean, 6) AS recorded FROM t, m WHERE value < mean"""

# --- streams: the same tables as in batch --------------------------------------------------------

ORACLES["stream_period_answers"] = f"""WITH {METRIC} SELECT strftime(ts, '%Y-%m-%d') AS period, intent, status, count(*) AS answers, CAST(trunc(avg(latency_ms)) AS BIGINT) AS avg_latency_ms
  FROM ok JOIN events USING (event_id) WHERE kind = 'answer' GROUP BY ALL"""
ORACLES["stream_metric_summary"] = ORACLES["metric_summary"]
ORACLES["stream_metric_ingest"] = ORACLES["metric_accept_reject"]
ORACLES["stream_rate_limit"] = ORACLES["rate_limited"]
ORACLES["stream_quota"] = f"SELECT event_id, accepted, used FROM ({ORACLES['quota_decisions']})"
# Every seventh event has an unknown type; users with even ids are linked by a checkout event or not at all.
STREAMED = """FROM (SELECT * FROM events WHERE event_id % 7 <> 0 AND (user_id % 2 = 1 OR user_id IN (SELECT user_id FROM events WHERE event_id % 7 <> 0 AND event_id % 11 = 3)))"""
ORACLES["stream_subscriptions"] = f"SELECT * EXCLUDE (renews_at) FROM ({ORACLES['subscription_state'].replace('FROM events', STREAMED)})"
