"""SQL counterparts of the training-data queries, for DuckDB, where SQL can express them."""

from __future__ import annotations

from parchment.llm.chat_format import PART
from parchment.llm.queries import SHARDS
from parchment.llm.sharding import SLOTS, fill_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '{_TERM}'), lambda w: translate(w, '{_UPPER}', '{_LOWER}'))"


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}) || ':' || {f} END" for f in fields) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of all levels (tree, level, k, n, digest), and the runs of three they form, as lists."""
    return f"""
        {name} AS (
            SELECT tree, 0 AS level, k, n, digest FROM {leaves}
            UNION ALL
            SELECT tree, level + 1, k // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY k)) FROM {name} WHERE n > 1
            GROUP BY tree, level, k // 3, n
        ),
        {name}_run AS (SELECT tree, level, k // 3 AS up, list(digest ORDER BY k) AS run FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _path_sql(name: str, tree: str, start: str) -> str:
    """From rows (row_id, tree, k, folded, siblings) level by level to the root of their tree."""
    return f"""
        {name} AS (
            SELECT row_id, tree, 0 AS level, k, folded, siblings FROM {start}
            UNION ALL
            SELECT row_id, p.tree, p.level + 1, p.k // 3,
                sha256(array_to_string(run[:(p.k % 3)], '') || folded || array_to_string(run[(p.k % 3 + 2):], '')),
                siblings || array_to_string(run[:(p.k % 3)], '') || array_to_string(run[(p.k % 3 + 2):], '')
            FROM {name} p JOIN {tree}_run r ON r.tree = p.tree AND r.level = p.level AND r.up = p.k // 3
        )"""


_CRC32 = """(SELECT list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(coalesce(doc_id::VARCHAR, ''), '') IF c <> '']),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT FOR i IN range(8)]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

ORACLES = {
    "op2_decontamination": f"""
        WITH i AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
        p AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM i WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, w[k:(k + 9)] AS win FROM p),
        sizes AS (SELECT DISTINCT len(win) AS size FROM win),
        d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
        place AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes),
        hit AS (SELECT doc_id, k, size, item_id FROM (SELECT doc_id, k, size, w[k:(k + size - 1)] AS win FROM place) JOIN win USING (win)),
        n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) FROM hit) GROUP BY doc_id),
        ids AS (SELECT doc_id, list(DISTINCT item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
            sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)
    """,
    # The fill of the table is compared with a plain simulation in tests/llm; here it is given.
    "op6_sharding": f"""
        WITH t AS (SELECT [{", ".join(str(SHARDS.index(s)) for s in fill_table(SHARDS))}] AS k),
        d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INT AS slot FROM documents)
        SELECT doc_id, slot, format('shard-{{:03d}}', k[slot + 1]) AS shard FROM d, t
    """,
    "op8_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, replace(coalesce(text, ''), '<|im_end|>', '<| im_end|>') AS text,
                CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS who
            FROM conversations
        ),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, text) - 1 AS k FROM t),
        p AS (SELECT DISTINCT conv_id, who AS perspective FROM t),
        m AS (
            SELECT conv_id, perspective, k, k // {PART} AS part, who,
                CASE WHEN who = perspective THEN '<|im_start|>assistant' ELSE '<|im_start|>user name=' || who END
                    || chr(10) || replace(text, '<|im_start|>', '<| im_start|>') || '<|im_end|>' || chr(10) AS msg
            FROM n JOIN p USING (conv_id)
        ),
        e AS (SELECT *, sum(length(msg)) OVER (PARTITION BY conv_id, perspective, part ORDER BY k) AS fin FROM m),
        g AS (
            SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(msg, '' ORDER BY k) AS text,
                string_agg((fin - length(msg) + 22)::VARCHAR || '-' || (fin - 1)::VARCHAR, ',' ORDER BY k) FILTER (who = perspective) AS mask
            FROM e GROUP BY ALL
        )
        SELECT conv_id, perspective, part, n_turns, text, coalesce(mask, '') AS mask, coalesce(sum(length(text)) OVER (
            PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
        FROM g
    """,
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
    """,
    "op12_dual_tree": f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS w FROM documents),
        c AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM d),
        p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
        q AS MATERIALIZED (SELECT i, item_id, unnest(list_distinct({_terms("text")})) AS term FROM (SELECT *, row_number() OVER () AS i FROM benchmark)),
        v AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term),
        m AS (SELECT r, doc_id, 50 + (50 * len(w) * docs) // terms AS m FROM d, c),
        s AS (
            SELECT i, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
            FROM q JOIN v USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL
        ),
        o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
    """,
    "op13_merkle": f"""
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
                -- The complement at the end of a crc32 turns its last bit over.
                CASE WHEN {_CRC32} % 2 = 1 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS changed
            FROM documents
        ),
        l AS MATERIALIZED (
            SELECT *, row_number() OVER () AS row_id, coalesce('v' || source, 'n') AS tree, leaf AS digest,
                row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY source) AS n
            FROM d
        ),
        {_tree_sql("low", "l")},
        s AS MATERIALIZED (
            SELECT tree AS name, '' AS tree, digest, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS n FROM low WHERE n = 1
        ),
        {_tree_sql("high", "s")},
        a AS (SELECT row_id, tree, k, changed AS folded, '' AS siblings FROM l),
        {_path_sql("lower_path", "low", "a")},
        b AS (
            SELECT row_id, s.tree, s.k, folded, siblings FROM (SELECT * FROM lower_path QUALIFY level = max(level) OVER (PARTITION BY row_id)) p
            JOIN s ON s.name = p.tree
        ),
        {_path_sql("upper_path", "high", "b")},
        e AS (SELECT * FROM upper_path QUALIFY level = max(level) OVER (PARTITION BY row_id)),
        r AS (SELECT digest AS root FROM high WHERE n = 1)
        SELECT doc_id, leaf, s.digest AS subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM l JOIN e USING (row_id) JOIN s ON s.name = l.tree, r
    """,
}
