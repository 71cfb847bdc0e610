"""DuckDB forms of the operators that SQL can express."""

from __future__ import annotations

from .chat import CONTROL

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


def _words(name: str, table: str, key: str, text: str, pattern: str) -> str:
    """A CTE with one row for each word: key, word, position from 1."""
    return f"""{name} AS (
        SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) AS p
        FROM (SELECT {key}, regexp_extract_all({text}, {pattern}) AS w FROM {table} WHERE text IS NOT NULL))"""


def _frame(key: str, size: int, words: str = "word") -> str:
    return f"string_agg({words}, ' ') OVER (PARTITION BY {key} ORDER BY p ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)"


def _count(key: str, size: int) -> str:
    return f"count(*) OVER (PARTITION BY {key} ORDER BY p ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)"


ARCHIVE = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
    FROM f"""

LINKS = f"""
    WITH RECURSIVE {_words('w', 'documents', 'doc_id', _FOLD.format('text'), _SPACED)},
    n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
    g AS (SELECT doc_id, p, {_frame('doc_id', 5)} AS gram, {_count('doc_id', 5)} AS have FROM w),
    s AS (SELECT DISTINCT g.doc_id, gram FROM g JOIN n USING (doc_id) WHERE have = 5 OR (n.n < 5 AND p = 1)),
    c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT gram FROM s GROUP BY gram HAVING count(*) > 1),
    t AS (SELECT * FROM s WHERE gram IN (SELECT gram FROM shared)),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM t a JOIN t b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT i.a, i.b FROM i JOIN c x ON x.doc_id = i.a JOIN c y ON y.doc_id = i.b WHERE 100 * i.n >= 75 * (x.n + y.n - i.n)),
    r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
    SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id, coalesce(k.n, 0) AS n_links
    FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
    LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM l GROUP BY a) k ON k.doc_id = d.doc_id"""

_ADDED = " + ".join(f"3 * ((length(text) - length(replace(text, '{c}', ''))) // {len(c)})" for c in CONTROL)
CHAT = f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    f AS (SELECT *, length(role) + 24 + length(text) + length(text) - length(replace(text, '\\', '')) + {_ADDED} AS chars FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM f GROUP BY conv_id"""

SUBSTRINGS = f"""
    WITH {_words('w', 'documents', 'doc_id', 'text', _SPACED)},
    g AS (SELECT *, md5({_frame('doc_id', 35)}) AS window_hash, {_count('doc_id', 35)} AS have FROM w),
    many AS (SELECT window_hash FROM g WHERE have = 35 GROUP BY window_hash HAVING count(*) > 1),
    f AS (SELECT doc_id, p, word, CASE WHEN have = 35 AND window_hash IN (SELECT window_hash FROM many) THEN 1 ELSE 0 END AS starts FROM g),
    c AS (SELECT *, max(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
    a AS (SELECT doc_id, count(*) AS n, CAST(sum(gone) AS BIGINT) AS removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id"""

_SIZES = " UNION ALL ".join(
    f"SELECT w.doc_id, w.p, {k} AS size, b.item_id FROM (SELECT doc_id, p, {_frame('doc_id', k)} AS gram, {_count('doc_id', k)} AS have FROM w) w JOIN (SELECT DISTINCT item_id, gram FROM bw WHERE size = {k}) b ON b.gram = w.gram AND w.have = {k}"
    for k in range(1, 11)
)
CONTAMINATION = f"""
    WITH {_words('w', 'documents', 'doc_id', _FOLD.format('text'), _ALNUM)},
    {_words('v', 'benchmark', 'item_id', _FOLD.format('text'), _ALNUM)},
    vn AS (SELECT item_id, count(*) AS n FROM v GROUP BY item_id),
    bw AS (SELECT x.item_id, gram, CAST(least(n, 10) AS BIGINT) AS size FROM (SELECT item_id, p, {_frame('item_id', 10)} AS gram, {_count('item_id', 10)} AS have FROM v) x JOIN vn ON vn.item_id = x.item_id WHERE have = 10 OR (n < 10 AND p = 1)),
    m AS ({_SIZES}),
    h AS (SELECT doc_id, unnest(range(p, p + size)) AS p FROM (SELECT DISTINCT doc_id, p, size FROM m)),
    hn AS (SELECT doc_id, count(DISTINCT p) AS n FROM h GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
    wn AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id)
    SELECT d.doc_id, coalesce(wn.n, 0) AS n_words, coalesce(hn.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hn.n, 0) > 0 AS contaminated
    FROM documents d LEFT JOIN wn ON wn.doc_id = d.doc_id LEFT JOIN hn ON hn.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""

RANKING = f"""
    WITH {_words('w', 'documents', 'doc_id', _FOLD.format('text'), _TERMS)},
    {_words('v', 'benchmark', 'item_id', _FOLD.format('text'), _TERMS)},
    q AS (SELECT DISTINCT item_id, word FROM v),
    d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
    a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
    t AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word IN (SELECT word FROM q) GROUP BY 1, 2),
    f AS (SELECT word, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, a GROUP BY word, docs),
    s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score
          FROM q JOIN t USING (word) JOIN f USING (word) JOIN d USING (doc_id), a GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""

# The unsigned CRC-32 of a run's id and text, bit by bit over its UTF-8 bytes.
_BYTES = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))"
VARIANTS = f"""
    WITH RECURSIVE w AS (SELECT doc_id, unnest(regexp_extract_all({_FOLD.format('text')}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
    u AS (SELECT doc_id, run, count(*) AS k, {_BYTES.format("doc_id || ':' || run")} AS b FROM w GROUP BY doc_id, run),
    h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(8 * len(b)), lambda i: CAST((b[i // 8 + 1] >> (i % 8)) & 1 AS BIGINT))),
                 lambda a, d: xor(a >> 1, 3988292384 * (xor(a, d) & 1))), 4294967295) AS h FROM u),
    o AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM h),
    v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM o WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
    cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
    e AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT c.word, c.n, v.word, v.n FROM cut c JOIN v ON c.rest = v.word
          UNION SELECT v.word, v.n, c.word, c.n FROM cut c JOIN v ON c.rest = v.word),
    r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM e),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
          FROM v LEFT JOIN r ON r.word = v.word AND place = 1),
    c(word, last) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL)
    SELECT f.*, c.last AS root FROM f JOIN c ON c.word = f.word JOIN f AS z ON z.word = c.last AND z.form IS NULL"""

ORACLES = {
    "op2_warc": ARCHIVE,
    "op5_jaccard_join": LINKS,
    "op6_chat_format": CHAT,
    "op7_substring_dedup": SUBSTRINGS,
    "op9_decontaminate": CONTAMINATION,
    "op12_spelling_variants": VARIANTS,
    "op13_ranked_search": RANKING,
}
