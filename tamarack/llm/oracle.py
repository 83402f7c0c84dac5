"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_scan import NAMING, PHRASES, TEMPLATES

_BITS = " + ".join(f"CAST(substr(bits, i * 5 + {k + 1}, 1) AS INTEGER) * {16 >> k}" for k in range(5))
WARC = f"""WITH coded AS (SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits FROM pages),
    digests AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1)), '') AS payload_digest FROM coded),
    grouped AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response_id, md5(concat_ws('|', page_id, payload_digest)) AS m FROM digests)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response_id THEN response_id END AS refers_to,
        concat('<urn:uuid:', substr(m, 1, 8), '-', substr(m, 9, 4), '-', substr(m, 13, 4), '-', substr(m, 17, 4), '-', substr(m, 21, 12), '>') AS record_id, true AS digest_ok FROM grouped"""  # fmt: skip

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_TEMPLATE_ROWS = ", ".join(f"('{label}', {sorted(set(text.split()))}, CAST({NAMING.get(label, '').split()} AS VARCHAR[]), {-int(-len(text.split()) / 0.8 // 1)})" for label, text in TEMPLATES)
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM words, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in PHRASES
)
LICENSES = f"""WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    words AS (SELECT doc_id, regexp_extract_all(t, {_WORDS}) AS w FROM lowered),
    hits AS ({_HITS}),
    base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY 1),
    templates(label, words, naming, span) AS (VALUES {_TEMPLATE_ROWS}),
    blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), {_WORDS})) AS w FROM lowered),
    places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE list_has_any(w, (SELECT list_distinct(flatten(list(words))) FROM templates))),
    windows AS (SELECT doc_id, label, list_distinct(w[i:i + span - 1]) AS w, t.words, naming FROM places, templates t WHERE list_contains(t.words, w[i])),
    tried AS (SELECT doc_id, label, b.w, t.words, naming FROM blocks b, templates t WHERE list_has_any(b.w, t.words) UNION ALL SELECT doc_id, label, w, words, naming FROM windows),
    met AS (SELECT doc_id, label, len(list_intersect(w, words)) / CAST(len(words) AS DOUBLE) AS share FROM tried WHERE len(list_intersect(w, words)) >= 0.8 * len(words) AND list_has_all(w, naming)),
    more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM met GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
    FROM words LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""  # fmt: skip

_CRC_ROW = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295)"
TRIE = f"""WITH turns AS (SELECT conv_id, turn, substr(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32) AS digest, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list(digest || ':' || bytes ORDER BY turn NULLS FIRST, digest) AS seq FROM turns GROUP BY 1),
    crc_table AS (SELECT list_transform(range(256), lambda x: {_CRC_ROW}) AS crc),
    headed AS (SELECT conv_id, seq, CAST({_CRC} % 9 AS BIGINT) AS h FROM own, crc_table),
    rebuilt AS (SELECT o.conv_id, list_concat(coalesce(list_slice(b.seq, 1, h), []), list_slice(o.seq, h + 1, len(o.seq))) AS seq FROM headed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
    prefixes AS (SELECT conv_id, d, array_to_string(list_slice(seq, 1, d), '|') AS key, array_to_string(list_slice(seq, 1, d - 1), '|') AS above, d = len(seq) AS ends, CASE WHEN d > 0 THEN CAST(split_part(seq[d], ':', 2) AS BIGINT) ELSE 0 END AS bytes FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
    nodes AS (SELECT d, key, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) * (count(*) - 1) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY 1, 2),
    children AS (SELECT d - 1 AS d, above AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
    valued AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (d, key)),
    totals AS (SELECT p.d, p.key, count(*) FILTER (v.n_children = 0) AS n_leaves, CAST(sum(v.saved) AS BIGINT) AS saved_tokens FROM valued v JOIN prefixes p ON p.conv_id = v.conv_id AND p.d <= v.d GROUP BY 1, 2)
    SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256 FROM valued v JOIN totals t USING (d, key) LEFT JOIN nodes u ON v.d > 0 AND u.d = v.d - 1 AND u.key = v.above"""  # fmt: skip

ORACLES: dict[str, str] = {"op2_warc": WARC, "op9_license_scan": LICENSES, "op12_prefix_trie": TRIE}
