"""SQL twins of the registered queries that SQL can express."""

from __future__ import annotations

_BLANK = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP10_LINE_DEDUP = f"""
WITH lines AS (
  SELECT d, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT row_number() OVER () AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts
        FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, {_BLANK}), {_AZ}) AS key FROM lines
), shared AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT d) >= 10
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE s.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL), ''))
         AS kept_sha256
FROM keyed LEFT JOIN shared s USING (key)
GROUP BY d, doc_id
"""

OP3_NGRAM_JACCARD = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM docs
), classes AS (
  SELECT s, len(s) AS n, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY s
), elements AS (
  SELECT node, n, unnest(s) AS e FROM classes
), overlap_of AS (
  SELECT a.node AS x, b.node AS y, a.n + b.n AS both_n, count(*) AS o
  FROM elements a JOIN elements b ON a.e = b.e AND a.node < b.node
   AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (
  SELECT x, y FROM overlap_of WHERE 100 * o >= 80 * (both_n - o)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT node, node FROM classes UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
), least_of AS (
  SELECT x AS node, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles,
       CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE l.component_id END AS component_id
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN least_of l USING (node)
"""

#: The anchors, written out again so that the query's own list is checked too.
_ANCHORS = """a al an and are as at au auf be by con dans das de del dem den der des die du ein eine
el en es est et for from für il in is ist it la las le les los mit nicht no of on or para por pour
que qui se sich sur that the this to un una und une von was with y zu"""

OP9_SPOTSIGS = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t,
         row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, '')) DESC) - 1 AS pos
  FROM documents
), pairs AS (
  SELECT a.pos, a.doc_id, a.t, length(a.t) // 2 AS half, b.t AS nt, b.pos AS npos
  FROM docs a JOIN docs b ON b.pos = (a.pos + 1) % (SELECT count(*) FROM docs)
), texts AS (
  SELECT pos, 'own' AS kind, t FROM docs
  UNION ALL
  SELECT pos, 'edited', left(t, length(t) - half) || left(nt, half) FROM pairs
), words AS (
  SELECT pos, kind, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i
  FROM (SELECT pos, kind, regexp_extract_all(translate(translate(t, {_AZ}), chr(1), chr(2)),
               '[^\\x20\\x09-\\x0D]+') AS w FROM texts)
), marked AS (
  SELECT *, i < n AND word IN ({", ".join(f"'{w}'" for w in _ANCHORS.split())}) AS anchor FROM words
), grouped AS (
  SELECT *, sum(CASE WHEN anchor THEN 0 ELSE 1 END) OVER (PARTITION BY pos, kind ORDER BY i)
            + CASE WHEN anchor THEN 1 ELSE 0 END AS g FROM marked
), content AS (
  SELECT pos, kind, g, string_agg(word, chr(1) ORDER BY i) AS whole,
         max(word) FILTER (WHERE NOT anchor) AS word, count(*) > 1 AS spot
  FROM grouped GROUP BY pos, kind, g
), chains AS (
  SELECT pos, kind, spot, whole
         || coalesce(' ' || lead(word, 1) OVER o, '') || coalesce(' ' || lead(word, 2) OVER o, '') AS chain
  FROM content WINDOW o AS (PARTITION BY pos, kind ORDER BY g)
), found AS (
  SELECT pos, kind, list_sort(list_distinct(list(substr(md5(chain), 1, 12)))) AS sigs
  FROM chains WHERE spot GROUP BY pos, kind
), sigs AS (
  SELECT t.pos, t.kind, t.t, coalesce(f.sigs, [substr(md5(t.t), 1, 12)]) AS s
  FROM texts t LEFT JOIN found f USING (pos, kind)
)
SELECT p.doc_id, length(p.t) AS n_chars, sha256(e.t) AS edited_sha256,
       array_to_string(o.s, '') AS fingerprint, array_to_string(e.s, '') AS edited_fingerprint,
       len(list_intersect(o.s, e.s)) / (len(o.s) + len(e.s) - len(list_intersect(o.s, e.s))) AS near_edited,
       len(list_intersect(o.s, x.s)) / (len(o.s) + len(x.s) - len(list_intersect(o.s, x.s))) AS near_next
FROM pairs p JOIN sigs o ON o.pos = p.pos AND o.kind = 'own'
JOIN sigs e ON e.pos = p.pos AND e.kind = 'edited'
JOIN sigs x ON x.pos = p.npos AND x.kind = 'own'
"""

#: Unsigned CRC-32 of a decimal number, a byte and a bit at a time.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(
    list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"""

OP11_PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL
), named AS (
  SELECT conv_id, turn, md5(strlen(r) || ':' || r || t) AS id, strlen(t) AS size FROM turns
), own AS (
  SELECT conv_id, list({{'id': id, 'size': size}} ORDER BY turn NULLS FIRST, id) AS s FROM named GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.s[1:o.h], []), o.s[o.h+1:]) AS s
  FROM (SELECT *, conv_id - conv_id % 5 AS base, {_CRC.format("conv_id")} % 9 AS h FROM own) o
  LEFT JOIN own b ON b.conv_id = o.base
), steps AS (
  SELECT conv_id, len(s) AS n, s, unnest(range(len(s) + 1)) AS d FROM rebuilt
), prefixes AS (
  SELECT conv_id, n, d, list_reduce(list_prepend('', list_transform(s[1:d], lambda x: x.id)), lambda a, b: a || b) AS path,
         CASE WHEN d = 0 THEN 0 ELSE s[d].size END AS size
  FROM steps
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends
  FROM prefixes GROUP BY path, d
), kids AS (
  SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), up AS (
  SELECT left(n.path, 32 * k) AS path, n.saved, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf
  FROM (SELECT *, unnest(range(d + 1)) AS k FROM nodes) n LEFT JOIN kids c ON c.path = n.path
), below AS (
  SELECT path, sum(saved)::BIGINT AS saved, sum(leaf)::BIGINT AS leaves FROM up GROUP BY path
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       b.leaves AS n_leaves, b.saved AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below b USING (path) LEFT JOIN kids k USING (path)
LEFT JOIN nodes p ON n.d > 0 AND p.path = left(n.path, 32 * (n.d - 1)) AND p.d = n.d - 1
"""

#: Fixed values, written out again so that the query's own list is checked too: phrases, then notices.
_NOTICES = """mit|1|[under the mit license]
apache-2|1|[apache license version 2]
cc-by-nc|1|[cc by nc]
agpl-3|0|licensed under the [gnu affero general public license version 3]
apache-2|0|licensed under the [apache license version 2] 0
apache-2|0|you may obtain a copy of the license at http www [apache org licenses license 2] 0
boost-1|0|distributed under the [boost software license version 1] 0
bsd|0|[redistribution and use in source and binary forms] with or without modification are permitted
cc-by|0|licensed under [cc by 4] 0
cc-by|0|creative commons [attribution 4 0 international] license
cc-by-nc|0|licensed under [cc by nc] 4 0
cc-by-nc|0|creative commons [attribution noncommercial] 4 0 international license
cc-by-sa|0|licensed under [cc by sa] 4 0
cc-by-sa|0|creative commons [attribution sharealike] 4 0 international license
cc0|0|[cc0 1 0 universal] public domain dedication
epl-2|0|under the terms of the [eclipse public license 2] 0
gpl-2|0|under the terms of the [gnu general public license version 2]
gpl-3|0|licensed under the [gnu general public license version 3]
isc|0|[permission to use copy modify and or distribute this software] for any purpose
lgpl-3|0|licensed under the [gnu lesser general public license version 3]
mit|0|released under the [mit license]
mit|0|[permission is hereby granted free of charge] to any person obtaining a copy of this software
mpl-2|0|subject to the terms of the [mozilla public license v 2] 0
unlicense|0|this is [free and unencumbered software] released into the public domain
zlib|0|this software is provided [as is without any express or implied warranty]"""

OP13_LICENSE_SCAN = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws
  FROM documents
), lines AS (
  SELECT i AS tpl, string_split(l, '|') AS f
  FROM (SELECT unnest(string_split('{_NOTICES}', chr(10))) AS l, unnest(range(25)) AS i)
), tokens AS (
  SELECT tpl, f[1] AS label, f[2] = '1' AS phrase, unnest(string_split(f[3], ' ')) AS t,
         unnest(range(len(string_split(f[3], ' ')))) AS k FROM lines
), marks AS (
  SELECT *, sum(CASE WHEN starts_with(t, '[') THEN 1 ELSE 0 END) OVER (PARTITION BY tpl ORDER BY k)
          - sum(CASE WHEN ends_with(t, ']') THEN 1 ELSE 0 END) OVER (PARTITION BY tpl ORDER BY k)
          + CASE WHEN ends_with(t, ']') THEN 1 ELSE 0 END AS inside FROM tokens
), tw AS (
  SELECT tpl, label, phrase, k, trim(t, '[]') AS word, inside > 0 AS must FROM marks
), occ AS (
  SELECT r, word, i FROM (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM docs)
  WHERE word IN (SELECT word FROM tw)
), weight AS (
  SELECT w.word, 1 + CAST(floor(1000 * ln(((SELECT count(*) FROM docs) + 1) / (count(DISTINCT o.r) + 1))) AS BIGINT) AS idf
  FROM (SELECT DISTINCT word FROM tw) w LEFT JOIN occ o USING (word) GROUP BY w.word
), hits AS (
  SELECT o.r, t.tpl, any_value(t.label) AS label, any_value(t.phrase) AS phrase, o.i - t.k AS place,
         count(*) FILTER (WHERE t.must) AS n_must, sum(w.idf) AS got
  FROM occ o JOIN tw t USING (word) JOIN weight w USING (word) GROUP BY o.r, t.tpl, o.i - t.k
), needs AS (
  SELECT tpl, count(*) FILTER (WHERE must) AS n_must, sum(idf) AS whole FROM tw JOIN weight USING (word) GROUP BY tpl
), found AS (
  SELECT h.*, h.got / n.whole AS share FROM hits h JOIN needs n ON n.tpl = h.tpl AND n.n_must = h.n_must
  WHERE h.got / n.whole >= 0.6
), digest AS (
  SELECT r, count(*) FILTER (WHERE phrase) AS n_base, min(place) FILTER (WHERE phrase) AS first_word,
         max(place) FILTER (WHERE phrase) AS last_word, max(share) AS score,
         array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE phrase))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
  FROM found GROUP BY r
)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(g.n_base, 0) AS n_base, g.first_word, g.last_word,
       coalesce(g.base_labels, '') AS base_labels, coalesce(g.labels, '') AS labels, coalesce(g.score, 0.0) AS score
FROM docs d LEFT JOIN digest g USING (r)
"""

ORACLES = {
    "op11_prefix_trie": OP11_PREFIX_TRIE,
    "op13_license_scan": OP13_LICENSE_SCAN,
    "op9_spotsigs": OP9_SPOTSIGS,
    "op3_ngram_jaccard": OP3_NGRAM_JACCARD,
    "op10_line_dedup": OP10_LINE_DEDUP,
}
