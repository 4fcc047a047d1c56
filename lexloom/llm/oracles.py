"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"

OP4 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.c::DOUBLE[], r.c::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id AND len(q.c) = len(r.c)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP7 = f"""
WITH sized AS (
    SELECT doc_id, source, len({WORDS.format('text')})::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
    FROM sized GROUP BY source
), c AS (
    SELECT *, 3 * source_size AS cap,
           sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS rest,
           sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest_weight
    FROM s WINDOW b AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, cap * rest_weight <= weight * rest AS capped FROM c),
t AS (
    SELECT source, source_size,
           CASE WHEN capped THEN cap::DOUBLE
                ELSE (weight * (sum(source_size) OVER () - coalesce(sum(cap) FILTER (capped) OVER (), 0)))::DOUBLE
                     / (sum(weight) FILTER (NOT capped) OVER ()) END AS target
    FROM f
), r AS (
    SELECT sized.doc_id, sized.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1 END AS rate,
           ('0x' || substr(md5('7' || chr(1) || concat_ws(chr(2), sized.doc_id::VARCHAR, sized.digest)), 1, 8))::BIGINT
               / 4294967296.0 AS draw
    FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP8 = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE
        WHEN len(words) = 0 THEN []
        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles
    FROM w
), classes AS (
    SELECT min(doc_id) AS node, len(shingles) AS n, list_sort(shingles) AS shingles
    FROM sets WHERE len(shingles) > 0 GROUP BY list_sort(shingles), len(shingles)
), entries AS (
    SELECT node, n, unnest(shingles) AS shingle FROM classes
), pairs AS (
    SELECT a.node AS a, b.node AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.node < b.node
         AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
    GROUP BY a.node, b.node
), links AS (
    SELECT a, b FROM pairs WHERE 100 * common >= 75 * (na + nb - common)
    UNION SELECT b, a FROM pairs WHERE 100 * common >= 75 * (na + nb - common)
), reach(node, seen) AS (
    SELECT node, node FROM classes
    UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
), lowest AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(l.component, s.doc_id) AS component_id,
       s.doc_id = coalesce(l.component, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON list_sort(s.shingles) = c.shingles LEFT JOIN lowest l ON l.node = c.node
"""

OP9 = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, {WORDS.format('text')} AS words FROM documents
), windows AS (
    SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS gram
    FROM d, (VALUES (3), (10)) AS sizes(size), unnest(range(1, len(words) - size + 2)) AS r(i)
), twice AS (
    SELECT doc_id, size, i FROM windows
    QUALIFY count(*) OVER (PARTITION BY doc_id, size, gram) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT CASE WHEN size = 3 THEN place END) AS c3,
           count(DISTINCT CASE WHEN size = 10 THEN place END) AS c10
    FROM (SELECT doc_id, size, unnest(range(i, i + size)) AS place FROM twice) GROUP BY doc_id
), lim AS (
    SELECT doc_id, words, greatest(1, (30 * len(words)) // 100 + 1) AS longer FROM d
), long_windows AS (
    SELECT doc_id, hash(words[i:i + longer - 1]) AS h FROM lim, unnest(range(1, len(words) - longer + 2)) AS r(i)
), too_long AS (
    SELECT DISTINCT doc_id FROM (SELECT doc_id FROM long_windows GROUP BY doc_id, h HAVING count(*) > 1)
), lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS dup
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
    SELECT d.doc_id, len(words)::BIGINT AS n_words,
           coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(c3, 0)::BIGINT AS n_repeat_words,
           coalesce(c10, 0)::BIGINT AS covered_words, t.doc_id IS NOT NULL AS too_long
    FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN too_long t USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * covered_words <= 30 * n_words AND NOT too_long AS kept
FROM base
"""


OP11 = r"""
WITH RECURSIVE bits(b, c, k) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL SELECT b, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8
), t AS (SELECT b, c FROM bits WHERE k = 8),
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL
), named AS (SELECT *, row_number() OVER () AS id, concat(doc_id, ':', run) AS name FROM runs),
-- A checksum is the exclusive or of what each byte adds at its distance from the end, and of the checksum of zeros.
share(d, b, c) AS (
    SELECT 0, b, c FROM t
    UNION ALL
    SELECT s.d + 1, s.b, xor(s.c >> 8, t.c) FROM share s JOIN t ON t.b = s.c & 255
    WHERE s.d < (SELECT max(strlen(name)) FROM named)
), zeros(n, c) AS (
    SELECT 0, 4294967295
    UNION ALL
    SELECT z.n + 1, xor(z.c >> 8, t.c) FROM zeros z JOIN t ON t.b = z.c & 255 WHERE z.n < (SELECT max(strlen(name)) FROM named)
), bytes AS (
    SELECT id, size, unnest(range(size)) AS i, x FROM (SELECT id, strlen(name) AS size, hex(encode(name)) AS x FROM named)
), sums AS (
    SELECT id, any_value(size) AS size, bit_xor(share.c::BIGINT)::BIGINT AS c
    FROM bytes JOIN share ON share.d = size - 1 - i AND share.b = ('0x' || substr(x, 2 * i + 1, 2))::BIGINT GROUP BY id
), checked AS (
    SELECT run, named.n, xor(xor(sums.c, zeros.c::BIGINT), 4294967295::BIGINT) AS h
    FROM named JOIN sums USING (id) JOIN zeros ON zeros.n = size
), damaged AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
    FROM checked
), words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM words, unnest(range(1, length(word) + 1)) AS r(i)),
deleted AS (SELECT DISTINCT c.word AS long_word, w.word AS short_word FROM cuts c JOIN words w ON w.word = c.head || c.tail),
near AS (
    SELECT long_word AS word, short_word AS other FROM deleted
    UNION ALL SELECT short_word, long_word FROM deleted
    UNION ALL SELECT a.word, b.word FROM cuts a JOIN cuts b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
), best AS (
    SELECT near.word, count(*) AS n_near, min({'less': -w.n, 'other': w.word}) AS best
    FROM near JOIN words w ON w.word = near.other GROUP BY near.word
), forms AS (
    SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
           CASE WHEN -best.less >= 10 * n THEN best.other END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n
    FROM words LEFT JOIN best USING (word)
), chain(word, last, step) AS (
    SELECT word, word, 0 FROM forms
    UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL
), ends AS (SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN ends USING (word)
"""

_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""

OP12 = f"""
WITH numbered AS (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents),
tf AS (SELECT row_no, doc_id, term, count(*) AS tf FROM (SELECT row_no, doc_id, {_TERMS} FROM numbered) GROUP BY ALL),
sizes AS (SELECT row_no, sum(tf)::BIGINT AS n FROM tf GROUP BY row_no),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
factor AS (SELECT row_no, 75 + (25 * n * n_docs) // n_terms AS m FROM sizes, whole),
weight AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term
),
asked AS (SELECT item_no, item_id, {_TERMS} FROM (SELECT row_number() OVER () AS item_no, item_id, text FROM benchmark)),
scored AS (
    SELECT item_no, any_value(item_id) AS item_id, row_no, any_value(tf.doc_id) AS doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN factor USING (row_no) GROUP BY item_no, row_no
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def _found(place: int, kind: str, pattern: str, kept: str = "true", before: str = "") -> str:
    """Rows of the spans of one kind: matches are put between two marks, and lengths between marks summed up."""
    marked = rf"regexp_replace(text, '{before}({pattern})', '{chr(92) + '1' if before else ''}' || chr(57344) || '\{2 if before else 1}' || chr(57345), 'g')"
    return f"""
    SELECT row_no, {place} AS place, '{kind}' AS kind, start, start + length(found) AS stop FROM (
        SELECT row_no, split_part(segs[i], chr(57345), 1) AS found,
               (length(segs[1]) + coalesce(list_sum(list_transform(segs[2:i - 1], lambda s: length(s) - 1)), 0))::BIGINT AS start
        FROM (SELECT row_no, string_split({marked}, chr(57344)) AS segs FROM texts), unnest(range(2, len(segs) + 1)) AS r(i)
    ) WHERE {kept}"""


_ANY_CASE = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")
)
_ASSIGN = rf"""(?:{_ANY_CASE})["'']?\x20*[:=]\x20*["'']?"""
_KINDS = " UNION ALL ".join(
    (
        _found(0, "assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(found, '^{_ASSIGN}([A-Za-z0-9+/_.=-]+)', 1)) >= 6"),
        _found(1, "access", "AKIA[A-Z0-9]+", "length(found) >= 20"),
        _found(2, "hex", "[0-9a-f]+", "length(found) >= 24"),
        _found(3, "keyblock", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*"),
        _found(4, "webtoken", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*", before="(^|[^A-Za-z0-9_-])"),
        _found(5, "vendor", r"gh[opsur]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"),
    )
)
_LISTED = "coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, place){}, '')"

OP13 = f"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_KINDS})
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
       count(*) FILTER (place = 2) AS n_hex, sha256({_LISTED.format(" FILTER (place < 3)")}) AS base_sha256, {_LISTED.format(" FILTER (place >= 0)")} AS spans
FROM texts LEFT JOIN spans USING (row_no) GROUP BY row_no
"""

ORACLES = {
    "op4_va_top_k": OP4,
    "op7_mix_sources": OP7,
    "op8_minhash_near_dedup": OP8,
    "op9_repetition_rules": OP9,
    "op11_spelling_variants": OP11,
    "op12_ranked_search": OP12,
    "op13_secret_scan": OP13,
}
