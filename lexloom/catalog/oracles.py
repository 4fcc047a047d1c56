"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from lexloom.functions.hints import OFFENSES
from lexloom.functions.languages import LOCALES, SCRIPT_BLOCKS, script_pattern
from lexloom.functions.text import UNICODE_SPACES
from lexloom.operators.requests import TRANSCRIPT_MODEL
from lexloom.operators.context import EXPLAIN_ROLE, EXPLAIN_TOKENS, GUIDANCE_ROLE, GUIDANCE_TOKENS

SPACES = "||".join(f"chr({ord(char)})" for char in UNICODE_SPACES)
LANGUAGES = ("de", "en", "es", "fr")


def literal(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


def case(column: str, values: dict[str, str]) -> str:
    branches = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in values.items())
    return f"CASE {column} {branches} END"


def flattened(column: str) -> str:
    return rf"trim(regexp_replace({column}, '\r\n|\r|\n', ' ', 'g'))"


def stripped(column: str) -> str:
    return f"trim({column}, {SPACES})"


# Chunk folds


def closed(state: str) -> str:
    return (
        f"CASE WHEN {state}.current = '' THEN {state}.done "
        f"ELSE list_append({state}.done, {state}.current) END"
    )


def states(pieces: str) -> str:
    return f"list_transform({pieces}, lambda p: {{'done': []::VARCHAR[], 'current': p}})"


EMPTY = "{'done': []::VARCHAR[], 'current': ''}"


def added(acc: str, piece: str, joiner: str, limit: int) -> str:
    extended = f"CASE WHEN {acc}.current = '' THEN {piece} ELSE {acc}.current || {joiner} || {piece} END"
    return (
        f"CASE WHEN length({extended}) <= {limit} THEN {{'done': {acc}.done, 'current': {extended}}} "
        f"ELSE {{'done': {closed(acc)}, 'current': {piece}}} END"
    )


def packed(pieces: str, joiner: str, limit: int, acc: str, item: str) -> str:
    body = added(acc, f"{item}.current", joiner, limit)
    return f"list_reduce({states(pieces)}, lambda {acc}, {item}: {body}, {EMPTY})"


def paragraph_chunks_of(table: str, key: str, limit: int = 900, hard: bool = False) -> str:
    long_line = packed("string_split(x.current, '. ')", "'. '", limit, "b", "y")
    body = (
        f"CASE WHEN length(x.current) > {limit} "
        f"THEN {{'done': list_concat({closed('a')}, {closed(f'({long_line})')}), 'current': ''}} "
        f"ELSE {added('a', 'x.current', 'chr(10)', limit)} END"
    )
    fold = f"list_reduce({states('string_split(text, chr(10))')}, lambda a, x: {body}, {EMPTY})"
    whole = closed("state")
    if hard:
        cut = f"list_transform(range(0, length(c), {limit}), lambda i: substr(c, i + 1, {limit}))"
        whole = f"flatten(list_transform({whole}, lambda c: {cut}))"
    kept = f"list_filter(list_transform({whole}, lambda c: {stripped('c')}), lambda c: c <> '')"
    return (
        f"folded AS (SELECT {key}, {fold} AS state FROM {table}), "
        f"listed AS (SELECT {key}, {kept} AS chunks FROM folded), "
        f"chunks AS (SELECT {key}, generate_subscripts(chunks, 1) - 1 AS chunk_no, unnest(chunks) AS chunk FROM listed)"
    )


def sentence_chunks_of(table: str) -> str:
    sentences = (
        f"list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), "
        f"lambda s: {stripped('s')}), lambda s: s <> '')"
    )
    fold = packed(sentences, "'. '", 480, "a", "x")
    return (
        f"folded AS (SELECT doc_id, lang, {fold} AS state FROM {table}), "
        f"listed AS (SELECT doc_id, lang, list_transform({closed('state')}, lambda c: c || '.') AS chunks FROM folded)"
    )


def first_sentence_chunks(n: int) -> str:
    return f"""
        WITH {sentence_chunks_of("documents")}
        SELECT doc_id, greatest(len(chunks) - {n}, 0)::INTEGER AS n_dropped,
               (generate_subscripts(chunks[1:{n}], 1) - 1)::INTEGER AS chunk_no, unnest(chunks[1:{n}]) AS chunk
        FROM listed"""


# Dense retrieval


def matches(k: int, corpus: str = "embeddings", others: bool = False) -> str:
    condition = "WHERE q.vec_id <> c.vec_id" if others else ""
    return f"""
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS key,
                   round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity
            FROM embeddings q CROSS JOIN {corpus} c {condition}),
        matches AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key)::INTEGER AS rank,
                   key, similarity
            FROM pairs QUALIFY rank <= {k})"""


def topk(k: int) -> str:
    return f"WITH {matches(k)} SELECT query_id, rank, key, similarity FROM matches"


LINE = "'- Section ' || key || ' (' || coalesce(source, '') || '): ' || left(coalesce(text, ''), 300) || '…'"
RECORDS = "matches LEFT JOIN documents ON doc_id = key"
HINTS = "||chr(10)||".join(literal(f"- {offense}: {reference}") for offense, reference in OFFENSES.items())


def contexts() -> str:
    return f"""{matches(5)},
        context AS (
            SELECT query_id, count(*) AS n_sections, string_agg({LINE}, chr(10) ORDER BY rank) AS context
            FROM {RECORDS} GROUP BY query_id)"""


def chat_requests() -> str:
    user = (
        "'Incident: ' || text || chr(10) || chr(10) || 'Sections found:' || chr(10) || coalesce(context, '') "
        f"|| chr(10) || chr(10) || 'Offense reference:' || chr(10) || {HINTS}"
    )
    return f"""
        WITH {contexts()},
        asked AS (SELECT d.doc_id AS query_id, {user} AS content
                  FROM documents d LEFT JOIN context ON query_id = d.doc_id)
        SELECT query_id, 0 AS pos, 'system' AS role, {literal(GUIDANCE_ROLE)} AS content,
               {GUIDANCE_TOKENS} AS max_tokens FROM asked
        UNION ALL SELECT query_id, 1, 'user', content, {GUIDANCE_TOKENS} FROM asked"""


# Sparse retrieval


def sparse_retrieval(k: int) -> str:
    def tokens(table: str, key: str) -> str:
        return (
            rf"SELECT {key}, token, count(*) AS tf FROM (SELECT {key}, "
            rf"unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}]+')) AS token FROM {table}) "
            rf"WHERE token <> '' GROUP BY ALL"
        )

    return f"""
        WITH dtf AS ({tokens("documents", "doc_id")}), qtf AS ({tokens("benchmark", "item_id")}),
        vocabulary AS (
            SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM dtf GROUP BY token),
        dw AS (SELECT doc_id, token, tf * idf AS w FROM dtf JOIN vocabulary USING (token) WHERE idf > 0),
        qw AS (SELECT item_id, token, tf * idf AS w FROM qtf JOIN vocabulary USING (token) WHERE idf > 0),
        dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY doc_id),
        qn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY item_id),
        dots AS (SELECT item_id, doc_id, sum(qw.w * dw.w) AS dot FROM qw JOIN dw USING (token) GROUP BY ALL),
        scored AS (
            SELECT item_id AS query_id, doc_id AS key, round(dot / (qn.n * dn.n), 4) AS similarity
            FROM dots JOIN qn USING (item_id) JOIN dn USING (doc_id))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key)::INTEGER AS rank,
               key, similarity
        FROM scored QUALIFY rank <= {k}"""


# Language


def trigrams(table: str, columns: str, condition: str = "") -> str:
    return rf"""
        SELECT {columns}, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram
        FROM (SELECT *, regexp_extract_all(lower(text), '(?s).') AS c FROM {table}) {condition}"""


def detection(table: str, keys: str, learned: str = "documents") -> str:
    counts = ", ".join(f"count(*) FILTER (lang = '{code}') AS {code}" for code in LANGUAGES)
    totals = ", ".join(f"sum({code}) AS total_{code}" for code in LANGUAGES)
    kept = " UNION ".join(
        f"(SELECT gram FROM counts WHERE {code} > 0 ORDER BY {code} DESC, gram LIMIT 300)" for code in LANGUAGES
    )
    logs = ", ".join(
        f"round(ln(({code} + 0.5::DOUBLE) / total_{code}) * 1000000)::BIGINT AS log_{code}" for code in LANGUAGES
    )
    sums = ", ".join(f"sum(log_{code}) AS log_{code}" for code in LANGUAGES)
    best = "greatest(" + ", ".join(f"log_{code}" for code in LANGUAGES) + ")"
    first_best = " ".join(f"WHEN log_{code} = {best} THEN '{code}'" for code in LANGUAGES)
    votes = {code: f"len(regexp_extract_all(text, '{script_pattern(code)}'))" for code in SCRIPT_BLOCKS}
    most = "greatest(" + ", ".join(votes.values()) + ")"
    by_script = " ".join(f"WHEN {vote} = {most} THEN '{code}'" for code, vote in votes.items())
    return f"""
        counts AS (SELECT gram, {counts} FROM ({trigrams(learned, "lang")}) GROUP BY gram),
        totals AS (SELECT {totals} FROM counts),
        profile AS (SELECT gram, {logs} FROM counts, totals WHERE gram IN ({kept})),
        sums AS (SELECT {keys}, {sums} FROM ({trigrams(table, keys)}) JOIN profile USING (gram) GROUP BY {keys}),
        detected AS (
            SELECT {keys}, coalesce(
                CASE WHEN {most} = 0 THEN NULL {by_script} END, CASE {first_best} END, 'unknown') AS detected
            FROM {table} LEFT JOIN sums USING ({keys}))"""


def half(number: int) -> str:
    return f"(SELECT * FROM documents WHERE doc_id % 2 = {number})"


def detected_by_other_half(number: int) -> str:
    return f"(WITH {detection(half(number), 'doc_id', half(1 - number))} SELECT doc_id, detected FROM detected)"


SCORES = f"""
    WITH detected AS ({detected_by_other_half(0)} UNION ALL {detected_by_other_half(1)}),
    judged AS (
        SELECT doc_id, detected, CASE WHEN lang = 'en' THEN '' ELSE lang END AS expected
        FROM detected JOIN documents USING (doc_id)),
    scores AS (SELECT *, CASE WHEN detected = expected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM judged)"""

NAMES = {"en": "English", "fr": "Hindi", "de": "Tamil", "es": "Marathi"}
TARGETS = {"en": "hi-IN", "fr": "en-IN", "de": "en-IN", "es": "mr-IN"}
LOCALE_OF_LANG = {code: LOCALES[name] for code, name in NAMES.items()}
ISO_OF_LANG = {code: "" if name == "English" else LOCALES[name][:2] for code, name in NAMES.items()}

STATISTIC_COLUMNS = {
    "p_partkey": ("BIGINT", 8),
    "p_name": ("VARCHAR", None),
    "p_brand": ("VARCHAR", None),
    "p_type": ("VARCHAR", None),
    "p_size": ("INTEGER", 4),
    "p_retailprice": ("DOUBLE", 8),
}


def part_statistics() -> str:
    parts = []
    for name, (kind, width) in STATISTIC_COLUMNS.items():
        figures = {"num_nulls": f"count(*) FILTER ({name} IS NULL)", "distinct_count": "max('true')"}
        figures["max_col_len"] = f"max({width})" if width else f"max(strlen({name}))"
        figures["avg_col_len"] = f"max({width})" if width else f"ceil(avg(strlen({name})))::BIGINT"
        if width:
            figures |= {"min": f"min({name})", "max": f"max({name})"}
        parts += [
            f"SELECT '{name}' AS \"column\", '{statistic}' AS statistic, ({value})::VARCHAR AS value FROM part"
            for statistic, value in figures.items()
        ]
    return " UNION ALL ".join(f"({part})" for part in parts)


def letters() -> str:
    counts = ", ".join(f"length(text) - length(replace(text, '{chr(97 + i)}', ''))" for i in range(26))
    return f"""
        WITH counted AS (SELECT doc_id, [{counts}]::DOUBLE[] AS n FROM documents),
        normed AS (SELECT doc_id, n, sqrt(list_dot_product(n, n)) AS norm FROM counted)
        SELECT doc_id, (generate_subscripts(n, 1) - 1)::INTEGER AS pos,
               round((unnest(n) / norm)::FLOAT::DOUBLE, 4) AS value
        FROM normed WHERE norm > 0"""


def index_counts() -> str:
    body = "coalesce(source, '') || '. ' || coalesce(text, '')"
    counts = ", ".join(f"length(body) - length(replace(body, '{chr(97 + i)}', ''))" for i in range(26))
    return f"""
        WITH texts AS (SELECT doc_id, {body} AS body FROM documents),
        counted AS (SELECT doc_id, [{counts}]::DOUBLE[] AS n FROM texts),
        normed AS (SELECT doc_id, n, sqrt(list_dot_product(n, n)) AS norm FROM counted)
        SELECT doc_id, len(n)::INTEGER AS dimension, round((n[5] / norm)::FLOAT::DOUBLE, 4) AS fifth_element,
               count(*) FILTER (norm > 0) OVER () AS stored, count(*) FILTER (norm = 0) OVER () AS rejected
        FROM normed QUALIFY norm > 0"""


def sketch_columns() -> str:
    parts = []
    for name in ("doc_id", "text", "lang", "n_chars"):
        number = name in ("doc_id", "n_chars")
        bounds = f"min({name})::VARCHAR, max({name})::VARCHAR" if number else "NULL::VARCHAR, NULL::VARCHAR"
        parts.append(
            f"SELECT '{name}' AS \"column\", count(*) AS \"rows\", count(*) - count({name}) AS nulls, "
            f"sum(strlen({name}::VARCHAR))::BIGINT AS bytes, {bounds}, count(DISTINCT {name}) AS distinct_exact, "
            f"true AS distinct_close, {'true' if number else 'NULL::BOOLEAN'} AS median_close FROM documents"
        )
    columns = '"column", "rows", nulls, bytes, low, high, distinct_exact, distinct_close, median_close'
    return f"WITH figures({columns}) AS ({' UNION ALL '.join(parts)}) SELECT * FROM figures"


def index_update() -> str:
    body = "coalesce(source, '') || '. ' || coalesce(text, '')"
    counts = ", ".join(f"length(body) - length(replace(body, '{chr(97 + i)}', ''))" for i in range(26))
    edits = {
        "n_new": "doc_id % 11 = 3",
        "n_changed": "doc_id % 11 <> 3 AND doc_id % 7 = 1",
        "n_edited": "doc_id % 11 <> 3 AND doc_id % 7 <> 1 AND doc_id % 13 = 2 AND lang <> 'xx'",
        "n_gone": "doc_id % 17 = 5",
        "n_same": "doc_id % 11 <> 3 AND doc_id % 7 <> 1 AND doc_id % 13 <> 2",
        "n_embedded": "doc_id % 11 = 3 OR doc_id % 7 = 1",
    }
    figures = ", ".join(f"(SELECT count(*) FROM documents WHERE {where}) AS {name}" for name, where in edits.items())
    return f"""
        WITH texts AS (SELECT doc_id, lang, {body} AS body FROM documents),
        counted AS (SELECT doc_id, lang, [{counts}]::DOUBLE[] AS n FROM texts),
        normed AS (SELECT *, sqrt(list_dot_product(n, n)) AS norm FROM counted)
        SELECT doc_id, lang, len(n)::INTEGER AS dimension, round((n[5] / norm)::FLOAT::DOUBLE, 4) AS fifth_element, {figures}
        FROM normed WHERE norm > 0"""


LEDGER = """
    WITH turns AS (SELECT *, (conv_id * 31 + turn) % 8 AS way FROM conversations),
    tries AS (
        SELECT text, role, conv_id, way, generate_subscripts(codes, 1) - 1 AS pos, unnest(codes) AS status
        FROM (SELECT *, [[], [500, 200], [500, 503, 502], [400], [200, 200], [429], [200], [200, 500]][way + 1] AS codes FROM turns)),
    came AS (
        SELECT text, role, status, pos + 1 AS attempt, conv_id * 100 + pos AS received,
               CASE WHEN way <> 6 THEN text || ' #' || pos END AS body FROM tries),
    seen AS (
        SELECT text, role, count(DISTINCT attempt) AS attempts, arg_max(status, {'r': received, 'a': attempt, 's': status}) AS last_status,
               arg_max(body, {'r': received, 'a': attempt, 'b': body}) FILTER (status = 200 AND body IS NOT NULL) AS best
        FROM came GROUP BY ALL),
    asked AS (SELECT text, role, count(*) AS n_requests FROM turns GROUP BY ALL),
    states AS (
        SELECT text, role, n_requests, coalesce(attempts, 0) AS attempts, last_status, best,
               CASE WHEN best IS NOT NULL THEN 'answered'
                    WHEN coalesce(last_status, 200) IN (200, 408, 425, 429, 500, 502, 503, 504) AND coalesce(attempts, 0) < 3 THEN 'outstanding'
                    ELSE 'dead' END AS state
        FROM asked LEFT JOIN seen USING (text, role))
    SELECT conv_id || '-' || turn AS request_id, state, attempts, last_status, best AS translated, state = 'dead' AS dead,
           CASE WHEN state = 'outstanding' THEN n_requests END AS n_requests,
           CASE WHEN state = 'outstanding' THEN attempts + 1 END AS next_attempt
    FROM turns JOIN states USING (text, role)"""


def stream_refresh() -> str:
    def batch(number: int, corpus: str, source: str) -> str:
        return f"""
            SELECT query_id, rank::INTEGER AS rank, key, similarity, {source} AS source, {number}::INTEGER AS corpus_version, {number}::INTEGER AS records_version
            FROM (SELECT q.vec_id AS query_id, c.vec_id AS key,
                         round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity,
                         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id) AS rank
                  FROM embeddings q CROSS JOIN {corpus} c WHERE q.vec_id % 2 = {number} QUALIFY rank <= 5)
            LEFT JOIN documents ON doc_id = key"""

    even = "(SELECT * FROM embeddings WHERE label % 2 = 0)"
    return f"{batch(0, even, repr('old ') + ' || source')} UNION ALL {batch(1, 'embeddings', 'source')}"


TOKEN = r"""^["''“(\[]*([\p{L}\p{M}]+(?:\.[\p{L}\p{M}]+)*)(\.?)["''”)\],;:!?]*$"""
ABBREVIATIONS = rf"""
    WITH flat AS (SELECT string_split(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t FROM documents),
    each AS (SELECT unnest(t) AS token, unnest(list_append(t[2:], '')) AS next FROM flat),
    parts AS (
        SELECT lower(regexp_extract(token, '{TOKEN}', 1)) AS word, regexp_extract(token, '{TOKEN}', 2) = '.' AS stop,
               regexp_matches(next, '^[\p{{Ll}}\p{{Nd}}]') AS goes_on
        FROM each)
    SELECT word, count(*) AS places, count(*) FILTER (stop) AS stops, count(*) FILTER (stop AND goes_on) AS going_on
    FROM parts WHERE word <> '' AND length(word) <= 6 GROUP BY word"""


def shown(column: str) -> str:
    value = f"{column}::VARCHAR"
    return f"CASE WHEN length({value}) > 80 THEN left({value}, 77) || '...' ELSE {value} END AS {column}"


def oracles() -> dict[str, str]:
    return {
        "clean_documents": f"""
            SELECT * FROM (SELECT doc_id, {flattened("text")} AS text, lang, trim(source) AS source FROM documents)
            WHERE length(text) > 20 AND source <> 'source'""",
        "clean_short_text": """
            SELECT * FROM (SELECT conv_id, turn, trim(role) AS role, trim(text) AS text FROM conversations)
            WHERE length(text) > 5""",
        "normalise_headers": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
        "csv_quoted_scan": f"""
            SELECT * FROM (
                SELECT doc_id::VARCHAR AS doc_id, {flattened("text")} AS text, lang, trim(source) AS source
                FROM documents)
            WHERE length(text) > 20""",
        "csv_split_scan": f"""
            SELECT * FROM (
                SELECT doc_id::VARCHAR AS doc_id, {flattened("text")} AS text, lang, trim(source) AS source
                FROM documents)
            WHERE length(text) > 20""",
        "csv_plain_scan": """
            SELECT * FROM (
                SELECT p_partkey::VARCHAR AS p_partkey, trim(p_name) AS p_name, p_brand, trim(p_type) AS p_type
                FROM part)
            WHERE length(p_name) > 5""",
        "table_roundtrip": "SELECT * FROM part",
        "table_statistics": part_statistics(),
        "compact_table": """
            SELECT *, 'p_brand' AS partitioned_by, 'true' AS optimize, true AS measured FROM part""",
        "table_versions": """
            SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, NULL::INTEGER AS p_area, 0 AS version, false AS is_current
            FROM part
            UNION ALL SELECT p_partkey, p_name, p_brand, NULL, p_size, p_retailprice, p_size * 2, 1, true FROM part WHERE p_size > 10""",
        "table_compaction": """
            SELECT *, true AS merged, 1::BIGINT AS largest_kept, 'p_brand' AS partitioned_by, 'catalog' AS owner FROM part""",
        "column_sketches": sketch_columns(),
        "etl_sections": f"""
            WITH kept AS (
                SELECT lang AS Chapter, trim(source) AS Chapter_name, NULL::VARCHAR AS Chapter_subtype, doc_id::VARCHAR AS Section,
                       trim(source) AS Section_name, {flattened("text")} AS Description
                FROM documents WHERE length({flattened("text")}) > 20)
            SELECT *, count(*) OVER (PARTITION BY Chapter_name) AS in_chapter, count(*) OVER () AS loaded FROM kept""",
        "etl_incidents": """
            WITH kept AS (SELECT trim(p_type) AS offense_type FROM part WHERE length(trim(p_name)) > 5)
            SELECT offense_type, count(*) AS "count", (SELECT count(*) FROM kept) AS loaded FROM kept GROUP BY offense_type""",
        "index_update": index_update(),
        "table_preview": f"""
            SELECT {", ".join(shown(c) for c in ("doc_id", "text", "lang", "source", "n_chars"))}
            FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 10)""",
        "index_build": index_counts(),
        "count_rows": 'SELECT count(*) AS "rows" FROM documents',
        "count_by_source_asc": "SELECT source, count(*) AS sections FROM documents GROUP BY source ORDER BY source",
        "count_by_lang_desc": """
            SELECT lang, count(*) AS "count" FROM documents GROUP BY lang ORDER BY "count" DESC, lang""",
        "embed_text": """
            SELECT doc_id, coalesce(source, '') || '. ' || coalesce(text, '') AS embedding_text FROM documents""",
        "embed_model": letters(),
        "l2_normalise": """
            WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: (x * 3)::FLOAT) AS v FROM embeddings),
            normed AS (SELECT vec_id, v, sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])) AS norm FROM scaled)
            SELECT vec_id, (generate_subscripts(v, 1) - 1)::INTEGER AS pos,
                   round((unnest(v)::DOUBLE / norm)::FLOAT::DOUBLE, 4) AS value
            FROM normed""",
        "inner_product": """
            WITH first AS (SELECT label, arg_min(embedding, vec_id) AS f FROM embeddings GROUP BY label)
            SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], f::DOUBLE[]), 6) AS product
            FROM embeddings JOIN first USING (label)""",
        **{f"topk_cosine_k{k}": topk(k) for k in (3, 5, 7, 10)},
        **{f"topk_cosine_k5_{way}": topk(5) for way in ("queries", "corpus", "waves")},
        **{f"sparse_retrieval_k5_{way}": sparse_retrieval(5) for way in ("waves", "term_join", "large_vocabulary")},
        "topk_per_request": f"""
            WITH {matches(10)} SELECT query_id, rank, key, similarity FROM matches WHERE rank <= query_id % 8 + 3""",
        "rejected_requests": """
            SELECT doc_id, CASE lang WHEN 'fr' THEN 'Urdu' WHEN 'de' THEN 'hindi' END AS language,
                   NULL::VARCHAR AS locale, false AS supported, false AS multilingual
            FROM documents WHERE lang IS NULL OR lang <> 'en'""",
        "transcript_requests": f"""
            WITH kinds AS (
                SELECT conv_id || '-' || turn AS request_id,
                       CASE role WHEN 'user' THEN 'wav' ELSE 'webm' END AS kind
                FROM conversations WHERE role = 'user' OR (role = 'assistant' AND length(text) > 0))
            SELECT request_id, 'audio.' || kind AS file_name, 'audio/' || kind AS media_type,
                   {literal(LOCALES["Hindi"])} AS language_code, {literal(TRANSCRIPT_MODEL)} AS model
            FROM kinds""",
        "guidance_answers": """
            SELECT q.conv_id || '-' || q.turn AS request_id, q.text AS resolved, a.text AS answer,
                   CASE WHEN a.conv_id IS NULL THEN 'missing' WHEN a.text IS NULL THEN 'empty' ELSE 'answered' END AS status
            FROM conversations q LEFT JOIN conversations a
              ON a.conv_id = q.conv_id AND a.turn - 1 = q.turn AND a.role = 'assistant'
            WHERE q.role = 'user'""",
        "topk_short_corpus": f"""
            WITH few AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
            {matches(100, "few")} SELECT query_id, rank, key, similarity FROM matches""",
        "retrieve_records": f"""
            WITH {matches(5)} SELECT query_id, rank, key, similarity, source, lang, n_chars FROM {RECORDS}""",
        "match_display": f"""
            WITH {matches(5)}
            SELECT query_id, rank, key::VARCHAR AS section, source AS name, printf('%.3f', similarity) AS cosine,
                   left(coalesce(text, ''), 400) || '…' AS excerpt
            FROM {RECORDS}""",
        "retrieval_hit_rate": f"""
            WITH {matches(5, others=True)},
            hits AS (
                SELECT query_id, max((own.label = found.label)::INTEGER) AS hit
                FROM matches JOIN embeddings own ON own.vec_id = query_id JOIN embeddings found ON found.vec_id = key
                GROUP BY query_id)
            SELECT label, count(*) AS queries, count(*) FILTER (hit = 1) AS hits,
                   round(avg(coalesce(hit, 0)), 6) AS hit_rate
            FROM embeddings LEFT JOIN hits ON query_id = vec_id GROUP BY label""",
        "retrieval_context": f"WITH {contexts()} SELECT query_id, n_sections, context FROM context",
        "hint_block": f"SELECT conv_id, turn, {HINTS} AS hint_block FROM conversations",
        "chat_requests": chat_requests(),
        "stream_chat_requests": chat_requests(),
        "explanation_requests": f"""
            SELECT doc_id AS query_id, 0 AS pos, 'system' AS role, {literal(EXPLAIN_ROLE)} AS content,
                   {EXPLAIN_TOKENS} AS max_tokens FROM documents
            UNION ALL
            SELECT doc_id, 1, 'user', 'Explain in simple words:' || chr(10) || chr(10) || text, {EXPLAIN_TOKENS}
            FROM documents""",
        "sparse_retrieval_k5": sparse_retrieval(5),
        "chunk_900": f"""
            WITH {paragraph_chunks_of("documents", "doc_id")}
            SELECT doc_id, chunk_no::INTEGER AS chunk_no, chunk FROM chunks""",
        "chunk_120_hard": f"""
            WITH {paragraph_chunks_of("documents", "doc_id", 120, hard=True)}
            SELECT doc_id, chunk_no::INTEGER AS chunk_no, chunk FROM chunks""",
        "abbreviation_counts": ABBREVIATIONS,
        "translated_answers": f"""
            WITH routed AS (SELECT * FROM documents WHERE lang <> 'es' AND {stripped("text")} <> ''),
            {paragraph_chunks_of("routed", "doc_id")},
            joined AS (
                SELECT doc_id, string_agg(CASE WHEN chunk_no % 3 = 0 THEN '[' || chunk || ']' ELSE chunk END, chr(10) ORDER BY chunk_no) AS rejoined,
                       count(*) FILTER (chunk_no % 3 > 0) AS n
                FROM chunks GROUP BY doc_id)
            SELECT doc_id, coalesce(rejoined, text) AS translated, coalesce(n, 0) AS n_untranslated
            FROM documents LEFT JOIN joined USING (doc_id)""",
        "translation_calls": f"""
            WITH routed AS (SELECT * FROM documents WHERE lang <> 'es' AND {stripped("text")} <> ''),
            {paragraph_chunks_of("routed", "doc_id")},
            joined AS (
                SELECT doc_id, string_agg(CASE WHEN length(chunk) % 5 IN (2, 3) THEN '[' || chunk || ']' ELSE chunk END, chr(10) ORDER BY chunk_no) AS rejoined,
                       count(*) FILTER (length(chunk) % 5 NOT IN (2, 3)) AS n, count(*) FILTER (length(chunk) % 5 = 1) AS dead
                FROM chunks GROUP BY doc_id)
            SELECT doc_id, coalesce(rejoined, text) AS translated, coalesce(n, 0) AS n_untranslated, coalesce(dead, 0) AS n_dead,
                   CASE WHEN dead > 0 THEN 'failed' WHEN n > 0 THEN 'waiting' ELSE 'done' END AS status
            FROM documents LEFT JOIN joined USING (doc_id)""",
        "request_ledger": LEDGER,
        "stream_refresh": stream_refresh(),
        "chunk_rejoin": f"""
            WITH {paragraph_chunks_of("documents", "doc_id")}
            SELECT doc_id, string_agg('[' || chunk || ']', chr(10) ORDER BY chunk_no) AS text FROM chunks GROUP BY doc_id""",
        "sentence_chunks_480_first3": first_sentence_chunks(3),
        "sentence_chunks_480_first6": first_sentence_chunks(6),
        "speech_requests": f"""
            WITH {sentence_chunks_of("documents")}
            SELECT doc_id, greatest(len(chunks) - 3, 0)::INTEGER AS n_dropped,
                   len(chunks[1:3])::INTEGER AS n_inputs, array_to_string(chunks[1:3], '|') AS inputs,
                   {case("lang", LOCALE_OF_LANG)} AS target_language_code, 'anushka' AS speaker,
                   8000 AS speech_sample_rate, 'bulbul:v2' AS model
            FROM listed WHERE len(chunks) > 0""",
        "previews": """
            SELECT doc_id, left(text, 120) || '…' AS first_120, left(text, 300) || '…' AS first_300,
                   left(text, 400) || '…' AS first_400
            FROM documents""",
        "resolve_input": f"""
            SELECT *, resolved <> '' AS accepted FROM (
                SELECT conv_id, turn, CASE role WHEN 'assistant' THEN text WHEN 'user' THEN {stripped("text")}
                                      ELSE '' END AS resolved
                FROM conversations)""",
        "translate_plan": f"""
            SELECT doc_id, {case("lang", NAMES)} AS language, {case("lang", LOCALE_OF_LANG)} AS locale,
                   {case("lang", ISO_OF_LANG)} AS iso, {case("lang", TARGETS)} AS target,
                   n_chars > 1000 AND lang <> 'en' AS multilingual,
                   lang <> 'es' AND {stripped("text")} <> '' AND n_chars > 1000 AS wanted
            FROM documents""",
        "translate_requests": f"""
            WITH routed AS (SELECT * FROM documents WHERE lang <> 'es' AND {stripped("text")} <> ''),
            {paragraph_chunks_of("routed", "doc_id")}
            SELECT doc_id, chunk_no::INTEGER AS chunk_no, chunk AS input,
                   {case("lang", LOCALE_OF_LANG)} AS source_language_code,
                   {case("lang", TARGETS)} AS target_language_code,
                   CASE WHEN lang <> 'en' THEN 'Female' END AS speaker_gender,
                   CASE WHEN lang <> 'en' THEN 'formal' END AS mode,
                   CASE WHEN lang <> 'en' THEN 'mayura:v1' ELSE 'sarvam-translate:v1' END AS model,
                   lang <> 'en' AS enable_preprocessing, lang <> 'en' AS sends_mode
            FROM chunks JOIN documents USING (doc_id)""",
        "response_extract": """
            WITH answered AS (
                SELECT conv_id, turn, role,
                       json_object('choices', json_array(json_object('message', json_object('content', text)))) AS chat,
                       CASE WHEN role = 'user' THEN json_object('translated_text', text)
                            ELSE json_object() END AS translation,
                       json_object('transcript', text) AS speech, json_object('audios', json_array(role, text)) AS sound
                FROM conversations)
            SELECT conv_id, turn, json_extract_string(chat, '$.choices[0].message.content') AS content,
                   coalesce(json_extract_string(translation, '$.translated_text'), role) AS translated,
                   coalesce(json_extract_string(speech, '$.transcript'), '') AS transcript,
                   array_to_string(json_extract_string(sound, '$.audios[*]'), '|') AS audios
            FROM answered""",
        "response_defaults": """
            SELECT event_id, json_extract_string(props, '$.choices[0].message.content') AS content,
                   coalesce(json_extract_string(props, '$.translated_text'), event_type) AS translated,
                   coalesce(json_extract_string(props, '$.transcript'), '') AS transcript,
                   coalesce(json_array_length(props, '$.audios'), 0)::INTEGER AS n_audios
            FROM events""",
        **{
            name: f"""
            WITH {detection("conversations", "conv_id, turn")} SELECT conv_id, turn, detected FROM detected"""
            for name in ("lang_detect", "lang_detect_stored")
        },
        "lang_score": f"""
            {SCORES} SELECT *, (score * 100)::INTEGER AS composite, (score * 100)::INTEGER AS language_detection
            FROM scores""",
        "lang_bench": f"""
            {SCORES} SELECT expected, count(*) AS texts, count(*) FILTER (score = 1) AS matched,
                            count(*) FILTER (detected = 'unknown') AS unknown,
                            round(avg(score) * 100, 6) AS mean_composite
            FROM scores GROUP BY expected""",
        "lang_confusion": f"""
            {SCORES} SELECT expected, detected, count(*) AS texts FROM scores GROUP BY expected, detected""",
        "stream_retrieval": topk(5),
    }
