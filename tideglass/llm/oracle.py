"""DuckDB SQL for the operators that SQL can express: the n-gram join, the WARC capture records and the quality rules."""

from __future__ import annotations

from . import quality

#: A word, as a regular expression of DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE32 = f"{UPPER}234567"


def ngram_join(relation: str = "documents") -> str:
    """The columns of `ngram_join.link_documents`: equal sets are one node, links are counted over shared shingles."""
    return rf"""
    WITH RECURSIVE
    texts AS (
        SELECT ROW_NUMBER() OVER () AS row_id, doc_id, REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words
        FROM {relation}),
    shingled AS (
        SELECT row_id, doc_id,
            CASE WHEN LEN(words) = 0 THEN []::VARCHAR[] WHEN LEN(words) < 5 THEN [ARRAY_TO_STRING(words, ' ')]
                 ELSE LIST_SORT(LIST_DISTINCT(LIST_TRANSFORM(RANGE(1, LEN(words) - 3), lambda i: ARRAY_TO_STRING(words[i:i + 4], ' ')))) END AS shingles
        FROM texts),
    keyed AS (SELECT doc_id, LEN(shingles)::BIGINT AS n, CASE WHEN LEN(shingles) > 0 THEN MD5(ARRAY_TO_STRING(shingles, CHR(10))) END AS node, shingles FROM shingled),
    nodes AS (SELECT node, ANY_VALUE(n) AS n, ANY_VALUE(shingles) AS shingles, MIN(doc_id) AS own FROM keyed WHERE node IS NOT NULL GROUP BY node),
    tokens AS (SELECT node, n, UNNEST(shingles) AS token FROM nodes),
    shared AS (
        SELECT a.node AS x, b.node AS y, ANY_VALUE(a.n) AS nx, ANY_VALUE(b.n) AS ny, COUNT(*) AS common
        FROM tokens a JOIN tokens b ON a.token = b.token AND a.node < b.node GROUP BY a.node, b.node),
    links AS (SELECT x, y FROM shared WHERE 100 * common >= 75 * (nx + ny - common)),
    sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reached(x, y) AS (SELECT node, node FROM nodes UNION SELECT r.x, s.y FROM reached r JOIN sides s ON r.y = s.x),
    components AS (SELECT r.x AS node, MIN(m.own) AS component_id FROM reached r JOIN nodes m ON r.y = m.node GROUP BY r.x)
    SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.node IS NULL THEN k.doc_id ELSE c.component_id END AS component_id
    FROM keyed k LEFT JOIN components c ON k.node = c.node
    """


def warc(relation: str = "pages") -> str:
    """The columns of `warc.archive_pages`; base32 digits are five bits each, four to five hexadecimal digits."""
    return f"""
    WITH payloads AS (SELECT page_id, url, COALESCE(html, '') AS payload FROM {relation}),
    ordered AS (
        SELECT page_id, payload, SHA1(payload) AS hex,
            ROW_NUMBER() OVER same AS place, FIRST_VALUE(page_id) OVER same AS first_id
        FROM payloads WINDOW same AS (PARTITION BY payload ORDER BY page_id NULLS LAST, url NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT page_id, STRLEN(payload)::BIGINT AS payload_bytes,
        ARRAY_TO_STRING(LIST_TRANSFORM(RANGE(0, 32), lambda i:
            SUBSTR('{BASE32}', 1 + (((('0x' || SUBSTR(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)), 1)), '') AS payload_digest,
        CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN place > 1 THEN first_id END AS refers_to
    FROM ordered
    """


def _distance(p: str, q: str) -> str:
    """Terms of the Jensen-Shannon divergence of two shares, twice."""

    def part(a: str) -> str:
        return f"CASE WHEN {a} > 0 THEN {a} * LOG2({a} / (({p} + {q}) / 2)) ELSE 0 END"

    return f"{part(p)} + {part(q)}"


def quality_rules(relation: str = "documents") -> str:
    """The columns of `quality.judge`: histograms as rows (document, place, count), the references as their sums by language."""
    languages = ", ".join(f"'{x}'" for x in quality.COMMON_WORDS)
    listed = ", ".join(f"('{lang}', {i}, '{w}')" for lang, words in quality.COMMON_WORDS.items() for i, w in enumerate(words))
    classes = [c.replace("'", "''") for c in quality.CLASSES]
    counted = ", ".join(f"LENGTH(text) - LENGTH(REGEXP_REPLACE(text, '{c}', '', 'g'))" for c in classes)
    blank = r"REGEXP_MATCHES(line, '[^ \x09\x0B-\x0D]')"
    return rf"""
    WITH
    docs AS (
        SELECT ROW_NUMBER() OVER () AS row_id, doc_id, CASE WHEN lang IN ({languages}) THEN lang ELSE '' END AS lang, COALESCE(text, '') AS text
        FROM {relation}),
    split AS (SELECT *, REGEXP_EXTRACT_ALL(text, '{WORD}') AS words, [{counted}] AS known FROM docs),
    words AS (SELECT row_id, lang, UNNEST(words) AS word, GENERATE_SUBSCRIPTS(words, 1) AS i FROM split),
    windows AS (
        SELECT row_id, i, COUNT(*) OVER (PARTITION BY row_id, run) AS times
        FROM (SELECT row_id, UNNEST(RANGE(1, LEN(words) - 3)) AS i, ARRAY_TO_STRING(words[i:i + 4], ' ') AS run FROM split WHERE LEN(words) >= 5)),
    repeated AS (
        SELECT row_id, COUNT(DISTINCT i + k) AS n FROM windows, (SELECT UNNEST(RANGE(0, 5)) AS k) WHERE times > 1 GROUP BY row_id),
    lines AS (
        SELECT row_id, COUNT(*) - COUNT(DISTINCT line) AS n FROM (SELECT row_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS line FROM split) WHERE {blank} GROUP BY row_id),
    counts AS (
        SELECT s.row_id, doc_id, lang, LEN(words)::BIGINT AS n_words, LENGTH(text)::BIGINT AS n_chars, LENGTH(text) - known[4] AS word_chars, known[6] AS n_symbols,
            COALESCE(l.n, 0) AS n_dup_lines, COALESCE(r.n, 0) AS n_repeat_words, LIST_APPEND(known, LENGTH(text) - LIST_SUM(known)) AS classes
        FROM split s LEFT JOIN lines l ON s.row_id = l.row_id LEFT JOIN repeated r ON s.row_id = r.row_id),
    class_counts AS (SELECT row_id, lang, UNNEST(classes)::DOUBLE AS c, GENERATE_SUBSCRIPTS(classes, 1) AS place FROM counts),
    class_sums AS (
        SELECT lang, place, SUM(c) AS c FROM class_counts WHERE lang <> '' GROUP BY lang, place
        UNION ALL SELECT '', place, SUM(c) FROM class_counts GROUP BY place),
    class_shares AS (SELECT lang, place, c / GREATEST(SUM(c) OVER (PARTITION BY lang), 1) AS q FROM class_sums),
    class_distances AS (
        SELECT row_id, SQRT(GREATEST(0, SUM({_distance("p", "q")}) / 2)) AS distance
        FROM (SELECT d.row_id, d.c / GREATEST(SUM(d.c) OVER (PARTITION BY d.row_id), 1) AS p, s.q FROM class_counts d JOIN class_shares s ON d.lang = s.lang AND d.place = s.place)
        GROUP BY row_id),
    listed(lang, place, word) AS (VALUES {listed}),
    common AS (SELECT w.row_id, w.lang, l.place, COUNT(*)::DOUBLE AS c FROM words w JOIN listed l ON w.lang = l.lang AND LOWER(w.word) = l.word GROUP BY w.row_id, w.lang, l.place),
    common_sums AS (SELECT lang, place, SUM(c) AS c FROM common GROUP BY lang, place),
    common_shares AS (SELECT lang, place, c / SUM(c) OVER (PARTITION BY lang) AS q FROM common_sums),
    languages AS (
        SELECT k.lang, COALESCE((SELECT SUM(c) FROM common_sums s WHERE s.lang = k.lang), 0) / GREATEST(SUM(n_words), 1) AS share
        FROM counts k GROUP BY k.lang),
    n_common AS (SELECT row_id, SUM(c) AS n FROM common GROUP BY row_id),
    common_distances AS (
        SELECT row_id, SQRT(GREATEST(0, SUM({_distance("p", "q")}) / 2)) AS distance
        FROM (
            SELECT n.row_id, COALESCE(c.c, 0) / n.n AS p, s.q
            FROM n_common n JOIN counts d ON n.row_id = d.row_id JOIN common_shares s ON d.lang = s.lang LEFT JOIN common c ON c.row_id = n.row_id AND c.place = s.place)
        GROUP BY row_id),
    judged AS (
        SELECT d.*, d.n_words < {quality.LEAST_TOTAL_WORDS} OR 100 * d.n_repeat_words > {quality.MOST_REPEATED_PERCENT} * d.n_words AS failed,
            CASE WHEN d.n_chars >= {quality.LEAST_CHARS} THEN k.distance END AS class_distance,
            CASE WHEN d.n_words >= {quality.LEAST_WORDS} AND d.lang <> '' AND n.n >= {quality.LEAST_COMMON} THEN w.distance END AS word_distance,
            d.n_words >= {quality.LEAST_WORDS} AND d.lang <> '' AND COALESCE(n.n, 0) < {quality.LEAST_COMMON_SHARE}::DOUBLE * d.n_words * g.share AS few
        FROM counts d JOIN languages g ON d.lang = g.lang LEFT JOIN class_distances k ON d.row_id = k.row_id
            LEFT JOIN n_common n ON d.row_id = n.row_id LEFT JOIN common_distances w ON d.row_id = w.row_id)
    SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed AS base_failed,
        NOT failed AND NOT (COALESCE(class_distance, 0) > {quality.MOST_CLASS_DISTANCE} OR COALESCE(word_distance, 0) > {quality.MOST_WORD_DISTANCE} OR few) AS kept,
        ROUND(class_distance, 9) AS class_distance, ROUND(word_distance, 9) AS word_distance
    FROM judged
    """
