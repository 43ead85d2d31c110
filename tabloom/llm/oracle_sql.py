"""SQL that gives the rows of corpus queries."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# words of 5 in a row, links by their sets, and what is reached over links
OP3 = f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingled AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded
), sized AS (SELECT doc_id, len(s) AS n FROM shingled), long AS (SELECT doc_id, unnest(s) AS x FROM shingled
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM long a JOIN long b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM reached r JOIN sides s ON s.a = r.b)
SELECT sized.doc_id, sized.n AS n_shingles, min(b) AS component_id, min(b) = sized.doc_id AS kept FROM sized JOIN reached ON a = sized.doc_id GROUP BY sized.doc_id, sized.n"""

OP10 = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS size FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0
    WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98
), reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, min(b) AS component_id, min(b) = e.vec_id AS kept
FROM embeddings e JOIN reached ON a = e.vec_id GROUP BY e.vec_id"""


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# eight steps of the checksum for each digit: -1 stands for a step, other numbers are the digits' bytes
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, s: CASE WHEN s >= 0 THEN xor(crc, s) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END))"""
_RUN = "string_agg(digest, '' ORDER BY i)"

OP13 = f"""
WITH RECURSIVE rows AS (
    SELECT doc_id, lang, {_leaf('text')} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(LOWER.format('text'))} ELSE {_leaf('text')} END AS altered,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents
), nodes AS (
    SELECT lang, 0 AS level, i, n, leaf AS digest FROM rows
    UNION ALL SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256({_RUN}) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 8, n
), subroots AS (
    SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
    SELECT 0 AS level, i, n, digest FROM subroots
    UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256({_RUN}) FROM upper WHERE n > 1 GROUP BY level, i // 8, n
), inner_paths AS (
    SELECT doc_id, lang, leaf, 0 AS level, i, n, '' AS proof, altered AS folded FROM rows
    UNION ALL
    SELECT p.doc_id, p.lang, p.leaf, p.level + 1, p.i // 8, (p.n + 7) // 8,
        p.proof || coalesce(string_agg(CASE WHEN s.i <> p.i THEN s.digest END, '' ORDER BY s.i), ''),
        sha256(string_agg(CASE WHEN s.i = p.i THEN p.folded ELSE s.digest END, '' ORDER BY s.i))
    FROM inner_paths p JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = p.level AND s.i // 8 = p.i // 8
    WHERE p.n > 1 GROUP BY p.doc_id, p.lang, p.leaf, p.level, p.i, p.n, p.proof, p.folded
), outer_paths AS (
    SELECT p.doc_id, p.leaf, t.digest AS subroot, 0 AS level, t.i, t.n, p.proof, p.folded
    FROM inner_paths p JOIN subroots t ON t.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
    UNION ALL
    SELECT p.doc_id, p.leaf, p.subroot, p.level + 1, p.i // 8, (p.n + 7) // 8,
        p.proof || coalesce(string_agg(CASE WHEN s.i <> p.i THEN s.digest END, '' ORDER BY s.i), ''),
        sha256(string_agg(CASE WHEN s.i = p.i THEN p.folded ELSE s.digest END, '' ORDER BY s.i))
    FROM outer_paths p JOIN upper s ON s.level = p.level AND s.i // 8 = p.i // 8
    WHERE p.n > 1 GROUP BY p.doc_id, p.leaf, p.subroot, p.level, p.i, p.n, p.proof, p.folded
)
SELECT p.doc_id, p.leaf, p.subroot, u.digest AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root, p.folded = u.digest AS verified
FROM outer_paths p, (SELECT digest FROM upper WHERE n = 1) u WHERE p.n = 1"""
