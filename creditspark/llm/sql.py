"""DuckDB forms of the operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def decontamination(width: int = 10) -> str:
    def words(table: str, key: str) -> str:
        text = f"translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}')"
        return rf"SELECT {key}, regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"

    return f"""
WITH d AS ({words('documents', 'doc_id')}),
i AS (SELECT *, LEAST(len(w), {width}) AS n FROM ({words('benchmark', 'item_id')}) WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT *, UNNEST(range(1, len(w) - n + 2)) AS s FROM i)),
sizes AS (SELECT DISTINCT n FROM i),
doc_windows AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT d.doc_id, d.w, z.n, UNNEST(range(1, len(d.w) - z.n + 2)) AS s FROM d, sizes z)),
hits AS (SELECT doc_id, s, n, item_id FROM doc_windows JOIN item_windows USING (n, k)),
hit_words AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, UNNEST(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
  sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


def substring_dedup(width: int = 20) -> str:
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + {width} - 1], ' ') AS k
  FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - {width} + 2)) AS s FROM d)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, ROW_NUMBER() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, UNNEST(range(s, s + {width})) AS p FROM later),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, COUNT(*) AS n
  FROM (SELECT doc_id, UNNEST(w) AS word, UNNEST(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - COALESCE(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(COALESCE(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def collocation(threshold: int = 30, longest: int = 4, first: int = 2000, scale: int = 2_000_000) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS len, array_to_string(w[s:s + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, UNNEST(range(1, len(w) - {k - 2})) AS s FROM pieces)" for k in range(1, longest + 1))
    cuts = " UNION ALL ".join(
        f"SELECT lang, phrase, a, {c} AS cut, array_to_string(w[1:{c}], ' ') AS lp, array_to_string(w[{c + 1}:], ' ') AS rp FROM cand WHERE len > {c}" for c in range(1, longest))
    inner = " UNION ALL ".join(
        f"SELECT lang, array_to_string(w[{s}:{s + size - 1}], ' ') AS phrase, a AS around FROM cand WHERE len > {size} AND len >= {s + size - 1}"
        for size in range(2, longest) for s in range(1, longest - size + 2))
    return rf"""
WITH texts AS (SELECT COALESCE(lang, 'und') AS lang, translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM (SELECT lang, UNNEST(string_split_regex(t, '[.,;:!?
-
]')) AS p FROM texts)),
totals AS (SELECT lang, CAST(SUM(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, len, phrase, COUNT(*) AS a FROM ({grams}) GROUP BY lang, len, phrase HAVING COUNT(*) >= {threshold}),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE len > 1),
cuts AS ({cuts}),
scored AS (SELECT c.lang, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, CAST((CAST({scale} AS HUGEINT) * c.a) // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp),
least AS (SELECT * FROM scored QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (SELECT lang, phrase, MAX(around) AS around FROM ({inner}) GROUP BY lang, phrase),
kept AS (SELECT s.* FROM least s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE h.around IS NULL OR 100 * CAST(h.around AS HUGEINT) < 80 * CAST(s.a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT k.lang, ROW_NUMBER() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept k JOIN totals t ON t.lang = k.lang)
WHERE rank <= {first}"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Every round's assignment and codebook as one table after another."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM (
  SELECT x.vec_id, x.part, b.entry, SUM((x.x - b.x) * (x.x - b.x)) AS d FROM points x JOIN book{i} b ON b.part = x.part AND b.dim = x.dim GROUP BY x.vec_id, x.part, b.entry)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)""")
        if i < rounds:
            steps.append(f"""book{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.dim, COALESCE(m.x, b.x) AS x FROM book{i} b LEFT JOIN (
  SELECT n.part, n.entry, p.dim, CAST((SUM(p.x) - ((SUM(p.x) % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*) AS BIGINT) AS x
  FROM near{i} n JOIN points p ON p.vec_id = n.vec_id AND p.part = n.part GROUP BY n.part, n.entry, p.dim) m ON m.part = b.part AND m.entry = b.entry AND m.dim = b.dim)""")
    return f"""
WITH kept AS (SELECT vec_id, label, [CAST(floor(CAST(e AS DOUBLE) * {scale}) AS BIGINT) for e in embedding] AS v, len(embedding) // {parts} AS size FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0),
flat AS (SELECT vec_id, size, UNNEST(v) AS x, UNNEST(range(len(v))) AS pos FROM kept),
points AS MATERIALIZED (SELECT vec_id, pos // size AS part, pos % size AS dim, x FROM flat),
first AS (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}),
book0 AS MATERIALIZED (SELECT p.part, f.entry, p.dim, p.x FROM points p JOIN first f ON f.vec_id = p.vec_id),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(SUM(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, dim)) AS sha FROM book{rounds}),
errors AS (SELECT label, CAST(SUM(error) AS BIGINT) AS label_error FROM kept JOIN coded USING (vec_id) GROUP BY label)
SELECT k.vec_id, code, error, label_error, sha AS codebooks_sha256
FROM kept k JOIN coded USING (vec_id) JOIN errors e ON e.label IS NOT DISTINCT FROM k.label CROSS JOIN books"""
