"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op2_decontaminate
from .jaccard_join import op6_ngram_jaccard
from .line_rules import op4_line_frequency
from .packing import op1_pack
from .ppm import op9_ppm
from .quality import op10_quality
from .secrets import op3_secrets
from .sharding import op8_byte_shards
from .substring_dedup import op7_substring_dedup
from .superminhash import op13_superminhash
from .target_sampling import op11_target_sampling
from .url_filter import op5_url_filter
from .vector_codes import op12_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pack,
        op2_decontaminate,
        op3_secrets,
        op4_line_frequency,
        op5_url_filter,
        op6_ngram_jaccard,
        op7_substring_dedup,
        op8_byte_shards,
        op9_ppm,
        op10_quality,
        op11_target_sampling,
        op12_vector_codes,
        op13_superminhash,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NAMES = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


def _shingles(source: str, key: str, words: str, size: int) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(ws[i:i + {size - 1}], ' ') AS s
  FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {size - 2})) AS i FROM (SELECT {key}, {words} AS ws FROM {source}))"""


def _similar(size: int, percent: int, more: str = "") -> str:
    """Components of documents whose shingle sets are alike."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("text", _LOWER, 1)} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {size - 1}], ' ') AS s FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [1] ELSE range(1, len(ws) - {size - 2}) END) AS i FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
 met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM met JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * x >= {percent} * (p.n + q.n - x)),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id{more} FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n"""


def _lloyd(parts: int, entries: int, rounds: int) -> str:
    """Codes and errors after so many rounds, every part held against every entry; ``b{k}`` are the codebooks after k rounds."""
    near = lambda k: f"""a{k} AS (SELECT vec_id, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM
  (SELECT p.vec_id, p.part, b.entry, CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN b{k} b ON p.part = b.part) GROUP BY ALL)"""  # noqa: E731
    moved = lambda k: f"""m{k} AS (SELECT part, entry, list(y ORDER BY j) AS x FROM (SELECT part, entry, j, CAST(floor(CAST(sum(x[j]) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM
  (SELECT part, a{k - 1}.entry, x, unnest(range(1, len(x) + 1)) AS j FROM p JOIN a{k - 1} USING (vec_id, part)) GROUP BY ALL) GROUP BY ALL),
 b{k} AS (SELECT part, entry, coalesce(m{k}.x, b{k - 1}.x) AS x FROM b{k - 1} LEFT JOIN m{k} USING (part, entry))"""  # noqa: E731
    steps = ",\n ".join(f"{near(k)},\n {moved(k + 1)}" for k in range(rounds))
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS x FROM v, range({parts}) AS r(part)),
 b0 AS (SELECT part, n AS entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
 {steps},
 {near(rounds)},
 c AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL),
 h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
 l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN v USING (vec_id) GROUP BY label)
 SELECT c.vec_id, code, error, label_error, codebooks_sha256 FROM c JOIN v ON c.vec_id = v.vec_id JOIN l ON l.label IS NOT DISTINCT FROM v.label, h"""


def _resampled(buckets: int, seed: int, words: int, percent: int) -> str:
    """DuckDB has no CRC-32: it is folded over the bytes of each distinct word by the table of its polynomial."""
    bag = lambda source, key: f"SELECT {key}, unnest(regexp_extract_all({_LOWER.replace('text', "coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {source}"
    return f"""WITH RECURSIVE poly AS (SELECT i, 0 AS k, i AS c FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
 tab AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM poly WHERE k = 8),
 d AS ({bag("documents", "doc_id")}), g AS ({bag("benchmark", "item_id")}),
 u AS (SELECT w, list_transform(range(1, strlen(w) + 1), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i - 1, 2) AS BIGINT)) AS bytes FROM (SELECT w FROM d UNION SELECT w FROM g)),
 b AS (SELECT w, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % {buckets} AS bucket FROM u, tab),
 s AS (SELECT bucket, count(*) AS s FROM d JOIN b USING (w) GROUP BY ALL), t AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (w) GROUP BY ALL),
 n AS (SELECT (SELECT CAST(sum(s) AS DOUBLE) FROM s) AS n_s, (SELECT CAST(sum(t) AS DOUBLE) FROM t) AS n_t),
 gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (n_s + {buckets}) / ((s + 1) * (n_t + {buckets})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
 f AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN b USING (w) JOIN gain USING (bucket) GROUP BY ALL),
 r AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{seed}:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM documents LEFT JOIN f USING (doc_id)),
 o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * {percent} // 100 AS drawn FROM r WHERE n_features >= {words})
 SELECT r.*, CASE WHEN place <= drawn THEN place END AS rank FROM r LEFT JOIN o USING (doc_id)"""


_FLAT = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')"

#: SQL for the operators whose whole result it can state; the others are held against brute force in the tests.
ORACLES: dict[str, str] = {
    "op2_decontaminate": f"""WITH d AS ({_shingles("documents", "doc_id", _NAMES, 5)}), b AS ({_shingles("benchmark", "item_id", _NAMES, 5)}),
 n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id),
 m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (s) GROUP BY ALL)
 SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment FROM m JOIN n USING (item_id) WHERE 10 * shared >= 8 * item_shingles""",
    "op4_line_frequency": rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
 v AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
 rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM v) WHERE n > 1) GROUP BY ALL),
 l AS (SELECT doc_id, host, i, ls[i] AS line FROM (SELECT doc_id, host, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, host, string_split(text, chr(10)) AS ls FROM d))),
 n AS (SELECT doc_id, host, i, line, regexp_extract_all({_FLAT}, '[^\x20\x09-\x0D]+') AS nw FROM l),
 m AS (SELECT doc_id, host, i, line, array_to_string(nw, ' ') AS norm, len(nw) AS words FROM n WHERE len(nw) > 0),
 fp AS (SELECT doc_id, string_agg(norm, chr(10) ORDER BY i) AS whole, count(*) - count(DISTINCT line) AS n_dup_lines FROM m GROUP BY ALL),
 bad AS (SELECT m.host, norm FROM m JOIN fp USING (doc_id) JOIN (SELECT host, count(*) AS docs FROM d GROUP BY ALL) h ON h.host = m.host GROUP BY m.host, norm, docs HAVING count(DISTINCT whole) > 20 AND count(DISTINCT whole) > 0.002 * docs),
 gone AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS removed_words FROM m JOIN bad USING (host, norm) GROUP BY ALL),
 c AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(CAST(list_sum(list_transform(ws, lambda w: len(w))) AS BIGINT), 0) AS word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words FROM d LEFT JOIN fp USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
 b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
 SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 10 OR n_words - removed_words < 0.2 * n_words)) AS kept FROM b""",
    "op6_ngram_jaccard": _similar(4, 85),
    "op7_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
 v AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
 f AS (SELECT k, min(doc_id) AS first FROM v GROUP BY k),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM v JOIN f USING (k) WHERE first < doc_id),
 g AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
 x AS (SELECT w.doc_id, ws, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, coalesce(gone, []) AS gone FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
 SELECT doc_id, n_words, n_removed, sha256(array_to_string(list_filter(ws, lambda t, j: NOT list_contains(gone, j)), ' ')) AS kept_sha256 FROM x""",
    "op11_target_sampling": _resampled(10_000, 2024, 20, 10),
    "op12_vector_codes": _lloyd(16, 64, 2),
    "op13_superminhash": _similar(5, 85, ", d.doc_id = min(r.b) AS kept"),
}
