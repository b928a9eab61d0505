"""The rows of this subpackage's queries in SQL for DuckDB, where SQL can express them; over the same tables, without any limit."""

from __future__ import annotations

from rectpart.llm import quality
from rectpart.llm.textops import SPACE_CLASS, WORD_CLASS

_WORDS = f"'{WORD_CLASS}+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A window is 100 hexadecimal digits; texts are first cut into chunks, in which a substring is found quickly.
SUBSTRINGS = """WITH d AS (SELECT CAST(doc_id AS BIGINT) doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
chunk AS (SELECT doc_id, k * 500 base, substring(h, 1000 * k + 1, 1098) part FROM (SELECT doc_id, h, unnest(range(1 + len(h) // 1000)) k FROM d)),
w AS (SELECT doc_id, base + i pos, substring(part, CAST(2 * i + 1 AS BIGINT), 100) s FROM (SELECT doc_id, base, part, unnest(range(least(500, len(part) // 2 - 49))) i FROM chunk WHERE len(part) >= 100)),
hit AS (SELECT w.doc_id, w.pos FROM w JOIN (SELECT s, min(doc_id) low FROM w GROUP BY s HAVING count(*) > 1) f ON w.s = f.s AND f.low < w.doc_id GROUP BY 1, 2),
mark AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END fresh FROM hit),
run AS (SELECT doc_id, min(pos) lo, max(pos) + 50 hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) r FROM mark) GROUP BY doc_id, r),
gap AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) since FROM run),
left_over AS (SELECT g.doc_id, string_agg(substring(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substring(any_value(h), 2 * max(hi) + 1) k, sum(hi - lo) n, count(*) c FROM gap g JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) n_bytes, CAST(coalesce(n, 0) AS BIGINT) n_removed, CAST(coalesce(c, 0) AS BIGINT) n_spans, sha256(unhex(coalesce(k, h))) kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT CAST(doc_id AS BIGINT) id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) w FROM documents),
s AS (SELECT DISTINCT id, x FROM (SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END) x FROM w)),
n AS (SELECT id, count(x) n FROM w LEFT JOIN s USING (id) GROUP BY 1),
common AS (SELECT a.id a, b.id b, count(*) c FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
low AS (SELECT a id, min(b) low FROM reach GROUP BY 1)
SELECT id doc_id, n n_shingles, CAST(least(id, coalesce(low, id)) AS BIGINT) component_id FROM n LEFT JOIN low USING (id)"""


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


#: The phrases, written out here on their own. Each character that is no letter or digit is doubled in the line and here, so that neighbours of two phrases can belong to both.
_PHRASES = "all  rights  reserved|licensed  under|terms  of  use|terms  of  service|privacy  policy|cookie  policy|accept  cookies|enable  javascript|powered  by|click  here|subscribe  to  our|sign  up  for  our|lorem  ipsum|copyright  \\(\\(c\\)\\)"
_DOUBLED = "regexp_replace(lower(x), '([^\\p{L}\\p{N}_])', '\\1\\1', 'g')"
_PROSE = f"""{_count(_DOUBLED, '(?:^|[^\\p{L}\\p{N}_])(?:' + _PHRASES + ')(?:$|[^\\p{L}\\p{N}_])')} * {quality.CHARS_PER_PHRASE} < greatest(length(x), 1)
 AND {_count('x', quality.SEPARATOR_CLASS.replace('\\u00BB', '»').replace('\\u2022', '•').replace('\\u00B7', '·'))} * {quality.CHARS_PER_SEPARATOR} < length(x)
 AND {_count('x', quality.SYMBOL_CLASS)} * {quality.CHARS_PER_SYMBOL} < length(x)
 AND (regexp_matches(right(x, 8), '[.!?:;…。][\\s\\x0b"''\\)\\]”»]*$') OR {_count('x', WORD_CLASS + '+')} >= {quality.LONG_LINE})"""

QUALITY = f"""WITH d AS (SELECT doc_id, t, regexp_extract_all(t, {_WORDS}) w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD_CLASS}')) lines FROM (SELECT doc_id, coalesce(text, '') t FROM documents)),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT k) n FROM (SELECT doc_id, unnest(range(i, i + 8)) k FROM twice) GROUP BY 1),
base AS (SELECT doc_id, len(w) n_words, length(t) - {_count('t', SPACE_CLASS)} word_chars, {_count('t', quality.SYMBOL_CLASS)} n_symbols, len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(rep.n, 0) n_repeat_words,
 coalesce(list_sum(list_transform(list_filter(lines, lambda x: {_PROSE}), lambda x: length(x) - {_count('x', SPACE_CLASS)})), 0) left_chars FROM d LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) n_words, CAST(word_chars AS BIGINT) word_chars, CAST(n_symbols AS BIGINT) n_symbols, CAST(n_dup_lines AS BIGINT) n_dup_lines, CAST(n_repeat_words AS BIGINT) n_repeat_words,
 base_failed, NOT base_failed AND left_chars >= word_chars * 0.5 kept, CAST(left_chars AS BIGINT) left_chars FROM judged"""

MIXING = f"""WITH d AS (SELECT CAST(doc_id AS BIGINT) doc_id, source, md5(text) th, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) size FROM documents),
r AS (SELECT *, CASE WHEN size < 16 THEN size ELSE len(bin(size)) * 8 + (size >> (len(bin(size)) - 4)) % 8 END class,
 CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), th)), 1, 7) AS BIGINT) % (8 + (SELECT count(*) FROM documents) // 500000) salt FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM d GROUP BY 1),
wt AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS BIGINT) weight FROM s),
sh AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(source_size) OVER upto, 0) * 3)::DOUBLE / ((SELECT sum(weight) FROM wt) - coalesce(sum(weight) OVER upto, 0))::DOUBLE share FROM wt
 WINDOW upto AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT source, source_size, CASE WHEN source_size * 3 <= weight * share THEN (source_size * 3)::DOUBLE ELSE weight * (SELECT max(share) FROM sh) END target, source_size * 3 <= weight * share held,
 (CAST('0x' || substr(md5('mix' || coalesce(':' || source, '')), 1, 7) AS BIGINT) % 1048576) / 1048576.0::DOUBLE shift FROM sh),
rated AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN held THEN 3.0::DOUBLE ELSE target / source_size::DOUBLE END rate FROM tg),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id NULLS FIRST, th NULLS FIRST) n FROM r),
got AS (SELECT p.doc_id, p.size, t.source_size, t.target, CAST(least(3, floor(n * rate + shift) - floor((n - 1) * rate + shift)) AS INTEGER) copies FROM placed p JOIN rated t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) taken, copies FROM got"""

TOP = """WITH v AS (SELECT CAST(vec_id AS BIGINT) id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.id query_id, c.id vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) score FROM v q JOIN v c ON q.id % 50 = 0 AND c.id <> q.id)
SELECT query_id, CAST(rank AS INTEGER) rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM p) WHERE rank <= 5"""


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Checksums by a table of 256 entries, over the bytes of distinct words.
RESAMPLING = f"""WITH d AS (SELECT CAST(doc_id AS BIGINT) doc_id, row_number() OVER () r, {_TERMS} w FROM documents), b AS (SELECT {_TERMS} w FROM benchmark),
tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) t FROM range(256) x(i)),
word AS (SELECT DISTINCT w FROM (SELECT unnest(w) w FROM d UNION ALL SELECT unnest(w) FROM b)),
hashed AS (SELECT w, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: CAST('0x' || substring(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
 lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]), 4294967295::BIGINT), 4294967295) % 10000 bucket FROM (SELECT w, hex(encode(w)) h FROM word), tab),
f AS (SELECT r, bucket, count(*) n FROM (SELECT r, unnest(w) w FROM d) JOIN hashed USING (w) GROUP BY 1, 2), s AS (SELECT bucket, sum(n) s FROM f GROUP BY 1),
t AS (SELECT bucket, count(*) t FROM (SELECT unnest(w) w FROM b) JOIN hashed USING (w) GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) gain FROM s LEFT JOIN t USING (bucket)),
wt AS (SELECT r, CAST(floor(sum(gain * n)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) weight FROM f JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) score FROM d LEFT JOIN wt USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN CAST(place AS BIGINT) END rank FROM placed"""

DECONTAMINATION = f"""WITH d AS (SELECT CAST(doc_id AS BIGINT) doc_id, row_number() OVER () r, {_TERMS} w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') item, {_TERMS} w FROM benchmark), b10 AS (SELECT item, w, least(10, len(w)) n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') s FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) i FROM b10)),
long AS (SELECT DISTINCT n FROM b10),
place AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, long WHERE len(w) >= n)),
hit AS (SELECT r, item, i, p.n FROM place p JOIN win USING (n, s)),
per AS (SELECT r, count(DISTINCT k) n_hit FROM (SELECT r, unnest(range(i, i + n)) k FROM hit) GROUP BY 1),
named AS (SELECT r, count(*) n_items, string_agg(item, ',' ORDER BY encode(item)) items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated FROM d LEFT JOIN per USING (r) LEFT JOIN named USING (r)"""

RANKED = f"""WITH d AS (SELECT CAST(doc_id AS BIGINT) doc_id, row_number() OVER () r, {_TERMS} w FROM documents), b AS (SELECT item_id, row_number() OVER () q, {_TERMS} w FROM benchmark),
tf AS (SELECT r, w, count(*) tf FROM (SELECT r, unnest(w) w FROM d) GROUP BY 1, 2),
st AS (SELECT count(*) n, CAST(sum(len(w)) AS BIGINT) l FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(w) * n) // l m FROM d, st WHERE len(w) > 0),
wt AS (SELECT w, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) wt FROM (SELECT w, count(*) df FROM tf GROUP BY 1), st),
asked AS (SELECT q, w, count(*) times FROM (SELECT q, unnest(w) w FROM b) GROUP BY 1, 2),
scored AS (SELECT q, r, CAST(sum(times * wt * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) score FROM asked JOIN wt USING (w) JOIN tf USING (w) JOIN m USING (r) GROUP BY 1, 2),
placed AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) rank FROM scored JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) rank, doc_id, score FROM placed JOIN b USING (q) WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substrings": SUBSTRINGS, "op5_jaccard": JACCARD, "op6_quality": QUALITY, "op7_mixing": MIXING, "op10_maxscore": TOP, "op11_resampling": RESAMPLING, "op12_decontamination": DECONTAMINATION, "op13_ranked_search": RANKED}
