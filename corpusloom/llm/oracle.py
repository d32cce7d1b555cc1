"""SQL of the training-data queries that SQL can state on whole tables.

The near-duplicate queries join all n-grams of all texts here, which is what
the operators avoid; it is quick enough at the scale of the comparison.
"""

from __future__ import annotations

from corpusloom.plans.oracle import _FULL, _HALF, BLANK, KINDS, _normalized, _quoted, _tokens

FOLD = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
NORM = f"norm AS (SELECT pos, split, {_normalized('text')} AS t FROM clean_corpus WHERE text IS NOT NULL)"
FOLDED = f"{NORM}, folded AS (SELECT pos, split, {FOLD.format('t')} AS f FROM norm WHERE t IS NOT NULL)"
GRAMS = rf"""{FOLDED}, words AS (SELECT pos, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w FROM norm WHERE t IS NOT NULL),
 grams AS (SELECT DISTINCT pos, hash(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT pos, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
 sizes AS (SELECT pos, count(*) AS n FROM grams GROUP BY pos),
 shared AS (SELECT a.pos AS pa, b.pos AS pb, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.pos < b.pos GROUP BY ALL),
 alike AS (SELECT pa, pb FROM shared JOIN sizes x ON x.pos = pa JOIN sizes y ON y.pos = pb WHERE 5 * k >= 3 * (x.n + y.n - k))"""
CROSS = f"""{GRAMS}, either_way AS (SELECT pa, pb FROM alike UNION SELECT a.pos, b.pos FROM folded a JOIN folded b ON a.f = b.f AND a.f <> '' AND a.pos < b.pos),
 crossed AS (SELECT CASE WHEN x.split = 'train' THEN pb ELSE pa END AS pos, CAST(fx.f = fy.f AND fx.f <> '' AS BIGINT) AS copy FROM either_way JOIN clean_corpus x ON x.pos = pa JOIN clean_corpus y ON y.pos = pb JOIN folded fx ON fx.pos = pa JOIN folded fy ON fy.pos = pb WHERE (x.split = 'train') <> (y.split = 'train'))"""
FIVES = rf"""{NORM}, words AS (SELECT pos, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w FROM norm WHERE t IS NOT NULL),
 grams AS (SELECT DISTINCT pos, hash(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS g FROM (SELECT pos, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
 sets AS (SELECT pos, list(g ORDER BY g) AS s, count(*) AS n FROM grams GROUP BY pos), classes AS (SELECT pos, n, min(pos) OVER (PARTITION BY s) AS class_id FROM sets),
 heads AS (SELECT g.pos, g.g, c.n FROM grams g JOIN classes c ON c.pos = g.pos AND c.class_id = c.pos),
 shared AS (SELECT a.pos AS pa, b.pos AS pb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM heads a JOIN heads b ON a.g = b.g AND a.pos <> b.pos GROUP BY ALL),
 degree AS (SELECT pa AS class_id, count(*) AS links FROM shared WHERE 5 * k >= 4 * (na + nb - k) GROUP BY pa)"""

RECORDS = f"""{KINDS}, objects AS (SELECT line_number, value FROM kinds WHERE kind = 'text' AND length({_normalized("json_extract_string(value, '$.text')")}) >= 20),
 nodes AS (SELECT line_number, fullkey, type, atom FROM objects, json_tree(value)),
 leaves AS (SELECT line_number, fullkey, CASE WHEN type = 'VARCHAR' THEN 's' || {FOLD.format("coalesce(" + _normalized("json_extract_string(atom, '$')") + ", '')")}
   WHEN type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'n' || CAST(CAST(atom AS DOUBLE) AS VARCHAR) WHEN atom IS NULL THEN type ELSE 'o' || CAST(atom AS VARCHAR) END AS leaf FROM nodes),
 canon AS (SELECT line_number, string_agg(fullkey || '=' || leaf, chr(10) ORDER BY fullkey) AS c FROM leaves GROUP BY line_number)"""


LISTED = r"regexp_replace(lower(source), '^\s+|\s+$', '', 'g')"
#: Budgets in SQL: sources by the level at which they are used up, the first that holds out sets the level of the rest.
MIXED = f"""sized AS (SELECT doc_id, {LISTED} AS name, coalesce(len({_tokens('text')}), 0) AS n FROM documents),
 own AS (SELECT z.doc_id, s.source, z.n FROM sized z JOIN source_targets s ON z.name = {LISTED.replace('source', 's.source')}),
 held AS (SELECT s.source, any_value(s.target_share) AS target_share, any_value(s.max_repeats) AS max_repeats, count(o.doc_id) AS documents, CAST(coalesce(sum(o.n), 0) AS BIGINT) AS tokens FROM source_targets s LEFT JOIN own o USING (source) GROUP BY s.source),
 total AS (SELECT CAST(sum(tokens) AS BIGINT) AS total FROM held),
 levels AS (SELECT *, (total - coalesce(sum(max_repeats * tokens) OVER (ORDER BY max_repeats * tokens / target_share, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(target_share) OVER (ORDER BY max_repeats * tokens / target_share, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY max_repeats * tokens / target_share, source) AS turn FROM held, total WHERE target_share > 0),
 water AS (SELECT arg_min(level, turn) FILTER (WHERE level * target_share < max_repeats * tokens) AS level FROM levels),
 budgets AS (SELECT held.*, total, CASE WHEN target_share <= 0 THEN 0 WHEN water.level IS NULL OR water.level * target_share >= max_repeats * tokens THEN max_repeats * tokens ELSE CAST(floor(water.level * target_share + 1e-6) AS BIGINT) END AS budget FROM held, total, water),
 classes AS (SELECT source, CAST(floor(log2(n) * 4 + 1e-9) AS INTEGER) AS k, CAST(sum(n) AS BIGINT) AS t FROM own WHERE n > 0 GROUP BY ALL),
 parts AS (SELECT source, budget // tokens AS whole, budget % tokens AS rest FROM budgets WHERE tokens > 0),
 rates AS (SELECT source, k, pow(2.0, k / 8.0) AS w, (rest - coalesce(sum(t) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(pow(2.0, k / 8.0) * t) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM classes JOIN parts USING (source)),
 scales AS (SELECT source, arg_max(c, k) FILTER (WHERE c * w <= 1) AS c FROM rates GROUP BY source),
 chances AS (SELECT source, k, CASE WHEN s.c IS NULL THEN 1.0 ELSE least(1.0, greatest(0.0, s.c * w)) END AS p FROM rates JOIN scales s USING (source)),
 drawn AS (SELECT doc_id, o.source, n, whole, rest, p, (('0x' || substr(md5('42|' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM own o JOIN parts USING (source) JOIN chances ch ON ch.source = o.source AND ch.k = CAST(floor(log2(n) * 4 + 1e-9) AS INTEGER) WHERE n > 0),
 ranked AS (SELECT *, CASE WHEN p >= 1 THEN u * pow(2.0, -61) WHEN p > 0 THEN u / (1 - u) * (1 - p) / p END AS q FROM drawn),
 places AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM ranked),
 mix AS (SELECT doc_id, source, n AS tokens, CAST(whole + CASE WHEN rest > 0 AND q IS NOT NULL AND earlier * 2 + n <= rest * 2 THEN 1 ELSE 0 END AS BIGINT) AS copies FROM places)"""


# The statistics of problem 1 character by character; of compatibility forms the texts hold full-width ones and the ellipsis.
QUALITY = rf"""chars AS (SELECT pos, generate_subscripts(cs, 1) - 1 AS place, unnest(cs) AS c FROM (SELECT pos, regexp_extract_all(text, '(?s).') AS cs FROM clean_corpus WHERE text <> '')),
 kinds AS (SELECT pos, place, c, CASE WHEN regexp_matches(c, '{BLANK}') THEN 1 WHEN regexp_matches(c, '[\p{{Cc}}\p{{Cf}}\p{{Mn}}]') THEN 0 WHEN regexp_matches(c, '[\p{{L}}\p{{N}}]') THEN 2 ELSE 3 END AS k, lower(translate(c, {_quoted(_FULL)}, {_quoted(_HALF)})) AS fold FROM chars),
 live AS (SELECT *, CAST(k = 2 AND lag(k) OVER (PARTITION BY pos ORDER BY place) IS DISTINCT FROM 2 AS INTEGER) AS begins FROM kinds WHERE k > 0),
 numbered AS (SELECT *, sum(begins) OVER (PARTITION BY pos ORDER BY place ROWS UNBOUNDED PRECEDING) AS w FROM live),
 frequent AS (SELECT DISTINCT word FROM common_words WHERE length(word) > 1 OR NOT regexp_full_match(word, '[\x{{00}}-\x{{7F}}]*')),
 words AS (SELECT pos, w, min(place) AS begun, count(*) AS size, string_agg(fold, '' ORDER BY place) IN (SELECT word FROM frequent) AS hit FROM numbered WHERE k = 2 GROUP BY pos, w),
 seen AS (SELECT pos, place // 128 AS win, count(*) AS visible FROM kinds WHERE k >= 2 GROUP BY ALL),
 begun AS (SELECT pos, begun // 128 AS win, count(*) AS n, count(*) FILTER (WHERE hit) AS common FROM words GROUP BY ALL),
 prose AS (SELECT pos, sum(visible) AS prose FROM seen JOIN begun USING (pos, win) WHERE common >= 1 AND common * 20 >= n AND visible <= n * 12 GROUP BY pos),
 totals AS (SELECT pos, count(*) FILTER (WHERE k >= 2) AS visible, count(*) FILTER (WHERE k = 3) AS symbols, count(*) FILTER (WHERE k = 2 AND fold BETWEEN '0' AND '9') AS digits FROM kinds GROUP BY pos),
 sums AS (SELECT pos, count(*) AS words, sum(size) AS word_chars, count(*) FILTER (WHERE hit) AS common FROM words GROUP BY pos),
 placed AS (SELECT *, coalesce(sum(CAST(c = chr(10) AS INTEGER)) OVER (PARTITION BY pos ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM kinds),
 ends AS (SELECT pos, line, arg_max(translate(c, {_quoted(_FULL)}, {_quoted(_HALF)}), place) AS last FROM placed WHERE k >= 2 GROUP BY ALL),
 lines AS (SELECT pos, count(*) AS lines, count(*) FILTER (WHERE last IN ('.', '!', '?', '…', '。', '"', '”', chr(39), '’', ')', '»', ':', ';')) AS ended FROM ends GROUP BY pos),
 measured AS (SELECT c.pos, c.text IS NULL AS none, coalesce(s.words, 0) AS words, coalesce(word_chars, 0) / greatest(coalesce(s.words, 0), 1) AS mean_word_length, coalesce(symbols, 0) / greatest(coalesce(visible, 0), 1) AS symbol_ratio, coalesce(digits, 0) / greatest(coalesce(visible, 0), 1) AS digit_ratio,
  coalesce(lines, 0) AS line_count, coalesce(ended, 0) / greatest(coalesce(lines, 0), 1) AS ended_line_share, coalesce(common, 0) / greatest(coalesce(s.words, 0), 1) AS common_share, coalesce(prose, 0) / greatest(coalesce(visible, 0), 1) AS prose_share
  FROM clean_corpus c LEFT JOIN totals USING (pos) LEFT JOIN sums s USING (pos) LEFT JOIN lines USING (pos) LEFT JOIN prose USING (pos)),
 stats AS (SELECT *, prose_share >= 0.5 AND symbol_ratio <= 0.25 AND digit_ratio <= 0.3 AS is_prose FROM measured)"""


def oracle_sql() -> dict[str, str]:
    listed = r"regexp_replace(lower(source), '^\s+|\s+$', '', 'g')"
    return {
        "p1_stats": f"WITH {QUALITY} SELECT pos, CASE WHEN NOT none THEN words END AS words, CASE WHEN NOT none THEN mean_word_length END AS mean_word_length, CASE WHEN NOT none THEN symbol_ratio END AS symbol_ratio, CASE WHEN NOT none THEN digit_ratio END AS digit_ratio, CASE WHEN NOT none THEN line_count END AS line_count, CASE WHEN NOT none THEN ended_line_share END AS ended_line_share, CASE WHEN NOT none THEN common_share END AS common_share, CASE WHEN NOT none THEN prose_share END AS prose_share, CASE WHEN NOT none THEN is_prose END AS is_prose FROM stats",
        "p1_found": f"WITH {QUALITY} SELECT pos FROM stats WHERE NOT none AND NOT is_prose",
        "p3_found": f"WITH {GRAMS} SELECT pa AS pos_a, pb AS pos_b FROM (SELECT pa, pb FROM alike UNION SELECT a.pos, b.pos FROM folded a JOIN folded b ON a.f = b.f AND a.f <> '' AND a.pos < b.pos) JOIN clean_corpus x ON x.pos = pa JOIN clean_corpus y ON y.pos = pb WHERE (x.split = 'train') <> (y.split = 'train')",
        "p3_report": f"WITH {CROSS}, per AS (SELECT pos, count(*) AS pairs, sum(copy) AS copies FROM crossed GROUP BY pos) SELECT split, source, count(*) AS records, count(pairs) AS leaked, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS pairs, CAST(coalesce(sum(copies), 0) AS BIGINT) AS copies FROM clean_corpus LEFT JOIN per USING (pos) WHERE split <> 'train' GROUP BY ALL",
        "p3_coverage": rf"""WITH {NORM}, words AS (SELECT pos, split, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w FROM norm WHERE t IS NOT NULL),
 places AS (SELECT pos, split, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT pos, split, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
 held AS (SELECT DISTINCT g FROM places WHERE split = 'train'),
 inside AS (SELECT pos, count(DISTINCT i + k) AS covered FROM places JOIN held USING (g), range(0, 3) r(k) WHERE split <> 'train' GROUP BY pos)
 SELECT c.pos, CAST(coalesce(len(w), 0) AS BIGINT) AS words, coalesce(covered, 0) AS covered FROM clean_corpus c LEFT JOIN words USING (pos) LEFT JOIN inside USING (pos) WHERE c.split <> 'train' AND c.text IS NOT NULL""",
        "p4_found": "SELECT 'clean_corpus' AS table_name, pos FROM clean_corpus WHERE length(text) > 2000 UNION ALL SELECT DISTINCT 'token_store', pos FROM token_store WHERE end_offset - start_offset > 510",
        "p4_rejoined": "SELECT pos, sha256(text) AS id, TRUE AS fits FROM clean_corpus WHERE length(text) > 2000",
        "p4_token_cover": "SELECT DISTINCT store, doc_index, pos, end_offset - start_offset AS tokens, TRUE AS fits FROM token_store WHERE end_offset - start_offset > 510",
        "p7_checks": f"SELECT count(*) AS documents, CAST(sum((n + 511) // 512) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS overlapping, CAST(0 AS BIGINT) AS misplaced FROM (SELECT len({_tokens('text')}) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 0",
        "p5_found": f"""WITH {FOLDED}, {RECORDS}, texts AS (SELECT min(pos) OVER (PARTITION BY f) AS first_no, pos AS copy_no FROM folded),
 records AS (SELECT min(line_number) OVER (PARTITION BY c) AS first_no, line_number AS copy_no FROM canon)
 SELECT 'clean_corpus' AS table_name, * FROM texts WHERE first_no <> copy_no UNION ALL SELECT 'raw_records', * FROM records WHERE first_no <> copy_no""",
        "p5_collapsed": f"WITH {FOLDED}, groups AS (SELECT min(pos) AS pos, count(*) AS copies FROM folded GROUP BY f) SELECT pos, copies FROM groups UNION ALL SELECT pos, 1 FROM norm WHERE t IS NULL",
        "p5_collapsed_records": f"WITH {RECORDS} SELECT min(line_number) AS line_number, count(*) AS copies FROM canon GROUP BY c UNION ALL SELECT line_number, 1 FROM lines WHERE value IS NOT NULL AND line_number NOT IN (SELECT line_number FROM canon)",
        "p6_found": f"WITH {GRAMS} SELECT pa AS pos_a, pb AS pos_b FROM alike JOIN folded x ON x.pos = pa JOIN folded y ON y.pos = pb WHERE x.f <> y.f",
        "p6_groups": f"WITH {FIVES} SELECT pos, coalesce(c.class_id, pos) AS class_id, coalesce(links, 0) AS links FROM clean_corpus LEFT JOIN classes c USING (pos) LEFT JOIN degree d ON d.class_id = c.class_id",
        "p8_mix": f"WITH {MIXED} SELECT doc_id, source, tokens, copies FROM mix WHERE copies > 0",
        "p8_shares": f"""WITH {MIXED}, got AS (SELECT source, CAST(sum(tokens * copies) AS BIGINT) AS mixed_tokens, max(copies) AS most_copies FROM mix WHERE copies > 0 GROUP BY source)
 SELECT b.source, target_share, max_repeats, documents, tokens, target_share * total AS target_tokens, target_share * total <= max_repeats * tokens AS reachable, budget, coalesce(mixed_tokens, 0) AS mixed_tokens, coalesce(most_copies, 0) AS most_copies, coalesce(mixed_tokens, 0) / (SELECT sum(mixed_tokens) FROM got) AS mixed_share FROM budgets b LEFT JOIN got USING (source)""",
        "p7_found": f"SELECT doc_id FROM documents WHERE len({_tokens('text')}) > 512",
        "p8_found": f"""WITH sized AS (SELECT {listed} AS name, coalesce(len({_tokens('text')}), 0) AS n FROM documents),
 held AS (SELECT s.source, any_value(s.target_share) AS share, any_value(s.max_repeats) AS most, coalesce(sum(z.n), 0) AS n FROM source_targets s LEFT JOIN sized z ON z.name = {listed.replace('source', 's.source')} GROUP BY s.source)
 SELECT source FROM held WHERE share * (SELECT sum(n) FROM held) > most * n""",
    }
