"""DuckDB SQL of the core queries, over the same tables.

The tables hold Latin and Cyrillic letters only, and of the characters that
compatibility composition changes only full-width forms, the ellipsis and loose
marks; the SQL states the operators' rules for these.
"""

from __future__ import annotations

from corpusloom.plans.queries import BATCH, BIAS, MAX_LENGTH, TINY, WEIGHT

BLANK = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PUNCTUATION = r"!-/:-@\[-`{-~\pP"
_FULL = "".join(chr(0xFF01 + i) for i in range(94))
_HALF = "".join(chr(0x21 + i) for i in range(94))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _nfkc(text: str) -> str:
    return f"nfc_normalize(translate(replace({text}, '…', '...'), {_quoted(_FULL)}, {_quoted(_HALF)}))"


def _normalized(text: str) -> str:
    spaced = f"regexp_replace({_nfkc(text)}, '{BLANK}', ' ', 'g')"
    kept = rf"regexp_replace({spaced}, '[\x{{0}}\x{{FFFD}}\p{{Cc}}\p{{Cf}}]', '', 'g')"
    return f"nullif(trim(regexp_replace({kept}, ' +', ' ', 'g')), '')"


def _tokens(text: str) -> str:
    """Basic tokens with lower-casing; the texts hold no special tokens."""
    clean = rf"regexp_replace(regexp_replace({text}, '[\t\n\r\p{{Zs}}]', ' ', 'g'), '[\x{{FFFD}}\p{{C}}]', '', 'g')"
    bare = rf"regexp_replace(strip_accents(lower({clean})), '\p{{Mn}}', '', 'g')"
    unknown = rf"regexp_replace({bare}, '(?:\p{{Cyrillic}}\p{{M}}*)+', chr(57344), 'g')"
    found = rf"regexp_extract_all({unknown}, '[^ \x{{2028}}\x{{2029}}\x{{E000}}0-9{PUNCTUATION}]+|[\x{{E000}}0-9{PUNCTUATION}]')"
    return f"list_transform({found}, lambda t: CASE WHEN t = chr(57344) THEN '[UNK]' ELSE t END)"


WORDS = f"words AS (SELECT word, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS word FROM documents WHERE text IS NOT NULL) WHERE word NOT IN ('[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]') GROUP BY word)"
PIECES = f"{WORDS}, pieces AS (SELECT word, n, list_transform(range(1, length(word) + 1), lambda i: CASE WHEN i = 1 THEN word[1] ELSE '##' || word[i] END) AS p FROM words WHERE n >= 2)"
PAIRS = f"{PIECES}, spread AS (SELECT word, n, p, unnest(range(1, len(p))) AS i FROM pieces), pairs AS (SELECT p[i] AS \"left\", p[i + 1] AS \"right\", word, n FROM spread)"

RECORDS = "lines AS (SELECT line_number, min(value) AS value FROM raw_records GROUP BY line_number)"
KINDS = rf"""{RECORDS}, kinds AS (SELECT line_number, value, CASE
  WHEN value IS NULL OR regexp_full_match(value, '{BLANK}*') THEN 'blank'
  WHEN NOT json_valid(value) THEN 'invalid'
  WHEN json_type(value) <> 'OBJECT' THEN 'not_object'
  WHEN coalesce(json_type(value, '$.text'), '') <> 'VARCHAR' THEN 'no_text' ELSE 'text' END AS kind FROM lines)"""
STATUSES = f"""{KINDS}, norm AS (SELECT line_number, kind, CASE WHEN kind = 'text' THEN {_normalized("json_extract_string(value, '$.text')")} END AS t FROM kinds WHERE kind <> 'blank'),
 first AS (SELECT *, CASE WHEN kind IN ('invalid', 'not_object') THEN 'invalid_json' WHEN kind <> 'text' THEN 'invalid_schema' WHEN t IS NULL THEN 'empty' WHEN length(t) < 20 THEN 'short' ELSE 'kept' END AS s FROM norm),
 statuses AS (SELECT line_number AS position, CASE WHEN s = 'kept' AND row_number() OVER (PARTITION BY s, t ORDER BY line_number) > 1 THEN 'duplicate' ELSE s END AS status, t FROM first)"""

SPLITS = "ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY split_ord, line_number) AS r, first_value(split) OVER (PARTITION BY id ORDER BY split_ord, line_number) AS first_split FROM clean_corpus WHERE id IS NOT NULL)"

SEGMENTS = f"""{WORDS}, steps AS (
  SELECT word, 1 AS here, CAST([] AS VARCHAR[]) AS out, FALSE AS lost FROM words WHERE length(word) <= 100
  UNION ALL
  SELECT word, CASE WHEN m IS NULL THEN length(word) + 1 ELSE here + m END, CASE WHEN m IS NULL THEN ['[UNK]'] ELSE list_append(out, CASE WHEN here > 1 THEN '##' ELSE '' END || substr(word, here, m)) END, m IS NULL
  FROM (SELECT s.*, (SELECT max(k) FROM (SELECT unnest(range(1, length(s.word) - s.here + 2)) AS k) JOIN vocabulary v ON v.token = CASE WHEN s.here > 1 THEN '##' ELSE '' END || substr(s.word, s.here, k)) AS m FROM steps s WHERE s.here <= length(s.word))),
 segments AS (SELECT word, out FROM steps WHERE here > length(word) UNION ALL SELECT word, ['[UNK]'] FROM words WHERE length(word) > 100)"""
ENCODED = f"""{SEGMENTS}, places AS (SELECT doc_id, generate_subscripts(t, 1) AS w, unnest(t) AS word FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents WHERE text IS NOT NULL)),
 parts AS (SELECT p.doc_id, p.w, coalesce(s.out, [p.word]) AS out FROM places p LEFT JOIN segments s USING (word)),
 tokens AS (SELECT doc_id, w, generate_subscripts(out, 1) AS k, unnest(out) AS token FROM parts),
 encoded AS (SELECT doc_id, list(coalesce(v.id, 1) ORDER BY w, k) AS ids FROM tokens LEFT JOIN vocabulary v USING (token) GROUP BY doc_id)"""

STORED = "stored AS (SELECT store, doc_index, start_offset, end_offset, max(token_ids) AS ids FROM token_store GROUP BY ALL)"
BODY = MAX_LENGTH - 2
SEQUENCES = f"""{STORED}, chunked AS (SELECT store, doc_index, ids, unnest(range(0, CAST(ceil(len(ids) / {BODY}.0) AS BIGINT))) AS chunk FROM stored WHERE len(ids) > 0),
 seqs AS (SELECT row_number() OVER (ORDER BY store, doc_index, chunk) - 1 AS seq_index, store, doc_index, chunk, list_concat([2], list_concat(ids[chunk * {BODY} + 1 : chunk * {BODY} + {BODY}], [3])) AS x FROM chunked)"""
BATCHES = f"""{SEQUENCES}, sized AS (SELECT *, seq_index // {BATCH} AS batch_id, max(len(x)) OVER (PARTITION BY seq_index // {BATCH}) AS m FROM seqs),
 batches AS (SELECT seq_index, batch_id, m, list_resize(x, m, 0) AS ids, list_transform(range(0, m), lambda i: CASE WHEN i < len(x) THEN 1 ELSE 0 END) AS mask FROM sized)"""


def _hash(kind: str) -> str:
    return f"('0x' || substr(md5('42|0|' || seq_index || '|' || i || '|{kind}'), 1, 15))::BIGINT"


MASKED = f"""{BATCHES}, cells AS (SELECT seq_index, i, ids[i + 1] AS old, mask[i + 1] = 1 AND ids[i + 1] NOT IN (0, 2, 3) AS can FROM (SELECT seq_index, ids, mask, unnest(range(0, m)) AS i FROM batches)),
 drawn AS (SELECT *, CASE WHEN can THEN row_number() OVER (PARTITION BY seq_index, can ORDER BY {_hash('pick')}, i) END AS r, count(*) FILTER (WHERE can) OVER (PARTITION BY seq_index) AS c FROM cells),
 chosen AS (SELECT *, coalesce(r <= least(greatest(1, CAST(round_even(c * 0.15::DOUBLE, 0) AS INTEGER)), c), FALSE) AS picked, {_hash('kind')}::DOUBLE / 1152921504606846976.0::DOUBLE AS u, 5 + {_hash('token')} % {TINY.vocab_size - 5} AS other FROM drawn),
 masked AS (SELECT seq_index, i, CASE WHEN picked AND u < 0.8 THEN 4 WHEN picked AND u < 0.9 THEN other ELSE old END AS new, CASE WHEN picked THEN old ELSE -100 END AS label FROM chosen)"""

CELLS = "cells AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_GELU = "0.5::DOUBLE * x * (1.0::DOUBLE + tanh(sqrt(2.0::DOUBLE / pi()) * (x + 0.044715::DOUBLE * x * x * x)))"


def _linear() -> str:
    terms = [" + ".join(f"({w}::DOUBLE) * embedding[{k + 1}]::DOUBLE" for k, w in enumerate(row)) + f" + ({b}::DOUBLE)" for row, b in zip(WEIGHT, BIAS)]
    return " UNION ALL ".join(f"SELECT vec_id, {i} AS place, round({t}, 6) AS y FROM embeddings" for i, t in enumerate(terms))


def _places() -> str:
    parts = []
    for i in range(2):
        terms = " + ".join(f"embedding[{4 * i + k + 1}]::DOUBLE + ({w}::DOUBLE)" for k, w in enumerate(WEIGHT[i]))
        parts.append(f"SELECT vec_id, {i} AS place, round({terms}, 6) AS y FROM embeddings")
    return " UNION ALL ".join(parts)


def _attention() -> str:
    score = lambda j: f"exp((embedding[1]::DOUBLE * embedding[{2 * j + 1}]::DOUBLE + embedding[2]::DOUBLE * embedding[{2 * j + 2}]::DOUBLE) / sqrt(2.0::DOUBLE))"
    total = " + ".join(score(j) for j in range(3))
    out = [f"SELECT vec_id, {d} AS place, round(({' + '.join(f'{score(j)} * embedding[{2 * j + d + 1}]::DOUBLE' for j in range(3))}) / ({total}), 6) AS y FROM embeddings" for d in range(2)]
    return " UNION ALL ".join(out)


LOSS = "SELECT vec_id, label, ln(list_sum(list_transform(embedding, lambda e: exp(e::DOUBLE)))) - embedding[label % len(embedding) + 1]::DOUBLE AS l FROM embeddings"


def _text(values: str) -> str:
    return f"array_to_string({values}, ' ')"


def oracle_sql() -> dict[str, str]:
    return {
        "word_counts": f"WITH {WORDS} SELECT word, n FROM words",
        "top_words": f"WITH {WORDS} SELECT word, n FROM words ORDER BY n DESC, word LIMIT 100",
        "basic_token_counts": f"SELECT doc_id, CAST(len({_tokens(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) AS INTEGER) AS n_tokens FROM documents",
        "basic_token_lists": f"SELECT doc_id, {_text(_tokens('text'))} AS tokens FROM documents WHERE text IS NOT NULL",
        "token_counts_by_lang": f"SELECT lang, count(*) AS documents, CAST(sum(coalesce(len({_tokens('text')}), 0)) AS BIGINT) AS n_tokens FROM documents GROUP BY lang",
        "normalized_documents": f"SELECT doc_id, {_normalized('text')} AS text_norm FROM documents",
        "document_ids": "SELECT doc_id, sha256(text) AS id FROM documents",
        "record_kinds": f"WITH {KINDS} SELECT kind, count(*) AS lines FROM kinds GROUP BY kind",
        "clean_documents": f"WITH {STATUSES} SELECT position, sha256(t) AS id, t AS text FROM statuses WHERE status = 'kept'",
        "clean_statuses": f"WITH {STATUSES} SELECT position, status FROM statuses",
        "clean_stats": f"WITH {STATUSES} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("kept", "invalid_json", "invalid_schema", "empty", "short", "duplicate")) + " FROM statuses",
        "split_dedup": f"WITH {SPLITS} SELECT pos, split, line_number, id FROM ranked WHERE r = 1",
        "split_dedup_stats": f"WITH {SPLITS} SELECT split, count(*) AS input, count(*) FILTER (WHERE r = 1) AS kept, count(*) FILTER (WHERE r > 1) AS removed FROM ranked GROUP BY split",
        "split_overlaps": f"WITH {SPLITS} SELECT id, split, line_number, first_split FROM ranked WHERE r > 1",
        "article_titles": rf"WITH own AS (SELECT shard, row_index, regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g') AS t FROM shard_lines) SELECT DISTINCT shard, row_index, regexp_extract(t, '^= ([^\n]+) =$', 1) AS title FROM own WHERE NOT starts_with(t, '= =') AND regexp_matches(t, '^= [^\n]+ =$')",
        "line_documents": rf"""WITH once AS (SELECT shard, row_index, min(line) AS line FROM shard_lines GROUP BY ALL),
 own AS (SELECT shard, row_index, regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g') AS t FROM once),
 titled AS (SELECT *, CASE WHEN NOT starts_with(t, '= =') AND regexp_matches(t, '^= [^\n]+ =$') THEN regexp_extract(t, '^= ([^\n]+) =$', 1) END AS title FROM own WHERE t <> ''),
 numbered AS (SELECT *, CAST(count(title) OVER (ORDER BY shard, row_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS doc_no FROM titled)
 SELECT doc_no, string_agg(coalesce(title, t), ' ' ORDER BY shard, row_index) AS text FROM numbered GROUP BY doc_no""",
        "alphabet": f"WITH {PIECES}, found AS (SELECT DISTINCT unnest(p) AS token FROM pieces UNION SELECT CAST(unnest(range(0, 10)) AS VARCHAR)) SELECT CAST(row_number() OVER (ORDER BY token) + 4 AS INTEGER) AS id, token FROM found UNION ALL SELECT CAST(i AS INTEGER), ['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]'][i + 1] FROM range(0, 5) t(i)",
        "piece_counts": f"WITH {PIECES} SELECT piece, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(p) AS piece, n FROM pieces) GROUP BY piece",
        "pair_counts": f'WITH {PAIRS} SELECT "left", "right", CAST(sum(n) AS BIGINT) AS n FROM pairs GROUP BY ALL',
        "pair_words": f'WITH {PAIRS} SELECT DISTINCT "left", "right", word FROM pairs',
        "best_pairs": f"""WITH {PAIRS}, c AS (SELECT piece, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(p) AS piece, n FROM pieces) GROUP BY piece), f AS (SELECT "left", "right", CAST(sum(n) AS BIGINT) AS n FROM pairs GROUP BY ALL)
 SELECT f."left", f."right", f.n, round(f.n::DOUBLE / (a.n::DOUBLE * b.n::DOUBLE), 12) AS score FROM f JOIN c a ON a.piece = f."left" JOIN c b ON b.piece = f."right" ORDER BY f.n::DOUBLE / (a.n::DOUBLE * b.n::DOUBLE) DESC, f.n DESC, f."left", f."right" LIMIT 50""",
        "vocabulary_checks": "SELECT count(*) AS size, count(*) - count(DISTINCT token) AS duplicates, max(id) + 1 - count(DISTINCT id) AS gaps, count(*) FILTER (WHERE id < 5 AND token = ['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]'][id + 1]) AS specials FROM vocabulary",
        "word_segments": f"WITH RECURSIVE {SEGMENTS} SELECT word, {_text('out')} AS pieces FROM segments",
        "encoded_documents": f"WITH RECURSIVE {ENCODED} SELECT doc_id, {_text('ids')} AS ids FROM encoded",
        "encoded_offsets": f"WITH RECURSIVE {ENCODED} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_index, CAST(coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, len(ids) AS length FROM encoded",
        "store_round_trip": f"WITH RECURSIVE {ENCODED} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_index, CAST(coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, len(ids) AS length, {_text('ids')} AS ids FROM encoded",
        "packed_round_trip": f"WITH RECURSIVE {ENCODED} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_index, CAST(coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, len(ids) AS length, {_text('ids')} AS ids FROM encoded",
        "text_round_trip": "SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text",
        "vocabulary_round_trip": "SELECT id, token FROM vocabulary",
        "first_encoded": f"WITH RECURSIVE {ENCODED} SELECT doc_id, CAST(len(ids) + 2 AS INTEGER) AS n_ids FROM encoded WHERE doc_id < 100",
        "stored_token_counts": f"WITH {STORED} SELECT token, n FROM (SELECT id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM stored) GROUP BY id) JOIN vocabulary USING (id)",
        "word_ids": f"WITH {WORDS} SELECT word, coalesce(id, 1) AS id FROM words LEFT JOIN vocabulary ON token = word",
        "stored_checks": f"WITH {STORED} SELECT store, count(*) AS documents, CAST(sum(end_offset - start_offset) AS BIGINT) AS tokens, count(*) FILTER (WHERE len(ids) <> end_offset - start_offset) AS bad_lengths, count(*) FILTER (WHERE list_min(ids) < 0 OR list_max(ids) >= 2111) AS bad_ids FROM stored WHERE ids IS NOT NULL GROUP BY store",
        "store_summary": f"WITH RECURSIVE {ENCODED} SELECT count(*) AS documents, CAST(sum(len(ids)) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS bad_lengths, CAST(0 AS BIGINT) AS gaps, 0 AS bad_starts, CAST(0 AS BIGINT) AS bad_ids FROM encoded",
        "training_sequences": f"WITH {SEQUENCES} SELECT seq_index, store, doc_index, CAST(chunk AS INTEGER) AS chunk, {_text('x')} AS ids FROM seqs",
        "padded_batches": f"WITH {BATCHES} SELECT seq_index, batch_id, {_text('ids')} AS ids, {_text('mask')} AS mask FROM batches",
        "batch_shapes": f"WITH {BATCHES} SELECT batch_id, count(*) AS batch_size, CAST(max(m) AS INTEGER) AS sequence_length FROM batches GROUP BY batch_id",
        "mlm_masks": f"WITH {MASKED} SELECT seq_index, string_agg(CAST(new AS VARCHAR), ' ' ORDER BY i) AS ids, string_agg(CAST(label AS VARCHAR), ' ' ORDER BY i) AS labels FROM masked GROUP BY seq_index",
        "mlm_label_counts": f"WITH {MASKED} SELECT seq_index, CAST(count(*) FILTER (WHERE label <> -100) AS INTEGER) AS selected FROM masked GROUP BY seq_index",
        "layer_norm": f"WITH {CELLS}, m AS (SELECT vec_id, avg(x) AS a, var_pop(x) AS v FROM cells GROUP BY vec_id) SELECT vec_id, CAST(place AS INTEGER) AS place, round((x - a) / sqrt(v + 0.00001::DOUBLE), 4) + 0.0 AS x FROM cells JOIN m USING (vec_id)",
        "gelu": f"WITH {CELLS} SELECT vec_id, CAST(place AS INTEGER) AS place, round({_GELU}, 6) AS y FROM cells",
        "linear": _linear(),
        "linear_whole": f"WITH {CELLS} SELECT vec_id, CAST(i AS INTEGER) AS place, round(sum(x * (((31 * i + 17 * place + i * place) % 13 - 6) / 8.0::DOUBLE)) + (i - 3) / 4.0::DOUBLE, 6) AS y FROM cells, range(0, 8) r(i) GROUP BY vec_id, i",
        "position_add_whole": f"WITH {CELLS} SELECT vec_id, CAST(place AS INTEGER) AS place, round(x + (((5 * (place // 8) + 3 * (place % 8)) % 9) - 4) / 4.0::DOUBLE, 6) AS y FROM cells",
        "attention_whole": f"""WITH {CELLS}, parts AS (SELECT vec_id, place // 8 AS i, place % 8 AS d, x FROM cells),
 scores AS (SELECT q.vec_id, q.i, k.i AS j, exp(sum(q.x * k.x) / sqrt(8.0::DOUBLE)) AS e FROM parts q JOIN parts k ON k.vec_id = q.vec_id AND k.d = q.d AND k.i < 7 GROUP BY ALL),
 totals AS (SELECT vec_id, i, sum(e) AS t FROM scores GROUP BY ALL)
 SELECT s.vec_id, CAST(s.i * 8 + v.d AS INTEGER) AS place, round(sum(s.e * v.x) / any_value(t), 6) + 0.0 AS y FROM scores s JOIN totals USING (vec_id, i) JOIN parts v ON v.vec_id = s.vec_id AND v.i = s.j GROUP BY s.vec_id, s.i, v.d""",
        "softmax": f"WITH {CELLS}, m AS (SELECT vec_id, sum(exp(x)) AS s FROM cells GROUP BY vec_id) SELECT vec_id, CAST(place AS INTEGER) AS place, round(exp(x) / s, 6) AS y FROM cells JOIN m USING (vec_id)",
        "position_add": _places(),
        "attention": _attention(),
        "mlm_loss": f"SELECT vec_id, round(l, 6) AS loss FROM ({LOSS})",
        "loss_metrics": f"WITH per AS (SELECT label, avg(l) AS loss, count(*) AS masked FROM ({LOSS}) GROUP BY label) SELECT round(sum(loss * masked) / sum(masked), 6) AS loss, count(*) AS batches, CAST(sum(masked) AS BIGINT) AS masked_positions FROM per",
    }
