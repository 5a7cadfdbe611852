"""The same results in SQL for DuckDB, written from the operators' definitions."""

from __future__ import annotations

# Expected values, written out here so that a wrong one in the library shows.
SPECIAL_TOKENS = (
    "[UNK]", "[PAD]", "[BOS]", "[EOS]", "[SEP]", "<features>", "</features>", "<words>", "</words>",
    "<summary>", "</summary>", "<story>", "</story>",
)
COVERAGE_CUTOFFS = (256, 512, 768, 850, 1024, 1280, 1536, 2048)
SPACING_REPAIRS = (
    (" ,", ","), (" .", "."), (" !", "!"), (" ?", "?"), (" '", "'"), (" \n", "\n"), ("Ġ", " "), ("Ċ", "\n"),
)
BLANK_CODES = (
    *range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288,
)

VOCAB = 512
BPE_VOCAB = 256

BLANK = r"[\s\x0b\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s]+"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
STRIP = "||".join(f"chr({code})" for code in BLANK_CODES)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, {quoted(BLANK)}, ' ', 'g'))"


def words(x: str) -> str:
    return f"regexp_extract_all({norm(x)}, {quoted(WORD)})"


def strip(x: str) -> str:
    return f"trim({x}, {STRIP})"


def text_of(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


def u32(key: str) -> str:
    return f"('0x' || substr(md5('42:' || {key}), 1, 8))::UBIGINT"


def u60(key: str) -> str:
    return f"('0x' || substr(md5('42:' || {key}), 1, 15))::UBIGINT"


def split_of(key: str) -> str:
    u = f"({u32(key)}::DOUBLE / 4294967296.0)"
    return f"CASE WHEN {u} < 0.8 THEN 'train' WHEN {u} < 0.9 THEN 'test' ELSE 'validation' END"


SPECIALS = "(VALUES " + ", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(SPECIAL_TOKENS)) + ") s(id, token)"


def counts_cte(table: str = "documents") -> str:
    return f"""counts AS (
  SELECT word, count(*) AS n FROM (SELECT unnest({words('text')}) AS word FROM {table}) GROUP BY word)"""


VOCAB_CTE = f"""{counts_cte()},
vocab AS (
  SELECT id::INTEGER AS id, token, 'special' AS kind FROM {SPECIALS}
  UNION ALL
  SELECT * FROM (
    SELECT (12 + row_number() OVER (ORDER BY n DESC, word))::INTEGER AS id, word AS token, 'word' AS kind
    FROM counts WHERE n >= 2) WHERE id < {VOCAB})"""

ENCODED_CTE = f"""{VOCAB_CTE},
tok AS (
  SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, {words('text')} AS w FROM documents)),
enc AS (
  SELECT d.doc_id, coalesce(e.ids, []::INTEGER[]) AS ids FROM documents d LEFT JOIN (
    SELECT doc_id, list(coalesce(id, 0) ORDER BY pos) AS ids
    FROM tok LEFT JOIN vocab USING (token) GROUP BY doc_id) e USING (doc_id))"""

# Expected records straight from the documents, never from the line stream.
FEATURES = """list_filter([lang, source, CASE WHEN quality = 1 THEN 'quality' END,
    CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)"""
FIRST_LINE = "string_split(text, chr(10))[1]"
DESCRIBED_CTE = f"""described AS (
  SELECT d.doc_id, d.source, d.text, {FEATURES} AS features, {words(FIRST_LINE)} AS words,
    {FIRST_LINE} AS summary
  FROM documents d LEFT JOIN labels USING (doc_id))"""
RECORDS_CTE = f"""{DESCRIBED_CTE},
records AS (
  SELECT source AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rec_id,
    array_to_string(features, ', ') AS features, array_to_string(words, ', ') AS words,
    {strip('summary')} AS summary,
    {strip(f"array_to_string(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), ' ')")} AS story,
    doc_id
  FROM described)"""

LINES_CTE = f"""{DESCRIBED_CTE},
lines AS (
  SELECT source AS src, doc_id, unnest(ls) AS text, unnest(range(len(ls))) AS k FROM (
    SELECT source, doc_id, list_concat(
      ['Features: ' || array_to_string(features, ', '), 'Words: ' || array_to_string(words, ', '),
       'Summary: ' || summary, 'Story:'], list_concat(string_split(text, chr(10)), ['<|endoftext|>'])) AS ls
    FROM described))"""
LINE_NO = "(doc_id << 24) + k"

RENC_CTE = """renc AS (
  SELECT r.src, r.rec_id,
    coalesce(f.ids, []::INTEGER[]) AS f, coalesce(w.ids, []::INTEGER[]) AS w,
    coalesce(s.ids, []::INTEGER[]) AS s, coalesce(t.ids, []::INTEGER[]) AS t
  FROM records r
  LEFT JOIN rids f ON (f.src, f.rec_id, f.field) = (r.src, r.rec_id, 0)
  LEFT JOIN rids w ON (w.src, w.rec_id, w.field) = (r.src, r.rec_id, 1)
  LEFT JOIN rids s ON (s.src, s.rec_id, s.field) = (r.src, r.rec_id, 2)
  LEFT JOIN rids t ON (t.src, t.rec_id, t.field) = (r.src, r.rec_id, 3))"""
SFT_CTE = """prompts AS (
  SELECT *, [2, 5] || f || [6, 7] || w || [8, 9] || s || [10, 11] AS prompt FROM renc),
sft AS (
  SELECT src, rec_id, prompt || t || [12, 3] AS ids,
    list_transform(range(len(prompt)), lambda i: -100) || t || [12, 3] AS labels
  FROM prompts),
cut AS (
  SELECT src, rec_id, CASE WHEN len(ids) > 512 THEN ids[:511] || [3] ELSE ids END AS ids,
    CASE WHEN len(ids) > 512 THEN labels[:511] || [3] ELSE labels END AS labels
  FROM sft)"""

RECORDS_ENCODED_CTE = f"""{VOCAB_CTE},
{RECORDS_CTE},
fields AS (
  SELECT src, rec_id, unnest([0, 1, 2, 3]) AS field, unnest([features, words, summary, story]) AS text
  FROM records),
rtok AS (
  SELECT src, rec_id, field, unnest(w) AS token, unnest(range(len(w))) AS pos
  FROM (SELECT src, rec_id, field, {words('text')} AS w FROM fields)),
rids AS (
  SELECT src, rec_id, field, list(coalesce(id, 0) ORDER BY pos) AS ids
  FROM rtok LEFT JOIN vocab USING (token) GROUP BY ALL),
{RENC_CTE},
{SFT_CTE}"""

FRAMED = "[2] || ids || [3]"
TRUNCATED = f"CASE WHEN len(ids) > 510 THEN ([2] || ids)[:511] || [3] ELSE {FRAMED} END"


def feistel(x: str) -> str:
    """Four turns of two half steps, as text: sides a and b, each half moved by a hash of the other."""
    left, right = f"({x} // b)", f"({x} % b)"
    steps = []
    for turn in range(4):
        steps.append(("l", f"(l + {moved(turn, 'l', 'r')} % a) % a"))
        steps.append(("r", f"(r + {moved(turn, 'r', 'l')} % b) % b"))
    query = f"(SELECT {left} AS l, {right} AS r)"
    for name, step in steps:
        other = "r" if name == "l" else "l"
        query = f"(SELECT {step} AS {name}, {other} FROM {query})"
    return f"(SELECT l * b + r FROM {query})"


def moved(turn: int, side: str, value: str) -> str:
    return f"('0x' || substr(md5('42:' || epoch || ':{turn}:{side}:' || {value}), 1, 15))::BIGINT"


def padded(ids: str, value: int, upto: str) -> str:
    return f"{ids} || list_transform(range({upto} - len({ids})), lambda i: {value})"


def padded_corpus(order: str, size: int, encoded: str = ENCODED_CTE) -> str:
    return f"""WITH RECURSIVE {encoded},
seqs AS (SELECT doc_id, {TRUNCATED} AS ids FROM enc),
numbered AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM seqs),
measured AS (SELECT *, i // {size} AS batch_id, max(len(ids)) OVER (PARTITION BY i // {size}) AS longest
  FROM numbered)
SELECT doc_id, batch_id, i % {size} AS row_in_batch, {text_of('(' + padded('ids', 1, 'longest') + ')')} AS input_ids
FROM measured"""


LENGTHS_CTE = f"""lengths AS (
  SELECT doc_id, len({words('text')}) AS n_tokens FROM documents WHERE text IS NOT NULL AND text <> '')"""

SFT_LENGTHS_CTE = f"""{RECORDS_CTE},
lengths AS (SELECT 10 + len({words('features')}) + len({words('words')}) + len({words('summary')})
  + len({words('story')}) AS n_tokens FROM records)"""
STATS = """SELECT count(*) AS n, min(n_tokens) AS min, max(n_tokens) AS max, round(avg(n_tokens), 6) AS mean,
  round(stddev_pop(n_tokens), 6) AS std, round(quantile_cont(n_tokens, 0.5), 6) AS median,
  round(quantile_cont(n_tokens, 0.25), 6) AS p25, round(quantile_cont(n_tokens, 0.75), 6) AS p75,
  round(quantile_cont(n_tokens, 0.9), 6) AS p90, round(quantile_cont(n_tokens, 0.95), 6) AS p95,
  round(quantile_cont(n_tokens, 0.99), 6) AS p99 FROM lengths"""
COVERAGE = f"""SELECT max_seq, round(100.0::DOUBLE * count(*) FILTER (WHERE n_tokens <= max_seq) / count(*), 6) AS coverage
FROM lengths, (SELECT unnest([{', '.join(map(str, COVERAGE_CUTOFFS))}])::INTEGER AS max_seq) GROUP BY max_seq"""

LOG_CTE = """log AS (SELECT event_type AS epoch, event_id AS step, value / 100.0::DOUBLE AS loss FROM events)"""

SCORES_CTE = """scores AS (
  SELECT vec_id AS ctx, (unnest(range(len(embedding))))::INTEGER AS cand,
    unnest(embedding)::DOUBLE / 0.7::DOUBLE AS score
  FROM embeddings)"""
SOFT = """SELECT *, exp(score - max(score) OVER (PARTITION BY ctx))
    / sum(exp(score - top)) OVER (PARTITION BY ctx) AS prob
  FROM (SELECT *, max(score) OVER (PARTITION BY ctx) AS top FROM {0})"""
KEPT_K = """kept AS (SELECT ctx, cand, score FROM scores
  QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY score DESC, cand) <= 20)"""
KEPT_P = f"""{KEPT_K},
nucleus AS (SELECT ctx, cand, score FROM (
    SELECT *, coalesce(sum(prob) OVER (PARTITION BY ctx ORDER BY score DESC, cand
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM ({SOFT.format('kept')})) WHERE before <= 0.83)"""


LENGTH_PLAN_CTE = f"""{LENGTHS_CTE},
sized AS (SELECT ceil(count(*) / 8)::BIGINT AS n FROM lengths),
sides AS (SELECT n, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM sized),
placed AS (SELECT doc_id, n_tokens, row_number() OVER (
    ORDER BY n_tokens // 64, {u60('doc_id')} >> 16, doc_id) - 1 AS i FROM lengths),
walk AS (
  SELECT no, epoch, n, a, b, {feistel('no')} AS p
  FROM (SELECT DISTINCT i // 8 AS no, 0 AS epoch FROM placed), sides
  UNION ALL
  SELECT no, epoch, n, a, b, {feistel('p')} FROM walk WHERE p >= n),
plan AS (SELECT doc_id, n_tokens, p AS batch_id, (i % 8)::INTEGER AS row_in_batch,
    max(n_tokens) OVER (PARTITION BY i // 8) AS longest
  FROM placed JOIN walk ON no = i // 8 WHERE p < n)"""

LONG_CTE = """long AS (
  SELECT l_returnflag AS ctx, l_orderkey * 8 + l_linenumber AS cand,
    max(round(l_extendedprice / 1000.0::DOUBLE) / 10.0::DOUBLE - l_quantity / 25.0::DOUBLE) / 0.7::DOUBLE AS score
  FROM lineitem GROUP BY 1, 2),
topped AS (SELECT *, max(score) OVER (PARTITION BY ctx) AS top FROM long),
lse AS (SELECT ctx, any_value(top) + ln(sum(exp(score - top))) AS lse, count(*) AS n, avg(score) AS mean
  FROM topped GROUP BY ctx),
likely AS (SELECT ctx, cand, score, exp(score - lse) AS prob FROM long JOIN lse USING (ctx)),
placed AS (SELECT *, row_number() OVER w AS rank,
    coalesce(sum(prob) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM likely WINDOW w AS (PARTITION BY ctx ORDER BY score DESC, cand))"""


def probabilities(ctes: str, source: str) -> str:
    return f"WITH {ctes} SELECT ctx, cand, round(prob, 6) AS prob FROM ({SOFT.format(source)})"


def replaced(x: str) -> str:
    for written, wanted in SPACING_REPAIRS:
        x = "replace({}, {}, {})".format(
            x, quoted(written).replace("\n", "' || chr(10) || '"), quoted(wanted).replace("\n", "' || chr(10) || '")
        )
    return strip(x)


def duration(x: str) -> str:
    return f"format('{{}}:{{}}:{{:.1f}}', floor({x} / 3600)::BIGINT, floor({x} % 3600 / 60)::BIGINT, {x} % 60)"


BYTE_CHARS = "[" + ", ".join(
    f"chr({code})" for code in (
        lambda shown: [b if b in shown else 256 + [h for h in range(256) if h not in shown].index(b) for b in range(256)]
    )({*range(33, 127), *range(161, 173), *range(174, 256)})
) + "]"


def byte_words(x: str) -> str:
    spaced = f"CASE WHEN starts_with({norm(x)}, ' ') OR {norm(x)} = '' THEN {norm(x)} ELSE ' ' || {norm(x)} END"
    return f"regexp_extract_all({spaced}, {quoted(PIECE)})"


def bytes_shown(w: str) -> str:
    return (
        f"array_to_string(list_transform(range(octet_length(encode({w}))), "
        f"lambda i: tbl[('0x' || substr(hex(encode({w})), 2 * i + 1, 2))::INTEGER + 1]), '')"
    )


BYTE_TOKENS_CTE = f"""pieces AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, {byte_words('text')} AS w FROM documents)),
spelled AS (SELECT word, {bytes_shown('word')} AS shown
  FROM (SELECT DISTINCT word FROM pieces), (SELECT {BYTE_CHARS} AS tbl))"""

def bpe_cte(size: int = BPE_VOCAB) -> str:
    """Learning merges as a recursion over the distinct words, spelled as ids in angle brackets.

    A step finds the best pair (most frequent, then smallest ids) and replaces it, leftmost first. One
    more row holds the tokens; a merge that spells a known token takes its id.
    """
    specials = ", ".join(quoted(t) for t in SPECIAL_TOKENS)
    return f"""{BYTE_TOKENS_CTE},
wc AS (SELECT shown AS word, count(*) AS n FROM pieces JOIN spelled USING (word) GROUP BY 1),
alpha AS (SELECT c, 12 + row_number() OVER (ORDER BY unicode(c)) AS id
  FROM (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM wc)),
start AS (SELECT word, any_value(n) AS n, string_agg('<' || id || '>', '' ORDER BY i) AS s
  FROM (SELECT word, n, unnest(string_split(word, '')) AS c, unnest(range(length(word))) AS i FROM wc)
  JOIN alpha USING (c) GROUP BY word),
bpe AS (
  (SELECT 0 AS step, word, n, s, NULL::VARCHAR[] AS toks, 0::BIGINT AS l, 0::BIGINT AS r, 0::BIGINT AS m FROM start
   UNION ALL
   SELECT 0, NULL, 0, '', [{specials}] || coalesce(list(c ORDER BY id), []), 0, 0, 0 FROM alpha)
  UNION ALL
  SELECT step + 1, word, n, replace(s, '<' || p.l || '><' || p.r || '>', '<' || p.m || '>'),
    CASE WHEN toks IS NULL THEN NULL WHEN p.m = len(toks) THEN list_append(toks, p.joined) ELSE toks END, p.l, p.r, p.m
  FROM bpe, (
    SELECT l, r, joined, coalesce(list_position(known, joined) - 1, len(known)) AS m FROM (
      SELECT l, r, known, known[l + 1] || known[r + 1] AS joined FROM (
        SELECT pair[1] AS l, pair[2] AS r, sum(n) AS c FROM (
          SELECT n, unnest(list_transform(range(1, len(ids)), lambda i: [ids[i], ids[i + 1]])) AS pair FROM (
            SELECT n, regexp_extract_all(s, '\\d+')::BIGINT[] AS ids FROM bpe WHERE word IS NOT NULL))
        GROUP BY 1, 2 HAVING sum(n) >= 2 ORDER BY c DESC, l, r LIMIT 1),
        (SELECT toks AS known FROM bpe WHERE toks IS NOT NULL)
      WHERE len(known) < {size})) p),
learned AS (SELECT word AS shown, regexp_extract_all(s, '\\d+')::INTEGER[] AS ids FROM bpe
  WHERE word IS NOT NULL AND step = (SELECT max(step) FROM bpe))"""


def bpe_encoded(source: str, keys: str) -> str:
    """``keys`` and ids of the column text of a source whose words are among the learned ones or not."""
    return f"""SELECT {keys}, coalesce(ids, []::INTEGER[]) AS ids FROM {source} LEFT JOIN (
  SELECT {keys}, flatten(list(ids ORDER BY pos)) AS ids FROM (
    SELECT {keys}, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (
      SELECT {keys}, {byte_words('text')} AS w FROM {source}))
  JOIN spelled USING (word) JOIN learned USING (shown) GROUP BY {keys}) USING ({keys})"""


BPE_RECORDS_CTE = f"""{bpe_cte()},
{RECORDS_CTE},
fields AS (
  SELECT src, rec_id, unnest([0, 1, 2, 3]) AS field, unnest([features, words, summary, story]) AS text
  FROM records),
fpieces AS (
  SELECT src, rec_id, field, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT src, rec_id, field, {byte_words('text')} AS w FROM fields)),
fspelled AS (SELECT word, {bytes_shown('word')} AS shown
  FROM (SELECT DISTINCT word FROM fpieces), (SELECT {BYTE_CHARS} AS tbl)),
-- words of labels and sources may be none of the documents': the merges are replayed on them
fcodes AS (SELECT shown, string_agg('<' || coalesce(id, 0) || '>', '' ORDER BY i) AS s FROM (
  SELECT shown, unnest(string_split(shown, '')) AS c, unnest(range(length(shown))) AS i
  FROM (SELECT DISTINCT shown FROM fspelled)) LEFT JOIN alpha USING (c) GROUP BY shown),
steps AS (SELECT step, l, r, m FROM bpe WHERE toks IS NOT NULL AND step > 0),
replay AS (
  SELECT 0 AS done, shown, s FROM fcodes
  UNION ALL
  SELECT done + 1, shown, replace(s, '<' || l || '><' || r || '>', '<' || m || '>')
  FROM replay JOIN steps ON step = done + 1),
flearned AS (SELECT shown, regexp_extract_all(s, '\\d+')::INTEGER[] AS ids FROM replay
  WHERE done = (SELECT max(step) FROM steps)),
rids AS (SELECT src, rec_id, field, flatten(list(ids ORDER BY pos)) AS ids
  FROM fpieces JOIN fspelled USING (word) JOIN flearned USING (shown) GROUP BY ALL),
{RENC_CTE},
{SFT_CTE}"""

BPE_ENCODED_CTE = f"""{bpe_cte()},
enc AS ({bpe_encoded('documents', 'doc_id')})"""

DECODED = "array_to_string(list(token ORDER BY pos) FILTER (WHERE id >= 13), ' ')"
DECODED_CTE = f"""{ENCODED_CTE},
decoded AS (
  SELECT d.doc_id, coalesce(x.text, '') AS text FROM documents d LEFT JOIN (
    SELECT doc_id, {DECODED} AS text FROM tok LEFT JOIN vocab USING (token) GROUP BY doc_id) x USING (doc_id))"""

ORACLE = {
    "read_corpus": f"SELECT doc_id, text, 'train' AS split FROM documents WHERE {split_of('doc_id')} = 'train'",
    "read_corpus_pruned": f"SELECT doc_id, text, 'train' AS split FROM documents WHERE {split_of('doc_id')} = 'train'",
    "instruct_lines": f"WITH {LINES_CTE} SELECT src, {LINE_NO} AS line_no, text FROM lines",
    "split_counts": f"SELECT {split_of('doc_id')} AS split, count(*) AS n FROM documents GROUP BY 1",
    "sample_corpus": f"SELECT doc_id, text FROM documents ORDER BY {u60('doc_id')}, doc_id LIMIT 500",
    "head_records": f"WITH {RECORDS_CTE} SELECT * EXCLUDE (doc_id) FROM records ORDER BY src, rec_id LIMIT 600",
    "records_roundtrip": f"""WITH {RECORDS_CTE} SELECT * EXCLUDE (doc_id),
      CASE WHEN {split_of('src')} = 'train' THEN 'train' ELSE 'val' END AS part FROM records""",
    "published_records": f"""WITH {RECORDS_CTE} SELECT * EXCLUDE (doc_id),
      CASE WHEN {split_of('src')} = 'train' THEN 'train' ELSE 'val' END AS part FROM records""",
    "maintained_counts": f"WITH {counts_cte()} SELECT * FROM counts",
    "maintained_vocab": f"WITH {VOCAB_CTE} SELECT * FROM vocab",
    "vocab_roundtrip": f"WITH {VOCAB_CTE} SELECT * FROM vocab",
    "default_text": """SELECT doc_id, coalesce(quality::VARCHAR || ',' || toxic::VARCHAR, '') AS text
      FROM documents LEFT JOIN labels USING (doc_id)""",
    "drop_empty": "SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND text <> ''",
    "normalize_text": f"SELECT doc_id, {norm('text')} AS text FROM documents",
    "words_whitespace": f"SELECT doc_id, array_to_string({words('text')}, ' ') AS words FROM documents",
    "words_bytelevel": f"""WITH {BYTE_TOKENS_CTE}
SELECT d.doc_id, coalesce(x.words, '') AS words FROM documents d LEFT JOIN (
  SELECT doc_id, array_to_string(list(shown ORDER BY pos), ' ') AS words
  FROM pieces JOIN spelled USING (word) GROUP BY doc_id) x USING (doc_id)""",
    "special_literals": f"""WITH {DESCRIBED_CTE},
cut AS (SELECT doc_id, list_filter(['[BOS]', '<features>', array_to_string(features, ', '), '</features>',
  '<summary>', summary, '</summary>', '<story>', text, '</story>', '[EOS]', '[PAD]'], lambda x: x <> '') AS p
  FROM described)
SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS piece FROM cut""",
    "join_fields": f"""WITH {DESCRIBED_CTE}
SELECT doc_id, array_to_string(features[3:], ', ') AS features,
  array_to_string({words('text')}, ', ') AS words FROM described""",
    "clean_text": f"SELECT doc_id, {replaced(text_of(words('text')))} AS text FROM documents",
    "format_duration": f"""SELECT event_id, {duration('value')} AS short,
      {duration('(value * 100.0::DOUBLE)')} AS long FROM events""",
    "classify_lines": f"""WITH {LINES_CTE}
SELECT src, {LINE_NO} AS line_no,
  CASE WHEN k = 0 THEN 'features' WHEN k = 1 THEN 'words' WHEN k = 2 THEN 'summary' WHEN k = 3 THEN 'reset'
    WHEN text = '<|endoftext|>' THEN 'end' ELSE 'text' END AS kind,
  CASE WHEN k = 0 THEN {strip('substr(text, 11)')} WHEN k = 1 THEN {strip('substr(text, 8)')}
    WHEN k = 2 THEN {strip('substr(text, 10)')} WHEN k = 3 OR text = '<|endoftext|>' THEN ''
    ELSE {strip('text')} END AS payload
FROM lines""",
    "assign_records": f"""WITH {LINES_CTE},
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rec_id,
  count(*) OVER (PARTITION BY source) AS n_records FROM documents)
SELECT src, {LINE_NO} AS line_no, rec_id, n_records FROM lines JOIN ranked USING (doc_id)""",
    "assemble_records": f"WITH {RECORDS_CTE} SELECT * EXCLUDE (doc_id) FROM records",
    "stream_records": f"WITH {RECORDS_CTE} SELECT * EXCLUDE (doc_id) FROM records",
    "word_counts": f"WITH {counts_cte()} SELECT * FROM counts",
    "word_counts_bytelevel": f"""WITH {BYTE_TOKENS_CTE}
SELECT shown AS word, count(*) AS n FROM pieces JOIN spelled USING (word) GROUP BY 1""",
    "train_word_level": f"WITH {VOCAB_CTE} SELECT * FROM vocab",
    "bpe_pair_counts": f"""WITH {counts_cte()}
SELECT substr(word, i, 1) AS left, substr(word, i + 1, 1) AS right, sum(n)::BIGINT AS n
FROM (SELECT word, n, unnest(range(1, length(word))) AS i FROM counts) GROUP BY 1, 2""",
    "vocab_size": f"WITH {VOCAB_CTE} SELECT count(*) AS vocab_size FROM vocab",
    "token_to_id": f"""WITH {VOCAB_CTE}
SELECT token, coalesce(id, -1) AS id FROM (SELECT DISTINCT unnest({words('text')}) AS token FROM benchmark)
LEFT JOIN vocab USING (token)""",
    "encode_word_level": f"WITH {ENCODED_CTE} SELECT doc_id, {text_of('ids')} AS ids FROM enc",
    # a blank before every word that follows one; the training prefix blank leads
    "encode_bpe_lossless": f"SELECT doc_id, CASE WHEN {norm('text')} = '' THEN '' ELSE ' ' || {norm('text')} END AS text FROM documents",
    "decode_tokens": f"WITH {DECODED_CTE} SELECT * FROM decoded",
    "cut_continuation": f"WITH {ENCODED_CTE} SELECT doc_id, {text_of('(ids || ids)')} AS ids FROM enc",
    "cut_story": f"WITH {ENCODED_CTE} SELECT doc_id, {text_of('(ids || ids)')} AS ids FROM enc",
    "frame_corpus": f"WITH {ENCODED_CTE} SELECT doc_id, {text_of('(' + FRAMED + ')')} AS ids FROM enc",
    "truncate_corpus": f"WITH {ENCODED_CTE} SELECT doc_id, {text_of('(' + TRUNCATED + ')')} AS ids FROM enc",
    "build_prompt": f"WITH {RECORDS_ENCODED_CTE} SELECT src, rec_id, {text_of('prompt')} AS ids FROM prompts",
    "build_sft": f"WITH {RECORDS_ENCODED_CTE} SELECT src, rec_id, {text_of('ids')} AS ids FROM sft",
    "sft_labels": f"WITH {RECORDS_ENCODED_CTE} SELECT src, rec_id, {text_of('labels')} AS labels FROM sft",
    "truncate_sft": f"""WITH {RECORDS_ENCODED_CTE}
SELECT src, rec_id, {text_of('ids')} AS ids, {text_of('labels')} AS labels FROM cut""",
    "check_lengths": f"""WITH {RECORDS_CTE}
SELECT src, count(*) AS n_unequal FROM records WHERE rec_id % 3 = 0 GROUP BY src""",
    "shift_labels": f"""WITH {ENCODED_CTE},
padded AS (SELECT doc_id, {FRAMED} || [1, 1] AS ids FROM enc)
SELECT doc_id, {text_of('ids[:-2]')} AS ids,
  {text_of('list_transform(ids[2:], lambda x: CASE WHEN x = 1 THEN -100 ELSE x END)')} AS labels FROM padded""",
    "shift_sft_labels": f"WITH {RECORDS_ENCODED_CTE} SELECT src, rec_id, {text_of('labels[2:]')} AS labels FROM sft",
    "padding_mask": f"""WITH {ENCODED_CTE}
SELECT doc_id, repeat('1', len(ids) + 2) || '00' AS mask FROM enc""",
    "batch_train": f"""SELECT doc_id, i // 8 AS batch_id, i % 8 AS row_in_batch FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {u60('doc_id')}, doc_id) - 1 AS i FROM documents)""",
    "batch_epochs": f"""WITH RECURSIVE sized AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM documents),
sides AS (SELECT n, a, ceil(n / a)::BIGINT AS b FROM sized),
walk AS (
  SELECT doc_id, epoch, n, a, b, {feistel('i')} AS p FROM (
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, unnest([0, 1]) AS epoch FROM documents), sides
  UNION ALL
  SELECT doc_id, epoch, n, a, b, {feistel('p')} FROM walk WHERE p >= n)
SELECT doc_id, epoch::INTEGER AS epoch, p // 8 AS batch_id, (p % 8)::INTEGER AS row_in_batch FROM walk WHERE p < n""",
    "batch_lengths": f"WITH RECURSIVE {LENGTH_PLAN_CTE} SELECT doc_id, batch_id, row_in_batch, longest::INTEGER AS longest FROM plan",
    "padding_waste": f"""WITH RECURSIVE {LENGTH_PLAN_CTE}
SELECT sum(n_tokens)::BIGINT AS n_tokens, sum(longest)::BIGINT AS n_cells,
  round(1 - sum(n_tokens)::DOUBLE / sum(longest), 6) AS waste FROM plan""",
    "batch_eval": """SELECT doc_id, i // 4 AS batch_id, i % 4 AS row_in_batch FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)""",
    "pad_corpus": padded_corpus(f"{u60('doc_id')}, doc_id", 8),
    "pad_corpus_eval": padded_corpus("doc_id", 4),
    "pad_sft": f"""WITH {RECORDS_ENCODED_CTE},
numbered AS (SELECT *, row_number() OVER (ORDER BY {u60("src || ':' || rec_id")}, src || ':' || rec_id) - 1 AS i FROM cut),
measured AS (SELECT *, i // 8 AS batch_id, max(len(ids)) OVER (PARTITION BY i // 8) AS longest FROM numbered)
SELECT src, rec_id, batch_id, i % 8 AS row_in_batch, {text_of('(' + padded('ids', 1, 'longest') + ')')} AS input_ids,
  {text_of('(' + padded('labels', -100, 'longest') + ')')} AS labels FROM measured""",
    "step_budget": """SELECT n_batches, n_batches * 2 AS n_steps, floor(0.03::DOUBLE * (n_batches * 2))::BIGINT AS n_warmup
FROM (SELECT ceil(count(*) / 8)::BIGINT AS n_batches FROM documents)""",
    "corpus_lengths": f"WITH {LENGTHS_CTE} SELECT * FROM lengths",
    "length_stats": f"WITH {LENGTHS_CTE} {STATS}",
    "sketched_stats": f"""WITH {LENGTHS_CTE} SELECT count(*) AS n, min(n_tokens) AS min, max(n_tokens) AS max,
  round(avg(n_tokens), 6) AS mean, round(stddev_pop(n_tokens), 6) AS std, true AS near_p25, true AS near_p50, true AS near_p75,
  true AS near_p90, true AS near_p95, true AS near_p99 FROM lengths""",
    "sft_length_stats": f"WITH {SFT_LENGTHS_CTE} {STATS}",
    "sft_truncation_coverage": f"WITH {SFT_LENGTHS_CTE} {COVERAGE}",
    "length_stats_bpe_256": f"""WITH RECURSIVE {BPE_ENCODED_CTE},
lengths AS (SELECT len(ids) AS n_tokens FROM enc JOIN documents USING (doc_id) WHERE text <> '') {STATS}""",
    "train_bpe_256": f"""WITH RECURSIVE {bpe_cte()}
SELECT (step - 1)::INTEGER AS rank, l::INTEGER AS left_id, r::INTEGER AS right_id, m::INTEGER AS merged_id
FROM bpe WHERE toks IS NOT NULL AND step > 0""",
    "encode_bpe_256": f"WITH RECURSIVE {BPE_ENCODED_CTE} SELECT doc_id, {text_of('ids')} AS ids FROM enc",
    "pad_corpus_bpe_256": padded_corpus(f"{u60('doc_id')}, doc_id", 8, BPE_ENCODED_CTE),
    "truncate_sft_bpe_256": f"""WITH RECURSIVE {BPE_RECORDS_CTE}
SELECT src, rec_id, {text_of('ids')} AS ids, {text_of('labels')} AS labels FROM cut""",
    "continuation_prompts": f"WITH {ENCODED_CTE} SELECT doc_id, {text_of('([2] || ids)')} AS prompt FROM enc",
    "model_inputs": f"""WITH {ENCODED_CTE},
seqs AS (SELECT doc_id, {TRUNCATED} AS ids FROM enc),
numbered AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS batch FROM seqs),
measured AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM numbered)
SELECT doc_id, repeat('1', len(ids)) || repeat('0', longest - len(ids)) AS mask,
  {text_of('(ids[2:] || list_transform(range(longest - len(ids)), lambda i: -100))')} AS labels FROM measured""",
    "batch_eval_records": f"""WITH {RECORDS_CTE}
SELECT src, rec_id, i // 4 AS batch_id, i % 4 AS row_in_batch FROM (
  SELECT src, rec_id, row_number() OVER (ORDER BY src, rec_id) - 1 AS i FROM records)""",
    "pad_sft_eval": f"""WITH {RECORDS_ENCODED_CTE},
numbered AS (SELECT *, row_number() OVER (ORDER BY src, rec_id) - 1 AS i FROM cut),
measured AS (SELECT *, i // 4 AS batch_id, max(len(ids)) OVER (PARTITION BY i // 4) AS longest FROM numbered)
SELECT src, rec_id, batch_id, i % 4 AS row_in_batch, {text_of('(' + padded('ids', 1, 'longest') + ')')} AS input_ids,
  {text_of('(' + padded('labels', -100, 'longest') + ')')} AS labels FROM measured""",
    "truncation_coverage": f"WITH {LENGTHS_CTE} {COVERAGE}",
    "sft_lengths": f"""WITH {RECORDS_CTE}
SELECT src, rec_id, 10 + len({words('features')}) + len({words('words')}) + len({words('summary')})
  + len({words('story')}) AS n_tokens FROM records""",
    "sample_counts": f"""WITH {LINES_CTE} SELECT 'raw' AS kind, count(*) AS n FROM lines
UNION ALL SELECT 'structured', count(*) FROM documents""",
    "metric_windows": f"""WITH {LOG_CTE},
numbered AS (SELECT *, (row_number() OVER (PARTITION BY epoch ORDER BY step) - 1) // 100 AS win FROM log)
SELECT epoch, win AS "window", round(avg(loss), 6) AS mean_loss, round(exp(avg(loss)), 6) AS perplexity
FROM numbered GROUP BY ALL HAVING count(*) = 100""",
    "stream_metric_windows": f"""WITH {LOG_CTE},
numbered AS (SELECT *, (row_number() OVER (PARTITION BY epoch ORDER BY step) - 1) // 100 AS win FROM log)
SELECT epoch, win AS "window", round(avg(loss), 6) AS mean_loss, round(exp(avg(loss)), 6) AS perplexity
FROM numbered GROUP BY ALL HAVING count(*) = 100""",
    "epoch_summary": f"""WITH {LOG_CTE}
SELECT epoch, round(avg(loss), 6) AS mean_loss, round(exp(avg(loss)), 6) AS perplexity FROM log GROUP BY 1""",
    "cross_entropy": """WITH s AS (
  SELECT vec_id, label, (unnest(range(len(embedding))))::INTEGER AS cand, unnest(embedding)::DOUBLE AS score
  FROM embeddings WHERE label <> 9),
lp AS (SELECT *, score - ln(sum(exp(score)) OVER (PARTITION BY vec_id)) AS logp FROM s),
per AS (SELECT vec_id, 0.95 * sum(-logp) FILTER (WHERE cand = label) + 0.05 * avg(-logp) AS loss
  FROM lp GROUP BY vec_id)
SELECT count(*) AS n, round(avg(loss), 6) AS loss, round(avg(loss) + 0.01, 6) AS total_loss FROM per""",
    "softmax_scores": probabilities(SCORES_CTE, "scores"),
    "top_k": probabilities(f"{SCORES_CTE}, {KEPT_K}", "kept"),
    "top_p": probabilities(f"{SCORES_CTE}, {KEPT_P}", "nucleus"),
    "draw": f"""WITH {SCORES_CTE}, {KEPT_P}
SELECT ctx, cand AS token_id FROM ({SOFT.format('nucleus')})
QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY ln(prob) - ln(-ln((
  ('0x' || substr(md5('42:' || ctx || ':' || cand), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0)) DESC, cand) = 1""",
    "softmax_long": f"WITH {LONG_CTE} SELECT ctx, cand, round(prob * 1e6, 4) AS prob FROM likely",
    "log_sum_exp_long": """WITH s AS (SELECT o_orderpriority AS ctx, o_totalprice::DOUBLE / 100.0::DOUBLE + 50.0 AS score FROM orders),
t AS (SELECT *, max(score) OVER (PARTITION BY ctx) AS top FROM s)
SELECT ctx, round(any_value(top) + ln(sum(exp(score - top))), 6) AS log_sum_exp, count(*) AS n,
  round(sum(score), 3) AS total FROM t GROUP BY ctx""",
    "top_k_long": f"WITH {LONG_CTE} SELECT ctx, cand, rank FROM placed WHERE rank <= 500",
    "ranked_long": f"WITH {LONG_CTE} SELECT ctx, cand, rank, round(before, 6) AS before FROM placed",
    "top_p_long": f"WITH {LONG_CTE} SELECT ctx, cand, rank FROM placed WHERE before <= 0.6 OR rank = 1",
    "draw_long": f"""WITH {LONG_CTE} SELECT ctx, cand FROM long QUALIFY row_number() OVER (PARTITION BY ctx
  ORDER BY score - ln(-ln((('0x' || substr(md5('42:' || ctx || ':' || cand), 1, 8))::UBIGINT::DOUBLE + 0.5)
    / 4294967296.0)) DESC, cand) = 1""",
    "cross_entropy_long": f"""WITH {LONG_CTE},
labels AS (SELECT ctx, min(cand) AS cand FROM long GROUP BY ctx),
per AS (SELECT 0.95 * (lse - score) + 0.05 * (lse - mean) AS loss
  FROM labels JOIN long USING (ctx, cand) JOIN lse USING (ctx))
SELECT count(*) AS n, round(avg(loss), 6) AS loss, round(avg(loss) + 0.01, 6) AS total_loss FROM per""",
    "route_load": f"""WITH {SCORES_CTE},
picked AS (SELECT ctx, cand FROM scores QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY score DESC, cand) <= 2),
shares AS (SELECT c.cand, count(p.cand)::DOUBLE / (SELECT count(*) FROM picked) AS share
  FROM (SELECT unnest(range(64))::INTEGER AS cand) c LEFT JOIN picked p USING (cand) GROUP BY c.cand)
SELECT cand, round(share, 6) AS share, round(64 * sum(share / 64) OVER (), 6) AS balance,
  round(max(share) OVER () * 64, 6) AS worst FROM shares""",
    "routed_weights": """WITH s AS (
  SELECT vec_id AS ctx, (unnest(range(len(embedding))))::INTEGER AS cand, unnest(embedding)::DOUBLE AS score
  FROM embeddings),
picked AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY score DESC, cand) <= 2)
SELECT ctx, cand, round(exp(score) / sum(exp(score)) OVER (PARTITION BY ctx), 6) AS weight FROM picked""",
    "story_prompts": f"""WITH {VOCAB_CTE}, {DESCRIBED_CTE},
t AS (SELECT doc_id, array_to_string(features, ', ') AS features, array_to_string(words, ', ') AS words,
  text AS summary FROM described),
f AS (SELECT doc_id, unnest([0, 1, 2]) AS field, unnest([features, words, summary]) AS text FROM t),
k AS (SELECT doc_id, field, unnest(w) AS token, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, field, {words('text')} AS w FROM f)),
i AS (SELECT doc_id, field, list(coalesce(id, 0) ORDER BY pos) AS ids FROM k LEFT JOIN vocab USING (token) GROUP BY ALL)
SELECT t.*, {text_of('''([2, 5] || coalesce(a.ids, []::INTEGER[]) || [6, 7] || coalesce(b.ids, []::INTEGER[])
  || [8, 9] || coalesce(c.ids, []::INTEGER[]) || [10, 11])''')} AS prompt
FROM t LEFT JOIN i a ON a.doc_id = t.doc_id AND a.field = 0
  LEFT JOIN i b ON b.doc_id = t.doc_id AND b.field = 1 LEFT JOIN i c ON c.doc_id = t.doc_id AND c.field = 2""",
    "story_texts": f"WITH {DECODED_CTE} SELECT doc_id, {replaced('text')} AS story FROM decoded",
    "continuation_texts": f"WITH {DECODED_CTE} SELECT doc_id, {replaced('text')} AS text FROM decoded",
}
