"""The operators as queries over the given tables, with their contracts' columns, and the SQL for it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    bpe,
    decontaminate,
    exact,
    hosts,
    html,
    licenses,
    nbsvm,
    near,
    repeats,
    search,
    surrogates,
    toxicity,
    trie,
)

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Stands for a secret of the user's; with another one all surrogates differ.
SURROGATE_KEY = b"a key for the checks"
#: A document is taken for good, or toxic, from this score on.
CUT = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(docs: DataFrame, sf_dir: str, to: str = "score") -> DataFrame:
    """The documents with their quality score as column ``to``; labels of every fifth id, by checksum, are not learned."""
    settings = nbsvm.Settings()
    labels = table(docs.sparkSession, sf_dir, "labels").filter(nbsvm.remainder("doc_id", 5) != 0)
    return nbsvm.score(docs, nbsvm.fit(nbsvm.labelled(docs, labels, "quality", settings), settings), to=to)


def judged(scored: DataFrame, of: int, out: int) -> DataFrame:
    return scored.select(
        "doc_id",
        (nbsvm.remainder("doc_id", of) == out).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def tokens(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    coded = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(coded, path, public_tokenizers.PATTERN))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(table(spark, sf_dir, "documents"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = html.extract(pages, html.train(pages)).drop("html")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(nbsvm.remainder("doc_id", 4) != 2)
    return judged(toxicity.score(docs, toxicity.fit(docs, labels)), 4, 2)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(quality(table(spark, sf_dir, "documents"), sf_dir), 5, 0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hosts.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_toxicity": op5_toxicity,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_license_scan": op7_license_scan,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ranked_search": op12_ranked_search,
    "op13_host_rules": op13_host_rules,
}

ORACLE = {
    "op10_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM documents
        ), g AS (SELECT k, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY k)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256
        FROM t JOIN g USING (k)
    """,
    "op11_prefix_trie": """
        WITH crcs AS (
            SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, (c & 1) * 3988292384))
                        ORDER BY n) AS crc
            FROM (SELECT unnest(range(256)) AS n)
        ), filled AS (
            SELECT conv_id, turn, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list(t ORDER BY turn NULLS FIRST, sha256(strlen(t.role) || ':' || t.role || t.text)) AS turns
            FROM filled GROUP BY conv_id
        ), heads AS (
            SELECT conv_id, turns, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
                       [4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)),
                       lambda a, b: xor(a >> 8, crc[CAST(xor(a, b) & 255 AS BIGINT) + 1]))) % 6 AS h
            FROM own, crcs
        ), rebuilt AS (
            SELECT o.conv_id, coalesce(list_slice(b.turns, 1, o.h), []) || list_slice(o.turns, o.h + 1, len(o.turns)) AS turns
            FROM heads o LEFT JOIN own b ON b.conv_id = o.base
        ), prefixes AS (
            SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt
        ), named AS (
            SELECT conv_id, depth, len(turns) = depth AS ends,
                   CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS chars,
                   min(conv_id) OVER (PARTITION BY depth, list_slice(turns, 1, depth)) AS node
            FROM prefixes
        ), members AS (
            SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM named
        ), nodes AS (
            SELECT node, depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(chars) AS chars,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM members GROUP BY node, depth
        ), children AS (
            SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
        ), counted AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node, depth)
        ), sums AS (
            SELECT m.node, m.depth, CAST(sum((n_children = 0)::INT) AS BIGINT) AS n_leaves,
                   CAST(sum((n_convs - 1) * c.chars) AS BIGINT) AS saved_tokens
            FROM counted c JOIN members m ON m.conv_id = c.node AND m.depth <= c.depth GROUP BY m.node, m.depth
        )
        SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
        FROM counted JOIN sums USING (node, depth)
    """,
    "op12_ranked_search": r"""
        WITH terms AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ), asked AS (
            SELECT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT DISTINCT item_id, text FROM benchmark)
        ), lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
        totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM lengths),
        held AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
        weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE)))
                              AS BIGINT) AS w
            FROM held, totals GROUP BY term
        ), impacts AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // l)))) AS impact
            FROM held JOIN lengths USING (doc_id) JOIN weights USING (term), totals
        ), scores AS (
            SELECT item_id, doc_id, CAST(sum(repeats * impact) AS BIGINT) AS score
            FROM (SELECT item_id, term, count(*) AS repeats FROM asked GROUP BY ALL) JOIN impacts USING (term)
            GROUP BY item_id, doc_id
        ), ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
            FROM scores WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    "op13_host_rules": r"""
        WITH words AS (
            SELECT doc_id, source, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), starts AS (
            SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM words WHERE len(w) >= 8
        ), windows AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS times FROM starts
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS j FROM windows WHERE times > 1
        ), repeated AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
        lines AS (
            SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words
        ), filled AS (
            SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
            FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
        ), measured AS (
            SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
                   CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
                   coalesce(r.n, 0) AS n_repeat_words
            FROM words LEFT JOIN repeated r USING (doc_id) LEFT JOIN filled USING (doc_id)
        ), flagged AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
        ), failures AS (
            SELECT source, unnest(['base', 'symbols', 'lines', 'letters']) AS rule,
                   unnest([base_failed, 100 * n_symbols > 10 * n_words, 100 * n_dup_lines > 30 * n_lines,
                           word_chars < 2 * n_words]) AS failed
            FROM flagged
        ), hosts AS (
            SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(sum(failed::INT) AS DOUBLE) AS x
            FROM failures GROUP BY source, rule
        ), totals AS (
            SELECT rule, count(*) AS k, sum(n) AS docs, sum(x) / sum(n) AS p, sum(n * n) AS squares,
                   sum(x * x / n) - sum(x) * (sum(x) / sum(n)) AS spread
            FROM hosts GROUP BY rule
        ), prior AS (
            SELECT rule, p, greatest(0, least(CAST(1 AS DOUBLE) / 11, coalesce(
                CASE WHEN p * (1 - p) <> 0 AND docs - squares / docs - (k - 1) <> 0
                     THEN (spread / (p * (1 - p)) - (k - 1)) / (docs - squares / docs - (k - 1)) END, 0))) AS share
            FROM totals
        ), verdicts AS (
            SELECT source, max(p + n * share / (n * share + 1 - share) * (x / n - p)) <= 0.5 AS host_kept
            FROM hosts JOIN prior USING (rule) GROUP BY source
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND host_kept AS kept
        FROM flagged f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
    """,
}
