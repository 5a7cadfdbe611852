"""One Spark query per operator, each over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs
from checks.inputs import WORD_LEVEL, documents, table
from corpusloom import config as c
from corpusloom.functions import sequences as seq
from corpusloom.functions import text as tx
from corpusloom.operators import batching, bpe, long_scores, maintained, metrics, reports, selection, sketches, vocab
from corpusloom.operators import records as rec
from corpusloom.operators.batching import batch_eval, batch_train, step_budget
from corpusloom.operators.order import stored_index
from corpusloom.plans import finetuning, generation, length_analysis, pretraining
from corpusloom.session import scratch_path
from corpusloom.sources import corpus as src
from corpusloom.streaming import metrics as windows
from corpusloom.streaming import records as stream
from corpusloom.tokenizer import Tokenizer, get_or_train, load_tokenizer

QUERIES = {}


def query(fn, name: str | None = None):
    QUERIES[name or fn.__name__] = fn
    return fn


def query_as(name: str):
    return lambda fn: query(fn, name)


def with_small_vocabulary(fn):
    """Register ``fn``, and as ``.._256`` with a vocabulary that SQL can learn anew in reasonable time."""
    query(lambda spark, sf_dir: fn(spark, sf_dir, inputs.checked_bpe_tokenizer), f"{fn.__name__}_{inputs.CHECKED_VOCAB}")
    return query(fn)


def shown(ids):
    """An id array as text, so that results compare by value in any engine."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def rounded(*names: str):
    return {n: F.round(n, 6) for n in names}


# --- sources and sinks -------------------------------------------------------------------------


@query
def read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table with its split column, written out and read back by ``split``."""
    path = scratch_path(spark, "corpus")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    selection.split(docs, "doc_id").write.parquet(path)
    return src.read_corpus(spark, path, split="train")


@query
def read_corpus_pruned(spark, sf_dir):
    """The same, with a folder per split and files by ranges of ids."""
    path = scratch_path(spark, "corpus")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    src.write_corpus(selection.split(docs, "doc_id"), path, "doc_id")
    return src.read_corpus(spark, path, split="train")


@query
def instruct_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    inputs.instruct_lines(spark, sf_dir).write.parquet(path)
    return src.read_instruct_lines(spark, path)


@query
def split_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return selection.split(docs, "doc_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query
def sample_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return selection.sample(docs, "doc_id", c.DataSettings().sample_validation)


@query
def head_records(spark, sf_dir):
    return selection.head(rec.make_records(inputs.instruct_lines(spark, sf_dir)), 600)


@query
def stream_records(spark, sf_dir):
    """The lines dealt into files without regard to order, read as a stream of two files at a time."""
    arrived, out = (scratch_path(spark, name) for name in ("arrived", "streamed"))
    inputs.dense_lines(spark, sf_dir).repartition(8, F.xxhash64("line_no")).write.parquet(arrived)
    lines = spark.readStream.schema("src string, line_no long, text string").option("maxFilesPerTrigger", 2)
    stream.write_records(lines.parquet(arrived), out, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.schema(stream.RECORDS).parquet(out).filter("NOT late").drop("late")


@query
def records_roundtrip(spark, sf_dir):
    lines = selection.split(inputs.instruct_lines(spark, sf_dir), "src")
    is_train = F.col("split") == "train"
    train, val = src.get_or_make_records(
        lines.filter(is_train).drop("split"),
        lines.filter(~is_train).drop("split"),
        scratch_path(spark, "records"),
    )
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


@query
def vocab_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "tokenizer")
    get_or_train(documents(spark, sf_dir), path, WORD_LEVEL)
    return load_tokenizer(spark, path).vocab


@query
def published_records(spark, sf_dir):
    """The same behind one pointer; the second call reads what the first has published."""
    lines, root = selection.split(inputs.instruct_lines(spark, sf_dir), "src"), scratch_path(spark, "published")
    is_train = F.col("split") == "train"
    halves = [lines.filter(x).drop("split") for x in (is_train, ~is_train)]
    src.publish_records(*halves, root)
    train, val = src.publish_records(*[half.limit(0) for half in halves], root)
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


def _maintained(spark, sf_dir) -> str:
    """Counts of the training documents and all questions; then the other documents come and the questions go."""
    root = scratch_path(spark, "counts")
    docs = selection.split(documents(spark, sf_dir), "doc_id")
    asked = table(spark, sf_dir, "benchmark").select("text")
    is_train = F.col("split") == "train"
    maintained.update_counts(spark, root, WORD_LEVEL, docs.filter(is_train).select("text").unionByName(asked))
    maintained.update_counts(spark, root, WORD_LEVEL, docs.filter(~is_train), removed=asked)
    return root


@query
def maintained_counts(spark, sf_dir):
    return maintained.stored_counts(spark, _maintained(spark, sf_dir), WORD_LEVEL)


@query
def maintained_vocab(spark, sf_dir):
    return Tokenizer.from_counts(maintained_counts(spark, sf_dir), WORD_LEVEL).vocab


# --- text --------------------------------------------------------------------------------------


@query
def default_text(spark, sf_dir):
    """Documents without a label have no features text; it becomes empty and the row stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.concat_ws(",", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("text")
    )
    return docs.join(labels, "doc_id", "left").select("doc_id", tx.default_text(F.col("text")).alias("text"))


@query
def drop_empty(spark, sf_dir):
    """Whole texts of the labelled documents; the text is null without a label and empty for label 0."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    shown_ = F.when(F.col("quality") == 1, F.col("text")).when(F.col("quality") == 0, "")
    return selection.drop_empty(docs.select("doc_id", shown_.alias("text")))


@query
def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", tx.normalize_whitespace(F.col("text")).alias("text")
    )


@query
def words_whitespace(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.array_join(tx.pre_tokenize(F.col("text"), "whitespace"), " ").alias("words")
    )


@query
def words_bytelevel(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.array_join(tx.pre_tokenize(F.col("text"), "byte-level"), " ").alias("words")
    )


@query
def special_literals(spark, sf_dir):
    """Records written out with their marks, cut at the marks again."""
    d = inputs.described(spark, sf_dir)
    written = F.concat(
        F.lit("[BOS]<features>"), F.array_join("features", ", "), F.lit("</features><summary>"),
        F.col("summary"), F.lit("</summary><story>"), F.col("text"), F.lit("</story>[EOS][PAD]"),
    )
    pieces = F.posexplode_outer(tx.split_specials(written)).alias("pos", "piece")
    return d.select("doc_id", pieces).select("doc_id", F.col("pos").cast("long").alias("pos"), "piece")


@query
def join_fields(spark, sf_dir):
    """Words of each document's label list and of its whole text; unlabelled ones are empty."""
    d = inputs.described(spark, sf_dir)
    extra = F.slice("features", F.lit(3), F.size("features"))
    words = tx.pre_tokenize(F.col("text"), "whitespace")
    return d.select(
        "doc_id", tx.join_fields(extra).alias("features"), tx.join_fields(words).alias("words")
    )


@query
def clean_text(spark, sf_dir):
    spaced = F.array_join(tx.pre_tokenize(F.col("text"), "whitespace"), " ")
    return documents(spark, sf_dir).select("doc_id", tx.clean_generated(spaced).alias("text"))


@query
def format_duration(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return events.select(
        "event_id",
        tx.format_duration(F.col("value")).alias("short"),
        tx.format_duration(F.col("value") * 100.0).alias("long"),
    )


# --- instruction records -----------------------------------------------------------------------


@query
def classify_lines(spark, sf_dir):
    return rec.classify_lines(inputs.instruct_lines(spark, sf_dir)).select(
        "src", "line_no", "kind", "payload"
    )


@query
def assign_records(spark, sf_dir):
    lines = rec.classify_lines(inputs.instruct_lines(spark, sf_dir))
    return rec.assign_records(lines).select("src", "line_no", "rec_id", "n_records")


@query
def assemble_records(spark, sf_dir):
    return rec.make_records(inputs.instruct_lines(spark, sf_dir))


# --- vocabularies ------------------------------------------------------------------------------


@query
def word_counts(spark, sf_dir):
    return vocab.word_counts(documents(spark, sf_dir))


@query
def word_counts_bytelevel(spark, sf_dir):
    return vocab.word_counts(documents(spark, sf_dir), how="byte-level")


@query
def train_word_level(spark, sf_dir):
    return vocab.train_word_level(documents(spark, sf_dir), WORD_LEVEL)


@query
def bpe_pair_counts(spark, sf_dir):
    counts = vocab.word_counts(documents(spark, sf_dir))
    chars = counts.select(F.explode_outer(F.split("word", "")).alias("c")).distinct()
    # at most one row per code point
    ids = {ch: i for i, ch in enumerate(sorted(r.c for r in chars.collect() if r.c))}
    names = F.split(F.lit("".join(ids)), "")
    return bpe.pair_counts(bpe.spell(counts, ids)).select(
        F.get(names, "left_id").alias("left"), F.get(names, "right_id").alias("right"), "n"
    )


@with_small_vocabulary
def train_bpe(spark, sf_dir, tokenizer=inputs.bpe_tokenizer):
    tok = tokenizer(spark, sf_dir)
    return tok.merges.merge_table(spark)


@query
def vocab_size(spark, sf_dir):
    made = vocab.train_word_level(documents(spark, sf_dir), WORD_LEVEL)
    return made.agg(F.count(F.lit(1)).alias("vocab_size"))


@query
def token_to_id(spark, sf_dir):
    """Every distinct word of the benchmark texts, looked up in the documents' vocabulary.

    An unknown word's null is shown as -1, so that the column stays whole numbers everywhere.
    """
    made = vocab.train_word_level(documents(spark, sf_dir), WORD_LEVEL)
    tokens = vocab.word_counts(table(spark, sf_dir, "benchmark")).select(F.col("word").alias("token"))
    found = vocab.token_to_id(tokens, made)
    return found.select("token", F.coalesce("id", F.lit(-1)).alias("id"))


# --- encoding ----------------------------------------------------------------------------------


def _encoded(spark, sf_dir) -> DataFrame:
    tok = inputs.word_tokenizer(spark, sf_dir)
    return tok.encode(documents(spark, sf_dir), ["doc_id"], {"ids": "text"})


@query
def encode_word_level(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", shown("ids").alias("ids"))


@with_small_vocabulary
def encode_bpe(spark, sf_dir, tokenizer=inputs.bpe_tokenizer):
    tok = tokenizer(spark, sf_dir)
    return tok.encode(documents(spark, sf_dir), ["doc_id"], {"ids": "text"}).select(
        "doc_id", shown("ids").alias("ids")
    )


@query
def encode_bpe_lossless(spark, sf_dir):
    """Decoding the encoded text gives the normalised text (one leading blank, as in training)."""
    tok = inputs.bpe_tokenizer(spark, sf_dir)
    coded = tok.encode(documents(spark, sf_dir), ["doc_id"], {"ids": "text"})
    return tok.decode(coded, "ids").select("doc_id", "text")


@query
def decode_tokens(spark, sf_dir):
    tok = inputs.word_tokenizer(spark, sf_dir)
    return tok.decode(_encoded(spark, sf_dir), "ids").select("doc_id", "text")


@query
def cut_continuation(spark, sf_dir):
    ids = F.col("ids")
    generated = F.concat(seq.ids(c.BOS), ids, seq.ids(c.PAD), ids, seq.ids(c.EOS), ids)
    return _encoded(spark, sf_dir).select(
        "doc_id", shown(seq.cut_continuation(generated)).alias("ids")
    )


@query
def cut_story(spark, sf_dir):
    """The answer repeats the text with skipped marks inside and stops at EOS or at the story end."""
    ids = F.col("ids")
    prompt = seq.build_prompt(ids, ids, ids)
    stop = F.when(F.col("doc_id") % 2 == 0, seq.ids(c.EOS)).otherwise(seq.ids(c.STORY_END))
    generated = F.concat(
        prompt, seq.ids(c.STORY_START, c.PAD), ids, seq.ids(c.SUMMARY_END), ids, stop, ids
    )
    return _encoded(spark, sf_dir).select(
        "doc_id", shown(seq.cut_story(generated, F.size(prompt))).alias("ids")
    )


# --- sequences ---------------------------------------------------------------------------------


def _framed(spark, sf_dir) -> DataFrame:
    return _encoded(spark, sf_dir).select("doc_id", seq.frame_corpus(F.col("ids")).alias("ids"))


def _records_encoded(spark, sf_dir) -> DataFrame:
    made = rec.make_records(inputs.instruct_lines(spark, sf_dir))
    return finetuning.encode_records(made, inputs.word_tokenizer(spark, sf_dir))


def _sft(spark, sf_dir) -> DataFrame:
    return finetuning.sft_sequences(_records_encoded(spark, sf_dir))


@query
def frame_corpus(spark, sf_dir):
    return _framed(spark, sf_dir).select("doc_id", shown("ids").alias("ids"))


@query
def truncate_corpus(spark, sf_dir):
    return _framed(spark, sf_dir).select("doc_id", shown(seq.truncate(F.col("ids"))).alias("ids"))


@query
def build_prompt(spark, sf_dir):
    ids = [F.col(f"{f}_ids") for f in ("features", "words", "summary")]
    return _records_encoded(spark, sf_dir).select(
        "src", "rec_id", shown(seq.build_prompt(*ids)).alias("ids")
    )


@query
def build_sft(spark, sf_dir):
    return _sft(spark, sf_dir).select("src", "rec_id", shown("input_ids").alias("ids"))


@query
def sft_labels(spark, sf_dir):
    return _sft(spark, sf_dir).select("src", "rec_id", shown("labels").alias("labels"))


@query
def truncate_sft(spark, sf_dir):
    cut = finetuning.truncate_sft(_sft(spark, sf_dir))
    return cut.select("src", "rec_id", shown("input_ids").alias("ids"), shown("labels").alias("labels"))


@with_small_vocabulary
def truncate_sft_bpe(spark, sf_dir, tokenizer=inputs.bpe_tokenizer):
    """The same on the default tokenizer."""
    made = rec.make_records(inputs.instruct_lines(spark, sf_dir))
    coded = finetuning.encode_records(made, tokenizer(spark, sf_dir))
    cut = finetuning.truncate_sft(finetuning.sft_sequences(coded))
    return cut.select("src", "rec_id", shown("input_ids").alias("ids"), shown("labels").alias("labels"))


@query
def check_lengths(spark, sf_dir):
    """The labels of every third record lose their last one first, so the filter has rows to find."""
    cut = finetuning.truncate_sft(_sft(spark, sf_dir)).withColumn(
        "labels", F.when(F.col("rec_id") % 3 == 0, seq.drop_last(F.col("labels"))).otherwise(F.col("labels"))
    )
    return finetuning.unequal_lengths(cut).groupBy("src").agg(F.count(F.lit(1)).alias("n_unequal"))


@query
def shift_labels(spark, sf_dir):
    labels = seq.shift_labels_pretrain(F.concat("ids", seq.ids(c.PAD, c.PAD)))
    inputs_ = seq.drop_last(F.concat("ids", seq.ids(c.PAD, c.PAD)))
    return _framed(spark, sf_dir).select(
        "doc_id", shown(inputs_).alias("ids"), shown(labels).alias("labels")
    )


@query
def shift_sft_labels(spark, sf_dir):
    return _sft(spark, sf_dir).select(
        "src", "rec_id", shown(seq.shift_labels_sft(F.col("labels"))).alias("labels")
    )


@query
def padding_mask(spark, sf_dir):
    mask = seq.padding_mask(F.concat("ids", seq.ids(c.PAD, c.PAD)))
    return _framed(spark, sf_dir).select(
        "doc_id", F.array_join(F.transform(mask, lambda b: b.cast("int").cast("string")), "").alias("mask")
    )


# --- batches -----------------------------------------------------------------------------------


def _batch_columns(df: DataFrame, *arrays: str) -> DataFrame:
    return df.select(
        *[n for n in df.columns if n not in ("input_ids", "labels", "row_in_batch", "prompt_len")],
        F.col("row_in_batch").cast("long").alias("row_in_batch"),
        *[shown(a).alias(a) for a in arrays],
    )


@query_as("batch_train")
def batch_train_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return _batch_columns(batch_train(docs, "doc_id"))


@query
def batch_epochs(spark, sf_dir):
    """Both epochs' orders of the documents, from numbers that are given once."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    numbered, n = stored_index(docs, "doc_id"), docs.count()
    epochs = [
        batching.batch_epoch(numbered, "row_index", n, epoch=e).withColumn("epoch", F.lit(e))
        for e in range(c.PRETRAINING.epochs)
    ]
    return reduce(DataFrame.unionByName, epochs).drop("row_index")


@query
def batch_lengths(spark, sf_dir):
    lengths = length_analysis.corpus_lengths(documents(spark, sf_dir), inputs.word_tokenizer(spark, sf_dir))
    return batching.length_plan(lengths, "doc_id")


@query
def padding_waste(spark, sf_dir):
    lengths = length_analysis.corpus_lengths(documents(spark, sf_dir), inputs.word_tokenizer(spark, sf_dir))
    made = batching.padding_waste(batching.length_plan(lengths, "doc_id"), lengths, "doc_id")
    return made.withColumns(rounded("waste"))


@query_as("batch_eval")
def batch_eval_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return _batch_columns(batch_eval(docs, "doc_id"))


@query
def pad_corpus(spark, sf_dir):
    tok = inputs.word_tokenizer(spark, sf_dir)
    docs = documents(spark, sf_dir)
    made = pretraining.corpus_sequences(docs, tok, "doc_id")
    return _batch_columns(
        pretraining.train_batches(made, "doc_id", keys=table(spark, sf_dir, "documents")), "input_ids"
    )


@query
def pad_corpus_eval(spark, sf_dir):
    tok = inputs.word_tokenizer(spark, sf_dir)
    made = pretraining.corpus_sequences(documents(spark, sf_dir), tok, "doc_id")
    return _batch_columns(
        pretraining.eval_batches(made, "doc_id", keys=table(spark, sf_dir, "documents")), "input_ids"
    )


@query
def pad_sft(spark, sf_dir):
    """Sequences are stored once; the numbering then reads their keys only."""
    path = scratch_path(spark, "sft_sequences")
    finetuning.truncate_sft(_sft(spark, sf_dir)).write.parquet(path)
    return _batch_columns(
        finetuning.train_batches(spark.read.parquet(path)), "input_ids", "labels"
    )


@with_small_vocabulary
def pad_corpus_bpe(spark, sf_dir, tokenizer=inputs.bpe_tokenizer):
    tok = tokenizer(spark, sf_dir)
    made = pretraining.corpus_sequences(documents(spark, sf_dir), tok, "doc_id")
    return _batch_columns(
        pretraining.train_batches(made, "doc_id", keys=table(spark, sf_dir, "documents")), "input_ids"
    )


@query
def model_inputs(spark, sf_dir):
    """Padding mask and next-token labels of padded batches."""
    tok = inputs.word_tokenizer(spark, sf_dir)
    made = pretraining.corpus_sequences(documents(spark, sf_dir), tok, "doc_id")
    batches = pretraining.eval_batches(made, "doc_id", keys=table(spark, sf_dir, "documents"))
    bits = F.array_join(F.transform("mask", lambda b: b.cast("int").cast("string")), "")
    return pretraining.model_inputs(batches).select("doc_id", bits.alias("mask"), shown("labels").alias("labels"))


@query
def batch_eval_records(spark, sf_dir):
    """Record numbers are per source; batches run through all sources."""
    records = rec.make_records(inputs.instruct_lines(spark, sf_dir)).select("src", "rec_id")
    return _batch_columns(batching.batch_eval_records(records))


@query
def pad_sft_eval(spark, sf_dir):
    path = scratch_path(spark, "sft_sequences")
    finetuning.truncate_sft(_sft(spark, sf_dir)).write.parquet(path)
    return _batch_columns(
        finetuning.eval_batches(spark.read.parquet(path)), "input_ids", "labels"
    )


@query_as("step_budget")
def budget(spark, sf_dir):
    return step_budget(table(spark, sf_dir, "documents"), c.PRETRAINING)


# --- reports -----------------------------------------------------------------------------------


@query
def corpus_lengths(spark, sf_dir):
    made = length_analysis.corpus_lengths(documents(spark, sf_dir), Tokenizer(WORD_LEVEL, None))
    return made.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))


def _stats(lengths: DataFrame) -> DataFrame:
    return reports.length_stats(lengths).select(
        "n",
        *[F.col(x).cast("long").alias(x) for x in ("min", "max")],
        *[F.round(x, 6).alias(x) for x in ("mean", "std", "median", "p25", "p75", "p90", "p95", "p99")],
    )


@query
def length_stats(spark, sf_dir):
    return _stats(length_analysis.corpus_lengths(documents(spark, sf_dir), Tokenizer(WORD_LEVEL, None)))


@query
def truncation_coverage(spark, sf_dir):
    made = length_analysis.corpus_lengths(documents(spark, sf_dir), Tokenizer(WORD_LEVEL, None))
    return reports.truncation_coverage(made).withColumns(rounded("coverage"))


@with_small_vocabulary
def length_stats_bpe(spark, sf_dir, tokenizer=inputs.bpe_tokenizer):
    tok = tokenizer(spark, sf_dir)
    return _stats(length_analysis.corpus_lengths(documents(spark, sf_dir), tok))


@query
def sft_lengths(spark, sf_dir):
    made = rec.make_records(inputs.instruct_lines(spark, sf_dir))
    lengths = length_analysis.sft_lengths(made, Tokenizer(WORD_LEVEL, None))
    return lengths.select("src", "rec_id", F.col("n_tokens").cast("long").alias("n_tokens"))


@query
def sketched_stats(spark, sf_dir):
    """Exact sums, and whether each quantile's true ranks come as near as the sketch's error says."""
    tok, path = inputs.word_tokenizer(spark, sf_dir), scratch_path(spark, "sketches")
    docs = selection.drop_empty(documents(spark, sf_dir, "doc_id", "source", "text"))
    lengths = tok.lengths(docs, "text").select("source", "n_tokens")
    sketches.length_sketches(lengths, "source").write.parquet(path)
    made = sketches.sketched_stats(spark.read.parquet(path)).first()

    def near(p: float):
        value = made["median" if p == 0.5 else f"p{round(p * 100)}"]
        below, upto = (F.sum(F.when(x, F.col("n")).otherwise(0)) / F.sum("n") for x in (F.col("length") < value, F.col("length") <= value))
        return (F.greatest(below - p, p - upto) <= made.rank_error).alias(f"near_p{round(p * 100)}")

    return reports.length_histogram(lengths).agg(
        *[F.lit(made[name]).cast("long").alias(name) for name in ("n", "min", "max")],
        *[F.lit(made[name]).alias(name) for name in ("mean", "std")],
        *[near(p) for p in reports.PERCENTILES],
    ).withColumns(rounded("mean", "std"))


@query
def sft_length_stats(spark, sf_dir):
    made = rec.make_records(inputs.instruct_lines(spark, sf_dir))
    return _stats(length_analysis.sft_lengths(made, Tokenizer(WORD_LEVEL, None)))


@query
def sft_truncation_coverage(spark, sf_dir):
    made = rec.make_records(inputs.instruct_lines(spark, sf_dir))
    lengths = length_analysis.sft_lengths(made, Tokenizer(WORD_LEVEL, None))
    return reports.truncation_coverage(lengths).withColumns(rounded("coverage"))


@query
def sample_counts(spark, sf_dir):
    lines = inputs.instruct_lines(spark, sf_dir)
    return reports.sample_counts(lines, rec.make_records(lines))


# --- metrics -----------------------------------------------------------------------------------


def _log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("epoch"),
        F.col("event_id").alias("step"),
        (F.col("value") / 100.0).alias("loss"),
    )


@query
def metric_windows(spark, sf_dir):
    return metrics.windowed_history(_log(spark, sf_dir), 100).withColumns(
        rounded("mean_loss", "perplexity")
    )


@query
def stream_metric_windows(spark, sf_dir):
    """The log in three arrivals, cut at steps that end no window, each read by a query that goes on with the state."""
    arrived, out, progress = (scratch_path(spark, name) for name in ("log", "windows", "progress"))
    log = _log(spark, sf_dir).select("epoch", "step", "loss")
    steps = log.agg(F.min("step").alias("first"), F.max("step").alias("last")).first()
    third = (steps.last - steps.first) // 3
    cuts = [steps.first, steps.first + third, steps.last - third, steps.last + 1]
    for low, high in zip(cuts, cuts[1:]):
        log.filter((F.col("step") >= low) & (F.col("step") < high)).write.mode("append").parquet(arrived)
        running = spark.readStream.schema(log.schema).parquet(arrived)
        windows.write_history(running, 100, out, progress).awaitTermination()
    return spark.read.schema(windows.WINDOWS).parquet(out).withColumns(rounded("mean_loss", "perplexity"))


@query
def epoch_summary(spark, sf_dir):
    return metrics.epoch_summary(_log(spark, sf_dir)).withColumns(rounded("mean_loss", "perplexity"))


def _scores(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ctx"),
        F.transform("embedding", lambda x: x.cast("double")).alias("scores"),
        "label",
    )


@query
def cross_entropy(spark, sf_dir):
    """Label 9 stands for an ignored position."""
    rows = _scores(spark, sf_dir).withColumn(
        "label", F.when(F.col("label") == 9, -100).otherwise(F.col("label"))
    )
    made = metrics.cross_entropy(rows, smoothing=c.FINETUNING.label_smoothing, aux=0.01)
    return made.withColumns(rounded("loss", "total_loss"))


# --- candidates --------------------------------------------------------------------------------


def _probabilities(spark, sf_dir, **filters) -> DataFrame:
    kept = generation.candidates(_scores(spark, sf_dir).select("ctx", "scores"), **filters)
    return generation.probabilities(kept.drop("scores")).withColumns(rounded("prob"))


@query
def softmax_scores(spark, sf_dir):
    return _probabilities(spark, sf_dir, temperature=0.7)


@query
def top_k(spark, sf_dir):
    return _probabilities(spark, sf_dir, temperature=0.7, k=20)


@query
def top_p(spark, sf_dir):
    return _probabilities(spark, sf_dir, temperature=0.7, k=20, p=0.83)


@query
def draw(spark, sf_dir):
    kept = generation.candidates(_scores(spark, sf_dir), temperature=0.7, k=20, p=0.83)
    return generation.next_tokens(kept, "ctx").select("ctx", "token_id")


@query
def route_load(spark, sf_dir):
    made = metrics.route_load(_scores(spark, sf_dir), k=2, categories=64)
    return made.withColumns(rounded("share", "balance", "worst"))


@query
def routed_weights(spark, sf_dir):
    made = metrics.route(_scores(spark, sf_dir), 2).select("ctx", F.inline("routed"))
    return made.withColumns(rounded("weight"))


# --- the same with one row per candidate: a context may hold any share of them ------------------


def _long_scores(spark, sf_dir) -> DataFrame:
    """The lines of orders as candidates of three contexts, each of which holds a third of them."""
    score = F.round(F.col("l_extendedprice") / 1000.0) / 10.0 - F.col("l_quantity") / 25.0
    cand = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("cand")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", cand).agg(F.max(score).alias("score"))
    return long_scores.long_scores(lines, "l_returnflag", "cand", F.col("score"), temperature=0.7)


@query
def softmax_long(spark, sf_dir):
    made = long_scores.softmax(_long_scores(spark, sf_dir))
    return made.select("ctx", "cand", F.round(F.col("prob") * 1e6, 4).alias("prob"))


@query
def log_sum_exp_long(spark, sf_dir):
    """Scores of order priorities far from zero, so that exponentials would overflow without a scale."""
    orders = table(spark, sf_dir, "orders")
    long = long_scores.long_scores(orders, "o_orderpriority", "o_orderkey", F.col("o_totalprice") / 100.0 + 50.0)
    made = long_scores.context_sums(long)
    return made.select("ctx", F.round("log_sum_exp", 6).alias("log_sum_exp"), "n", F.round("total", 3).alias("total"))


@query
def top_k_long(spark, sf_dir):
    return long_scores.top_k(_long_scores(spark, sf_dir), 500).select("ctx", "cand", "rank")


@query
def ranked_long(spark, sf_dir):
    made = long_scores.ranked(_long_scores(spark, sf_dir))
    return made.select("ctx", "cand", "rank", F.round("before", 6).alias("before"))


@query
def top_p_long(spark, sf_dir):
    return long_scores.top_p(_long_scores(spark, sf_dir), 0.6).select("ctx", "cand", "rank")


@query
def draw_long(spark, sf_dir):
    return long_scores.draw(_long_scores(spark, sf_dir))


@query
def cross_entropy_long(spark, sf_dir):
    """The first line of each context is its label."""
    long = _long_scores(spark, sf_dir)
    labels = long.groupBy("ctx").agg(F.min("cand").alias("label"))
    made = long_scores.cross_entropy(long, labels, smoothing=0.05, aux=0.01)
    return made.withColumns(rounded("loss", "total_loss"))


# --- prompts and generated texts ---------------------------------------------------------------


@query
def story_prompts(spark, sf_dir):
    tok = inputs.word_tokenizer(spark, sf_dir)
    whole = inputs.described(spark, sf_dir).withColumn("summary", F.col("text"))
    made = generation.story_prompts(whole, tok, "doc_id")
    return made.select("doc_id", "features", "words", "summary", shown("prompt").alias("prompt"))


@query
def continuation_prompts(spark, sf_dir):
    tok = inputs.word_tokenizer(spark, sf_dir)
    made = generation.continuation_prompts(documents(spark, sf_dir), tok, "doc_id")
    return made.select("doc_id", shown("prompt").alias("prompt"))


@query
def story_texts(spark, sf_dir):
    """A model that answers with the text itself: prompt, text ids, story end, text ids."""
    tok = inputs.word_tokenizer(spark, sf_dir)
    ids = F.col("ids")
    prompt = seq.build_prompt(ids, ids, ids)
    answered = _encoded(spark, sf_dir).select(
        "doc_id",
        F.size(prompt).alias("prompt_len"),
        F.concat(prompt, ids, seq.ids(c.STORY_END), ids).alias("ids"),
    )
    return generation.story_texts(answered, tok).select("doc_id", "story")


@query
def continuation_texts(spark, sf_dir):
    tok = inputs.word_tokenizer(spark, sf_dir)
    ids = F.col("ids")
    answered = _encoded(spark, sf_dir).select(
        "doc_id", F.concat(seq.ids(c.BOS), ids, seq.ids(c.EOS), ids).alias("ids")
    )
    return generation.continuation_texts(answered, tok).select("doc_id", "text")
