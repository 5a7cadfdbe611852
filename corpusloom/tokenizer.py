"""A trained tokenizer: settings, vocabulary and merges, with encode, decode, save and load."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import SPECIAL_TOKENS, TokenizerSettings
from corpusloom.functions.text import encodable_words
from corpusloom.operators import bpe, encode, vocab
from corpusloom.session import cut_lineage
from corpusloom.sources import snapshots


@dataclass(frozen=True)
class Tokenizer:
    settings: TokenizerSettings
    vocab: DataFrame
    merges: bpe.Merges | None = None

    @classmethod
    def train(cls, df: DataFrame, settings: TokenizerSettings, text: str = "text") -> Tokenizer:
        if settings.strategy == "word-level":
            # bounded by its settings; cut, so that its uses don't count the corpus again
            return cls(settings, cut_lineage(vocab.train_word_level(df, settings, text)))
        merges = bpe.train_bpe(df, settings, text)
        return cls(settings, merges.vocab(df.sparkSession), merges)

    @classmethod
    def from_counts(cls, counts: DataFrame, settings: TokenizerSettings) -> Tokenizer:
        """A tokenizer from ``word, n``, such as the maintained counts of a changing corpus."""
        if settings.strategy == "word-level":
            return cls(settings, cut_lineage(vocab.word_level_of(counts, settings)))
        merges = bpe.bpe_of(counts, settings)
        return cls(settings, merges.vocab(counts.sparkSession), merges)

    @property
    def byte_level(self) -> bool:
        return self.settings.pre_tokenizer == "byte-level"

    def size(self) -> int:
        return self.vocab.count()

    def token_to_id(self, token: str) -> int | None:
        row = self.vocab.filter(F.col("token") == token).select("id").first()
        return None if row is None else row.id

    def encode(
        self, df: DataFrame, key: Sequence[str], texts: dict[str, str], keep: Sequence[str] = ()
    ) -> DataFrame:
        """``key``, ``keep`` and one id array per entry of ``texts`` (output to text column).

        Row-local for either strategy: no shuffle, and it runs on streams.
        """
        encoded = encode.encode_texts(
            df, self._encoder(), texts, self.settings.pre_tokenizer, self.settings.normalize_whitespace
        )
        return encoded.select(*key, *keep, *texts)

    def _encoder(self):
        if self.merges is None:
            return encode.word_encoder(self.vocab)
        first = len(SPECIAL_TOKENS)
        alphabet = self.merges.tokens[first : self.merges.alphabet_end]
        return encode.bpe_encoder(
            {c: first + i for i, c in enumerate(alphabet)}, self.merges.merges, self.byte_level
        )

    def lengths(self, df: DataFrame, text: str = "text", out: str = "n_tokens") -> DataFrame:
        """Add the encoded length. A word-level word is one token, so there it needs no lookup."""
        if self.merges is None:
            words = encodable_words(
                F.col(text), self.settings.pre_tokenizer, self.settings.normalize_whitespace
            )
            return df.withColumn(out, F.size(words))
        encoded = encode.encode_texts(
            df, self._encoder(), {"__ids": text}, self.settings.pre_tokenizer,
            self.settings.normalize_whitespace,
        )
        return encoded.withColumn(out, F.size("__ids")).drop("__ids")

    def decode(self, df: DataFrame, ids: str, out: str = "text") -> DataFrame:
        """Add the text of an id array."""
        return encode.decode(df, self.vocab, ids, self.byte_level, out)

    def save(self, path: str) -> None:
        """Publish vocabulary, merges and settings together as the newest version under ``path``."""
        spark = self.vocab.sparkSession

        def write(folder: str) -> None:
            self.vocab.write.parquet(f"{folder}/vocab")
            if self.merges is not None:
                self.merges.merge_table(spark).write.parquet(f"{folder}/merges")
            spark.createDataFrame([asdict(self.settings)]).write.parquet(f"{folder}/settings")

        snapshots.publish(spark, path, write)


def is_saved(spark: SparkSession, path: str) -> bool:
    return snapshots.current(spark, path)[0] > 0


def load_tokenizer(spark: SparkSession, path: str, version: int | None = None) -> Tokenizer:
    """The newest version, or an earlier one; later writers don't change what this one reads."""
    _, folder = snapshots.current(spark, path, version)
    if folder is None:
        raise FileNotFoundError(f"no tokenizer at {path}")
    settings = TokenizerSettings(**spark.read.parquet(f"{folder}/settings").first().asDict())
    table = spark.read.schema(vocab.VOCAB_SCHEMA).parquet(f"{folder}/vocab")
    if settings.strategy == "word-level":
        return Tokenizer(settings, table)
    # both tables are bounded by the vocabulary size
    rows = table.orderBy("id").collect()
    merges = spark.read.schema(bpe.MERGE_SCHEMA).parquet(f"{folder}/merges").orderBy("rank").collect()
    fixed = sum(r.kind != "merge" for r in rows)
    return Tokenizer(
        settings,
        table,
        bpe.Merges(
            [r.token for r in rows], fixed, [(r.left_id, r.right_id, r.merged_id) for r in merges]
        ),
    )


def get_or_train(
    df: DataFrame, path: str, settings: TokenizerSettings, text: str = "text", force: bool = False
) -> Tokenizer:
    """The saved tokenizer, or a new one trained on ``df`` and saved."""
    spark = df.sparkSession
    if force or not is_saved(spark, path):
        Tokenizer.train(df, settings, text).save(path)
    return load_tokenizer(spark, path)
