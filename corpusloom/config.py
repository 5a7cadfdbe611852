"""Settings that define the results."""

from __future__ import annotations

from dataclasses import dataclass

# The special tokens. Their position in this list is their id.
SPECIAL_TOKENS = (
    "[UNK]",
    "[PAD]",
    "[BOS]",
    "[EOS]",
    "[SEP]",
    "<features>",
    "</features>",
    "<words>",
    "</words>",
    "<summary>",
    "</summary>",
    "<story>",
    "</story>",
)
UNK, PAD, BOS, EOS, SEP = range(5)
(
    FEATURES_START,
    FEATURES_END,
    WORDS_START,
    WORDS_END,
    SUMMARY_START,
    SUMMARY_END,
    STORY_START,
    STORY_END,
) = range(5, 13)

# The sequence lengths whose coverage is reported.
COVERAGE_CUTOFFS = (256, 512, 768, 850, 1024, 1280, 1536, 2048)

STRATEGIES = ("word-level", "subword-level")
PRE_TOKENIZERS = ("whitespace", "byte-level")


@dataclass(frozen=True)
class TokenizerSettings:
    strategy: str = "subword-level"
    pre_tokenizer: str = "byte-level"
    vocab_size: int = 20000
    min_frequency: int = 2
    normalize_whitespace: bool = True

    def __post_init__(self):
        if self.pre_tokenizer not in PRE_TOKENIZERS:
            raise ValueError(f"no such way to split words: {self.pre_tokenizer}")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"no such kind of vocabulary: {self.strategy}")
        if self.strategy == "word-level" and self.pre_tokenizer == "byte-level":
            raise ValueError("A word-level vocabulary cannot use the byte-level pre-tokenizer")


@dataclass(frozen=True)
class StageSettings:
    """One training stage: what its sequences, labels, batches and logs look like."""

    max_length: int = 512
    batch_size: int = 8
    ignore_index: int = -100
    label_smoothing: float = 0.0
    epochs: int = 2
    warmup_share: float = 0.03
    train_history_step: int = 1000
    val_history_step: int = 100

    @property
    def eval_batch_size(self) -> int:
        return max(1, self.batch_size // 2)


PRETRAINING = StageSettings()
FINETUNING = StageSettings(label_smoothing=0.05, epochs=1)


@dataclass(frozen=True)
class DataSettings:
    test_ratio: float = 0.2
    eval_ratio: float = 0.5
    seed: int = 42
    sample_train: int = 1000
    sample_validation: int = 500
    head_records: int = 2500
