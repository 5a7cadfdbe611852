"""Column functions over token-id arrays: framing, truncation, prompts, labels, cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import config as c


def ids(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


def frame_corpus(tokens: Column) -> Column:
    return F.concat(ids(c.BOS), tokens, ids(c.EOS))


def truncate(sequence: Column, max_length: int = 512, length_of: Column | None = None) -> Column:
    """Cut to ``max_length`` and end in EOS. ``length_of`` decides, if another array rules."""
    size = F.size(sequence if length_of is None else length_of)
    cut = F.concat(F.slice(sequence, 1, max_length - 1), ids(c.EOS))
    return F.when(size > max_length, cut).otherwise(sequence)


def build_prompt(features: Column, words: Column, summary: Column) -> Column:
    return F.concat(
        ids(c.BOS, c.FEATURES_START),
        features,
        ids(c.FEATURES_END, c.WORDS_START),
        words,
        ids(c.WORDS_END, c.SUMMARY_START),
        summary,
        ids(c.SUMMARY_END, c.STORY_START),
    )


def build_sft(prompt: Column, story: Column) -> Column:
    return F.concat(prompt, story, ids(c.STORY_END, c.EOS))


def sft_labels(prompt: Column, story: Column, ignore_index: int = -100) -> Column:
    masked = F.array_repeat(F.lit(ignore_index), F.size(prompt))
    return F.concat(masked, story, ids(c.STORY_END, c.EOS))


def drop_first(sequence: Column) -> Column:
    return F.slice(sequence, F.lit(2), F.greatest(F.size(sequence) - 1, F.lit(0)))


def drop_last(sequence: Column) -> Column:
    return F.slice(sequence, F.lit(1), F.greatest(F.size(sequence) - 1, F.lit(0)))


def shift_labels_pretrain(sequence: Column, ignore_index: int = -100) -> Column:
    """Next-token labels: every PAD, also one written in the text, is ignored."""
    return F.transform(
        drop_first(sequence), lambda x: F.when(x == c.PAD, F.lit(ignore_index)).otherwise(x)
    )


def shift_labels_sft(labels: Column) -> Column:
    return drop_first(labels)


def padding_mask(sequence: Column) -> Column:
    return F.transform(sequence, lambda x: x != c.PAD)


def pad_right(sequence: Column, length: Column, value: int) -> Column:
    return F.concat(sequence, F.array_repeat(F.lit(value), length - F.size(sequence)))


def _before_any(sequence: Column, stops: tuple[int, ...]) -> Column:
    """The part of an array before the first of ``stops``."""
    places = [F.nullif(F.array_position(sequence, F.lit(s)), F.lit(0)) for s in stops]
    end = F.size(sequence) + 1
    first = F.least(*places, end) if places else end
    return F.slice(sequence, F.lit(1), (first - 1).cast("int"))


def cut_continuation(sequence: Column) -> Column:
    kept = _before_any(sequence, (c.EOS,))
    return F.filter(kept, lambda x: ~x.isin(c.BOS, c.PAD))


def cut_story(sequence: Column, prompt_length: Column) -> Column:
    answer = F.slice(
        sequence,
        prompt_length + 1,
        F.greatest(F.size(sequence) - prompt_length, F.lit(0)),
    )
    kept = _before_any(answer, (c.EOS, c.STORY_END))
    skipped = (
        c.BOS,
        c.PAD,
        c.FEATURES_START,
        c.FEATURES_END,
        c.WORDS_START,
        c.WORDS_END,
        c.SUMMARY_START,
        c.SUMMARY_END,
        c.STORY_START,
    )
    return F.filter(kept, lambda x: ~x.isin(*skipped))
