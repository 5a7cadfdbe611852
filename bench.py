"""Time the headline queries: one JSON line with the median of three runs per query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from dataclasses import replace
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import inputs
from checks.queries import QUERIES
from corpusloom.session import local_session
from corpusloom.tokenizer import Tokenizer

HEADLINE = (
    "length_stats",
    "truncation_coverage",
    "word_counts",
    "word_counts_bytelevel",
    "train_word_level",
    "encode_word_level",
    "encode_bpe",
    "decode_tokens",
    "length_stats_bpe",
    "assemble_records",
    "truncate_sft",
    "pad_corpus",
    "pad_sft",
    "batch_train",
    "metric_windows",
    "cross_entropy",
    "top_p",
    "route_load",
)


def host_speed() -> float:
    """Seconds of a fixed sum in plain Python: tells a slow host from a slow query."""
    start = time.process_time()
    sum(i * i for i in range(10_000_000))
    return time.process_time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g")
    times = {}
    host = [host_speed()]

    start = time.time()
    inputs.word_tokenizer(spark, sf_dir)
    times["get_or_train_word_level"] = time.time() - start
    # the default tokenizer's size, and a small one
    for size in (20_000, 1024):
        start = time.time()
        settings = replace(inputs.SUBWORD, vocab_size=size)
        Tokenizer.train(inputs.documents(spark, sf_dir), settings)
        times[f"train_bpe_{size}"] = time.time() - start
    inputs.bpe_tokenizer(spark, sf_dir)

    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = statistics.median(runs)
    host.append(host_speed())
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "host_seconds": [round(x, 3) for x in host],
            }
        )
    )


if __name__ == "__main__":
    main()
