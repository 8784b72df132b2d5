"""A corpus pipeline: quality, language, near duplicates, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

from tidemill.llm.common import table, written
from tidemill.llm.language import language_stage
from tidemill.llm.ngram_join import dedup_stage
from tidemill.llm.packing import digests, pack
from tidemill.llm.quality import quality_stage


def packing_stage(spark, docs, sf_dir):
    """The pieces of every kept document, with the crc32 of their ids. Executors are full after the stages before, so
    workers remember less and take fewer texts at once."""
    return digests(pack(docs, memo=30_000_000, most_chars=1_000_000))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("packing", packing_stage),
]

#: The quality and language models are trained, which SQL cannot express; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to the documents of ``sf_dir``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
