"""Five stages that turn ``documents`` into encoded training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread as the next stage's docs. The query belongs to subpackage llm.

Defined results: what each operator states for nulls, empty and long texts, ties and repeated rows holds for its
stage. Rows that repeat both doc_id and text share every decision; near_duplicates keeps one
of them. A null text has no evidence (its posterior decides), loses no line, is near nothing,
holds no benchmark item and has no ids. An empty table stays empty; extra columns go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.bpe import encode_documents, public_path
from tallyloom.llm.common import stash, table
from tallyloom.llm.contamination import decontamination_stage
from tallyloom.llm.lines import line_stage
from tallyloom.llm.neardup import neardup_stage
from tallyloom.llm.quality import quality_stage


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and digests of the ids and of the bytes decoded from them."""
    return encode_documents(docs, public_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encode_stage),
]

#: A fitted classifier, LSH and BPE are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
