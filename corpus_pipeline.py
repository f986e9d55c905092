"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents:

1. quality rules: documents that fail the base rules or the suffix-array repetition rule go
2. line dedup: lines that five or more of the documents left share stay in one of them
3. near duplicates: of each group of near copies among the texts that are left one document stays
4. mixing: sources are taken to their target weights; a document taken twice is two rows
5. packing: the texts are encoded and placed into sequences of 2,048 ids

An empty table gives an empty result. Null and empty texts have no words and go in stage 1. Rows with a null id are
rows of their own in stages 1, 2 (which takes no lines from them), 4 and 5; in stage 3 a copy with an id stays before one without. Of
rows that are repeated whole one stays after stage 3; ties there go to the smaller id, then to a hash of the text. A
null source is a source of its own, the last. Texts of any length are taken whole. Further columns of documents, of any
name, pass through to stage 4 unchanged (n_chars follows the text); packing reads the id and the text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from figshelf.llm import common, lines, mixing, near_duplicates, packing, quality
from figshelf.sources.storage import new_folder, remove

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_dedup), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Mixing draws at random and packing searches; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Each stage's table goes when the next one's is there: the last stage keeps one of its own."""
    docs, before = common.documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        folder = None
        if k < len(STAGES) - 1:
            folder = new_folder(spark, f"stage-{k}")
            docs = common.written_to(docs, folder)
        if before:
            remove(spark, before)
        before = folder
    return docs
