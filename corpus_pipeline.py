"""A corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of documents.

1. language: texts that are in none of the learnt languages go.
2. near_duplicates: one document of each group of near copies stays (Jaccard
   similarity of 0.8 or more over five-word shingles, candidates by SimHash and
   shared shingles).
3. personal_data: spans in the text are replaced by their kind.
4. mixing: documents are put in the order that gives each source its share.
5. packing: one row for each piece of a training sequence. Sequences follow the
   order that mixing has written: that of its files by name, and of rows in them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import jaccard, lang_id, mixing, packing, pii
from gridloom.llm.common import deleted, read, staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in some learnt language, by cross-parsing entropy.

    A null or empty text, one without letters, and one of 64 bytes or more that
    costs over 7 bits a byte in every language go; with nothing to learn from
    all go. A null language or id changes nothing; of repeated rows all stay or
    none.
    """
    return lang_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of near copies.

    Null, empty and white texts are one group. A null id comes after all
    others; of rows that share id and text one stays.
    """
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data in the text replaced by its kind.

    A null text stays null; n_chars follows the text where it is not null; all
    rows and other columns stay as they are.
    """
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that gives each source its share of any stretch.

    A null source is a source; repeated rows and null ids each have a place;
    ties of ids are in any order.
    """
    return mixing.in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset, source, position.

    A null or empty text is one piece of the end id; longer texts than a
    sequence are cut; a repeated row is packed as often as it occurs. Positions
    are the documents' places as they stand, from 0.
    """
    return packing.pack_mixed(docs, public_tokenizers.path("word_bpe_49k.json"), ordered=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language models, SimHash components and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            made = staged(made)
        if k:
            deleted(docs)  # the last stage has stored what it read
        docs = made
    return docs
