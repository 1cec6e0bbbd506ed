"""Corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of documents.
"""

import public_tokenizers

from riskflow.llm import decontam, langid, lines, packing, simhash
from riskflow.llm.tables import read, stored


def language_id(spark, docs, sf_dir):
    """Documents whose text is null or has no letter go, missing labels are filled in where the guess is not ambiguous; the
    classifier learns from the labels of the same documents."""
    return langid.keep_identified(docs, langid.train(docs), lang="lang")


def line_dedup(spark, docs, sf_dir):
    """Lines that are boilerplate of their source go, copies of a document counted once; documents stay."""
    return lines.drop_boilerplate(docs, copies_once=True)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays, that with the smallest id."""
    return simhash.deduplicate(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark, docs, sf_dir):
    """Token pieces and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("best_fit_packing", best_fit_packing)]

#: Language models, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to all documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
