"""The corpus pipeline: toxicity, quality rules, SimHash near-dedup by five-word shingles, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again.

Defined cases: those of the operators, stage by stage. Null and empty texts fail the quality rules; repeated rows and
copies end as one; rows with null ids are kept like others; further columns are carried along; without any label no text
is toxic; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from quire.llm import copies, packing, quality, toxicity
from quire.llm.common import shared_folder, table


def keep_civil(spark, docs, sf_dir):
    """Documents whose toxicity score is under the threshold; labels come from ``labels``, examples from ``docs``."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_good(spark, docs, sf_dir):
    """Documents that pass the base rules and are no outlier of their language and source."""
    return quality.drop_low_quality(docs)


def keep_first_copies(spark, docs, sf_dir):
    """Of each class of texts that a Jaccard similarity of 0.8 of their five-word shingles links, the document with the smallest id. Candidates come from the Gray index of fingerprints first."""
    return copies.drop_near_duplicates(docs, shingle=5, least=0.8)


def pack_sequences(spark, docs, sf_dir):
    """Every piece of every document with its sequence and offset."""
    return packing.packed(docs)


STAGES = [("toxicity", keep_civil), ("quality", keep_good), ("near_duplicates", keep_first_copies), ("packing", pack_sequences)]

#: Neither similarities of shingles, tokenizer ids nor nearest labelled examples can be stated in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; returns the rows of the last. A stage's folder is removed once the next one is written."""
    top = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
