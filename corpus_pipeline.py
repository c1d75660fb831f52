"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a
DataFrame; run() writes it as Parquet in the shared folder and reads it again for the next.

* toxicity: documents with a score of 0.7 or more go. Unlabelled tables reject nothing.
* line_dedup: later copies of repeated line runs of 50 words or more are cut out of the texts, and
  n_chars follows; a document of which no word is left goes.
* simhash: of each group of near duplicates the document with the least doc_id stays. Linked are texts
  whose SimHash fingerprints differ in 4 bits or fewer, by op5's operator, and those whose five-word
  shingles have a Jaccard similarity of 0.8 or more.
* mixing: each source gives its share of all words by the weights 5, 2, 1, ...; a document that is
  taken more than once has a row for each copy.
* bpe: token ids of every row, and the digests that show that decoding them gives the text back.

Nulls, empty texts and tables, repeated rows: as the operators say. Extra columns are carried along
by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.llm import bpe, linededup, mixing, nearcopies, toxicity
from passagelake.llm.common import prepare, read, scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.kept(docs, toxicity.fitted(docs, read(spark, sf_dir, "labels")), toxicity.TOXIC)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    # All columns but the new ones travel in a struct, so that none can clash with the operator's and no text is carried twice.
    row = F.struct(*[c for c in docs.columns if c not in new])
    done = linededup.deduplicated(docs.select("doc_id", "text", row.alias("row")))
    has_word = F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    left = done.filter((F.col("n_deleted") == 0) | has_word)
    return left.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col("row").getField(f.name).alias(f.name) for f in docs.schema])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return nearcopies.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    prepare(spark)
    return bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=["doc_id", "source"])


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_repeated_lines),
    ("simhash", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No stage's model, suffix array, components or merges can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole table documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
