"""The corpus pipeline: stages that each read what the stage before them kept.

Quality classifier, near-duplicates, benchmark decontamination, mixing to target weights, packed token ids.

No stage tells rows apart by doc_id, so null and repeated ids are rows like any other. Documents with a null text have
no features, words or windows: the quality stage scores them like empty texts, the next two keep them if it does, the
mix takes them once, and packing lists them without tokens. Of repeated rows, and of copies of a text, one stays. Of
rows that tie in the mix, those with the smaller hash of text and id are taken more often. Texts are never cut. Other
columns than those of documents are dropped at the start, whatever their names. Without rows, every stage is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm.common import drop_stored, stored, table
from boxwright.llm.mix import mix, repeated
from boxwright.llm.order_minhash import keep_one
from boxwright.llm.phrase_index import build_index, search
from boxwright.llm.token_pack import pack
from boxwright.llm.weak_quality import keep_good

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs.select(*COLUMNS))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row: of the text with the smallest id, the smallest row. Null texts stay."""
    return keep_one(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Rows are told apart by their texts, which alone decide."""
    keyed = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("text"))
    index = build_index(keyed, id_col="_key")
    hit = stored(search(index, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("doc_id").alias("_key")).distinct(), "hit")
    drop_stored(index)
    return keyed.join(hit, "_key", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return repeated(mix(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near-duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token ids", packed),
]

#: Models, sketches and tokenisers have no counterpart in SQL. Tests compare parts of operators 2, 3, 4, 7, 9 and 10 with
#: brute force; of the pipeline itself they only check that three documents are dropped from about 30 rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
