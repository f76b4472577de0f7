"""The corpus pipeline: documents through five stages, each written as Parquet in the shared folder and read again."""

from pyspark.sql import DataFrame, SparkSession

from tidelens.llm.anchors import strip_repeats
from tidelens.llm.hdlang import keep_languages
from tidelens.llm.minhash import keep_first
from tidelens.llm.mixing import mix_stage
from tidelens.llm.shared import table
from tidelens.llm.wfst import piece_stage

STAGES = [
    ("language ID", keep_languages),
    ("MinHash near-dedup", keep_first),
    ("substring dedup", strip_repeats),
    ("mixing to target weights", mix_stage),
    ("SentencePiece", piece_stage),
]

#: The stages learn, hash and encode in ways that SQL does not express; tests compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
