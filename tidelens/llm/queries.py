"""The queries of the operators, each over its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm import align, anchors, archives, bitslice, codes, hdlang, imatch, linkgraph, minhash, mixing, tokenfile, toxicity, wfst


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge_urls(read(spark, sf_dir, "pages"))


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdlang.identify(read(spark, sf_dir, "documents"))


def op5_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.search(read(spark, sf_dir, "embeddings"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(read(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.tokenize(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.remove_repeats(read(spark, sf_dir, "documents"))


def op9_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return wfst.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_pages(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codes.compress(read(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_link_graph": op1_link_graph,
    "op2_pareto_mix": op2_pareto_mix,
    "op3_minhash": op3_minhash,
    "op4_hd_language": op4_hd_language,
    "op5_bit_slices": op5_bit_slices,
    "op6_imatch": op6_imatch,
    "op7_token_files": op7_token_files,
    "op8_anchors": op8_anchors,
    "op9_piece_transducer": op9_piece_transducer,
    "op10_toxicity": op10_toxicity,
    "op11_archives": op11_archives,
    "op12_alignment": op12_alignment,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {
    "op1_link_graph": linkgraph.judge_sql(),
    "op2_pareto_mix": mixing.MIX_SQL,
    "op11_archives": archives.ARCHIVE_SQL,
}
