"""The queries ``opN_<name>``: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm import brown, forest, langid, licenses, linededup, mixing, ogg, packing, prefixtrie, resampling, simhash, warc, whitening
from loomgrid.llm.common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = linededup.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select("row.doc_id", "n_lines", "n_flagged", "n_removed", d.new_text.alias("clean_text"))


def op2_brown_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = Scratch(spark, "ogg").save("media", ogg.media_table(table(spark, sf_dir, "documents")))
    return ogg.digest_table(media)


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_forest_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return m.select(m.id.alias("doc_id"), "size", "source_size", "target", "taken")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_spread,
        op2_brown_class_scores,
        op3_crf_language,
        op4_simhash_golay,
        op5_ogg_media,
        op6_warc_normaliser,
        op7_forest_near_dup,
        op8_best_fit_packing,
        op9_importance_resampling,
        op10_sainte_lague_mix,
        op11_prefix_trie,
        op12_license_scan,
        op13_lanczos_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_line_spread": linededup.oracle(), "op11_prefix_trie": prefixtrie.oracle(), "op12_license_scan": licenses.oracle()}
