"""Results that must not depend on how a table lies on disk."""

from loomgrid.llm import brown


def test_brown_scores_do_not_depend_on_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    key = lambda d: sorted((r.doc_id, r.n_known, r.score, r.base_score) for r in d.collect())
    try:
        one = key(brown.score(docs))
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert key(brown.score(docs.repartition(3, "doc_id"))) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
