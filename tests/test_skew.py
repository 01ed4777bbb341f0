"""Hot keys: a third of the lake shares one size and one content.  With broadcast off (so the
cascade joins are sort-merge joins) AQE must split the hot partition, and results stay exact."""

from pyspark.sql import functions as F

from tidemark.operators import compare as cmp
from tidemark.operators import dedup as dd


def _skewed(spark, n=30000):
    ids = spark.range(n).withColumnRenamed("id", "i")
    hot = F.col("i") % 3 == 0
    return ids.select(
        F.concat(F.lit("/lake/f"), F.col("i").cast("string"), F.lit(".pdf")).alias("full_path"),
        F.concat(F.lit("f"), F.col("i").cast("string"), F.lit(".pdf")).alias("relative_path"),
        F.concat(F.lit("f"), F.col("i").cast("string"), F.lit(".pdf")).alias("filename"),
        F.lit(".pdf").alias("file_extension"),
        F.when(hot, F.lit(4096)).otherwise(F.col("i") + 10).cast("bigint").alias("file_size"),
        F.when(hot, F.lit("hotprefix")).otherwise(F.concat(F.lit("p"), F.col("i").cast("string"))).alias("prefix_hash"),
        F.when(hot, F.lit("hotcontent")).otherwise(F.concat(F.lit("h"), F.col("i").cast("string"))).alias("full_hash"),
        F.col("i").alias("position"),
    )


def test_hot_size_join_is_split_and_exact(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        lake = _skewed(spark)
        lib = lake.where(F.col("position") % 2 == 0).withColumn("full_path", F.concat(F.lit("/lib"), F.col("full_path")))
        flagged = cmp.classify(lake, lib)
        rows = flagged.collect()  # runs this very plan, so its final (adaptive) form can be read
        counts = {}
        for r in rows:
            counts[r["stage"]] = counts.get(r["stage"], 0) + 1
        # hot rows (i % 3 == 0) are duplicates (the library holds some); of the rest, even i are
        # duplicates and odd i are unique by size
        assert counts == {"duplicate": 10000 + 10000, "size": 10000}
        plan = flagged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin(skew=true)") == 3, plan[:3000]
        res = dd.dedup_content(cmp.missing_only(flagged))
        assert res.kept.count() == 10000
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_content_dedup_one_keeper(spark):
    lake = _skewed(spark)
    res = dd.dedup_content(lake.withColumn("stage_no", F.lit(1)))
    # 10,000 copies of one content, 20,000 singletons
    assert res.kept.count() == 20001
    s = res.summary.first()
    assert (s["before"], s["after"], s["removed"]) == (30000, 20001, 9999)
    assert res.duplicates.select("original_path").distinct().collect()[0][0] == "/lake/f0.pdf"


def _skew_conf(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    return old


def _restore(spark, old):
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_content_report_join_is_split(spark):
    old = _skew_conf(spark)
    try:
        lake = _skewed(spark).withColumn("stage_no", F.lit(1))
        rep = dd.dedup_content(lake).duplicates
        rows = rep.collect()
        assert len(rows) == 9999
        assert "SortMergeJoin(skew=true)" in rep._jdf.queryExecution().executedPlan().toString()
    finally:
        _restore(spark, old)


def test_hot_name_copy_plan_is_split(spark):
    from tidemark.operators.copyplan import plan_copy

    old = _skew_conf(spark)
    try:
        lake = _skewed(spark).withColumn(
            "filename", F.when(F.col("position") % 3 == 0, F.lit("book.pdf")).otherwise(F.col("filename"))
        )
        plan = plan_copy(lake, "/t", "skip")
        rows = plan.collect()
        assert sum(r["outcome"] == "skipped" for r in rows) == 9999
        assert "SortMergeJoin(skew=true)" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        _restore(spark, old)
