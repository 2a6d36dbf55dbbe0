"""What one task holds follows from its input's bytes, not from the size of the whole input."""

from pyspark.sql import functions as F

from tagweave.operators import match
from tagweave.operators.match import match_tags
from tagweave.plans.queries import QUERIES
from tagweave.session import TASK_BYTES, apply_defaults

DOCS = "doc_id long, lang string, source string, text string"
TAGS = "target_lang string, name string, file string, kind string"


def _inputs(spark):
    docs = [(i, "en", f"f{i % 3}", f"w{i} w1 other") for i in range(30)]
    docs += [(5, "en", "f1", "w7"), (None, "en", "f2", "w1"), (100, "en", "f0", None), (101, None, "f0", "w1"), (102, "en", None, "w2")]
    tags = [("en", f"w{i}", f"f{i % 2}", "f") for i in range(10)] + [("en", "w1", "f2", "c"), ("fr", "w1", "f0", "c")]
    return docs, tags


def _want(docs, tags):
    return {
        (d, name, kind)
        for d, lang, source, text in docs
        for target, name, file, kind in tags
        if target == lang and (file == source or name in (text or "").split())
    }


def test_small_and_large_index_give_all_matches(spark, monkeypatch):
    docs, tags = _inputs(spark)
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(tags, TAGS)
    for limit in (100_000, 3):
        monkeypatch.setattr(match, "SMALL_INDEX", limit, raising=False)
        got = [tuple(r) for r in match_tags(d, t).collect()]
        assert len(got) == len(set(got)) and set(got) == _want(docs, tags)


def test_tokens_are_not_shuffled_to_a_small_index(spark):
    docs, tags = _inputs(spark)
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(tags, TAGS)
    plan = match_tags(d, t)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(doc_id" in plan


def test_tasks_after_a_shuffle_are_bounded_in_bytes(spark):
    """More than eight tasks' worth of rows arrive in more than eight tasks, whatever the session's partitions."""
    apply_defaults(spark)
    rows = spark.range(9 * TASK_BYTES // 8).select(F.xxhash64("id").alias("k"))
    tasks = rows.repartition("k").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 8


def test_sketches_of_documents_are_not_shuffled(spark):
    """Between the partial and the final step of a document's sketches there is no exchange, as it ran."""
    apply_defaults(spark)
    found = QUERIES["token_sketch"](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Final Plan" in plan
    part = plan.index("partial_approx_top_k_accumulate")
    assert "Exchange" not in plan[plan.rindex("approx_top_k_accumulate", 0, part - len("partial_")) : part]
