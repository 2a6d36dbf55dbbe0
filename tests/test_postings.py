import random

from pyspark.sql import functions as F

from tagweave.operators import postings
from tagweave.operators.match import match_tags
from tagweave.operators.postings import delta_matches, store_matches

TAGS = "target_lang string, name string, file string, kind string"
DOCS = "doc_id long, lang string, source string, text string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_delta_equals_a_full_match_when_both_sides_change(spark, tmp_dir):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rnd.choice(words) for _ in range(8))
    docs = [(i, rnd.choice(["c", "en", None]), f"f{i % 5}", "w0 " + text(), 1) for i in range(80)]
    tags = [(rnd.choice(["c", "en"]), w, f"f{rnd.randint(0, 6)}", rnd.choice("cdf")) for w in words for _ in range(3)]
    store_matches(_docs(spark, docs), spark.createDataFrame(tags, TAGS), f"{tmp_dir}/store")
    after = []
    for doc_id, lang, source, body, tick in docs:
        turn = doc_id % 8
        if turn == 0:
            continue  # closed
        if turn == 1:
            body, tick = text(), tick + 1
        if turn == 2:
            source = "f6"  # moved to another file
        if turn == 3:
            lang = "c"
        after.append((doc_id, lang, source, body, tick))
    after += [(1000 + i, "en", "f1", text(), 1) for i in range(5)]
    after += [(None, "c", "f2", text(), 1), (2000, "c", None, None, None)]
    # index rows go, come, and change file or kind; "w0" occurs in every document
    changed = [t for i, t in enumerate(tags) if i % 4] + [("c", "w0", "f9", "z"), ("en", "new", "f1", "d")]
    new_docs, new_tags = _docs(spark, after), spark.createDataFrame(changed, TAGS)
    key = lambda r: tuple(map(str, r))
    got = sorted(map(key, delta_matches(spark, f"{tmp_dir}/store", new_docs, new_tags).collect()))
    assert got == sorted(map(key, match_tags(new_docs, new_tags).collect()))


def test_unchanged_documents_are_not_tokenized(spark, tmp_dir):
    """The text of a document with an unmoved tick is not read: another one changes nothing."""
    docs = [(i, "en", "f", f"alpha w{i}", 1) for i in range(6)]
    tags = spark.createDataFrame([("en", "alpha", "x", "f"), ("en", "gone", "x", "f")], TAGS)
    store_matches(_docs(spark, docs), tags, f"{tmp_dir}/store")
    after = _docs(spark, docs).withColumn("text", F.lit("gone"))
    after = after.withColumn("n_chars", F.when(F.col("doc_id") == 2, 2).otherwise(F.col("n_chars")))
    more = tags.unionByName(spark.createDataFrame([("en", "w3", "y", "d")], TAGS))
    got = {tuple(r) for r in delta_matches(spark, f"{tmp_dir}/store", after, more).collect()}
    assert got == {(i, "alpha", "f") for i in (0, 1, 3, 4, 5)} | {(2, "gone", "f"), (3, "w3", "d")}


def test_only_touched_buckets_are_read(spark, tmp_dir):
    docs = _docs(spark, [(i, "en", "f", f"w{i}", 1) for i in range(6)])
    tags = spark.createDataFrame([("en", "w1", "x", "f")], TAGS)
    store_matches(docs, tags, f"{tmp_dir}/store")
    more = tags.unionByName(spark.createDataFrame([("en", "w2", "x", "f")], TAGS))
    plan = delta_matches(spark, f"{tmp_dir}/store", docs, more)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    none = delta_matches(spark, f"{tmp_dir}/store", docs, tags)
    assert {tuple(r) for r in none.collect()} == {(1, "w1", "f")}


def test_empty_snapshots(spark, tmp_dir):
    tags = spark.createDataFrame([("en", "w1", "x", "f")], TAGS)
    docs = _docs(spark, [(1, "en", "f", "w1", 1)])
    store_matches(_docs(spark, []), tags, f"{tmp_dir}/store")
    assert {tuple(r) for r in delta_matches(spark, f"{tmp_dir}/store", docs, tags).collect()} == {(1, "w1", "f")}
    assert delta_matches(spark, f"{tmp_dir}/store", _docs(spark, []), tags.limit(0)).collect() == []


def test_files_of_postings_are_cut_by_rows(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(postings, "FILE_ROWS", 3, raising=False)
    docs = _docs(spark, [(i, "en", "f", "w1", 1) for i in range(200)])
    store_matches(docs, spark.createDataFrame([("en", "w1", "x", "f")], TAGS), f"{tmp_dir}/store")
    files = spark.read.parquet(f"{tmp_dir}/store/postings").groupBy(F.input_file_name()).count()
    assert files.agg(F.max("count"), F.sum("count")).first()[:] == (3, 200)
