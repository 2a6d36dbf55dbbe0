import random

from pyspark.sql import functions as F

from tagweave.operators.sketches import TOP_ERROR, UNIQUE_ERROR, merge_sketches, read_sketches, token_sketches


def test_merged_sketches_keep_their_bounds(spark):
    rnd = random.Random(2)
    rows = []
    for doc in range(60):
        words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(3000)]
        rows.append((doc, "ab"[doc % 2], words))
    docs = spark.createDataFrame(rows, "doc_id long, grp string, toks array<string>").repartition(5)
    per_doc = token_sketches(docs, "doc_id", "grp")
    assert per_doc.count() == 60
    got = {r.grp: r for r in read_sketches(merge_sketches(per_doc, "grp"), "grp", k=5).collect()}
    for grp in "ab":
        all_words = [w for _, g, ws in rows if g == grp for w in ws]
        counts = {w: 0 for w in all_words}
        for w in all_words:
            counts[w] += 1
        r = got[grp]
        assert r.n_tokens == len(all_words)
        assert abs(r.unique_tokens - len(counts)) <= 5 * UNIQUE_ERROR * len(counts)
        assert len(r.top) == 5
        for item in r.top:
            assert abs(item["count"] - counts[item["item"]]) <= TOP_ERROR * len(all_words)


def test_empty_texts_and_null_groups(spark):
    docs = spark.createDataFrame(
        [(1, None, ["a", "a", "b"]), (2, None, []), (3, "x", None), (None, "y", ["c"])],
        "doc_id long, grp string, toks array<string>",
    )
    merged = read_sketches(merge_sketches(token_sketches(docs, "doc_id", "grp"), "grp"), "grp")
    got = {r.grp: (r.n_tokens, r.unique_tokens, r.top[0]["item"]) for r in merged.collect()}
    assert got == {None: (3, 2, "a"), "y": (1, 1, "c")}
    none = token_sketches(docs.where(F.lit(False)), "doc_id", "grp")
    assert merge_sketches(none, "grp").collect() == []
