import json
import os

from pyspark.sql import functions as F

from tagweave.functions.arrays import delete_range, insert_before, replace_at, splice
from tagweave.operators.edits import splice as py_splice
from tagweave.operators.index import TagConfig
from tagweave.sources.settings import (
    groups_from_settings,
    ignored_from_settings,
    kind_map_from_settings,
    read_settings,
)


def test_settings_match_config(spark, tmp_dir):
    path = os.path.join(tmp_dir, "settings.json")
    with open(path, "w") as f:
        json.dump({"order": {"c": "cdfm", "py": "fc"}, "equivalent": {"c": {"t": "c"}},
                   "ignored": {"c": ["the", "of"]},
                   "groups": {"c": {"f": {"group": "Fn", "prefix": None, "suffix": "\\>"}}}}, f)
    s = read_settings(spark, path)
    cfg = TagConfig(order={"c": "cdfm", "py": "fc"}, equiv={"c": {"t": "c"}}, ignored={"c": ["the", "of"]})
    assert sorted(map(tuple, kind_map_from_settings(s).collect())) == sorted(map(tuple, cfg.kind_map(spark).collect()))
    assert sorted(map(tuple, ignored_from_settings(s).collect())) == sorted(map(tuple, cfg.ignored_df(spark).collect()))
    assert [tuple(r) for r in groups_from_settings(s).collect()] == [("c", "f", "Fn", None, "\\>")]


def test_native_splice_equals_python(spark):
    cases = [(["a", "b"], 1, 2, ["x", "y"]), (["a", "b"], 0, 0, ["x"]), (["a", "b", "c"], 0, 2, []),
             (["a"], 1, 1, ["z"]), (["a"], 0, 1, []), (["a", "b"], 5, 9, ["q"])]
    df = spark.createDataFrame(cases, "a array<string>, f int, l int, r array<string>")
    got = [r.o for r in df.select(splice("a", "f", "l", "r").alias("o")).collect()]
    assert got == [py_splice(a, f, l, r) for a, f, l, r in cases]
    one = spark.createDataFrame([(["a", "b", "c"],)], "a array<string>")
    row = one.select(insert_before("a", F.lit(1), F.array(F.lit("n"))).alias("i"),
                     delete_range("a", F.lit(0), F.lit(2)).alias("d"),
                     replace_at("a", F.lit(2), F.lit("z")).alias("p")).collect()[0]
    assert (row.i, row.d, row.p) == (["a", "n", "b", "c"], ["c"], ["a", "b", "z"])
