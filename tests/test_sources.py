import lzma
import os

from tagweave.sources.files import (
    file_manifest,
    read_index,
    read_root_list,
    read_sources,
    skipped_sources,
    write_index,
)


def test_index_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("a\tb",), ("c",)], "line string")
    for comp in ["none", "gzip", "bzip2"]:
        path = os.path.join(tmp_dir, comp)
        write_index(df, path, comp)
        assert sorted(r.line for r in read_index(spark, path).collect()) == ["a\tb", "c"]


def test_xz_read(spark, tmp_dir):
    path = os.path.join(tmp_dir, "tags.xz")
    with open(path, "wb") as f:
        f.write(lzma.compress(b"a\tb\nc\n"))
    assert [r.line for r in read_index(spark, path).collect()] == ["a\tb", "c"]


def test_sources_manifest_roots(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "src", "d"))
    for name, text in [("src/x.c", "int x;\n"), ("src/d/y.h", "int y;")]:
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(text)
    texts = {os.path.basename(r.path): r.text for r in read_sources(spark, os.path.join(tmp_dir, "src", "*")).collect() if r.text}
    assert texts["x.c"] == "int x;\n"
    m = {r.file: r.length for r in file_manifest(spark, os.path.join(tmp_dir, "src")).collect()}
    assert m == {"x.c": 7, "y.h": 6}
    assert read_root_list(spark, os.path.join(tmp_dir, "missing.txt")).count() == 0
    with open(os.path.join(tmp_dir, "roots.txt"), "w") as f:
        f.write("/p\n\n/p/q\n")
    assert sorted(r.root for r in read_root_list(spark, os.path.join(tmp_dir, "roots.txt")).collect()) == ["/p", "/p/q"]


def test_mixed_directory(spark, tmp_dir):
    import gzip

    for name, data in [("a.txt", b"a\n"), ("b.xz", lzma.compress(b"b1\nb2")), ("c.gz", gzip.compress(b"c\n"))]:
        with open(os.path.join(tmp_dir, name), "wb") as f:
            f.write(data)
    assert sorted(r.line for r in read_index(spark, tmp_dir).collect()) == ["a", "b1", "b2", "c"]
    assert sorted(r.line for r in read_index(spark, os.path.join(tmp_dir, "*.xz")).collect()) == ["b1", "b2"]


def test_text_that_is_not_utf8(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "l.c"), "wb") as f:
        f.write("ok é".encode("latin-1"))
    assert [r.text for r in read_sources(spark, tmp_dir).collect()] == ["ok �"]


def test_only_xz_files_are_read_whole(spark, tmp_dir):
    """Plain and gzip files beyond the binary reader's largest file are read line by line."""
    import gzip

    lines = [f"line {k * k}" for k in range(3000)]
    text = "\n".join(lines).encode()
    for name, data in [("a.txt", text), ("b.gz", gzip.compress(text)), ("c.xz", lzma.compress(b"x\ny"))]:
        with open(os.path.join(tmp_dir, name), "wb") as f:
            f.write(data)
    assert os.path.getsize(os.path.join(tmp_dir, "b.gz")) > 1000
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert sorted(r.line for r in read_index(spark, tmp_dir).collect()) == sorted([*lines, *lines, "x", "y"])
        assert read_index(spark, os.path.join(tmp_dir, "a.txt")).count() == len(lines)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_skipped_files_are_named(spark, tmp_dir):
    for name in ("a.c", "b.c", "c.c"):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(name)
    read = read_sources(spark, tmp_dir)
    assert skipped_sources(spark, tmp_dir, read).count() == 0
    lost = skipped_sources(spark, tmp_dir, read.where("text <> 'b.c'")).collect()
    assert [(os.path.basename(r.path), r.length) for r in lost] == [("b.c", 3)]
