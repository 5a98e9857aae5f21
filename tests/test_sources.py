import os

import pytest
from pyspark.sql import functions as F

from strata.sources import files as FI
from strata.sources import text_formats as TF


def test_edge_list_file(spark, tmp_path):
    p = tmp_path / "edges.txt"
    p.write_text("# comment\n1 2\n\n  3\t4 extra\nfoo 1 2\n-5 6\n")
    e = sorted((r.src, r.dst, r.attr) for r in TF.read_edge_list(spark, str(p)).collect())
    assert e == [(-5, 6, 1), (1, 2, 1), (3, 4, 1)]
    c = sorted((r.src, r.dst) for r in TF.read_edge_list(spark, str(p), canonical=True).collect())
    assert c == [(-5, 6), (1, 2), (3, 4)]
    bad = tmp_path / "bad.txt"
    bad.write_text("1\n")
    with pytest.raises(Exception):
        TF.read_edge_list(spark, str(bad)).collect()


def test_libsvm_round_trip(spark, tmp_path):
    p = tmp_path / "a.libsvm"
    p.write_text("1 1:0.5 3:2.0\n# skip\n\n0 2:1.0\n")
    df = TF.read_libsvm(spark, str(p))
    rows = sorted((r.label, r.features.size, r.features.indices, r.features.values) for r in df.collect())
    assert rows == [(0.0, 3, [1], [1.0]), (1.0, 3, [0, 2], [0.5, 2.0])]
    out = str(tmp_path / "out")
    TF.write_libsvm(df, out)
    back = sorted((r.label, r.features.indices, r.features.values) for r in TF.read_libsvm(spark, out).collect())
    assert back == [(0.0, [1], [1.0]), (1.0, [0, 2], [0.5, 2.0])]
    p2 = tmp_path / "b.libsvm"
    p2.write_text("1 3:1 2:1\n")
    with pytest.raises(Exception):
        TF.read_libsvm(spark, str(p2)).collect()


def test_vector_text_and_json_round_trip(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("[1.0,2.5]\n(3,[0,2],[1.0,4.0])\n")
    v = TF.read_vectors(spark, str(p))
    got = [(r.features.type, r.features.size, r.features.indices, r.features.values) for r in v.collect()]
    assert got == [(1, None, None, [1.0, 2.5]), (0, 3, [0, 2], [1.0, 4.0])]
    out = str(tmp_path / "j")
    TF.write_vectors_json(v, out)
    back = [(r.features.type, r.features.values) for r in TF.read_vectors_json(spark, out).collect()]
    assert sorted(back) == sorted([(1, [1.0, 2.5]), (0, [1.0, 4.0])])
    bad = tmp_path / "bad.json"
    bad.write_text('{"type":2,"values":[1.0]}\n')
    with pytest.raises(Exception):
        TF.read_vectors_json(spark, str(bad)).collect()


def test_labeled_points(spark, tmp_path):
    p = tmp_path / "lp.txt"
    p.write_text("(1.0,[0.5,2.0])\n(0.0,(3,[1],[4.0]))\n")
    rows = [(r.label, r.features.values) for r in TF.read_labeled_points(spark, str(p)).collect()]
    assert rows == [(1.0, [0.5, 2.0]), (0.0, [4.0])]


def test_points_by_column(spark, tmp_path):
    p = tmp_path / "cols.txt"
    p.write_text("1 2 3\n4 5 6\n")
    pts = sorted((r.row, r.features) for r in TF.read_points_by_column(spark, str(p)).collect())
    assert pts == [(0, [1.0, 4.0]), (1, [2.0, 5.0]), (2, [3.0, 6.0])]


def test_documents_and_utf8_repair(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.txt").write_text("hello world\nline two")
    (d / "b.txt").write_bytes(b"ok \xff\xfe bytes")
    docs = {r.path.rsplit("/", 1)[-1]: r.text for r in FI.read_documents(spark, str(d)).collect()}
    assert docs["a.txt"] == "hello world\nline two"
    rep = {r.path.rsplit("/", 1)[-1]: r.text for r in FI.read_documents_repaired(spark, str(d)).collect()}
    assert "�" in rep["b.txt"] and rep["b.txt"].startswith("ok ")


@pytest.mark.parametrize("text", ["[1,2", "1,2]", "(3,[0,2],[1.0", "(3,[0,9],[1.0,2.0])", "(3,[0,2],[1.0])", "(3,[2,0],[1.0,2.0])",
                                  "(3,[0,0],[1.0,2.0])", "[1,,2]", "", None])
def test_malformed_vector_text_raises(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    with pytest.raises(Exception):
        df.select(TF.parse_vector_text("s").alias("v")).collect()


@pytest.mark.parametrize("text", ['{"type":0,"size":3,"indices":[0,1],"values":[1.0]}', '{"type":0,"size":1,"indices":[1],"values":[1.0]}',
                                  '{"type":1}', '{"type":1,"values":[null]}', "{", None])
def test_malformed_vector_json_raises(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    with pytest.raises(Exception):
        df.select(TF.parse_vector_json("s").alias("v")).collect()


def test_empty_vectors_parse(spark):
    df = spark.createDataFrame([("[]",), ("(3,[],[])",)], "s string")
    got = [(r.v.type, r.v.indices, r.v["values"]) for r in df.select(TF.parse_vector_text("s").alias("v")).collect()]
    assert got == [(1, None, []), (0, [], [])]


def test_column_file_in_blocks(spark, tmp_path):
    """64 lines of 200,000 values: blocks of 4,096 points, no row or group of the file's length."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(64, 200_000)), 3)
    path = tmp_path / "columns.txt"
    with open(path, "w") as f:
        for line in x:
            f.write(" ".join(map(str, line.tolist())) + "\n")
    pts = TF.read_points_by_column(spark, str(path))
    got = pts.agg(F.count("*"), F.min("row"), F.max("row"), F.min(F.size("features")), F.max(F.size("features")), F.sum(F.col("row") * F.get("features", 63))).first()
    assert got[:5] == (200_000, 0, 199_999, 64, 64) and abs(got[5] - float((np.arange(200_000) * x[63]).sum())) < 1e-3
    some = {r.row: r.features for r in pts.filter(F.col("row").isin(0, 4095, 4096, 199_999)).collect()}
    assert some == {i: x[:, i].tolist() for i in (0, 4095, 4096, 199_999)}


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_column_lines_of_any_block_size(spark, block):
    lines = spark.createDataFrame([(0, " 1 2  3 4 5", "f"), (1, "6 7 8 9 10 ", "f"), (0, "1", "g"), (1, "2", "g"), (0, "", "h"), (1, " ", "h")], "dim int, value string, file string")
    got = sorted((r.file, r.row, r.features) for r in TF.parse_column_lines(lines, keep=["file"], block_rows=block).collect())
    assert got == [*(("f", i, [i + 1.0, i + 6.0]) for i in range(5)), ("g", 0, [1.0, 2.0])]
    for short in ("1 2 3 4", "1 2 3 4 5 6", ""):
        with pytest.raises(Exception, match="equally many"):
            TF.parse_column_lines(lines.filter("file = 'f' and dim = 0").unionByName(spark.createDataFrame([(1, short, "f")], "dim int, value string, file string")),
                                  block_rows=block).collect()


def test_older_labeled_points(spark):
    df = spark.createDataFrame([("1.0,0.5 -2 3e1",), ("(0.0,[1.0,2.0])",), (" -1 , 4 ",), ("(2,(3,[1],[5.0]))",)], "value string")
    got = [(r.p.label, r.p.features.values, r.p.features.size) for r in df.select(TF.parse_labeled_point("value").alias("p")).collect()]
    assert got == [(1.0, [0.5, -2.0, 30.0], None), (0.0, [1.0, 2.0], None), (-1.0, [4.0], None), (2.0, [5.0], 3)]
    for bad in ("1.0", "1.0,2.0,3.0", "1.0,a b", "x,1 2"):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame([(bad,)], "value string").select(TF.parse_labeled_point("value").alias("p")).collect()


def test_write_documents_one_file_an_id(spark, tmp_path):
    """Many small documents are written by many tasks, and read back from folders of any depth."""
    rows = [(i, f"line {i}\nä\t") for i in range(300)] + [(7, "twice"), (-3, ""), (301, None)]
    path = f"file:{tmp_path}/documents"
    FI.write_documents(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), path)
    got = FI.read_documents(spark, path, nested=True).collect()
    read = {int(r.path.split("doc_id=")[1].split("/")[0]): r.text for r in got}
    assert len(got) == len(read) == 301
    assert sorted(read.pop(7).splitlines()) == sorted(["line 7", "ä\t", "twice"])
    assert read.pop(-3) == "\n"
    assert read == {i: f"line {i}\nä\t\n" for i in range(300) if i != 7}
    assert not [f for f in os.listdir(tmp_path / "documents" / "doc_id=5") if f.startswith(".")]
    with pytest.raises(FileExistsError):
        FI.write_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), path)


def test_write_documents_names(spark, tmp_path):
    path = f"{tmp_path}/named"
    FI.write_documents(spark.createDataFrame([("a/b", "x"), (None, "y")], "name string, body string"), path, "name", "body")
    assert sorted(os.listdir(path)) == ["name=__HIVE_DEFAULT_PARTITION__", "name=a%2Fb"]
    assert FI.read_documents(spark, path, nested=True).count() == 2
    FI.write_documents(spark.createDataFrame([], "name string, body string"), f"{tmp_path}/none", "name", "body")
    assert FI.read_documents(spark, f"{tmp_path}/none", nested=True).count() == 0


def test_nested_documents_are_not_listed_by_the_driver(spark, tmp_path):
    """The plan holds no status of a document: at 3,000,000 files they exceed the driver's memory."""
    path = f"{tmp_path}/many"
    FI.write_documents(spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id bigint, text string"), path)
    got = FI.read_documents(spark, f"file:{path}", nested=True)
    assert not [f for f in got.inputFiles() if f.endswith(".txt")] and len(got.inputFiles()) < 50
    assert {(r.path, r.text) for r in got.collect()} == {(f"file://{path}/doc_id={i}/part-0.txt", f"text {i}\n") for i in range(400)}
    names = spark.createDataFrame([("a",)], "path string")
    for number, size, tasks in ((0, 0, 1), (3, 9, 3), (400, 9, 8), (3_000_000, 9, 60), (400, 6 << 30, 48)):
        assert FI._dealt(names, number, size).rdd.getNumPartitions() == tasks


def _put(top, name, data=b"x"):
    at = os.path.join(os.fsencode(top), name if isinstance(name, bytes) else name.encode())
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "wb") as f:
        f.write(data)


def test_nested_documents_as_spark_reads_them(spark, tmp_path):
    """Same files, paths and bytes as Spark's own reader: names left out, empty files, links, odd characters."""
    top = f"{tmp_path}/a b%20#"
    _put(top, "a.txt", b"top\n")
    _put(top, "d/bad.txt", b"ok \xff\xfe \xed\xa0\x80 bytes")
    _put(top, "d/bom.txt", "\ufeffx\r\n".encode())
    _put(top, "d/nul.txt", b"a\0b")
    _put(top, "d/long.txt", b"0123456789" * 1_000_000)
    for name in ("d 1/x.txt", "p%25/q%.txt", "h#/i?.txt", "d/[b]{c}^`|~'\"<>\\;,@&=+$!*().txt", "d/\x01\n.txt", "deep/1/2/3/4/5.txt",
                 "_k=1/x.txt", "d/_y=1.txt", "d/_metadata/x.txt", "d/x..txt"):
        _put(top, name)
    for name in ("_hid/x.txt", ".dot/x.txt", "_temporary/x.txt", "d/.x.txt", "d/.txt", "d/_x.txt", "d/_metadata.txt", "d/a.TXT", "d/a.txt.gz",
                 "d/a.txt._COPYING_", b"d/bad\xff.txt"):
        _put(top, name)
    _put(top, "empty/e.txt", b"")
    os.symlink(f"{top}/deep", f"{top}/link")
    os.symlink(f"{top}/a.txt", f"{top}/linked.txt")
    os.symlink(f"{top}/none", f"{top}/dangling.txt")

    def rows(df):
        return sorted((r.path, bytes(r.b)) for r in df.select("path", F.col("text").cast("binary").alias("b")).collect())

    by_spark = spark.read.text(top, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    want = rows(by_spark.select(F.input_file_name().alias("path"), F.col("value").alias("text")))
    for path in (top, f"file:{top}", f"file://{top}//"):
        got = FI.read_documents(spark, path, nested=True)
        assert rows(got) == want and len(want) == 17
        assert [(f.name, f.dataType.simpleString(), f.nullable) for f in got.schema] == [("path", "string", False), ("text", "string", True)]
    assert FI.read_documents(spark, f"{top}/dee*", nested=True).count() == FI.read_documents(spark, f"{top}/a.txt", nested=True).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        FI.read_documents(spark, f"{top}/none", nested=True)


def test_nested_documents_of_other_alphabets(spark, tmp_path):
    """Names as Spark gives them where the JVM's locale can read them."""
    names = ["\xe9/\xfc.txt", "\U0001f600.txt", "comb\u0301.txt", "\xa0\u2028\x85.txt"]
    for name in names:
        _put(tmp_path, name)
    got = {r.path for r in FI.read_documents(spark, str(tmp_path), nested=True).collect()}
    assert got == {f"file://{tmp_path}/{x}" for x in (*names[:3], "%C2%A0%E2%80%A8%C2%85.txt")}


def test_nested_documents_check_sums(spark, tmp_path):
    path = f"{tmp_path}/sums"
    spark.createDataFrame([("x" * 2000,)], "value string").coalesce(1).write.text(path)
    (name,) = (f for f in os.listdir(path) if f.endswith(".txt"))
    assert os.path.exists(f"{path}/.{name}.crc")
    assert FI.read_documents(spark, path, nested=True).first().text == "x" * 2000 + "\n"
    with open(f"{path}/{name}", "r+b") as f:
        f.seek(1500)
        f.write(b"y")
    with pytest.raises(Exception, match="(?i)checksum"):
        FI.read_documents(spark, path, nested=True).collect()
