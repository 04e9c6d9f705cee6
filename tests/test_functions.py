import hashlib

import pytest
from pyspark.sql import functions as F

from stowage import functions as sf
from stowage.functions.formats import format_bytes


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_extension_of_odd_names(spark):
    names = ["a.tar.gz", ".bashrc", "x.", "noext", "..a", "q.TAR.gz", "/my.dir/f", "my file.Md", "", "a.b/.c"]
    expected = [".gz", "", ".", "", ".a", ".gz", "", ".md", "", ""]
    assert column(spark, names, sf.extension) == expected


def test_stem_and_suffix_join_to_the_name(spark):
    names = ["a.tar.gz", ".bashrc", "x.", "noext", "..a", "Q.TAR.GZ", "é.ü"]
    assert column(spark, names, lambda v: F.concat(sf.stem(v), sf.suffix(v))) == names
    assert column(spark, names, sf.stem) == ["a.tar", ".bashrc", "x", "noext", ".", "Q.TAR", "é"]


def test_path_parts(spark):
    paths = ["/a/b/c.txt", "/a", "a", "a/b", "/é/ü x/z"]
    assert column(spark, paths, sf.basename) == ["c.txt", "a", "a", "b", "z"]
    assert column(spark, paths, sf.dirname) == ["/a/b", "/", ".", "a", "/é/ü x"]
    assert column(spark, paths, sf.parent_name) == ["b", "", "", "a", "ü x"]


def test_order_key_compares_per_element_and_reverses(spark):
    paths = ["/a.txt", "/a/z", "/a/b/c", "/a/b.x", "/a-b/c", "/a/é", "/"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    by_key = [r.p for r in rows.orderBy(sf.order_key("p")).collect()]
    assert by_key == [r.p for r in rows.orderBy(F.split("p", "/")).collect()]
    assert by_key.index("/a/z") < by_key.index("/a.txt")
    assert column(spark, paths, lambda v: sf.from_order_key(sf.order_key(v))) == paths


@pytest.mark.parametrize("dirty, clean", [
    ("  /a//b/./c/ ", "/a/b/c"), ("/a/../../b", "/b"), ("a/../..", ".."), ("../x/..", ".."), ("/", "/"), ("a/..", "."),
    ("   ", "/home"), (None, "/home"), ("./a/", "a"), ("../../a", "../../a"),
])
def test_normalize_path(spark, dirty, clean):
    assert column(spark, [dirty], lambda v: sf.normalize_path(v, "/home")) == [clean]


def test_listed_follows_the_walk_rules(spark):
    paths = {
        "/r/a.txt": True, "/r/.hidden": True, "/r/.d/a": False, "/r/x/node_modules/y/a": False, "/r/node_modules": True,
        "/r/_x/a": True, "/other/a": False, "/r2/a": False, "/r/x/.git/a": False,
    }
    assert column(spark, list(paths), lambda v: sf.listed(v, F.lit("/r"))) == list(paths.values())
    assert column(spark, ["/.r/a"], lambda v: sf.listed(v, F.lit("/.r"))) == [True]


def test_categories(spark):
    assert sf.extension_dim(spark).count() == 126
    counts = {r.category: r.extensions for r in sf.category_dim(spark).collect()}
    assert counts == {"Documents": 16, "Images": 18, "Videos": 12, "Audio": 12, "Installers": 11, "Archives": 12,
                      "Code": 45, "Others": 0}
    files = spark.createDataFrame([("/a/x.PDF",), ("/a/y.tar.gz",), ("/a/z",), ("/a/w.R",)], "file_path string")
    got = {r.file_path: r.category for r in sf.with_category(files).collect()}
    assert got == {"/a/x.PDF": "Documents", "/a/y.tar.gz": "Archives", "/a/z": "Others", "/a/w.R": "Code"}
    with pytest.raises(ValueError):
        sf.extensions_for_category(spark, "Nope")


def exact_bytes(size, places):
    unit = min(5, (size.bit_length() - 1) // 10) if size else 0
    scaled = (size * 10**places * 2 + (1 << 10 * unit)) // (2 << 10 * unit)  # half up
    text = str(scaled) if not places else f"{scaled // 10**places}.{scaled % 10**places:0{places}}".rstrip("0").rstrip(".")
    return f"{text} {('Bytes', 'KB', 'MB', 'GB', 'TB', 'PB')[unit]}"


def test_format_bytes(spark):
    cases = {
        0: "0 Bytes", 1: "1 Bytes", 1023: "1023 Bytes", 1024: "1 KB", 1025: "1 KB", 1536: "1.5 KB", 1048575: "1024 KB",
        1048576: "1 MB", 2**30: "1 GB", 2**40: "1 TB", 2**50: "1 PB", 2**60: "1024 PB", 1285: "1.25 KB", 102400: "100 KB",
    }
    assert column(spark, list(cases), sf.format_bytes, "bigint") == list(cases.values())
    assert column(spark, [1536, 1100], lambda v: format_bytes(v, 0), "bigint") == ["2 KB", "1 KB"]
    assert column(spark, [1100], lambda v: format_bytes(v, 3), "bigint") == ["1.074 KB"]
    sizes = [0, 1, 1025, 1234567, 2**30 - 1, 2**40 + 12345, 5 * 2**50 + 7, 2**62 + 3]
    for places in range(11):
        assert column(spark, sizes, lambda v: format_bytes(v, places), "bigint") == [exact_bytes(n, places) for n in sizes]


def test_percent_and_rounding(spark):
    rows = spark.createDataFrame([(1, 8), (1, 200), (3, 200), (0, 0)], "a bigint, b bigint")
    assert [r[0] for r in rows.select(sf.percent(F.col("a"), F.col("b"))).collect()] == [13, 1, 2, 0]


def expected_partial(data):
    if not data:
        return hashlib.sha256(b"empty").hexdigest()
    chunk = min(65536, len(data) // 2)
    tail = data[len(data) - chunk:] if len(data) > 2 * chunk else b""
    return hashlib.sha256(data[:chunk] + tail + str(len(data)).encode()).hexdigest()


def test_hashes(spark):
    contents = [b"", b"a", b"ab", b"abc", bytes(range(256)) * 600, b"x" * 131072, b"x" * 131073]
    assert column(spark, contents, sf.full_hash, "binary") == [hashlib.sha256(c).hexdigest() for c in contents]
    assert column(spark, contents, sf.partial_hash, "binary") == [expected_partial(c) for c in contents]


def test_action_id_is_short_and_repeatable(spark):
    first = column(spark, ["/a", "/b"], lambda v: sf.action_id(F.lit("t"), v))
    assert first == column(spark, ["/a", "/b"], lambda v: sf.action_id(F.lit("t"), v))
    assert len(set(first)) == 2 and all(len(i) == 8 for i in first)
