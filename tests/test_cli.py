from pyspark.sql import functions as F

import pytest
from arbora import cli
from arbora.functions.scalars import append_suffix, capitalise, contains_literal, escape_digest, safe_item, seeded_bits
from arbora.operators.classes import read_machine_records
from arbora.operators.parsing import value_or_fail
from tests.test_trees import GOLDEN


@pytest.fixture(scope="module")
def trees(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli") / "trees")
    rows = [(k, "d/u.1.0:x" if i % 2 else "d/v.2:y", i, i + 5, v[0]) for i, (k, v) in enumerate(GOLDEN.items())] + [("again", "d/u.1.0:x", 90, 99, GOLDEN["opt"][0]), ("bad", "d/w", 1, 2, "(")]
    spark.createDataFrame(rows, "def_name string, source string, loc_start int, loc_end int, ir string").write.parquet(path)
    return path


def test_lookup(trees, capsys, spark, tmp_path):
    assert cli.main(["lookup", trees]) == 0
    out = capsys.readouterr().out
    assert "matches 1 definition(s)" in out and "again" in out
    assert cli.main(["lookup", "--machine", trees]) == 0
    records = capsys.readouterr().out
    parsed = spark.range(1).select(F.explode(read_machine_records(F.lit(records))).alias("r")).select("r.*").collect()
    assert {(r.start, r.end, tuple(r.names)) for r in parsed} == {(91, 100, ("u.1.0:x:opt",)), (6, 11, ("u.1.0:x:again",))}
    assert cli.main(["database", str(tmp_path / "db"), trees]) == 0
    assert cli.main(["lookup", "--database", str(tmp_path / "db"), "--limit", "1", trees]) == 0
    capsys.readouterr()
    assert cli.main(["lookup", str(tmp_path / "missing")]) == 1
    assert capsys.readouterr().err


def test_corpus(trees, capsys, tmp_path):
    assert cli.main(["corpus", str(tmp_path / "f"), "4", trees]) == 0
    assert cli.main(["inspect", str(tmp_path / "f"), "2", "2", str(tmp_path / "h-")]) == 0
    out = capsys.readouterr().out
    assert "all: 9 definitions" in out and (tmp_path / "h-all.csv").is_dir()


def test_small_columns(spark):
    r = spark.range(1).select(
        append_suffix(F.lit("a"), "b"), append_suffix(F.lit(None).cast("string"), "b"), capitalise(F.lit("foo.cmt")), safe_item(F.array(F.lit(1)), 3), contains_literal(F.lit("a.b"), "."),
        contains_literal(F.lit("ab"), "."), escape_digest(F.unhex(F.lit("AB"))), seeded_bits(F.lit("x")) == seeded_bits(F.lit("x"))).first()
    assert list(r) == ["ab", None, "Foo.cmt", None, True, False, "ab", True]
    u = spark.createDataFrame([("a",), ("b",)], "key string")
    v = spark.createDataFrame([("a", "t")], "key string, sig string")
    assert value_or_fail(u.where("key = 'a'"), v, "key", "sig").first().sig == "t"
    with pytest.raises(Exception, match="not found: b"):
        value_or_fail(u, v, "key", "sig").collect()
