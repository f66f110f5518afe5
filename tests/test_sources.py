import pytest

from lonepoint import cli
from lonepoint.operators import sets
from lonepoint.sources import points as source


def lines(tmp_path, text, name="points.txt"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_points_follow_the_lines(spark, tmp_path):
    path = lines(tmp_path, "".join(f"{i},{i + 0.5},c{i}\n" for i in range(500)))
    got = sorted((r.id, list(r["values"])) for r in source.read_csv(spark, path, contains_class=True).collect())
    assert got == [(i + 1, [float(i), i + 0.5]) for i in range(500)]


def test_trailing_empty_fields_vanish(spark, tmp_path):
    assert [list(r["values"]) for r in source.read_csv(spark, lines(tmp_path, "1,2,,\n3,4\n")).orderBy("id").collect()] == [[1.0, 2.0], [3.0, 4.0]]


@pytest.mark.parametrize("text", ["1,x\n", "1,2\n3\n", "1,NaN\n", "1,,2\n"])
def test_bad_lines(spark, tmp_path, text):
    with pytest.raises(Exception):  # noqa: B017
        source.read_csv(spark, lines(tmp_path, text)).collect()


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        source.read_csv(spark, str(tmp_path / "none.txt"))


def test_dimensions(spark):
    empty = spark.createDataFrame([], "id long, values array<double>")
    assert source.dimensions(empty) == -1


def test_ranks_are_dense_over_partitions(spark):
    df = spark.range(1000).selectExpr("1000 - id AS x").repartition(7)
    assert sorted((r.x, r.id) for r in source.ranked(df, "x").collect()) == [(i, i) for i in range(1, 1001)]


def test_ids_and_accuracy(spark, tmp_path):
    base = source.read_ids(spark, lines(tmp_path, "\n".join(map(str, range(1, 11))), "base"))
    test = source.read_ids(spark, lines(tmp_path, "1\n2\n3\n6\n7\n8\n10", "test"))
    r = sets.accuracy(base, test).head()
    assert (r.n_base, r.n_test, r.n_common, r.recall, r.precision) == (10, 7, 7, 70.0, 100.0)
    assert sorted(x.id for x in sets.common(base, test).collect()) == [1, 2, 3, 6, 7, 8, 10]
    assert sets.accuracy(base.limit(0), test).head().recall is None
    with pytest.raises(Exception, match="not an id"):
        source.read_ids(spark, lines(tmp_path, "1\n\n2", "blank")).collect()


@pytest.mark.parametrize("algorithm", cli.ALGORITHMS)
def test_command_line(spark, tmp_path, capsys, algorithm):
    path = lines(tmp_path, "0.0\n10.0\n0.5\n20.0\n10.4\n30.0\n")
    out = str(tmp_path / "out")
    assert cli.main(["detect", "--algorithm", algorithm, "--W", "4", "--slide", "2", "--R", "1.0", "--k", "1", "--datafile", path, "--outliersFile", out, "--exactLifecycle"], spark) == 0
    said = capsys.readouterr().out
    assert "points: 6" in said and "only outlier: 4 (66.7 %)" in said
    if algorithm in ("MCOD", "ApproxMCOD"):
        assert sorted(r.id for r in source.read_ids(spark, out).collect()) == [2, 4, 5, 6]
        base = lines(tmp_path, "2\n4\n5\n6\n", "base")
        assert cli.main(["compare", "--baselineFile", base, "--testFile", out], spark) == 0
        assert "recall: 100.00 %" in capsys.readouterr().out


@pytest.mark.parametrize("args", [["detect"], ["detect", "--algorithm", "x"], ["compare", "--baselineFile", "a"]])
def test_bad_arguments(args):
    with pytest.raises(SystemExit):
        cli.parser().parse_args(args)
