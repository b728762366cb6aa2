"""Text sources and sinks, settings."""

import pytest
from pyspark.sql import functions as F

from knotwork.sources import config, files
from knotwork.streaming.edges import edge_stream, running_degrees

GR = "c example\np cep 6 7\n1 2\n1 3\n2 3\nc in between\n3 4\n4 5\n4 6\n5 6\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_graph_round_trip(spark, tmp_path):
    nodes, edges = files.read_gr(spark, write(tmp_path / "a.gr", GR))
    assert nodes.count() == 6 and edges.count() == 7 and edges.where("u = 2 and v = 3").count() == 1
    files.write_gr(nodes, edges, str(tmp_path / "out"))
    n2, e2 = files.read_gr(spark, str(tmp_path / "out"))
    assert n2.count() == 6 and e2.exceptAll(edges).count() == 0


@pytest.mark.parametrize("text", ["1 2\n", "p cep 2 1\n1\n", "p cep 2 1\n1 3\n", "p cep 2 1\nx y\n"])
def test_bad_graphs(spark, tmp_path, text):
    with pytest.raises(files.BadFile):
        files.read_gr(spark, write(tmp_path / "b.gr", text))


def test_solution_round_trip(spark, tmp_path):
    a = spark.createDataFrame([(i, i // 3) for i in range(6)], "node long, cluster long")
    files.write_solution(a, str(tmp_path / "s"))
    assert files.read_solution(spark, str(tmp_path / "s")).exceptAll(a).count() == 0
    with pytest.raises(ValueError):
        files.write_solution(a, "")


def test_places_and_parts(spark, tmp_path):
    xy = files.read_coordinates(spark, write(tmp_path / "xy", "% c\n1 0.5 2\n9 1 1\n"), spark.range(3))
    assert sorted(map(tuple, xy.collect())) == [(0, 0.5, 2.0), (1, 0.0, 0.0), (2, 0.0, 0.0), (8, 1.0, 1.0)]
    p = files.read_partition(spark, write(tmp_path / "p", "2 5\n"), spark.range(3))
    assert sorted(map(tuple, p.collect())) == [(0, 0), (1, 5), (2, 0)]


def test_edit_and_result_lines(six, spark, tmp_path):
    from knotwork.operators.cost import edit_list

    a = spark.createDataFrame([(i, i // 3) for i in range(6)], "node long, cluster long")
    files.write_edits(edit_list(six, a), str(tmp_path / "e"))
    assert [r.value for r in spark.read.text(str(tmp_path / "e")).collect()] == ["3 4"]
    assert "numEdges=14" in files.result_line("g", 6, 7, 1, 0.5, 0, 1) and files.csv_line("g", 1, 2).startswith("g,1,2")
    places = spark.range(6).select(F.col("id").alias("node"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    page = files.ipe_page(files.drawing_primitives(six, a, places))
    assert page.count("<path") == 7 and page.count("<use") == 6


def test_numbered_graphs():
    assert files.numbered_graph("/d", 7) == "/d/exact007.gr"
    with pytest.raises(ValueError):
        files.numbered_graph("/d", 8)


def test_settings(tmp_path):
    ini = write(tmp_path / "c.ini", "# c\nr-evo-pool-size=4\nunknown=1\nr-lp-node-ordering = random # x\n")
    s = config.parse(["--config", ini, "--r-evo-pool-size", "2", "--seed", "5"])
    assert (s.pool, s.lp_order, s.seed) == (2, "random", 5)
    assert config.Settings.fast().repetitions == 1 and s.for_size(100, 10).local_steps == 10_000
    with pytest.raises(ValueError):
        config.Settings(lp_order="sideways")


def test_edge_stream(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 4)], "u long, v long").write.parquet(str(tmp_path / "in"))
    q = running_degrees(edge_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("deg").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("deg").collect())) == [(1, 1), (2, 2), (3, 1)]


def test_edge_stream_with_bounded_state(spark, tmp_path):
    from knotwork.streaming.edges import degrees_by_window

    rows = [(1, 2, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:05:00"), (2, 3, "2024-01-01 02:00:00"), (1, 2, "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "u long, v long, at string").withColumn("at", F.col("at").cast("timestamp"))
    for k in range(2):
        df.where(f"(at < '2024-01-02') = {k == 0}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = degrees_by_window(edge_stream(spark, str(tmp_path / "in"), "1 hour"), "1 day")
    q = stream.writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.node, r.degree) for r in spark.table("windows").where("start < '2024-01-02'").collect()} <= {(1, 1), (2, 2), (3, 1)}


@pytest.mark.parametrize("kind", ["exact", "heuristic"])
def test_command_line(spark, tmp_path, capsys, kind):
    from knotwork.__main__ import main

    path = write(tmp_path / "g.gr", GR)
    args = [kind, "--graph", path, "--num-repititions", "1", "--write-to-file", "true", "--csv", "true", "--print-result-line", "true"]
    assert main(args, spark) == 1
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "3 4" and "modifications=1" in out[1] and out[2].startswith(f"{path},1,")
    assert files.read_solution(spark, path + ".sol").count() == 6
    if kind == "heuristic":
        assert main([*args, "--read-from-file", "true", "--r-evo-steps", "3"], spark) == 1
        capsys.readouterr()
    with pytest.raises(SystemExit):
        main(["other"], spark)
