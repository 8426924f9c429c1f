"""Result files, checks that refuse, geometry, pair blocks with faulty rows, streams and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from strata.__main__ import main
from strata.functions import geometry, text
from strata.operators import blocks, quality, sets, similarity
from strata.plans import registry
from strata.sources import results
from strata.streaming import windows

SF = "/root/testdata/sf0.001"


def test_rewriting_one_table_keeps_the_others(spark, tmp_path):
    df, folder = spark.range(3), f"{tmp_path}/out"
    assert results.read_summary(spark, folder).count() == 0
    results.write_result(df, folder, "a", "x", "r1")
    results.write_result(df.limit(2), folder, "b", "x", "r1")
    results.write_result(df.limit(1), folder, "a", "y", "r2")
    assert sorted((r["table"], r["rows"], r["config"], r["revision"]) for r in results.read_summary(spark, folder).collect()) == [("a", 1, "y", "r2"), ("b", 2, "x", "r1")]


def test_frozen_and_cached_tables(spark, tmp_path):
    results.write_once(spark.range(2), f"{tmp_path}/f")
    with pytest.raises(FileExistsError):
        results.write_once(spark.range(5), f"{tmp_path}/f")
    made = []
    for _ in range(2):
        assert results.cached(spark, f"{tmp_path}/c", lambda: made.append(1) or spark.range(4)).count() == 4
    assert len(made) == 1


def test_tables_as_text(spark, tmp_path):
    df = spark.createDataFrame([(2, "a|b", None), (1, "<x>", 0.25)], "i int, s string, x double")
    assert results.to_markdown(df, "i") == "| i | s | x |\n| --- | --- | --- |\n| 1 | <x> | 0.25 |\n| 2 | a\\|b |  |"
    assert "<td>&lt;x&gt;</td>" in results.to_html("t & u", {"k": df}) and "<h1>t &amp; u</h1>" in results.to_html("t & u", {})
    (tmp_path / "c.yaml").write_text("data_root: data\nk: 3\n")
    assert results.load_config(f"{tmp_path}/c.yaml", {"data_root": "/r"}) == {"data_root": "/r/data", "k": 3}


def test_checks_refuse(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    assert quality.checked_join(left, right, "k").count() == 3
    with pytest.raises(quality.DataFault, match="left"):
        quality.checked_join(left, right, "k", "one_to_one")
    found = quality.faults(left, {"v": F.col("v") != "c"}, [["k"]])
    assert {(r["rule"], r["n"]) for r in found.collect()} == {("v", 1), ("unique k", 2)}
    with pytest.raises(quality.DataFault, match="unique k 2"):
        quality.refuse(found, "left")
    quality.refuse(quality.faults(right, {"w": F.col("w") > 0}, [["k"]]), "right")


def test_parse_model_name(spark):
    from strata.operators.labels import parse_model_name

    names = ["Audi A4 Sedan 2012", "Land Rover LR2 SUV 2012", "Audi A4", "Audi A4 12", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(parse_model_name(F.col("n"), ["Land Rover"]).alias("m"))
    got = [r["m"] and tuple(r["m"]) for r in df.collect()]
    assert got == [("Audi", "A4 Sedan", 2012), ("Land Rover", "LR2 SUV", 2012), None, None, None]


def test_text_functions(spark):
    df = spark.createDataFrame([("a&<\"'>",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(text.html_escape(F.col("s"))).collect()] == ["a&amp;&lt;&quot;&#x27;&gt;", "", None]
    assert [r[0] for r in df.select(text.cut_end(F.col("s"), 4)).collect()] == ["a&", "", None]


def test_windows_hold_their_box(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(300):
        w, h = (int(x) for x in rng.integers(5, 60, 2))
        x1, y1 = int(rng.integers(0, w - 1)), int(rng.integers(0, h - 1))
        rows.append((w, h, x1, y1, int(rng.integers(x1 + 1, w + 1)), int(rng.integers(y1 + 1, h + 1))))
    df = spark.createDataFrame(rows, "w int, h int, x1 int, y1 int, x2 int, y2 int").select("w", "h", F.struct("x1", "y1", "x2", "y2").alias("box"))
    df = df.withColumn("side", geometry.window_side(F.col("box"), F.col("w"), F.col("h")))
    df = df.withColumn("across", geometry.placed(F.col("box.x1"), F.col("box.x2"), F.col("side"), F.col("w"))).withColumn("down", geometry.placed(F.col("box.y1"), F.col("box.y2"), F.col("side"), F.col("h")))
    for r in df.withColumn("pad", geometry.pad_fraction(F.col("side"), F.col("across"), F.col("down"))).collect():
        for axis, low, high, length in ((r["across"], r["box"]["x1"], r["box"]["x2"], r["w"]), (r["down"], r["box"]["y1"], r["box"]["y2"], r["h"])):
            assert axis["start"] <= low and high <= axis["start"] + r["side"]
            if r["side"] <= length:
                assert 0 <= axis["start"] and axis["start"] + r["side"] <= length and axis["pad_low"] == axis["pad_high"] == 0
            else:
                assert axis["pad_low"] + axis["pad_high"] == r["side"] - length and axis["pad_high"] - axis["pad_low"] in (0, 1) and axis["start"] == -axis["pad_low"]
        longer = max(r["box"]["x2"] - r["box"]["x1"], r["box"]["y2"] - r["box"]["y1"])
        assert (r["pad"] > 0) == (r["side"] > min(r["w"], r["h"])) and r["side"] <= max(min(r["w"], r["h"]), round(1.02 * longer), longer)


def test_blocks_leave_faulty_rows_out(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, None, 1), (3, [], 1), (4, [None, 1.0], 1), (5, [1.0, 0.0, 0.0], 1), (6, [1.0, 0.0], None), (7, [0.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g long")
    assert sorted((r["a"], r["b"]) for r in similarity.pairs_over(df, df, 0.5).collect()) == [(0, 1), (1, 0)]
    assert {r["a"] for r in similarity.top_k(df.drop("g"), df.drop("g"), 1).collect()} == {0, 1, 6}
    assert similarity.top_k(df.limit(0), df, 3).count() == similarity.top_k(df, df.limit(0), 3).count() == 0


def test_blocks_meet_across_buckets(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3))
    df = spark.createDataFrame([(i, list(map(float, v)), i % 2) for i, v in enumerate(x)], "id long, v array<double>, g long").repartition(3)
    count = lambda own, other: __import__("pandas").DataFrame({"n": [len(own.ids) * len(other.ids)]})
    assert blocks.block_pairs(df, df, count, "n long", block=4).agg(F.sum("n")).first()[0] == 2 * 45 * 45
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {r["id"]: r["r"] for r in sets.radii(df.drop("g"), 4, block=7).collect()}
    assert all(np.isclose(got[i], np.sort(d[i])[4]) for i in range(90))


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    events = registry.table(spark, SF, "events")
    events.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = windows.window_counts(windows.read_events(spark, f"{tmp_path}/in"), "1 hour", "3650 days")
    windows.run_all(stream, f"{tmp_path}/out", f"{tmp_path}/state", "append")
    with_late = windows.window_counts(windows.read_events(spark, f"{tmp_path}/in"), "1 hour", "3650 days")
    query = with_late.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r["start"], r["event_type"], r["n"])
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, windows.window_counts(events, "1 hour", "1 hour").collect()))


def test_command_line(spark, tmp_path, capsys):
    main(["list"])
    assert "geometry_ratios" in capsys.readouterr().out
    main(["run", "group_count_labels", "--data", SF, "--out", f"{tmp_path}/o", "--revision", "r"])
    assert results.read_summary(spark, f"{tmp_path}/o").first()["table"] == "group_count_labels"
    for wrong in (["run", "group_count_labels", "--data", SF, "--out", f"{tmp_path}/o"], ["run", "nothing", "--data", SF, "--out", "x"], ["show"]):
        with pytest.raises(SystemExit):
            main(wrong)
