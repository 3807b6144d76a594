import io

import pytest
from pyspark.sql import functions as F

from quillmesh.plans import progress

STEPS = "label string, ord int, started double, ended double, failed boolean, prompt_tokens long, cached_tokens long, completion_tokens long"


def test_progress(spark):
    steps = spark.createDataFrame([("b", 2, 1.0, 5.0, False, 10, None, 1), ("a", 1, 0.0, 3.0, True, None, None, 2), ("d", 4, 2.0, None, None, None, None, None), ("c", 3, 2.0, None, None, None, None, None)], STEPS)
    t = progress.totals(steps).first()
    assert (t["done"], t["failures"], t["wall_seconds"], t["average_seconds"], t["last_is_slower"]) == (2, 1, 5.0, 3.5, True)
    assert (t["prompt_tokens"], t["cached_tokens"], t["completion_tokens"]) == (10, None, 3)
    assert progress.in_flight(steps).first()["labels"] == "c, d"
    out = io.StringIO()
    progress.report(steps, 4, 2, out)
    assert out.getvalue().splitlines() == ["█" * 10 + "░" * 10 + " 2/4 c, d  ETA 0:03", "last b  0:04  10  —  1  1  0", "total  0:05  10  —  3  2  1"]
    one = steps.where("label = 'b'").withColumn("started", F.lit(3.0))
    assert progress.eta(one, 3, 2).first()["eta_seconds"] == 2.0
    first, rest = progress.warm_up(steps, "ord", "label")
    assert [r["label"] for r in first.collect()] == ["a"] and rest.count() == 3


def test_eta_of_a_run_past_its_plan(spark):
    """Rounds are counted below zero as above it; the line shows a dash."""
    steps = spark.createDataFrame([(str(k), k, 0.0, 2.0, False, None, None, None) for k in range(20)], STEPS)
    left = [progress.eta(steps, planned, 8).first()["eta_seconds"] for planned in (45, 36, 23, 20, 12, 2)]
    assert left == [8.0, 4.0, 2.0, 0.0, -2.0, -4.0]
    late = progress.eta(steps, 2, 8).select(progress.progress_line(F.lit(20), F.lit(2), F.lit(""), F.col("eta_seconds"))).first()[0]
    assert late.endswith(" 20/2  ETA —")


def test_warm_up_by_id(spark):
    """Steps of equal order, and steps without one, are each run once."""
    steps = spark.createDataFrame([("b", 1), ("a", 1), ("c", None), ("d", None)], "label string, ord int")
    first, rest = progress.warm_up(steps, "ord", "label")
    assert [r["label"] for r in first.collect()] == ["a"] and sorted(r["label"] for r in rest.collect()) == ["b", "c", "d"]
    first, rest = progress.warm_up(steps.where("ord is null"), "ord", "label")
    assert [r["label"] for r in first.collect()] == ["c"] and [r["label"] for r in rest.collect()] == ["d"]
    assert [x.count() for x in progress.warm_up(steps.limit(0), "ord", "label")] == [0, 0]


def test_arguments():
    progress.check_extract_arguments(True)
    progress.check_extract_arguments(False, out="x", pairs="p", max_pairs=3)
    for bad in ({"list_pairs": True, "out": "x"}, {"list_pairs": False}, {"list_pairs": False, "out": "x", "max_pairs": 3}, {"list_pairs": False, "out": "x", "pairs": "p", "max_pairs": 0}):
        with pytest.raises(ValueError):
            progress.check_extract_arguments(**bad)


def test_lines(spark):
    rows = spark.createDataFrame([(0, 4, "0001-0002", None), (3, 4, "0001-0002, " * 9, 75.4), (4, 4, "", 3725.0), (0, 0, "x", 0.0)], "done int, total int, label string, eta double")
    text = [r[0] for r in rows.select(progress.progress_line(F.col("done"), F.col("total"), F.col("label"), F.col("eta"))).collect()]
    assert text[0] == "░" * 20 + " 0/4 0001-0002  ETA —"
    assert text[1].startswith("█" * 15 + "░" * 5 + " 3/4 0001-0002, ") and text[1].endswith("…  ETA 1:15") and len(text[1]) == 79
    assert text[2] == "█" * 20 + " 4/4  ETA 1:02:05" and text[3] == "░" * 20 + " 0/0 x  ETA —"


def test_list_pairs_takes_nothing_else():
    for extra in ({"merge_into": "g"}, {"model": "m"}, {"work_dir": "w"}, {"resume": True}, {"concurrency": 2}, {"pairs": "p"}):
        with pytest.raises(ValueError):
            progress.check_extract_arguments(True, **extra)
    progress.check_extract_arguments(True, out=" ")
