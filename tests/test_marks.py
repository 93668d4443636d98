"""Counting what is known on marks gives what counting on values gives, and stores no feature table."""

import os

import __spark_entry__ as entry
from pyspark.sql import functions as F

from fairline.operators import dataset, validation
from fairline.session import shared_folder


def test_marks_know_what_values_know(spark):
    nan = float("nan")
    rows = [("g1", "Blue", "a", "b", 1.5, None, 1), ("g1", "Red", "b", "a", nan, 2.0, 0), ("g2", "Blue", "a", "c", None, 3.0, 1),
            ("g2", "Red", "c", "a", 4.0, None, 0), ("g3", "Blue", "a", "b", 1.0, 1.0, 1), ("g4", "Blue", None, "b", 1.0, 1.0, 1), ("g4", "Red", "b", None, 1.0, None, 0)]
    df = spark.createDataFrame(rows, "gameid string, side string, teamid string, opp_teamid string, wr_L5 double, h2h_wr double, is_blue int")
    whole, marks = dataset.mirror_dataset(df), dataset.mirror_dataset(dataset.known_marks(df))
    assert marks.columns == whole.columns and dataset.model_columns(marks) == dataset.model_columns(whole)
    num, _ = dataset.model_columns(whole)
    assert {"opp_wr_L5", "diff_h2h_wr"} <= set(num)
    for counted in (lambda d: dataset.completeness(d, num), lambda d: validation.leak_audit(d, num)):
        assert sorted(counted(marks).collect(), key=str) == sorted(counted(whole).collect(), key=str)
    assert marks.select(F.max(F.greatest(*num))).first()[0] == 0


def test_counting_queries_store_no_features(spark, sf, tmp_path):
    source = f"{tmp_path}/tables"  # no stage table of another test serves it
    os.symlink(sf, source)
    top = f"{shared_folder(spark)}/fairline/{spark.sparkContext.applicationId}"
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    for name in ("V5_leak_audit", "P1_P3_feature_columns"):
        assert len(entry.queries()[name](spark, source).collect()) > 250
    assert "features" not in {x.rsplit("-", 1)[0] for x in set(os.listdir(top)) - before}
