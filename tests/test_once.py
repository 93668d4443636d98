"""Queries that read a table once do not store it, and the parts of the dataset are the dataset's."""

import os

import __spark_entry__ as entry
from fairline.catalog import models
from fairline.catalog.dataset import mirrored
from fairline.catalog.splits import assignment
from fairline.operators import validation
from fairline.session import shared_folder


def test_tables_of_one_reader_are_not_stored(spark, sf, tmp_path):
    source = f"{tmp_path}/tables"  # a source of its own, so no stage table of another test serves it
    os.symlink(sf, source)

    def stored(work) -> set[str]:
        top = f"{shared_folder(spark)}/fairline/{spark.sparkContext.applicationId}"
        before = set(os.listdir(top)) if os.path.isdir(top) else set()
        work()
        return {x.rsplit("-", 1)[0] for x in set(os.listdir(top)) - before}

    run = lambda name: entry.queries()[name](spark, source).collect()
    assert "rated" not in stored(lambda: run("W28_decayed_ratings"))
    assert "features" not in stored(lambda: run("T1_top_teams"))

    parts = []
    assert not {"dataset", "dev", "holdout"} & stored(lambda: parts.extend(models._parts(spark, source)))
    whole = mirrored(spark, source)
    shown = lambda df: sorted(df.select("gameid", "side", "opp_wr_L5", "diff_wr_L10").collect())
    for got, want in zip(parts[:2], validation.split_rows(whole, assignment(spark, source))):
        assert got.columns == want.columns and shown(got) == shown(want)
