"""Every registered query beside its SQL oracle at the smallest scale."""

import pytest

import __spark_entry__ as entry
import check_oracle

SF = "/root/testdata/sf0.001"
# The smallest raw tables hold no match for these; at the next scale they do.
MAY_BE_EMPTY = {"r_detect", "r_detect_pages", "t_scan", "secrets_by_source"}


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    ok, note = check_oracle.compare(spark, duck, SF, name)
    assert ok or (name in MAY_BE_EMPTY and note.startswith("EMPTY")), note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "severity", "findings"]
    assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
