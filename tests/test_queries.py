import pytest
from conftest import SF

import __spark_entry__ as entry
from quillmark import queries

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, duck, same):
    assert same(queries.queries()[name](spark, SF), ORACLES[name], duck) > 0


@pytest.mark.parametrize("name", sorted(set(queries.CATALOGUE) - set(ORACLES)))
def test_runs(name, spark):
    assert queries.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 15
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_facets_reach_the_scan(spark, capsys):
    queries.facet_scan(spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(lang,en)" in plan and "source" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_scored_texts_meet_one_reading_of_the_documents(spark, capsys):
    """What the profile measures is read from the documents once and written, however often it is measured."""
    queries.score_texts(spark, SF).explain("formatted")
    assert capsys.readouterr().out.split("== Physical Plan ==")[1].count(f"{SF}/documents.parquet") == 1
