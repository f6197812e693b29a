import pytest
from flowquery.plans.catalogue import ORACLE_SQL, QUERIES

from tests.compare import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_table_is_read_from_its_folder(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        QUERIES["topn_destinations"](spark, str(tmp_path)).count()
