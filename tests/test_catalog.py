import pytest

from cotejo.plans import catalog
from tests.compare import same
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_reconciled_states_follow_the_taxonomy(spark):
    m = catalog.QUERIES["q_nway_two_group_matrix"](spark, SF).toPandas()
    kind = m.key.astype(int) % 20
    assert set(kind[m.state == "only in ledger"]) == {16, 17}
    assert set(kind[m.state == "only in bank"]) == {18, 19}
    assert set(kind[m.has_diff]) == {13, 14}
    assert set(kind[m.in_all & ~m.has_diff]) == {*range(13), 15}


def test_key_suggestion_sees_through_the_disguise(spark):
    rows = catalog.QUERIES["q_key_suggestion"](spark, SF).orderBy("table").collect()
    assert [(r.column, r.form) for r in rows] == [("key", "digits"), ("ref", "digits")]
