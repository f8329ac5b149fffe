import pytest
from oracle import same

from sketchwell import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, data, name):
    same(spark, name, plans.QUERIES[name], plans.ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_forms_that_depend_on_order_give_rows(spark, data, name):
    assert plans.QUERIES[name](spark, data).count() > 0


def test_every_command_has_a_query():
    count = {"B": 11, "C": 14, "M": 6, "T": 7, "D": 14}
    for letter, n in count.items():
        assert {f"{letter}{i}" for i in range(1, n + 1)} <= {q.split("_")[0] for q in plans.QUERIES}
