import __spark_entry__
from graphloom.plans import registry


def test_names():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert set(registry.QUERIES) <= set(known) and registry.FLAGSHIP in known
