import __spark_entry__ as entry
from tarnwork.plans import registry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).count() == 5
