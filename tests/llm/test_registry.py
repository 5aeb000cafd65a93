import re

import __spark_entry__
from tidemill.llm import queries


def test_every_operator_is_registered_once():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and all(isinstance(v, str) for v in __spark_entry__.oracle_sql().values())
    assert all(callable(f) for f in __spark_entry__.queries().values()) and "pipeline" in __spark_entry__.queries()
