import re

import __spark_entry__ as entry
from tablecare import llm


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in llm.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert all(isinstance(sql, str) for sql in llm.ORACLES.values()) and set(llm.ORACLES) <= set(llm.QUERIES)
    assert {*llm.QUERIES, "pipeline"} <= set(entry.queries())
    assert all(callable(query) for query in llm.QUERIES.values())
