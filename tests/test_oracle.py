"""Every query of the library with SQL gives the rows of that SQL; the others run and give rows."""

from __future__ import annotations

import pytest

from scriptoria.plans import library
from tests.compare import same_rows

QUERIES, SQL = library.queries(), library.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    frame = QUERIES[name](spark, sf_dir)
    if name in SQL:
        same_rows(frame, duck, SQL[name])
    else:
        assert frame.limit(1).count() == 1
