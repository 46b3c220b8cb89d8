import os

import pytest
from parity import check

from prism.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE:
        check(spark, QUERIES[name], ORACLE[name], SF)
    else:
        QUERIES[name](spark, SF).collect()
