import resource

import numpy as np
import pytest

from lodestone.llm import near_dedup
from lodestone.llm.common import holding, local_rows


@pytest.mark.parametrize("rows", [[("a", 1.5), (None, 2.0)], []])
def test_rows_of_the_driver_need_no_python_workers(spark, rows):
    made = local_rows(spark, rows, "value string, target double")
    assert "LocalTableScan" in made._jdf.queryExecution().executedPlan().toString()
    assert made.schema.simpleString() == "struct<value:string,target:double>"
    assert [tuple(r) for r in made.collect()] == rows


def test_candidates_are_contracted_in_tasks_of_their_own(spark, monkeypatch):
    plans, real = [], near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda edges: (plans.append(edges._jdf.queryExecution().executedPlan().toString()), real(edges))[1])
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e f"), (3, "x y"), (4, "a b c d e f")], "doc_id bigint, text string")
    near_dedup.linked(docs).collect()
    assert plans
    assert not any("MapInArrow" in p for p in plans)


def test_freed_memory_is_held_for_the_next_step():
    def faults():
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        for _ in range(50):
            held = [np.ones(1 << 17) for _ in range(8)]
            del held
        return resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before

    with holding():
        faults()
        assert faults() < 50 * 8 * 256 / 10
