"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from jobloom.plans.queries import ORACLE_SQL, QUERIES
from tests.compare import duck, shown

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert shown(QUERIES[name](spark, SF).toPandas()) == shown(duck(ORACLE_SQL[name], SF))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_attempts_equal_a_plain_loop(spark):
    rows = QUERIES["q27"](spark, SF).toPandas().set_index("event_id").result
    events = duck("SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS s FROM events ORDER BY ts, event_id", SF)
    live, checked = {}, 0
    for e in events.itertuples():
        challenge = "x" if e.event_id % 9 == 0 else "c"
        if e.event_type == "signup":
            live[e.user_id] = ["right", challenge, e.s + 6 * 86400, 0]
            continue
        now = live.get(e.user_id)
        if now is None or e.s >= now[2] or challenge != now[1]:
            want = "invalid"
        elif e.event_id % 4 == 0:
            want = "ok"
            del live[e.user_id]
        else:
            now[3] += 1
            want = "too_many_attempts" if now[3] == 5 else "invalid"
            if now[3] == 5:
                del live[e.user_id]
        assert rows[e.event_id] == want
        checked += 1
    assert checked == len(rows)


@pytest.mark.parametrize("name", ["q12", "q35"])
def test_no_nested_loop_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
