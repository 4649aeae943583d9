"""Readouts of more keys than the public lengths hold: pages that equal the SQL, groups that have every key in its own."""

import duckdb
import pytest

from evenkeel.operators import shape
from evenkeel.plans import registry
from tests.oracle import _key, rows_of
from tests.test_histogram import single, updates

USERS = 66_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("many"))
    rows = spark.range(USERS + 1000).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts", f"id % {USERS} as user_id", "element_at(array('view', 'click', 'purchase'), cast(id % 3 as int) + 1) as event_type", "id / 100D as value", "'' as props"
    )
    rows.coalesce(2).write.parquet(f"{path}/events.parquet")
    return path


def expected(sql, folder):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    found = con.sql(sql)
    return sorted(found.project(", ".join(f'"{c}"' for c in sorted(found.columns))).fetchall(), key=_key)


PAGED = [
    "readout_padded",  # F2
    "readout_padded_pages",  # F2
    "grow_preserves",  # F1
    "readout_route_order",  # F3
    "readout_route_order_pages",  # F3
    "readout_route_order_consuming",  # F4
]


@pytest.mark.filterwarnings("ignore:.*pages of.*")
@pytest.mark.parametrize("name", PAGED)
def test_more_keys_than_slots_equals_sql(spark, folder, name):
    rows = registry.queries()[name](spark, folder)
    assert rows_of(rows) == expected(registry.oracle_sql()[name], folder)
    assert not name.endswith("_pages") or rows.filter("is_real").select("key").distinct().count() == USERS


def test_grown_readout_has_every_key(spark, folder):  # F3 of round 3
    rows = registry.queries()["grow_preserves"](spark, folder).orderBy("slot").select("slot", "is_real", "key").collect()
    assert [r.slot for r in rows] == list(range(2 * 65_600))
    assert [r.is_real for r in rows] == [True] * USERS + [False] * (len(rows) - USERS)
    assert [r.key for r in rows[:USERS]] == sorted(f"{i}".encode().ljust(16, b"\0").hex().upper() for i in range(USERS))


def test_pages_of_a_histogram(spark):
    h = single(spark, capacity=8, stash=1)
    h.append(updates(spark, [(f"k{i:02}", i) for i in range(64)]))
    length, want = h.readout_len, [f"k{i:02}".encode().ljust(16, b"\0") for i in range(64)]
    real = lambda df: [bytes(r.key) for r in df.filter("is_real").orderBy("slot").collect()]
    with pytest.raises(shape.CapacityExceeded):
        h.readout()
    n = -(-64 // length)
    assert n > 1
    with pytest.warns(UserWarning, match=f"64 keys take {n} pages"):
        found = [h.readout(p) for p in range(n + 1)]
    assert all(f.count() == length for f in found) and sum((real(f) for f in found), []) == want and real(found[n]) == []
    every = h.readout_pages()
    assert every.count() == n * length and sum((real(every.filter(f"page = {p}")) for p in range(n)), []) == want
    # F4
    drained = []
    with pytest.warns(UserWarning):
        while h.occupancy():
            drained += real(h.into_readout_tree_aware(paged=True))
    assert len(drained) == 64 and sorted(drained) == want


@pytest.mark.parametrize("name,group,of", [
    ("readout_subtree_chunks", "subtree", "(route >> 28)::int"),  # F5
    ("routed_quota_grid", "shard", "shard"),  # F6
])
def test_every_key_is_in_its_own_group(spark, folder, name, group, of):
    from evenkeel.plans.queries import ROUTED

    rows = registry.queries()[name](spark, folder)
    order = "route, tag >> 32, key" if group == "subtree" else "tag, key"
    want = expected(f"SELECT g, row_number() OVER (PARTITION BY g ORDER BY {order}) - 1 AS slot, key, packet_count, byte_sum FROM (SELECT *, {of} AS g FROM ({ROUTED}))", folder)
    got = rows.filter("is_real").selectExpr(f"{group} as g", "slot", "key", "packet_count", "byte_sum")
    assert rows_of(got) == sorted(((b, g, k, p, s) for b, g, k, p, s in want), key=_key) and len(want) == USERS
    lengths = [r["count"] for r in rows.groupBy(group).count().collect()]
    assert len(set(lengths)) == 1 and rows.select(group, "slot").distinct().count() == sum(lengths)
