"""The cross-check again, on small tables made to be awkward.

Orphans on every side, a customer, a product and an order that dominate,
negative and zero quantities, missing prices, priorities, pay and customers,
heavily tied values, empty months, customers without orders.
"""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import connect, differences

from tidemark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
# every role keeps some pay here, so the quality check passes as well
CHECKED = [name for name in QUERIES if name in SQL]


def write(folder, name, schema, rows):
    columns = list(zip(*rows))
    table = pa.table({field: pa.array(columns[i], type=kind) for i, (field, kind) in enumerate(schema.items())})
    pq.write_table(table, f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def dirty(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("dirty"))
    rng = random.Random(11)
    i32, i64, f64, s, ts = pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.timestamp("us")
    write(folder, "region", {"r_regionkey": i32, "r_name": s}, [(i, n) for i, n in enumerate(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])])
    write(folder, "nation", {"n_nationkey": i32, "n_name": s, "n_regionkey": i32}, [(i, f"NATION_{i}", i % 5) for i in range(25)])
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    write(
        folder,
        "customer",
        {"c_custkey": i64, "c_name": s, "c_nationkey": i32, "c_acctbal": f64, "c_mktsegment": s},
        [
            (k, f"Customer#{k}", k % 25, None if rng.random() < 0.1 else rng.choice([100.0, 100.0, -5.25, round(rng.uniform(-900, 9000), 2)]),
             "BUILDING" if rng.random() < 0.4 else rng.choice(segments))
            for k in range(1, 601)
        ],
    )
    write(
        folder,
        "part",
        {"p_partkey": i64, "p_name": s, "p_brand": s, "p_type": s, "p_size": i32, "p_retailprice": f64},
        [
            (k, f"part {k % 9}", f"Brand#{k % 4}", rng.choice(["ECONOMY", "PROMO", "SMALL"]), k % 50,
             None if k % 31 == 0 else rng.choice([0.0, 9.99, 9.99, 1234.56, round(rng.uniform(1, 2000), 2)]))
            for k in range(1, 121)
        ],
    )
    first = datetime(1996, 2, 10)
    days = [first + timedelta(days=d, hours=rng.randrange(24)) for d in range(1200)]
    days = [d for d in days if not (d.year == 1997 and d.month in (3, 4, 5))]
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", None]
    write(
        folder,
        "orders",
        {"o_orderkey": i64, "o_custkey": i64, "o_orderstatus": s, "o_totalprice": f64, "o_orderdate": ts, "o_orderpriority": s},
        [
            (k, rng.choice([7, 7, rng.randrange(1, 590), rng.randrange(1, 590), rng.randrange(1, 590), 9999 if k % 10 == 0 else 12]),
             rng.choice("FFOP"), 1.0, rng.choice(days), rng.choice(priorities))
            for k in range(1, 3001)
        ],
    )
    write(
        folder,
        "lineitem",
        {
            "l_orderkey": i64, "l_partkey": i64, "l_suppkey": i64, "l_linenumber": i32, "l_quantity": f64,
            "l_extendedprice": f64, "l_discount": f64, "l_tax": f64, "l_returnflag": s, "l_linestatus": s, "l_shipdate": ts,
        },
        [
            (
                rng.choice([42, rng.randrange(1, 3050), rng.randrange(1, 3050)]), rng.choice([5, rng.randrange(1, 126), rng.randrange(1, 126)]),
                1, n % 7, rng.choice([0.0, 1.0, 2.0, 5.0, 5.0, -3.0, None]), 1.0, 0.0, 0.0, "N", "O", days[0],
            )
            for n in range(9000)
        ],
    )
    return folder


@pytest.fixture(scope="module")
def con(dirty):
    return connect(dirty)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, dirty, name):
    assert differences(QUERIES[name](spark, dirty), SQL[name], con) == []
