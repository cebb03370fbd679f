import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_cleaning import frame, person

from tidemark.operators import cleaning, fact, quality, sales
from tidemark.plans import catalogue
from tidemark.session import scratch_path, shared_folder
from tidemark.sources import readers, schemas, sinks

CSV = {
    "customers": "customer_id,customer_name,city,segment,signup_date,state,region\n"
    "C1,Ann,MUMBAI ,Consumer,2023-01-01,MH,West\nC2,Bo,Pune,Corporate,bad,MH,West\n",
    "products": "product_id,category,sub_category,product_name,unit_cost,unit_price\n"
    'P1,Toys,Balls,"Ball, red",6.0,10.0\nP2,Food,Tea,Tea,1.25,2.5\n',
    "orders": "order_id,customer_id,order_date,ship_mode,discount_pct,status\n"
    "O1,C1,2024-01-05,,10,delivered\nO1,C1,2024-01-05,NA,10,Delivered\nO2,C2,2024-02-05,Express,0,Returned\n",
    "order_items": "order_id,product_id,quantity\nO1,P1,2\nO1,P2,x\nO2,P2,4\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in CSV.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def test_csv_to_reports(spark, folder):
    raw = readers.read_sales(spark, folder)
    assert [f.dataType for f in raw.products.schema.fields] == [f.dataType for f in schemas.PRODUCTS.fields]
    assert raw.orders.where("ship_mode IS NULL").count() == 2
    table = fact.clean_and_join(raw)
    # one bad quantity costs one NULL, not the row
    assert table.count() == 3 and table.where("quantity IS NULL").count() == 1
    assert [tuple(r) for r in sales.category_profitability(table).select("category", "revenue").collect()] == [("Toys", 18.0), ("Food", None)]


def test_null_tokens_and_corrupt_rows(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("k,v\na,1\nNaN,2\nb,null\nc,3,extra\n")
    schema = "k string, v int"
    got = readers.read_csv(spark, str(path), spark.createDataFrame([], schema).schema, keep_corrupt=True).collect()
    assert [(r["k"], r["v"]) for r in got] == [("a", 1), (None, 2), ("b", None), ("c", 3)]
    assert [r[readers.CORRUPT] for r in got] == [None, None, None, "c,3,extra"]


def test_round_trip_through_csv_and_parquet(spark):
    people = frame(spark, [person(1), person(2, income=None, attrition="Yes")])
    for fmt in ("csv", "parquet"):
        path = scratch_path(spark, "people")
        assert sinks.save(people, path, fmt) == 2
        back = readers.read_employees(spark, path, fmt)
        assert back.schema.simpleString() == schemas.EMPLOYEES.simpleString()
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, people.collect()))
        assert sinks.save(people.limit(1), path, fmt) == 1  # replaces, does not append


def test_register_replaces(spark):
    readers.register({"t1": spark.range(3)})
    readers.register({"t1": spark.range(5)})
    assert spark.sql("SELECT count(*) FROM t1").first()[0] == 5


def test_star_export(spark, folder):
    raw = readers.read_sales(spark, folder)
    out = scratch_path(spark, "star")
    saved = sinks.star_export(fact.clean_and_join(raw), cleaning.clean_customers(raw.customers), cleaning.clean_products(raw.products), out)
    assert saved == {"sales_fact": 3, "dim_customers": 2, "dim_products": 2}
    back = spark.read.parquet(f"{out}/sales_fact")
    assert set(back.columns) == set(fact.COLUMNS)
    # reading one month opens one folder
    plan = back.where("order_month = '2024-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan


def test_hot_month_is_written_by_several_tasks(spark, conf):
    conf(spark__sql__adaptive__advisoryPartitionSizeInBytes="64k")
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, "2024-01").otherwise(F.concat(F.lit("2023-0"), (F.col("id") % 9 + 1).cast("string"))).alias("order_month"),
        F.md5(F.col("id").cast("string")).alias("customer_id"),
    )
    out = scratch_path(spark, "hot")
    assert sinks.save_fact(rows, out) == 200_000
    files = [f for f in os.listdir(out.removeprefix("file:") + "/order_month=2024-01") if f.endswith(".parquet")]
    assert len(files) > 1
    assert spark.read.parquet(out).count() == 200_000


def test_catalogue_saves_every_report(spark, folder):
    out = scratch_path(spark, "catalogue")
    people = frame(spark, [person(i, attrition="Yes" if i % 3 == 0 else "No", income=None if i == 4 else 10.0 * i) for i in range(1, 9)])
    got = {r["query"]: r["rows"] for r in catalogue.run_catalogue(spark, readers.read_sales(spark, folder), people, out).collect()}
    assert list(got) == [*catalogue.SALES_REPORTS, *catalogue.WORKFORCE_REPORTS]
    assert got["kpi_summary"] == 1 and got["attrition_overall"] == 1 and got["rfm_segment_summary"] == 1
    saved = spark.read.option("header", True).csv(f"{out}/workforce/attrition_overall")
    assert tuple(saved.first()) == ("8", "2", "25.0")


def test_whole_batch(spark, folder):
    from test_model import planted

    out = scratch_path(spark, "batch")
    people = frame(spark, planted(300))
    got = catalogue.run_all(spark, readers.read_sales(spark, folder), people, out)
    assert got["statistical_tests"] == 4 and got["model_metrics"] == 3 and got["high_risk_employees"] == 50
    assert got["cleaning_log"] == 3 and got["dim_products"] == 2 and got["odds_ratios"] == 9
    tests = spark.read.option("header", True).csv(f"{out}/workforce/statistical_tests")
    assert tests.columns == ["test", "statistic", "p_value", "significant_at_5pct"] and tests.count() == 4


def test_batch_leaves_nothing_but_its_results(spark, folder):
    from test_model import planted

    shared = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    out = scratch_path(spark, "clean")
    catalogue.run_all(spark, readers.read_sales(spark, folder), frame(spark, planted(300)), out)
    assert set(os.listdir(shared)) - before == {os.path.basename(out)}


def test_reports_read_the_fact_once(spark, folder, monkeypatch):
    """Every table that is written from another names its input files; one of them reads the fact."""
    from tidemark.operators import customers, totals

    read = {}

    def seen(module, name, label):
        real = getattr(module, name)

        def noted(df, *rest):
            read[label(rest)] = df.inputFiles()
            return real(df, *rest)

        monkeypatch.setattr(module, name, noted)

    seen(sinks, "save", lambda rest: os.path.basename(rest[0]))
    seen(customers, "cut", lambda rest: f"cut {len(read)}")
    seen(totals, "save_totals", lambda rest: "totals")
    out = scratch_path(spark, "once")
    every = catalogue.SALES_REPORTS | catalogue.SALES_TABLES
    catalogue.run_sales(spark, readers.read_sales(spark, folder), out, reports=every)
    assert set(every) <= set(read)
    assert [name for name, files in read.items() if any("/sales_fact/" in f for f in files)] == ["totals"]


def test_reports_of_other_kinds_read_the_fact(spark, folder):
    out = scratch_path(spark, "own")
    own = {"units": lambda f: f.groupBy("product_id").sum("quantity"), "kpi_summary": catalogue.SALES_REPORTS["kpi_summary"]}
    assert catalogue.run_sales(spark, readers.read_sales(spark, folder), out, reports=own) == {"units": 2, "kpi_summary": 1}


def test_views_answer_sql(spark, folder):
    people = frame(spark, [person(1), person(2, income=None, attrition="Yes")])
    readers.register(catalogue.views(readers.read_sales(spark, folder), people))
    top = spark.sql("SELECT category, sum(revenue) AS r FROM sales_fact WHERE status = 'Delivered' GROUP BY category ORDER BY r DESC").first()
    assert (top["category"], float(top["r"])) == ("Toys", 18.0)
    assert spark.sql("SELECT count(*) FROM employees WHERE monthly_income IS NOT NULL").first()[0] == 2
    assert spark.sql("SELECT count(*) FROM raw_orders").first()[0] - spark.sql("SELECT count(*) FROM orders_clean").first()[0] == 1


def test_saved_reports_equal_the_registered_queries(spark):
    from tidemark.functions.exprs import portable
    from tidemark.plans import registry
    from tidemark.sources import given_tables as given

    sf_dir, out = "/root/testdata/sf0.001", scratch_path(spark, "parity")
    raw, people = given.raw_sales(spark, sf_dir), given.raw_employees(spark, sf_dir)
    catalogue.run_catalogue(spark, raw, people, out, fmt="parquet")
    for part, names in (("sales", catalogue.SALES_REPORTS), ("workforce", catalogue.WORKFORCE_REPORTS)):
        for name in names:
            saved = portable(spark.read.parquet(f"{out}/{part}/{name}"))
            fresh = registry.queries()[name](spark, sf_dir)
            assert sorted(map(tuple, saved.collect()), key=str) == sorted(map(tuple, fresh.collect()), key=str), name


def _same_as_csv_module(spark, tmp_path, rows):
    import csv

    names = list(rows[0])
    path = tmp_path / "mine.csv"
    with open(path, "w", newline="") as out:
        writer = csv.DictWriter(out, names)
        writer.writeheader()
        writer.writerows(rows)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in sorted(names)])
    back = readers.read_csv(spark, str(path), schema, multi_line=True).collect()
    assert sorted(map(tuple, back)) == sorted(tuple(r[n] for n in sorted(names)) for r in rows)
    saved = tmp_path / "saved"
    sinks.save(spark.createDataFrame(rows).select(*names).coalesce(1), str(saved))
    (part,) = saved.glob("part-*")
    with open(part, newline="") as lines:
        assert sorted(map(str, csv.DictReader(lines))) == sorted(map(str, rows))


def test_quotes_commas_and_line_breaks_both_ways(spark, tmp_path):
    names = ['27" Monitor, black', 'say "hi"', "two\nlines", "plain", ', "', 'ends with "']
    _same_as_csv_module(spark, tmp_path, [{"b": n, "a": str(k), "c": "x"} for k, n in enumerate(names)])


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "products.csv"
    path.write_text("unit_price,product_id,extra,category,unit_cost,product_name,sub_category\n10.125,P1,?,Toys,6,Ball,Balls\n")
    row = readers.read_csv(spark, str(path), schemas.PRODUCTS).first()
    assert (str(row.unit_price), str(row.unit_cost), row.product_name) == ("10.1250", "6.0000", "Ball")
    path.write_text("product_id,category\nP1,Toys\n")
    with pytest.raises(readers.MissingColumns, match="unit_cost"):
        readers.read_csv(spark, str(path), schemas.PRODUCTS)


def test_lost_values_and_broken_rows_are_counted(spark, tmp_path):
    path = tmp_path / "order_items.csv"
    path.write_text("order_id,product_id,quantity\nO1,P1,3.0\nO1,P2,x\nO2,P2,2.5\nO2,P3,,surplus\nO3,P1,12345678901\n")
    rows = readers.read_csv(spark, str(path), schemas.ORDER_ITEMS).collect()
    assert [r.quantity for r in rows] == [3, None, None, None, None]
    found = {r.metric: r.value for r in readers.read_problems(spark, str(path), schemas.ORDER_ITEMS).collect()}
    assert found == {"rows": 5, "broken_rows": 1, "lost_quantity": 3}


def test_parquet_is_held_to_the_schema(spark, tmp_path):
    path = str(tmp_path / "order_items.parquet")
    spark.createDataFrame([("O1", "P1", 2.0), ("O2", "P1", 2.5)], "order_id string, product_id string, quantity double").write.parquet(path)
    table = readers.read_table(spark, path, schemas.ORDER_ITEMS, "parquet")
    assert table.schema.simpleString() == schemas.ORDER_ITEMS.simpleString()
    assert sorted(str(r.quantity) for r in table.collect()) == ["2", "None"]


@pytest.mark.parametrize(
    "table, line", [("order_items", "O9,P1,1\n"), ("orders", "O1,C2,2024-03-05,Express,0,Returned\n")]
)
def test_orphans_and_repeated_keys_stop_the_batch(spark, folder, tmp_path, table, line):
    (tmp_path / f"{table}.csv").write_text(CSV[table] + line)
    with pytest.raises(quality.DataQualityError):
        catalogue.run_sales(spark, readers.read_sales(spark, folder), scratch_path(spark, "gate"))
