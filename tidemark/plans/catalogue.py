"""The report catalogue: every named report, run over tables that are written once."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import calendar, cleaning, customers, fact, model, quality, sales, stats, totals, workforce
from tidemark.session import scratch, scratch_path
from tidemark.sources import sinks
from tidemark.sources.readers import RawSales

SALES_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "kpi_summary": sales.kpi_summary,
    "monthly_revenue_mom": sales.monthly_revenue_mom,
    "category_profitability": sales.category_profitability,
    "top_products_per_category": sales.top_products_per_category,
    "regional_performance": sales.regional_performance,
    "discount_impact": sales.discount_impact,
    "return_rate_by_category": sales.return_rate_by_category,
    "customer_rfm": customers.customer_rfm,
    "rfm_segment_summary": lambda f: customers.rfm_segment_summary(customers.customer_rfm(f)),
    "pareto_customers": customers.pareto_customers,
    "cohort_retention": customers.cohort_retention,
}

#: Saved by the whole batch besides: the tables behind workbooks and dashboards.
SALES_TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sales_cube_monthly": sales.sales_cube_monthly,
    "summary_blocks": lambda f: sales.summary_blocks(sales.sales_cube_monthly(f)),
    "category_by_year": lambda f: sales.category_by_year(sales.sales_cube_monthly(f)),
    "cohort_matrix": lambda f: customers.cohort_matrix(customers.cohort_retention(f)),
    "return_rate_overall": sales.return_rate_overall,
    "top_customers": sales.top_customers,
    "date_dim": calendar.date_dim_for,
    "revenue_yoy": calendar.revenue_yoy,
    "revenue_mom_calendar": calendar.revenue_mom_calendar,
    "revenue_ytd": calendar.revenue_ytd,
}

#: The named sales reports that look at single products; all others need no more than orders by category.
BY_PRODUCT = ("top_products_per_category",)

WORKFORCE_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "attrition_overall": workforce.attrition_overall,
    "attrition_by_department": workforce.attrition_by_department,
    "attrition_by_overtime": workforce.attrition_by_overtime,
    "attrition_by_tenure_band": workforce.attrition_by_tenure_band,
    "attrition_by_income_quartile": workforce.attrition_by_income_quartile,
    "attrition_by_satisfaction": workforce.attrition_by_satisfaction,
    "attrition_by_promotion_gap": workforce.attrition_by_promotion_gap,
    "attrition_cost_by_department": workforce.attrition_cost_by_department,
    "rule_based_risk_flags": workforce.rule_based_risk_flags,
}


def views(raw: RawSales, raw_employees: DataFrame) -> dict[str, DataFrame]:
    """Raw, clean and joined tables by name, for ``readers.register`` and ``spark.sql``."""
    return {
        "raw_customers": raw.customers,
        "raw_products": raw.products,
        "raw_orders": raw.orders,
        "raw_order_items": raw.order_items,
        "raw_employees": raw_employees,
        "customers_clean": cleaning.clean_customers(raw.customers),
        "products_clean": cleaning.clean_products(raw.products),
        "orders_clean": cleaning.clean_orders(raw.orders),
        "order_items_clean": cleaning.clean_order_items(raw.order_items),
        "sales_fact": fact.clean_and_join(raw),
        "employees": cleaning.clean_employees(raw_employees),
    }


def _side_by_side(pool: ThreadPoolExecutor, run: Callable[[str], int], names: list[str]) -> dict[str, int]:
    """``run`` for every name in the pool, each in a copy of this thread's context (its scratch folder)."""
    jobs = {name: pool.submit(copy_context().run, run, name) for name in names}
    return {name: job.result() for name, job in jobs.items()}


def save_reports(
    table: DataFrame | Mapping[str, DataFrame],
    reports: Mapping[str, Callable[[DataFrame], DataFrame]],
    folder: str,
    fmt: str = "csv",
    at_once: int = 8,
) -> dict[str, int]:
    """Save each report below ``folder`` under its name; returns rows per report.

    All reports read ``table``, or each the one that ``table`` has under its name.
    Reports do not depend on each other, so a few run at the same time and
    share the cluster. RFM is computed once and read back for its roll-up.
    """
    source = table if isinstance(table, Mapping) else dict.fromkeys(reports, table)
    names = [n for n in reports if n != "rfm_segment_summary"]
    with ThreadPoolExecutor(at_once) as pool:
        saved = _side_by_side(pool, lambda n: sinks.save(reports[n](source[n]), f"{folder}/{n}", fmt), names)
    if "rfm_segment_summary" in reports:
        base = source["rfm_segment_summary"]
        rfm = customers.customer_rfm(base) if "customer_rfm" not in saved else _read_rfm(base.sparkSession, folder, fmt)
        saved["rfm_segment_summary"] = sinks.save(
            customers.rfm_segment_summary(rfm), f"{folder}/rfm_segment_summary", fmt
        )
    return {n: saved[n] for n in reports}


def _read_rfm(spark: SparkSession, folder: str, fmt: str) -> DataFrame:
    path = f"{folder}/customer_rfm"
    if fmt == "csv":
        columns = (
            "customer_id string, recency_days int, frequency bigint, monetary double, "
            "r_score int, f_score int, m_score int, segment string"
        )
        return spark.read.schema(columns).option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def report_sources(
    sold: DataFrame, reports: Mapping[str, Callable[[DataFrame], DataFrame]]
) -> dict[str, DataFrame]:
    """The table that each report reads: the shared totals for the named ones, the fact for any other.

    The totals are written once, so the fact is read once for all named reports.
    """
    named = SALES_REPORTS | SALES_TABLES
    own = {n for n, report in reports.items() if named.get(n) is not report}
    if own == set(reports):
        return dict.fromkeys(reports, sold)
    orders, products = totals.save_totals(sold, scratch_path(sold.sparkSession, "totals"))
    return {n: sold if n in own else products if n in BY_PRODUCT else orders for n in reports}


def run_sales(
    spark: SparkSession,
    raw: RawSales,
    folder: str,
    fmt: str = "csv",
    reports: Mapping[str, Callable[[DataFrame], DataFrame]] = SALES_REPORTS,
    strict: bool = True,
) -> dict[str, int]:
    """Clean, join and price once into Parquet, add up once what reports share, then run the sales reports.

    ``strict`` stops the run where an order key repeats or a line has no order.
    """
    orders = cleaning.clean_orders(raw.orders)
    if strict:
        quality.require_none(
            duplicate_keys=quality.duplicate_keys(orders, "order_id"),
            orphans=quality.orphans(cleaning.clean_order_items(raw.order_items), orders, "order_id"),
        )
    with scratch(spark):
        joined = fact.clean_and_join(raw)
        sinks.save_fact(joined, f"{folder}/sales_fact")
        sold = spark.read.schema(joined.schema).parquet(f"{folder}/sales_fact")
        return save_reports(report_sources(sold, reports), reports, folder, fmt)


def run_workforce(spark: SparkSession, raw_employees: DataFrame, folder: str, fmt: str = "csv") -> dict[str, int]:
    """Clean once into Parquet, check the table, then run the workforce reports over it."""
    with scratch(spark):
        sinks.save(cleaning.clean_employees(raw_employees), f"{folder}/employees_clean", "parquet")
        employees = spark.read.parquet(f"{folder}/employees_clean")
        quality.require_valid(employees, "employee_id")
        return save_reports(employees, WORKFORCE_REPORTS, folder, fmt)


def run_tests_and_model(employees: DataFrame, folder: str, fmt: str = "csv") -> dict[str, int]:
    """Save the hypothesis tests and the model's tables; the model is fitted once for all of them."""
    ready, fitted = model.train(employees)
    tables = {
        "statistical_tests": stats.statistical_tests(ready),
        "model_drivers": model.drivers_of(ready, fitted),
        "model_metrics": model.metrics_of(ready, fitted),
        "model_report": model.report_of(ready, fitted),
        "high_risk_employees": model.risk_list_of(ready, fitted),
        "odds_ratios": model.odds_ratios_wald(ready),
    }
    return {name: sinks.save(df, f"{folder}/{name}", fmt) for name, df in tables.items()}


def run_all(spark: SparkSession, raw: RawSales, raw_employees: DataFrame, folder: str, fmt: str = "csv") -> dict[str, int]:
    """The whole batch: star export, both catalogues, cleaning log, tests and model.

    Tables between its passes are gone when it returns.
    """
    with scratch(spark):
        star = {
            "dim_customers": sinks.save(cleaning.clean_customers(raw.customers), f"{folder}/sales/dim_customers", fmt),
            "dim_products": sinks.save(cleaning.clean_products(raw.products), f"{folder}/sales/dim_products", fmt),
        }
        counts = run_sales(spark, raw, f"{folder}/sales", fmt, SALES_REPORTS | SALES_TABLES)
        counts["dedup_report"] = sinks.save(
            cleaning.dedup_report(cleaning.standard_orders(raw.orders)), f"{folder}/sales/dedup_report", fmt
        )
        log = {"cleaning_log": sinks.save(cleaning.cleaning_log(raw_employees), f"{folder}/workforce/cleaning_log", fmt)}
        people = run_workforce(spark, raw_employees, f"{folder}/workforce", fmt)
        employees = spark.read.parquet(f"{folder}/workforce/employees_clean")
        return star | counts | log | people | run_tests_and_model(employees, f"{folder}/workforce", fmt)


def run_catalogue(
    spark: SparkSession, raw: RawSales, raw_employees: DataFrame, folder: str, fmt: str = "csv", strict: bool = True
) -> DataFrame:
    """Run both catalogues side by side; (query, rows) for every saved report."""
    with ThreadPoolExecutor(2) as pool:
        sold = pool.submit(run_sales, spark, raw, f"{folder}/sales", fmt, SALES_REPORTS, strict)
        staff = pool.submit(run_workforce, spark, raw_employees, f"{folder}/workforce", fmt)
        counts = sold.result() | staff.result()
    return spark.createDataFrame(list(counts.items()), "query string, rows long")
