"""Every registered query: (session, folder of the given tables) -> result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import portable, round_away
from tidemark.operators import calendar, cleaning, customers, fact, features, model, quality, sales, stats, workforce
from tidemark.plans import catalogue, oracle, slices
from tidemark.session import cut, scratch_path, tune
from tidemark.sources import given_tables as given
from tidemark.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact.clean_and_join(given.raw_sales(spark, sf_dir))


def _employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_employees(given.raw_employees(spark, sf_dir))


def _on_fact(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(_fact(spark, sf_dir))


def _on_staff(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(_employees(spark, sf_dir))


def _on_records(report: Callable[[DataFrame], DataFrame]) -> Query:
    """For reports that never look at pay: the same employees without the medians."""
    return lambda spark, sf_dir: report(cleaning.employee_records(given.raw_employees(spark, sf_dir)))


def _on_staff_once(report: Callable[[DataFrame], DataFrame]) -> Query:
    """For reports that read their input in several passes."""
    return lambda spark, sf_dir: report(cut(_employees(spark, sf_dir)))


def _clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_orders(given.raw_sales(spark, sf_dir).orders)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = given.raw_sales(spark, sf_dir)
    return quality.orphans(cleaning.clean_order_items(raw.order_items), cleaning.clean_orders(raw.orders), "order_id")


def _lookup_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = cleaning.clean_customers(given.raw_sales(spark, sf_dir).customers).select("customer_id", "city")
    found = cleaning.lookup_enrich(known, given.city_lookup(spark, sf_dir), "city")
    return found.select("customer_id", "city", "state", "region")


def _clamp_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = given.raw_sales(spark, sf_dir)
    signups = cleaning.clean_customers(raw.customers).select("customer_id", "signup_date")
    orders = cleaning.clean_orders(raw.orders).join(signups, "customer_id")
    last = F.lit(slices.LAST_DAY).cast("date")
    return cleaning.clamp_dates(orders, "order_date", "signup_date", last).select("order_id", "customer_id", "order_date")


def _star_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = given.raw_sales(spark, sf_dir)
    saved = sinks.star_export(
        fact.clean_and_join(raw),
        cleaning.clean_customers(raw.customers),
        cleaning.clean_products(raw.products),
        scratch_path(spark, "star"),
    )
    return spark.createDataFrame(list(saved.items()), "name string, rows long")


def _run_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.run_catalogue(
        spark, given.raw_sales(spark, sf_dir), given.raw_employees(spark, sf_dir), scratch_path(spark, "catalogue"), strict=False
    )


def _valid_employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    employees = cut(_employees(spark, sf_dir))
    quality.require_valid(employees, "employee_id")
    return quality.null_counts(employees, "employee_id")


def _rounded(report: Callable[[DataFrame], DataFrame], places: int) -> Callable[[DataFrame], DataFrame]:
    """Round the double columns of a report whose last digits depend on summing order."""

    def run(df: DataFrame) -> DataFrame:
        out = report(df)
        rounded = {c for c, t in out.dtypes if t == "double" and c != "p_value"}
        return out.select(*[round_away(c, places).alias(c) if c in rounded else F.col(c) for c in out.columns])

    return run


def _p_as_text(report: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Seven digits of the p-value, which may be far below any fixed number of places."""
    return lambda df: report(df).withColumn("p_value", F.format_string("%.6e", "p_value"))


def _numeric(employees: DataFrame) -> list[str]:
    return features.column_kinds(employees)[0]


def _alarm() -> Column:
    return F.col("risk_points") >= slices.ALARM_POINTS


def _dummies(employees: DataFrame) -> DataFrame:
    return features.one_hot_drop_first(employees, ["gender", "department", "education", "overtime", "job_role"])


_QUERIES: dict[str, Query] = {
    # cleaning, integrity, tables
    "clean_customers": lambda s, d: cleaning.clean_customers(given.raw_sales(s, d).customers),
    "clean_products": lambda s, d: cleaning.clean_products(given.raw_sales(s, d).products),
    "clean_orders": _clean_orders,
    "clean_order_items": lambda s, d: cleaning.clean_order_items(given.raw_sales(s, d).order_items),
    "dedup_report": lambda s, d: cleaning.dedup_report(cleaning.standard_orders(given.raw_sales(s, d).orders)),
    "sales_fact": _fact,
    "integrity_duplicate_keys": lambda s, d: quality.duplicate_keys(_clean_orders(s, d), "order_id"),
    "integrity_orphans": _orphans,
    "clean_employees": _employees,
    "cleaning_log": lambda s, d: cleaning.cleaning_log(given.raw_employees(s, d)),
    "assert_employees_valid": _valid_employees,
    "star_export": _star_export,
    "lookup_enrich": _lookup_enrich,
    "clamp_dates": _clamp_dates,
    # sales
    "kpi_summary": _on_fact(sales.kpi_summary),
    "monthly_revenue_mom": _on_fact(sales.monthly_revenue_mom),
    "category_profitability": _on_fact(sales.category_profitability),
    "top_products_per_category": _on_fact(sales.top_products_per_category),
    "regional_performance": _on_fact(sales.regional_performance),
    "discount_impact": _on_fact(sales.discount_impact),
    "return_rate_by_category": _on_fact(sales.return_rate_by_category),
    "customer_rfm": _on_fact(customers.customer_rfm),
    "rfm_segment_summary": _on_fact(lambda f: customers.rfm_segment_summary(customers.customer_rfm(f))),
    "rfm_segment_counts": _on_fact(lambda f: customers.rfm_segment_counts(customers.customer_rfm(f))),
    "pareto_customers": _on_fact(customers.pareto_customers),
    "cohort_retention": _on_fact(customers.cohort_retention),
    "cohort_matrix": _on_fact(lambda f: customers.cohort_matrix(customers.cohort_retention(f))),
    "sales_cube_monthly": _on_fact(sales.sales_cube_monthly),
    "summary_blocks": _on_fact(lambda f: sales.summary_blocks(sales.sales_cube_monthly(f))),
    "category_year_pivot": _on_fact(lambda f: sales.category_by_year(sales.sales_cube_monthly(f))),
    "category_year_pivot_wide": _on_fact(lambda f: sales.category_year_pivot(cut(sales.sales_cube_monthly(f)))),
    "loss_making_revenue": _on_fact(sales.loss_making_revenue),
    "return_rate_overall": _on_fact(sales.return_rate_overall),
    "top_customers": _on_fact(sales.top_customers),
    "customer_order_detail": _on_fact(sales.customer_order_detail),
    "sliced_kpis": _on_fact(lambda f: sales.sliced_kpis(f, slices.YEARS, slices.REGIONS, slices.CATEGORIES)),
    # calendar
    "date_dim": lambda s, d: calendar.date_dim_for(_clean_orders(s, d)),
    "revenue_yoy": _on_fact(calendar.revenue_yoy),
    "revenue_mom_calendar": _on_fact(calendar.revenue_mom_calendar),
    "annual_growth": _on_fact(calendar.annual_growth),
    "revenue_ytd": _on_fact(calendar.revenue_ytd),
    # workforce
    "attrition_overall": _on_records(workforce.attrition_overall),
    "attrition_by_department": _on_records(workforce.attrition_by_department),
    "attrition_by_overtime": _on_records(workforce.attrition_by_overtime),
    "attrition_by_tenure_band": _on_records(workforce.attrition_by_tenure_band),
    "attrition_by_income_quartile": _on_staff(workforce.attrition_by_income_quartile),
    "attrition_by_satisfaction": _on_records(workforce.attrition_by_satisfaction),
    "attrition_by_promotion_gap": _on_records(workforce.attrition_by_promotion_gap),
    "attrition_cost_by_department": _on_staff(workforce.attrition_cost_by_department),
    "rule_based_risk_flags": _on_staff_once(workforce.rule_based_risk_flags),
    "tenure_band_cut": _on_records(workforce.tenure_band_cut),
    "workforce_kpis": _on_staff(workforce.workforce_kpis),
    "attrition_blocks": _on_records(workforce.attrition_blocks),
    "attrition_vs_average": _on_records(workforce.attrition_vs_average),
    "attrition_by_age_group": _on_records(workforce.attrition_by_age_group),
    "department_attrition_pivot": _on_records(workforce.department_attrition_pivot),
    "sliced_attrition": _on_staff(
        lambda e: workforce.sliced_attrition(
            e, slices.DEPARTMENTS, slices.OVERTIME, slices.TENURE_BANDS, slices.SATISFACTION
        )
    ),
    "promotion_gap_confounding": _on_records(workforce.promotion_gap_confounding),
    "income_relative_log": _on_staff_once(_rounded(workforce.income_relative_log, 9)),
    # statistics
    "chi_square_test": _on_records(stats.chi_square_test),
    "chi_square_p": _on_records(_p_as_text(_rounded(stats.chi_square_p_values, 6))),
    "mann_whitney_u": _on_staff(stats.mann_whitney_test),
    "wilcox_w": _on_staff(_p_as_text(stats.wilcox_w)),
    "statistical_tests": _on_staff_once(stats.statistical_tests),
    # model
    "feature_split": _on_staff(features.feature_split),
    "standardize": _on_staff_once(_rounded(lambda e: features.standardize(e, _numeric(e)), 6)),
    "scale_sample": _on_staff_once(_rounded(lambda e: features.standardize(e, ["monthly_income"], sample=True), 6)),
    "one_hot_drop_first": lambda s, d: _dummies(cut(cleaning.employee_records(given.raw_employees(s, d)))),
    "stratified_split": lambda s, d: features.stratified_split(cut(cleaning.employee_records(given.raw_employees(s, d)))),
    "class_weights": _on_records(features.class_weights),
    "attrition_model": _on_staff(_rounded(model.attrition_model, 6)),
    "attrition_probability": _on_staff(_rounded(model.attrition_probability, 6)),
    "roc_auc": _on_staff_once(lambda e: model.roc_auc(workforce.risk_points(e), "risk_points", workforce.left())),
    "classification_report": _on_staff_once(
        lambda e: model.classification_report(workforce.risk_points(e), workforce.left(), _alarm())
    ),
    "model_metrics": _on_staff(model.model_metrics),
    "model_drivers": _on_staff(model.model_drivers),
    "high_risk_employees": _on_staff(model.high_risk_employees),
    "odds_ratios_wald": _on_staff(_p_as_text(_rounded(model.odds_ratios_wald, 6))),
    # catalogue
    "run_catalogue": _run_catalogue,
}


def _portable(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return portable(query(spark, sf_dir))

    return run


def queries() -> dict[str, Query]:
    return {name: _portable(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql([*catalogue.SALES_REPORTS, *catalogue.WORKFORCE_REPORTS])
