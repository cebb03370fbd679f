"""Fixed schemas of the raw tables; nothing is inferred from the files.

Raw dates stay text here: the cleaning step parses them and turns bad ones into NULL.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _INT, _PRICE, _ID = T.StringType(), T.IntegerType(), T.DecimalType(18, 4), T.StringType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


CUSTOMERS = _schema(
    customer_id=_ID, customer_name=_TEXT, city=_TEXT, segment=_TEXT, signup_date=_TEXT, state=_TEXT, region=_TEXT
)
PRODUCTS = _schema(
    product_id=_ID, category=_TEXT, sub_category=_TEXT, product_name=_TEXT, unit_cost=_PRICE, unit_price=_PRICE
)
ORDERS = _schema(
    order_id=_ID, customer_id=_ID, order_date=_TEXT, ship_mode=_TEXT, discount_pct=_INT, status=_TEXT
)
ORDER_ITEMS = _schema(order_id=_ID, product_id=_ID, quantity=_INT)
EMPLOYEES = _schema(
    employee_id=_ID,
    age=_INT,
    gender=_TEXT,
    department=_TEXT,
    job_role=_TEXT,
    education=_TEXT,
    monthly_income=_PRICE,
    years_at_company=_INT,
    years_since_last_promotion=_INT,
    overtime=_TEXT,
    job_satisfaction=_INT,
    work_life_balance=_INT,
    distance_from_home_km=_INT,
    performance_rating=_INT,
    num_companies_worked=_INT,
    attrition=_TEXT,
)

SALES_TABLES = {"customers": CUSTOMERS, "products": PRODUCTS, "orders": ORDERS, "order_items": ORDER_ITEMS}
