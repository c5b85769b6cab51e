import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from stagewatch.session import local_session
    s = local_session("*", shuffle_partitions=8, app_name="stagewatch-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_sources(spark):
    """A small sales/customers/products fixture of our own (40/10/5 rows)."""
    import datetime as dt

    from stagewatch.plans import jobs
    sales = spark.createDataFrame(
        [(f"TXN{i:03d}", f"C{i % 10}", f"P{i % 5}", 1 + i % 3, 10.0 + i, ["USD", "EUR", "GBP"][i % 3],
          dt.date(2024, 1, 1 + i % 10), ["North", "South"][i % 2], "completed") for i in range(40)],
        "transaction_id string, customer_id string, product_id string, quantity int, unit_price double, "
        "currency string, transaction_date date, region string, status string")
    customers = spark.createDataFrame(
        [(f"C{i}", f"Name {i}", f"c{i}@x.com", "gold", "US", dt.date(2020, 1, 1), 10.0) for i in range(10)],
        "customer_id string, name string, email string, tier string, country string, signup_date date, "
        "lifetime_value double")
    products = spark.createDataFrame([(f"P{i}", f"Prod {i}") for i in range(5)], "product_id string, name string")
    return jobs.Sources(sales, customers, products)
