"""What a star writes: joined sources once, no copy of a projection or of a fact read once."""

from pyspark.sql import functions as F

from platewise.functions.schemas import SOURCE_DDL, conform
from platewise.operators import audits
from platewise.plans import warehouse


def _stage(spark):
    def rows(name, data, ddl):
        return conform(spark.createDataFrame(data, ddl), SOURCE_DDL[name])

    day = "timestamp_ntz'2024-01-05 10:00:00'"
    orders = rows("orders", [("1", "c1", "r1", 5, 10.0), ("2", "c1", None, None, 7.0), ("2", "c2", "r1", 4, 7.0),
                             (None, "c2", "r1", 3, 1.0)],
                  "id string, customer_id string, restaurant_id string, rating int, order_total double")
    orders = orders.withColumn("created_at", F.expr(day)).withColumn("updated_at", F.expr(day))
    return {
        "restaurants": rows("restaurants", [("r1", "R")], "loc_number string, loc_name string"),
        "products": rows("products", [("p1", "r1", "$1.00")], "id string, restaurant_id string, price string"),
        "promotions": rows("promotions", [("1", "P")], "promotion_id string, name string"),
        "customers": rows("customers", [("c1",), ("c2",)], "id string"),
        "orders": orders,
        "order_items": rows("order_items", [("1-1", "1", "p1", 2, 1.0), ("2-1", "2", "p1", 1, 2.0), ("9-1", "9", "p1", 1, 2.0)],
                            "id string, order_id string, product_id string, item_quantity int, price double"),
        "delivery": rows("delivery", [("d1", "n1", "1", "05-01-2024", "10:00:00")],
                         "ID string, Delivery_person_ID string, Order_ID string, Order_Date string, Time_Orderd string"),
    }


def test_joined_sources_are_written_once_and_projections_never(spark, monkeypatch):
    written, write = [], warehouse._write_scratch
    monkeypatch.setattr(warehouse, "_write_scratch", lambda df, name: written.append(name) or write(df, name))
    s = warehouse.Star(_stage(spark), joined=("orders", "products", "promotions"), narrow=("order_items",))
    tables = s.tables(once=True)
    assert written.count("stage-orders") == 1
    assert not {"clean-orders", "clean-ratings", "clean-order_items", "fact-order_item", "fact-rating"} & set(written)
    plain = warehouse.Star(_stage(spark)).tables()
    for name, df in tables.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, plain[name].collect())), name
    assert audits.audit_primary_keys({"fact_order_item": tables["fact_order_item"]}).count() == 1  # order 2 comes twice
