"""CSV extracts: declared schema, NULL marker, quarantine, header check, S7."""

import os

import pytest
from pyspark.sql import functions as F

from platewise.sources import csv as csvsrc

TS = "2025-01-01 00:00:00"


def write(path, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.csv"), "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_bad_type_and_extra_column_are_quarantined(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "items"),
              "id,order_id,product_id,item_quantity,price\n"
              "i1,o1,p1,2,3.5\n"
              "i2,o1,p2,two,1.0\n"
              "i3,o2,p1,1,2.0,surplus\n")
    r = csvsrc.read_source(spark, "order_items", p, "items_csv", TS)
    good = r.good.collect()
    assert [(g["id"], g["item_quantity"], g["price"]) for g in good] == [("i1", 2, 3.5)]
    bad = sorted(x["raw_record"] for x in r.quarantine.collect())
    assert bad == ["i2,o1,p2,two,1.0", "i3,o2,p1,1,2.0,surplus"]
    # every good row carries its provenance
    assert good[0]["source_system"] == "items_csv" and good[0]["source_file"] == "part-0.csv"
    assert str(good[0]["load_timestamp"]) == TS


def test_null_marker_quotes_and_non_ascii(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "promos"),
              "promotion_id,name,description,discount_type,discount_value,start_date,end_date,"
              "min_order_value,max_discount,restaurant_id,is_active\n"
              'P1,"Save, now","Flat ₹50 off",fixed,50.0,2024-01-01,2024-01-01,100.0,NULL,NULL,0\n')
    r = csvsrc.read_source(spark, "promotions", p, "promotions_csv", TS)
    row = r.good.first()
    assert row["name"] == "Save, now" and row["description"] == "Flat ₹50 off"
    assert row["restaurant_id"] is None and row["max_discount"] is None
    assert row["is_active"] == 0 and str(row["start_date"]) == "2024-01-01"
    assert r.quarantine.count() == 0


def test_optional_columns_may_be_absent(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "products"),
              "id,name,description,price,cost\nx1,Soup,Hot,$12.50,$8.00\n")
    r = csvsrc.read_source(spark, "products", p, "products_csv", TS)
    row = r.good.first()
    assert row["restaurant_id"] is None and row["price"] == "$12.50"


def test_unexpected_header_fails(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "bad"), "id,unknown_col\n1,2\n")
    with pytest.raises(ValueError, match="unexpected file format"):
        csvsrc.read_source(spark, "customers", p, "customers_csv", TS)


def test_second_restaurant_feed_union(spark):
    main = spark.createDataFrame([("1", "A", "C1")], "loc_number string, loc_name string, "
                                 "cuisines string")
    main = csvsrc.with_provenance(main, "restaurants_csv", "r.csv", TS)
    second = spark.createDataFrame([("2", "B", "C2", "Paris")], "res_id string, res_name string, "
                                   "cuisines string, city string")
    for c in ["address", "state", "zipcode", "latitude", "longitude", "phone",
              "aggregate_rating"]:
        second = second.withColumn(c, F.lit(None).cast("string"))
    second = csvsrc.with_provenance(second, "feed2_csv", "z.csv", TS)
    u = csvsrc.union_restaurant_feeds(main, second)
    got = sorted((r["loc_number"], r["loc_name"], r["source_system"]) for r in u.collect())
    assert got == [("1", "A", "restaurants_csv"), ("2", "B", "feed2_csv")]


def test_only_first_lines_are_read_for_headers(spark, tmpdir_path):
    import gzip

    for i, opener in enumerate([open, gzip.open]):
        with opener(os.path.join(tmpdir_path, f"f{i}.csv" + (".gz" if i else "")), "wt") as f:
            f.write("\ufeffid, price\n" + "1,2\n" * 100_000)
    open(os.path.join(tmpdir_path, "empty.csv"), "w").close()
    found = csvsrc.headers_of(spark, tmpdir_path)
    assert list(found) == [("id", "price")] and len(found["id", "price"]) == 2


def test_null_markers_and_reasons(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "i.csv"), "w") as f:
        f.write("id,order_id,product_id,item_quantity,price\n")
        f.writelines(f"{i},{m},{m},{m},{m}\n" for i, m in enumerate(csvsrc.NULL_MARKERS))
        f.write('a,b,c,many,"1,5"\nb,b,c,3,4,5\nc,Nancy,NAN,3,1.5\n')
    r = csvsrc.read_source(spark, "order_items", tmpdir_path, "s", "2025-01-01 00:00:00")
    good = {x.id: (x.order_id, x.product_id, x.item_quantity, x.price) for x in r.good.collect()}
    assert good.pop("c") == ("Nancy", "NAN", 3, 1.5)
    assert len(good) == len(csvsrc.NULL_MARKERS) and set(good.values()) == {(None,) * 4}
    bad = {x.id: (x.raw_record, [tuple(c) for c in x.rejected]) for x in r.quarantine.collect()}
    assert bad["a"] == ('a,b,c,many,"1,5"', [("item_quantity", "many", "not a int"), ("price", "1,5", "not a double")])
    assert bad["b"] == ("b,b,c,3,4,5", [(None, None, "wrong number of fields")])
