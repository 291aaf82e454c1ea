import datetime as dt
import json

import pytest
from builders import customer, order, rows
from pyspark.sql import functions as F

from shopgauge import session as sessions
from shopgauge.schema import STAR_SCHEMAS, TUNED_PARAMETERS
from shopgauge.sources import csv_star, tables, trial_files
from shopgauge.star import Star


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "shop_orders_dataset.csv").write_text(
        " Order_ID,CUSTOMER_ID ,order_status,order_purchase_timestamp,order_delivered_customer_date,"
        "order_estimated_delivery_date,extra\n"
        "o1,c1,delivered,2024-01-05 10:11:12,2024-01-09,not a date,x\n"
        "o2,c1,shipped,2024-02-05 00:00:00,,2024-02-09 00:00:00,y\n"
    )
    (tmp_path / "shop_order_items_dataset.csv").write_text(
        "order_id,order_item_id,product_id,seller_id,price,freight_value\no1,1,p1,s1,12.50,3\n"
    )
    (tmp_path / "product_category_name_translation.csv").write_text(
        "product_category_name,product_category_name_english\ncasa,home\n"
    )
    (tmp_path / "customers.csv").write_text(
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
        'c1,u1,01234,"São Paulo, SP",SP\n'
    )
    return str(tmp_path)


def test_star_from_csv(spark, folder, caplog):
    star = csv_star.load_star(spark, folder)
    got = {r.order_id: r for r in star.orders.collect()}
    assert got["o1"].order_purchase_timestamp == dt.datetime(2024, 1, 5, 10, 11, 12)
    assert got["o1"].order_delivered_customer_date == dt.datetime(2024, 1, 9)
    assert got["o1"].order_estimated_delivery_date is None
    assert got["o2"].order_delivered_customer_date is None
    assert star.orders.schema == STAR_SCHEMAS["orders"]
    assert star.customers.first().customer_zip_code_prefix == "01234"
    assert star.customers.first().customer_city == "São Paulo, SP"
    assert float(star.order_items.first().price) == 12.5
    assert star.category_translation.count() == 1
    assert star.sellers.isEmpty() and star.sellers.schema == STAR_SCHEMAS["sellers"]
    assert "sellers" in caplog.text


def test_bad_purchase_time_is_an_error(spark, tmp_path):
    names = "order_id,customer_id,order_purchase_timestamp,order_status,order_delivered_customer_date,order_estimated_delivery_date"
    (tmp_path / "orders.csv").write_text(f"{names}\no1,c1,yesterday,delivered,,\n")
    with pytest.raises(Exception, match="not a timestamp: yesterday"):
        csv_star.load_star(spark, str(tmp_path)).orders.collect()


def test_two_files_of_one_table_are_an_error(spark, folder, tmp_path):
    (tmp_path / "returned_orders_dataset.csv").write_text((tmp_path / "shop_orders_dataset.csv").read_text())
    with pytest.raises(ValueError, match="several files may be the table orders"):
        csv_star.load_star(spark, folder)
    star = csv_star.load_star(spark, folder, files={"orders": f"{folder}/shop_orders_dataset.csv"})
    assert star.orders.count() == 2


def test_a_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "order_payments.csv").write_text("order_id,payment_sequential,payment_type,payment_installments,value\no1,1,x,1,9.00\n")
    with pytest.raises(ValueError, match="no column payment_value"):
        csv_star.load_star(spark, str(tmp_path))


def test_repeated_keys_are_an_error_unless_the_check_is_waived(spark, tmp_path):
    header = "order_id,customer_id,order_purchase_timestamp,order_status,order_delivered_customer_date,order_estimated_delivery_date\n"
    row = "o1,c1,2024-01-05,delivered,,\n"
    (tmp_path / "orders.csv").write_text(header + row + row.replace("o1", "o2") + row)
    with pytest.raises(ValueError, match="orders.order_id must be unique, but 'o1' occurs 2 times"):
        csv_star.load_star(spark, str(tmp_path))
    assert csv_star.load_star(spark, str(tmp_path), check_keys=False).orders.count() == 3


def test_csv_round_trip(spark, make_star, tmp_path):
    star = make_star(
        customers=[customer("c1")],
        orders=[order("o1", "c1", "2024-01-05 10:11:12", delivered="2024-01-09 01:02:03"), order("o2", "c1", "2024-01-06")],
    )
    csv_star.save_star_csv(star, str(tmp_path))
    back = csv_star.load_star(spark, str(tmp_path))
    assert sorted(back.orders.collect()) == sorted(star.orders.collect())


def test_star_as_tables(spark, make_star, tmp_path):
    star = make_star(customers=[customer("c1")], orders=[order("o1", "c1", "2024-01-05"), order("o2", "c1", "2023-01-05")])
    tables.save_star(star, str(tmp_path))
    back = tables.open_star(spark, str(tmp_path))
    assert sorted(back.orders.collect()) == sorted(star.orders.collect())
    assert back.orders.schema == STAR_SCHEMAS["orders"]
    assert back.customers.count() == 1 and back.sellers.isEmpty()


def test_a_star_needs_its_tables(spark):
    with pytest.raises(ValueError, match="a star has the tables"):
        Star(orders=spark.range(1))


def test_views(spark, make_star):
    make_star(customers=[customer("c1")]).create_views()
    assert tables.run_query(spark, "select customer_id from customers").collect()[0][0] == "c1"


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], [" A ", "Bc"])
    assert csv_star.normalize_headers(df).columns == ["a", "bc"]


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3)
    assert tables.write_table(df, path, "fail").count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_table(df, path, "fail")
    assert tables.write_table(df, path, "append").count() == 6
    assert tables.write_table(df, path).count() == 3


def test_run_query_with_positions_names_and_frames(spark):
    df = spark.range(10)
    assert tables.run_query(spark, "select ? + 1 as v", [41]).first().v == 42
    assert tables.run_query(spark, "select count(*) as n from {t} where id >= :low", {"low": 7}, {"t": df}).first().n == 3
    assert tables.run_query(spark, "select 1 as v").first().v == 1


def test_tuning_history_as_one_json_array(spark, tmp_path):
    params = {name: i + 1 for i, name in enumerate(TUNED_PARAMETERS)}
    trials = [
        {"number": 0, "value": 0.64, "params": params, "state": "COMPLETE"},
        {"number": 1, "value": None, "params": {"gamma": 1.5}, "state": "FAIL"},
    ]
    path = tmp_path / "trials.json"
    path.write_text(json.dumps(trials, indent=2))
    got = sorted(rows(trial_files.load_trials(spark, str(path)), "number", "value", "n_estimators", "gamma", "state"))
    assert got == [(0, 0.64, 1, 7.0, "COMPLETE"), (1, None, None, 1.5, "FAIL")]


class FakeSession:
    def __init__(self, master, conf_dir=None, context_dir=None):
        self.master, self.applicationId, self.context_dir = master, "app", context_dir
        self.conf_dir, self.sparkContext, self.conf = conf_dir, self, self

    def get(self, key, default):
        return (self.conf_dir if key == "spark.checkpoint.dir" else None) or default

    def getCheckpointDir(self):
        return self.context_dir


def test_scratch_folder_is_the_one_the_cluster_names():
    path = sessions.scratch_path(FakeSession("yarn", "hdfs://shared/ckpt/", "hdfs://shared/ckpt/1234"), "x")
    assert path.startswith("hdfs://shared/ckpt/app/x-")
    assert sessions.scratch_path(FakeSession("yarn", None, "hdfs://set/by/code"), "x").startswith("hdfs://set/by/code/app/x-")


def test_scratch_folder_must_be_named_off_local_mode():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        sessions.scratch_path(FakeSession("yarn"), "x")
    local = FakeSession("local[2]")
    assert sessions.scratch_path(local, "x").rsplit("/", 2)[0] == sessions.scratch_path(local, "y").rsplit("/", 2)[0]


def test_materialized_rows_are_read_from_the_scratch_folder(spark):
    df = sessions.materialize(spark.range(5).where(F.col("id") > 1), "x")
    assert df.count() == 3
    assert all(f"/{spark.sparkContext.applicationId}/x-" in name for name in df.inputFiles())


def test_scratch_is_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sessions, "_application_folder", lambda session: str(tmp_path / "app"))
    sessions.materialize(spark.range(5), "x")
    assert list(tmp_path.rglob("*.parquet"))
    sessions.remove_scratch(spark)
    assert not list(tmp_path.iterdir())
