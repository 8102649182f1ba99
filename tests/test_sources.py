"""Source round trips and the hand-made input cases (bad values, blanks,
file filter, empty input)."""

import datetime as dt
import os

import pytest
from helpers import rows
from pyspark.errors import AnalysisException

from tiller.operators import baskets, profile
from tiller.sources import readers
from tiller.sources.sinks import write_csv, write_json, write_sections


def _write(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def _tx_dir(root):
    d = os.path.join(root, "Transactions")
    os.makedirs(d)
    _write(os.path.join(d, "102_Tran.csv"), [
        "2013-01-01|102|1|4 5 6",
        "bad|102|x|4  5",
        "2013-01-02|103|6|",
        "2013-01-02|102|1|1 1 2",
    ])
    _write(os.path.join(d, "103_Tran.csv"), ["2013-02-03|103|2|7"])
    _write(os.path.join(d, "other.csv"), ["2013-03-01|999|9|9"])
    return d


def test_read_transactions_types_and_bad_values(spark, scratch):
    tx = readers.read_transactions(spark, _tx_dir(scratch))
    assert [f.dataType.simpleString() for f in tx.schema.fields] == ["date", "bigint", "bigint", "string"]
    got = rows(tx)
    assert len(got) == 5  # other.csv is not read
    bad = [r for r in got if r[0] is None]
    assert bad == [(None, 102, None, "4  5")]  # bad date and id -> NULL, row kept
    empty = [r for r in got if r[1] == 103 and r[2] == 6]
    assert empty[0][3] is None  # empty basket read as NULL


def test_source_files(spark, scratch):
    sf = readers.source_files(spark, _tx_dir(scratch))
    assert rows(sf) == [("102_Tran.csv", 4), ("103_Tran.csv", 1)]


def test_empty_directory_keeps_schema(spark, scratch):
    d = os.path.join(scratch, "none")
    os.makedirs(d)
    tx = readers.read_transactions(spark, d)
    assert tx.count() == 0
    assert tx.columns == ["date", "store_id", "customer_id", "products"]
    st = baskets.basket_statistics(tx).collect()[0]
    assert st["baskets"] == 0 and st["mean_size"] is None


def test_missing_inputs_are_errors(spark, scratch):
    with pytest.raises(AnalysisException):
        readers.read_transactions(spark, os.path.join(scratch, "does-not-exist")).count()
    with pytest.raises(AnalysisException):
        readers.read_categories(spark, os.path.join(scratch, "no.csv")).count()
    with pytest.raises(AnalysisException):
        readers.source_files(spark, os.path.join(scratch, "does-not-exist")).count()


def test_wrong_header_is_an_error(spark, scratch):
    p = os.path.join(scratch, "Categories.csv")
    _write(p, ["category_name|id", "FRUTAS|1"])
    with pytest.raises(Exception, match="header"):
        readers.read_categories(spark, p).collect()
    q = os.path.join(scratch, "ProductCategory.csv")
    _write(q, ["v.code|v.code_pr", "1|10"])
    with pytest.raises(Exception, match="header"):
        readers.read_product_category(spark, q).collect()


def test_parse_lines(spark):
    lines = spark.createDataFrame([("2013-01-01|1|2|4 5",), ("x||y|",), ("",)], "value string")
    got = rows(readers.typed_transactions(readers.parse_lines(lines)))
    assert (dt.date(2013, 1, 1), 1, 2, "4 5") in got and len(got) == 3
    assert sum(r[0] is None and r[1] is None and r[2] is None for r in got) == 2


def test_null_counts_on_hand_made_rows(spark, scratch):
    tx = readers.read_transactions(spark, _tx_dir(scratch))
    got = {r["column_name"]: r["nulls"] for r in profile.null_counts(tx).collect()}
    assert got == {"date": 1, "store_id": 0, "customer_id": 1, "products": 1}


def test_double_space_and_repeated_items(spark, scratch):
    tx = readers.read_transactions(spark, _tx_dir(scratch))
    sized = baskets.with_basket_size(tx)
    got = {r["products"]: r["basket_size"] for r in sized.collect()}
    assert got["4  5"] == 3  # raw size keeps the empty token
    assert got["1 1 2"] == 3
    assert got[None] is None
    items = baskets.basket_items(tx)
    assert items.count() == 3 + 2 + 3 + 1  # '' dropped, repeated item kept


def test_catalogue_reader(spark, scratch):
    p = os.path.join(scratch, "Categories.csv")
    _write(p, ["id|category_name", "1|FRUTAS", "2|", "3|QUESO"])
    cat = readers.read_categories(spark, p)
    assert rows(cat) == [(1, "FRUTAS"), (2, None), (3, "QUESO")]
    q = os.path.join(scratch, "ProductCategory.csv")
    _write(q, ["v.code_pr|v.code", "10|1", "10|1", "11|2"])
    pc = readers.read_product_category(spark, q)
    assert pc.columns == ["code_pr", "code"]
    assert rows(profile.exact_duplicates(pc)) == [(3, 2, 1, 100.0 / 3)]


def test_sinks_round_trip(spark, scratch):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", [3])], "k int, v string, arr array<int>")
    write_json(df, os.path.join(scratch, "j"))
    assert spark.read.json(os.path.join(scratch, "j")).count() == 2
    write_csv(df, os.path.join(scratch, "c"))
    back = spark.read.option("header", True).csv(os.path.join(scratch, "c"))
    assert sorted(r["arr"] for r in back.collect()) == ["[1,2]", "[3]"]
    written = write_sections({"one": df, "skipped": None}, os.path.join(scratch, "rep"), "parquet")
    assert written == ["one"]
    assert spark.read.parquet(os.path.join(scratch, "rep", "one")).count() == 2


def test_typed_projection_dates(spark):
    raw = spark.createDataFrame([("2013-1-3", "1", "2", "4"), ("2013-01-03", "1", "2", "4")],
                                readers.RAW_TRANSACTIONS_SCHEMA)
    got = [r["date"] for r in readers.typed_transactions(raw).collect()]
    assert sorted(got, key=lambda d: (d is None, d)) == [dt.date(2013, 1, 3), None]


def test_round_trip_equals_fixture(spark, scratch):
    """Purchases -> one pipe file per store -> S2 reader: same rows."""
    from pyspark.sql import functions as F

    from tiller.sources import fixtures as fx

    original = fx.store_purchases(spark, "/root/testdata/sf0.001").withColumn(
        "products", F.concat_ws(" ", "customer_id", "store_id"))
    by_store = {}
    for r in original.collect():
        by_store.setdefault(r["store_id"], []).append(
            "|".join("" if v is None else str(v) for v in r))
    d = os.path.join(scratch, "Transactions")
    os.makedirs(d)
    for store, lines in by_store.items():
        _write(os.path.join(d, f"{store}_Tran.csv"), lines)
    back = readers.read_transactions(spark, d)
    assert original.exceptAll(back).count() == 0 and back.exceptAll(original).count() == 0
