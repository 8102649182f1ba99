"""The month-partitioned store of transaction files."""

import os
from datetime import date as D

from helpers import rows

from tiller.sources import store as st
from tiller.sources.readers import read_transactions


def write(folder, name, lines):
    (folder / name).write_text("".join(line + "\n" for line in lines))


def stamps(store):
    data = store / "data"
    return {m.name: sorted(p.name for p in m.iterdir() if p.suffix == ".parquet")
            for m in data.iterdir() if m.is_dir()}


def test_incremental_store(spark, tmp_path):
    src, store = tmp_path / "in", tmp_path / "store"
    src.mkdir()
    read = ("date", "store_id", "customer_id", "products")
    assert st.update_store(spark, str(src), str(store)) == []
    assert st.read_store(spark, str(store)).count() == 0
    write(src, "1_Tran.csv", ["2024-01-05|1|10|1 2", "2024-02-01|1|11|3", "bad|1|x|"])
    write(src, "2_Tran.csv", ["2024-02-09|2|12|1", "2024-03-01|2|12|5"])
    write(src, "notes.csv", ["2024-02-09|9|9|9"])
    assert st.update_store(spark, str(src), str(store)) == ["1_Tran.csv", "2_Tran.csv"]

    def same():
        assert rows(st.read_store(spark, str(store)).select(*read)) == rows(
            read_transactions(spark, str(src)).select(*read))

    same()
    before = stamps(store)
    assert st.update_store(spark, str(src), str(store)) == []
    # a new file rewrites its own months only
    write(src, "3_Tran.csv", ["2024-03-07|3|13|1", "2024-04-01|3|13|5"])
    assert st.update_store(spark, str(src), str(store)) == ["3_Tran.csv"]
    same()
    after = stamps(store)
    changed = {m for m in after if after[m] != before.get(m)}
    assert changed == {"month=2024-03-01", "month=2024-04-01"}
    # a changed file replaces its rows, and a month of its own goes with them
    write(src, "3_Tran.csv", ["2024-03-08|3|14|1 1 1"])
    os.utime(src / "3_Tran.csv", (2_000_000_000, 2_000_000_000))
    assert st.update_store(spark, str(src), str(store)) == ["3_Tran.csv"]
    same()
    assert "month=2024-04-01" not in stamps(store)
    assert rows(st.manifest(spark, str(store)), "file_name") == [
        ("1_Tran.csv",), ("2_Tran.csv",), ("3_Tran.csv",)]
    # an update that broke off before the manifest was written is repeated
    st._record(spark, str(store), ["1_Tran.csv", "3_Tran.csv"], [("1_Tran.csv", None, None), ("3_Tran.csv", None, None)])
    write(src, "3_Tran.csv", ["2024-07-08|3|14|1 1 1 1"])
    assert st.update_store(spark, str(src), str(store)) == ["1_Tran.csv", "3_Tran.csv"]
    assert "month=2024-07-01" in stamps(store)
    same()
    assert not [p for p in store.iterdir() if p.name.startswith("incoming")]

    # days of a period, from the partitions of its months alone
    period = st.read_store(spark, str(store), "2024-02-01", "2024-02-05")
    assert rows(period, "date") == [(D(2024, 2, 1),)]
    plan = period._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
