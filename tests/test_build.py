"""Tables of a build are written side by side; an export by day is shuffled as flat rows."""

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sessionloom.plans import build as plan
from sessionloom.session import configure
from sessionloom.sources.adapter import raw_export
from sessionloom.sources.export import read_export, write_export
from tests.test_plans import formatted
from tests.test_scale import _tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return _tables(configure(spark), tmp_path_factory.mktemp("tables"))


def _sorted(df):
    return sorted(map(str, df.collect()))


def test_export_by_day_is_shuffled_flat(spark, folder):
    """What the exchange by day moves holds no nested parameters yet."""
    text = formatted(raw_export(spark, folder, by_day=True))
    node = next(t for t in text.split("\n\n") if "REBALANCE_PARTITIONS_BY_COL" in t)
    assert "props" not in node and "k#" in node.replace("[", " ")
    assert "event_params" not in node and "geo#" not in node


def test_export_by_day_has_the_same_rows(spark, folder, tmp_path):
    whole = raw_export(spark, folder, with_items=True)
    by_day = raw_export(spark, folder, with_items=True, by_day=True)
    assert by_day.schema == whole.schema and _sorted(by_day) == _sorted(whole)
    write_export(by_day, f"{tmp_path}/export", in_order=True)
    stored = read_export(spark, f"{tmp_path}/export", "20240101", "20240104")
    assert _sorted(stored.select(*whole.columns)) == _sorted(whole)


def test_tables_that_do_not_need_each_other_are_written_at_once(spark, folder, tmp_path, monkeypatch):
    """Each of these waits for its partner to be begun; one after the other they would never meet."""
    together = ({"events_sessionised", "attribution_history"}, {"fct_events", "fct_event_items"})
    meeting = {name: b for pair in together for b in [threading.Barrier(2)] for name in pair}
    write = plan.overwrite_table

    def met(df, path, *layout):
        if (name := path.rsplit("/", 1)[1]) in meeting:
            meeting[name].wait(timeout=60)
        return write(df, path, *layout)

    monkeypatch.setattr(plan, "overwrite_table", met)
    raw = raw_export(spark, folder, with_items=True, by_day=True)
    tables = plan.build(raw, str(tmp_path), whole_span=True, in_order=True)
    assert tables["fct_events"].count() == raw.count()
    assert tables["fct_event_items"].count() == raw.select(F.explode("items")).count() > 0


def test_a_table_that_fails_fails_the_build(spark, folder, tmp_path, monkeypatch):
    write = plan.overwrite_table

    def broken(df, path, *layout):
        if path.endswith("dim_date"):
            raise OSError("no calendar")
        return write(df, path, *layout)

    monkeypatch.setattr(plan, "overwrite_table", broken)
    with pytest.raises(OSError, match="no calendar"):
        plan.build(raw_export(spark, folder), str(tmp_path), whole_span=True)
