"""What workers keep between tasks."""

import time

import pyarrow as pa

from quernstone.llm import common


def batches():
    return [pa.RecordBatch.from_pydict({"text": ["one", "two"]})]


def test_idle_workers_forget(monkeypatch):
    monkeypatch.setattr(common, "IDLE_S", 0.3)
    common.LEARNT["x"] = 1
    assert sum(b.num_rows for b in common.pieces(batches(), operator="x")) == 2 and common.LEARNT == {"x": 1}
    time.sleep(0.1)
    list(common.pieces(batches(), operator="x"))  # another task within that time
    time.sleep(0.25)
    assert common.LEARNT == {"x": 1}
    time.sleep(0.3)
    assert common.LEARNT == {}


def test_a_task_at_work_keeps_what_it_has(monkeypatch):
    monkeypatch.setattr(common, "IDLE_S", 0.1)
    common.LEARNT["x"] = 1
    list(common.pieces(batches(), operator="x"))
    at_work = common.pieces(batches(), operator="x")
    next(at_work)
    time.sleep(0.3)
    assert common.LEARNT == {"x": 1}
    at_work.close()
    time.sleep(0.3)
    assert common.LEARNT == {} and not common._BUSY["tasks"]


def test_other_operators_drop_it():
    common.LEARNT["x"] = 1
    list(common.pieces(batches(), operator="y"))
    assert "x" not in common.LEARNT
