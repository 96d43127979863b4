from types import SimpleNamespace

import pyarrow as pa

from quernstone.operators import chunk


def test_few_documents_are_python_objects_at_once(spark, monkeypatch):
    """Whatever the batch: a batch of a thousand documents came as one list before."""
    kernels = []
    docs = spark.createDataFrame([(i, f"Text {i}.") for i in range(3)], "doc_id bigint, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: kernels.append(f) or self)
    chunk.fixed(docs, 50, 0)
    n = 1000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(map(str, range(n))), pa.array([f"Text {i}." for i in range(n)])], names=["doc_id", "source", "text"])
    seen = []

    class Watched(SimpleNamespace):
        num_rows = n

        def slice(self, at, size):
            seen.append(min(size, n - at))
            return batch.slice(at, size)

        @property
        def columns(self):
            raise AssertionError("the whole batch")

    out = [r for b in kernels[0](iter([Watched(schema=batch.schema)])) for r in b.to_pylist()]
    assert [r["text"] for r in out] == [f"Text {i}." for i in range(n)]
    assert max(seen) == chunk.SLICE and sum(seen) == n
