"""Python workers outlive their tasks, so what a task freed must go back to the system."""

import pyarrow as pa

from gridpanel.llm import arrowtext as A


def test_memory_goes_back_after_the_last_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(A, "trim", lambda: seen.append("trimmed"))

    def read(batches):
        for batch in batches:
            seen.append(batch.num_rows)
            yield batch

    batches = [pa.RecordBatch.from_pydict({"a": [1, 2]}), pa.RecordBatch.from_pydict({"a": [3]})]
    assert [b.to_pydict() for b in A.handing_back(read)(iter(batches))] == [{"a": [1, 2]}, {"a": [3]}]
    assert seen == [2, 1, "trimmed"]
    assert list(A.handing_back(read)(iter([]))) == []
