from __future__ import annotations

import pyarrow as pa
import pytest

from notelake.llm import memory


def test_memory_is_released_when_a_task_ends_or_fails(monkeypatch):
    calls = []
    monkeypatch.setattr(memory, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(memory.trimmed(lambda bs: bs)(iter([batch, batch]))) == [batch, batch] and calls == [1]

    def fails(batches):
        yield next(batches)
        raise ValueError

    with pytest.raises(ValueError):
        list(memory.trimmed(fails)(iter([batch])))
    assert calls == [1, 1]


def test_release_runs_anywhere(monkeypatch):
    memory.release()
    monkeypatch.setattr(memory.ctypes, "CDLL", lambda name: (_ for _ in ()).throw(OSError(name)))
    memory.release()
