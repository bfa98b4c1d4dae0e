"""Pieces are found by the task's own thread: Spark has a task for each core already."""

from __future__ import annotations

import os
import subprocess
import sys

import pyarrow as pa

from skyfold.llm import sentencepiece_codec
from skyfold.llm.queries import PIECE_MODEL

COUNT = f"""
import os
from skyfold.llm import sentencepiece_codec

def threads():
    return len(os.listdir("/proc/self/task"))

with open({PIECE_MODEL!r}, "rb") as file:
    data = file.read()
codec, before = sentencepiece_codec.codec(data), threads()
texts = [f"some words and {{i}} ünïcode ▁ 雪" for i in range(200)]
ids, parity = sentencepiece_codec.encode_batch(data, texts)
assert all(parity)
sentencepiece_codec.decode_batch(data, ids)
print(threads() - before)
"""


def test_the_library_starts_no_threads():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = {key: value for key, value in os.environ.items() if key != "TOKENIZERS_PARALLELISM"}
    found = subprocess.run(
        [sys.executable, "-c", COUNT], capture_output=True, text=True, env=environment | {"PYTHONPATH": root}, timeout=120
    )
    assert found.returncode == 0, found.stderr
    assert int(found.stdout) == 0


def test_identifiers_are_joined_once(monkeypatch):
    """A slice's identifiers are joined to be compared, and written as they were joined."""
    calls = []
    plain = sentencepiece_codec.flat
    monkeypatch.setattr(sentencepiece_codec, "flat", lambda ids: calls.append(len(ids)) or plain(ids))

    class Rows:
        def mapInArrow(self, function, schema):  # noqa: N802
            return list(function([pa.record_batch({"doc_id": [1, 2, 3], "text": ["some words", None, "some words more"]})]))

    monkeypatch.setattr(sentencepiece_codec, "identified", lambda *_: Rows())
    (batch,) = sentencepiece_codec.encode(None, PIECE_MODEL)
    assert calls == [3]
    ids = batch.column("ids").to_pylist()
    assert [len(x) for x in ids] == batch.column("n_tokens").to_pylist() and ids[1] == []
    assert sentencepiece_codec.codec(open(PIECE_MODEL, "rb").read()).decode(ids) == ["some words", "", "some words more"]
