from __future__ import annotations

import numpy as np
import pytest

from tessera.session import memory_status
from tessera.sources import binary

POSTINGS = {"b": [(5, 1), (2, 3)], "ä": [(1, 1)], "a": []}


def test_runs(tmp_path):
    path = str(tmp_path / "run" / "0")
    (tmp_path / "run").mkdir()
    assert binary.write_run(path, POSTINGS) == {"path": path, "num_terms": 3, "num_postings": 3}
    assert [(t, r.tolist()) for t, r in binary.read_run(path)] == [("a", []), ("b", [[2, 3], [5, 1]]), ("ä", [[1, 1]])]
    whole = (tmp_path / "run" / "0").read_bytes()
    (tmp_path / "run" / "0").write_bytes(whole[:-3])
    assert [t for t, _ in binary.read_run(path)] == ["a", "b"]
    with pytest.raises(ValueError, match="terms"):
        binary.write_run(path, {})
    assert binary.remove([path]) == [] and not (tmp_path / "run").exists() and binary.remove([path]) == [path]


def test_posting_file(tmp_path):
    path = str(tmp_path / "p")
    lexicon = binary.write_postings(path, sorted(POSTINGS.items()))
    assert lexicon["b"] == (4, 2) and binary.read_postings(path, *lexicon["b"]).tolist() == [[5, 1], [2, 3]]
    with pytest.raises(OSError, match="expected 3"):
        binary.read_postings(path, 4, 3)
    with pytest.raises(OSError, match="ends"):
        binary.read_postings(path, 999, 1)


def test_numbers():
    assert binary.number(258, np.dtype("<u2")) == b"\x02\x01" and binary.number(1, np.dtype("<u4")) == b"\x01\0\0\0"
    for value, kind in ((-1, "<u2"), (65536, "<u2"), (2**32, "<u4")):
        with pytest.raises(ValueError, match="outside"):
            binary.number(value, np.dtype(kind))


def test_memory(spark):
    rows = memory_status(spark)
    assert rows and all(0 < used <= most for used, most in rows.values())
