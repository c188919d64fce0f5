from __future__ import annotations

import json
from types import SimpleNamespace

import pytest

import scaling
from tessera import cli


def test_index_and_search(spark, tmp_path, capsys):
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": f"d{i}", "title": "Physics", "text": f"note {i} of album{i}"}) + "\n" for i in range(5)) + "bad\n")
    (tmp_path / "q.txt").write_text("physics\n\nmissing words\n")
    found = cli.run_index(spark, SimpleNamespace(corpus=str(tmp_path / "c.jsonl"), index=str(tmp_path / "ix"), max_docs=4))
    assert set(found) == {"Index Size", "Elapsed Time", "Number of Lists", "Average List Size"} and found["Number of Lists"] == 6
    assert "invalid JSON" in capsys.readouterr().err
    lines = cli.run_search(spark, SimpleNamespace(index=str(tmp_path / "ix"), queries=str(tmp_path / "q.txt"), ranker="BM25", k=3, stats=True))
    report = json.loads(capsys.readouterr().err.splitlines()[-1])
    assert report["num_queries"] == 2 and report["num_early"] == 1 and report["ms_a_query"] > 0
    answers = [json.loads(x) for x in lines]
    assert [a["Query"] for a in answers] == ["physics", "missing words"] and [r["ID"] for r in answers[0]["Results"]] == ["d0", "d1", "d2"] and answers[1]["Results"] == []


def test_arguments():
    for bad in (["index", "-c", "x", "-i", "y", "-m", "0"], ["index", "-c", "x", "-i", "y", "--threads", "0"], ["search", "-i", "x", "-q", "y", "-r", "other"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)
    assert cli.parser().parse_args(["search", "-i", "x", "-q", "y", "-r", "bm25"]).ranker == "BM25"


def test_speedup_table():
    table = scaling.summary([{"threads": 1, "Elapsed Time": 8.0}, {"threads": 4, "Elapsed Time": 4.0}])
    assert [(r["speedup"], r["efficiency"]) for r in table] == [(1.0, 1.0), (2.0, 0.5)]


def test_all_rejects(spark, tmp_path, capsys):
    (tmp_path / "c.jsonl").write_text('{"id": 1, "text": "good line"}\n' + "bad\n" * 35)
    cli.run_index(spark, SimpleNamespace(corpus=str(tmp_path / "c.jsonl"), index=str(tmp_path / "ix"), max_docs=None))
    lines = [x for x in capsys.readouterr().err.splitlines() if "reject" in x or "invalid JSON" in x]
    assert len(lines) == 36 and lines[0].endswith(":2: invalid JSON") and lines[-2].endswith(":36: invalid JSON") and lines[-1] == "35 lines rejected"
