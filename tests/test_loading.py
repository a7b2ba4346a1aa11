"""Question files: one scan for all, and checks in the pass that loads them."""

import json

import pytest

from tessella.operators import loading
from tessella.sources import tables


def row(user="q", answer="a", kind="forward_open", split=None, **more):
    messages = [{"role": "user", "content": user}, {"role": "assistant", "content": answer}]
    return json.dumps({"messages": messages, "metadata": {"qa_type": kind, "split": split}, **more})


def test_one_scan_for_many_files(spark, tmp_path):
    names = []
    for k in range(60):
        names.append(str(tmp_path / f"a {k}+%20é.jsonl"))
        (tmp_path / f"a {k}+%20é.jsonl").write_text(json.dumps({"id": k}) + "\n")
    (tmp_path / "dir" / "split=x").mkdir(parents=True)
    (tmp_path / "dir" / "split=x" / "part-1.json").write_text('{"id": 100}\n\n{"id": 101}\n')
    (tmp_path / "dir" / "_SUCCESS").write_text("")
    rows = tables.concatenated(spark, {"train": [*names, f"file://{tmp_path}/dir"], "validation": [names[3], names[3]]}, "id long")
    got = sorted((r.split, r.source, r.id) for r in rows.collect())
    assert got == sorted([("train", k, k) for k in range(60)] + [("train", 60, 100), ("train", 60, 101), ("validation", 0, 3), ("validation", 1, 3)])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan
    for bad, kind in (({}, ValueError), ({"train": []}, ValueError), ({"train": [str(tmp_path / "none")]}, FileNotFoundError)):
        with pytest.raises(kind):
            tables.concatenated(spark, bad, "id long")


def test_bad_rows_are_set_aside_with_reasons(spark, tmp_path):
    lines = [row(id=1), row(user=" ", id=2), row(answer="", id=3), row(kind="reverse_restricted", id=4), row(kind="x", id=5), row(split="validation", id=6), row(split="train", id=7), "{broken", '{"id": 8}']
    (tmp_path / "train.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "valid.jsonl").write_text(row(split="validation", id=9) + "\n" + row(split="train", id=10) + "\n")
    kept, refused, counts = loading.load_questions(spark, {"train": [str(tmp_path / "train.jsonl")], "validation": [str(tmp_path / "valid.jsonl")]}, f"file://{tmp_path}/out", "id long")
    assert sorted((r.id, r.split) for r in kept.collect()) == [(1, "train"), (7, "train"), (9, "validation")]
    reasons = {r.id: r.violation for r in refused.collect()}
    assert counts == {"kept": 3, "refused": 8, "train": 2} and len(reasons) == 8
    assert reasons[None] == "not a JSON object" and reasons[8] == "not exactly two messages" and reasons[4] == "unsafe qa_type" and reasons[10] == "row of another split"
    (tmp_path / "other.jsonl").write_text(row(split="validation", id=11) + "\n")
    with pytest.raises(ValueError):
        loading.load_questions(spark, {"train": [str(tmp_path / "other.jsonl")]}, f"file://{tmp_path}/out2")
