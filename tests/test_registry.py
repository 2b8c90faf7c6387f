"""The register of runs."""

import csv
import json

import pytest

from weftlink.plans.registry import COLUMNS, Register, timed


def test_register(tmp_path):
    book = Register(str(tmp_path / "runs.csv"))
    assert book.rows() == []
    one, two = book.start(str(tmp_path / "runs"), "first_try"), book.start(str(tmp_path / "runs"), "second")
    assert one.endswith("v001_first_try") and two.endswith("v002_second")
    book.log(two, "more pairs", {"seconds": 3}, decision="keep", local_f05=0.98765, parent="v001")
    book.log(one, "a start", local_f05=0.9)
    book.set_public("v002", 0.95)
    row = book.log(two, "more pairs, again", local_f05=0.99, notes="x, y")
    assert row["public_f05"] == "0.9500" and row["local_f05"] == "0.9900" and row["decision"] == ""
    assert [r["version"] for r in book.rows()] == ["v001", "v002"]
    assert json.load(open(f"{two}/metrics.json"))["change"] == "more pairs, again"
    with pytest.raises(ValueError, match="no row"):
        book.set_public("v009", 1.0)
    with pytest.raises(ValueError, match="decision"):
        book.log(one, "x", decision="perhaps")
    with pytest.raises(ValueError, match="unknown columns"):
        book.log(one, "x", colour="red")
    with pytest.raises(ValueError, match="no folder"):
        book.log(str(tmp_path), "x")
    with pytest.raises(ValueError, match="lower-case"):
        book.start(str(tmp_path / "runs"), "Not Good")


def test_merged_headers_are_passed_over(tmp_path):
    path = tmp_path / "runs.csv"
    path.write_text("version,date,change\nv001,2020-01-01,a\nversion,date,change\nv002,2020-01-02,b\n")
    book = Register(str(path))
    assert [r["version"] for r in book.rows()] == ["v001", "v002"] and book.rows()[0]["owner"] == ""
    book.set_public("v001", 0.5)
    with open(path) as f:
        rows = list(csv.reader(f))
    assert tuple(rows[0]) == COLUMNS and len(rows) == 3


def test_timed():
    seen = {}
    for _ in range(2):
        with timed(seen, "step"):
            pass
    assert seen["step"] >= 0
