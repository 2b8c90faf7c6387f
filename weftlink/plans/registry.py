"""A register of runs in one small CSV file: a row per version, with its scores and its parent."""

from __future__ import annotations

import csv
import datetime
import json
import os
import re
import subprocess
import time
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

# The columns, in order, and what may be decided about a run.
COLUMNS = ("version", "date", "group", "change", "local_f05", "mock_f05", "cand_recall", "public_f05", "commit", "notes", "owner", "parent", "decision")
DECISIONS = ("", "KEEP", "DROP", "INVESTIGATE")
_FOLDER = re.compile(r"v(\d{3})_[a-z0-9_]+")


def commit(folder: str = ".") -> str:
    """The short id of the commit that is checked out, marked if files differ from it; ``unknown`` outside a repository."""
    try:
        run = lambda *a: subprocess.run(("git", *a), cwd=folder, capture_output=True, text=True, check=True).stdout.strip()
        return run("rev-parse", "--short", "HEAD") + ("-dirty" if run("status", "--porcelain", "--untracked-files=no") else "")
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


class Register:
    """The rows of one file, in the order of their versions."""

    def __init__(self, path: str):
        self.path = path

    def rows(self) -> list[dict[str, str]]:
        """All rows; header lines that a merge has left among them are passed over, columns an older file lacks are empty."""
        if not os.path.exists(self.path):
            return []
        with open(self.path, newline="", encoding="utf-8") as f:
            return [{c: r.get(c) or "" for c in COLUMNS} for r in csv.DictReader(f) if r["version"] != "version"]

    def _put(self, row: dict[str, str]) -> None:
        others = [r for r in self.rows() if r["version"] != row["version"]]
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        fresh = f"{self.path}.new"
        with open(fresh, "w", newline="", encoding="utf-8") as f:
            out = csv.DictWriter(f, COLUMNS, lineterminator="\n")
            out.writeheader()
            out.writerows(sorted([*others, row], key=lambda r: r["version"]))
        os.replace(fresh, self.path)

    def start(self, root: str, slug: str) -> str:
        """A new folder with the next version's number."""
        taken = [int(m[1]) for name in (os.listdir(root) if os.path.isdir(root) else ()) if (m := _FOLDER.fullmatch(name))]
        folder = os.path.join(root, f"v{max(taken, default=0) + 1:03d}_{slug}")
        if not _FOLDER.fullmatch(os.path.basename(folder)):
            raise ValueError(f"{slug!r} must be of lower-case letters, digits and underscores")
        os.makedirs(folder)
        return folder

    def log(self, folder: str, change: str, metrics: Mapping | None = None, decision: str = "", **values) -> dict[str, str]:
        """Puts a run's row in the place of an earlier one of its version, whose public score stays, and its figures in its folder."""
        found = _FOLDER.fullmatch(os.path.basename(folder.rstrip("/")))
        if not found:
            raise ValueError(f"{folder} is no folder of a run")
        if unknown := set(values) - set(COLUMNS):
            raise ValueError(f"unknown columns {sorted(unknown)}")
        if decision.strip().upper() not in DECISIONS:
            raise ValueError(f"the decision is one of {DECISIONS}, not {decision!r}")
        version = f"v{found[1]}"
        before = next((r for r in self.rows() if r["version"] == version), {})
        text = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
        row = dict.fromkeys(COLUMNS, "") | {"public_f05": before.get("public_f05", "")} | {k: text(v) for k, v in values.items()}
        row |= {"version": version, "date": datetime.date.today().isoformat(), "change": change, "commit": commit(), "decision": decision.strip().upper()}
        self._put(row)
        with open(os.path.join(folder, "metrics.json"), "w", encoding="utf-8") as f:
            json.dump(row | {"metrics": dict(metrics or {})}, f, indent=2, default=float)
        return row

    def set_public(self, version: str, score: float) -> None:
        row = next((r for r in self.rows() if r["version"] == version), None)
        if row is None:
            raise ValueError(f"{version} has no row")
        self._put(row | {"public_f05": f"{score:.4f}"})


@contextmanager
def timed(timings: dict[str, float], name: str) -> Iterator[None]:
    """Adds the seconds that the block takes under ``name``."""
    began = time.perf_counter()
    try:
        yield
    finally:
        timings[name] = timings.get(name, 0.0) + time.perf_counter() - began
