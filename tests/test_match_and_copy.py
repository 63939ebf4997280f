"""Matches of many dies at once against a plain loop, and copies of tables."""

import math
import os
import random

import pandas as pd

from lotwise.functions.lineage import shared_folder
from lotwise.operators import learning
from lotwise.sources.tables import copy_tables

DIE = ["panel_id", "component_row", "component_col"]


def by_loop(rows):
    found = []
    for die in sorted({r[:3] for r in rows}):
        own = [r for r in rows if r[:3] == die]
        free = [r for r in own if r[3] == "system_b"]
        for r in own:
            if r[3] == "system_a" and free:
                near = min(free, key=lambda b: math.hypot(b[5] - r[5], b[6] - r[6]))
                if math.hypot(near[5] - r[5], near[6] - r[6]) <= r[7]:
                    free.remove(near)
                    found.append((die[0], r[4], near[4]))
    return found


def test_dies_match_as_by_a_loop(monkeypatch):
    rng = random.Random(3)
    rows = sorted((f"P{rng.randrange(4)}", rng.randrange(3), 0, rng.choice(["system_a", "system_b"]), f"k{k:04d}", rng.randrange(9) / 2, rng.randrange(9) / 2, 1.5) for k in range(400))
    rows.sort(key=lambda r: (*r[:3], r[4]))
    frame = pd.DataFrame(rows, columns=[*DIE, "source_system", "defect_key", "x", "y", "match_mm"])
    for pairs in (1, 50, 1 << 20):  # cut within a die as well
        monkeypatch.setattr(learning, "PAIRS", pairs)
        got = learning.match_dies(frame, DIE)
        assert list(got[["panel_id", "a_key", "b_key"]].itertuples(index=False, name=None)) == by_loop(rows)
    assert len(learning.match_dies(frame.iloc[:0], DIE)) == 0


def test_copies_add_each_key_once_and_write_once(spark, tmp_path):
    rows = spark.createDataFrame([(k % 7, k) for k in range(50)], "key long, value long")
    folder, shared = f"{tmp_path}/copy", f"{shared_folder(spark).removeprefix('file:')}/lotwise-core"
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    assert [copy_tables(spark, {"t": part}, folder, {"t": ["key"]})["t"] for part in (rows.filter("key < 3"), rows, rows)] == [3, 4, 0]
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/t").collect())) == [(k, k) for k in range(7)]
    assert not os.path.isdir(shared) or set(os.listdir(shared)) == before  # no second copy on the side
