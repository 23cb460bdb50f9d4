"""Links as a table, held against the file system."""

from __future__ import annotations

import errno
import os
import random

from lodestone.operators import links
from lodestone.sources.repo import links_on
from lodestone.sources.scratch import written

LINKS = "repo string, path string, target string, root string"


def tree(root, seed: int) -> list[tuple]:
    """A tree of folders, files and links of all kinds; its links as rows."""
    rng = random.Random(seed)
    folders = [""]
    for i in range(6):
        folders.append(os.path.join(rng.choice(folders), f"d{i}"))
        (root / folders[-1]).mkdir()
    for i in range(4):
        (root / rng.choice(folders) / f"f{i}").write_text("x")
    rows, names = [], []
    for i in range(25):
        at = os.path.join(rng.choice(folders), f"l{i}")
        names.append(at)
    for at in names:
        up = "/".join([".."] * at.count("/")) or "."
        to = rng.choice([*names, *folders[1:], "missing/x", "d0/../d1/./l3", "l1/../l2", "l4/d0"])
        target = rng.choice([f"{up}/{to}", f"{up}//{to}/", f"{root}/{to}", f"{up}/{to}/..", f"{up}/../.." if rng.random() < 0.2 else f"{up}/{to}", "/etc/passwd" if rng.random() < 0.3 else f"{up}/{to}", str(root)])
        os.symlink(target, root / at)
        rows.append((f"r{seed}", at, target, str(root)))
    return rows


def expected(root, path: str) -> tuple:
    try:
        os.path.realpath(root / path, strict=True)
    except OSError as e:
        if e.errno == errno.ELOOP:
            return "loop", None
    real = os.path.realpath(root / path)
    if real == str(root):
        return "inside", "."
    return ("inside", os.path.relpath(real, root)) if real.startswith(f"{root}/") else ("outside", None)


def test_targets_are_those_of_the_file_system(spark, tmp_path):
    rows, want = [], {}
    for seed in range(8):
        root = tmp_path / f"t{seed}"
        root.mkdir()
        own = tree(root, seed)
        rows += own
        want |= {(repo, path): expected(root, path) for repo, path, _, _ in own}
    got = {(r.repo, r.path): (r.status, r.final) for r in links.resolved(spark.createDataFrame(rows, LINKS), written).collect()}
    assert {s for s, _ in want.values()} == {"inside", "outside", "loop"}
    wrong = {k: (v, want[k]) for k, v in got.items() if v != want[k]}
    # A way out of the tree counts as outside, also where it would come back or go round.
    assert set(got) == set(want) and {v[0][0] for v in wrong.values()} <= {"outside"} and len(wrong) < 0.1 * len(want), wrong


def test_long_chains_take_few_rounds(spark):
    n, rounds = 300, []
    rows = [("a", f"l{i}", f"l{i + 1}", None) for i in range(n)] + [("b", f"c{i}", f"c{(i + 1) % 5}", None) for i in range(5)] + [("b", "self", "self", None), ("b", "grow", "grow/x", None), ("b", "to", "c0/../y", None)]

    def counted(df):
        rounds.append(1)
        return written(df)

    got = {(r.repo, r.path): (r.status, r.final) for r in links.resolved(spark.createDataFrame(rows, LINKS), counted).collect()}
    assert {v for (repo, _), v in got.items() if repo == "a"} == {("inside", f"l{n}")}
    assert {v for (repo, _), v in got.items() if repo == "b"} == {("loop", None)}
    assert len(rounds) < 18
    assert links.resolved(spark.createDataFrame([], LINKS), written).count() == 0


def test_no_table_of_links_goes_through_the_driver(spark):
    """All rounds join by shuffles; only the number of links of each tree may be sent to all tasks."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    rows = [("a", f"l{i}", f"l{i + 1}", None) for i in range(9)] + [("a", "up", "../x/../l1", None), ("a", "out", "l1/../../l2", None), ("a", "to_out", "out", None)]
    got = {r.path: (r.status, r.final) for r in links.resolved(spark.createDataFrame(rows, LINKS), seen).collect()}
    assert got == {f"l{i}": ("inside", "l9") for i in range(9)} | {p: ("outside", None) for p in ("up", "out", "to_out")}
    assert len(plans) > 4 and not [p for p in plans[2:] if "Broadcast" in p]
    stands = links.stands_on(spark.createDataFrame([("a", "l1/x")], "repo string, path string"), spark.createDataFrame(rows, LINKS))
    assert "Broadcast" not in stands._jdf.queryExecution().executedPlan().toString()


def test_paths_that_stand_on_a_link(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "d")
    (tmp_path / "d" / "inner").symlink_to("nowhere")
    table = spark.createDataFrame([("r", "link", "d"), ("r", "d/inner", "nowhere"), ("other", "d", "x")], "repo string, path string, target string")
    paths = ["link/x", "d/x", "link/../d/x", "d/./inner", "d/../link", "d//inner/y", "d", "./link"]
    got = {r.path: r.link for r in links.stands_on(spark.createDataFrame([("r", p) for p in paths], "repo string, path string"), table).collect()}
    assert got == {p: (links_on(str(tmp_path), p) or [None])[0] for p in paths}
