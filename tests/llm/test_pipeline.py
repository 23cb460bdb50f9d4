"""The pipeline against its stages, each held against a brute-force version on its own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

from .conftest import DOCS, prose
from .test_decontam import brute_leaks
from .test_quality import brute
from .test_simhash import brute_components, brute_fingerprint

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    shared = "\n".join(prose(5000 + i, 12) for i in range(10))
    items = [(i, prose(6000 + i, 20 + i)) for i in range(6)]
    rows, labels = [], []
    for i in range(240):
        text = f"{prose(i, 90)}\n{prose(10_000 + i, 30)}"
        if i % 12 == 0:
            text = prose(i, 20)
        if i % 12 == 1:
            text = rows[i - 11 if i > 11 else 0][1] if i > 12 else text
        if i % 12 == 2:
            text += "\n" + shared + "\n" + prose(20_000 + i, 30)
        if i % 12 == 3:
            text += "\n" + items[i % 6][1] + " " + prose(30_000 + i, 20)
        rows.append((i, text, ("en", "de")[i % 2], ("web", "web", "books", None)[i % 4], len(text)))
        labels.append((i, int(i % 5 > 0), 0))
    for name, data, schema in (("documents", rows, DOCS), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(data, schema).write.parquet(str(where / f"{name}.parquet"))
    return str(where)


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """name -> (rows before, rows after) of each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        after = materialize(stage(spark, docs, sf_dir), "test-stage")
        if name != "source_mixing":
            assert after.columns == docs.columns
        docs, out[name] = after, (before, [tuple(r) for r in after.collect()])
    return out


def test_quality_keeps_what_passes_the_base_rules(steps):
    before, after = steps["quality_rules"]
    passing = {r for r in before if brute(r[1])[0] >= 50 and 100 * brute(r[1])[4] <= 50 * brute(r[1])[0]}
    assert set(after) == passing and len(after) < len(before)


def test_line_dedup_cuts_the_shared_passage(steps):
    before, after = steps["line_dedup"]
    assert len(before) == len(after)
    texts = {r[0]: r for r in after}
    cut = [r for r in before if texts[r[0]][1] != r[1]]
    assert len([r for r in cut if r[0] % 12 == 2]) == 19
    assert all(r[4] == len(r[1]) for r in after)


def test_near_dedup_keeps_the_first_of_each_group(steps):
    before, after = steps["simhash_near_dedup"]
    ordered = sorted(before)
    roots = brute_components([brute_fingerprint(r[1]) for r in ordered])
    assert sorted(after) == [r for i, r in enumerate(ordered) if roots[i] == i]


def test_decontamination_drops_leaks(spark, sf_dir, steps):
    before, after = steps["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaking = {d for d, _ in brute_leaks([r[:2] for r in before], items)}
    assert sorted(after) == sorted(r for r in before if r[0] not in leaking)
    assert len(leaking) >= 15


def test_mixing_takes_from_what_is_left(steps):
    before, after = steps["source_mixing"]
    assert sorted(r[0] for r in after) == sorted(r[0] for r in before)
    assert all(r[1] == len((t[1] or "").split()) for r, t in zip(sorted(after), sorted(before), strict=True))


def test_run_applies_the_stages_in_order(spark, sf_dir, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "source_mixing"]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(steps["source_mixing"][1])


@pytest.fixture(scope="module")
def messy_dir(spark, messy, labels, tmp_path_factory):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing columns."""
    where = tmp_path_factory.mktemp("messy")
    extra = messy.where("doc_id in (6, 8)").withColumn("doc_id", F.lit(None).cast("long"))
    docs = messy.union(extra).withColumns({"n_removed_lines": F.lit(3), "n_lines": F.lit(None).cast("int"), "rid": F.lit("x"), "policy": F.lit(1.5)})
    docs = docs.withColumns({"pairs": F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)), "any": F.parse_json(F.lit('{"x": [1, null]}')), "deep": F.array(F.struct(F.create_map(F.lit(1), F.lit("v")).alias("m.n"))), "day": F.lit("2024-01-02").cast("date"), "raw": F.lit(b"\x00\xff"), "amount": F.lit("1.50").cast("decimal(20,2)")})
    docs.write.parquet(str(where / "documents.parquet"))
    labels.write.parquet(str(where / "labels.parquet"))
    spark.createDataFrame([(1, prose(1, 80)), (None, None), (2, "")], "item_id long, text string").write.parquet(str(where / "benchmark.parquet"))
    return str(where), docs


def test_messy_rows_pass_all_stages(spark, messy_dir):
    docs = messy_dir[1]
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, messy_dir[0]), "test-messy")
        if name != "source_mixing":
            assert after.columns == docs.columns
        docs = after
        if name == "quality_rules":
            assert {r.doc_id for r in docs.collect()} == {None, 4, 5, 6, 8}
        if name == "simhash_near_dedup":
            kept = docs.collect()
            # The copies of 6 and 8 without an id come first and keep their text, as does 4; one of the emptied texts stays.
            assert sorted((r.doc_id for r in kept), key=str) == [4, 5, None, None, None] and [r.text for r in kept if r.doc_id == 5] == [""]
            assert {(r.n_removed_lines, r.n_lines, r.rid, r.policy) for r in kept} == {(3, None, "x", 1.5)}
        if name == "decontamination":
            # The benchmark's text goes.
            assert sorted((r.doc_id for r in docs.collect()), key=str) == [4, 5, None, None]
    assert all(0 <= r.taken <= 2 * r.size for r in docs.collect())
    assert corpus_pipeline.run(spark, messy_dir[0]).count() == docs.count()


def test_empty_tables_pass_all_stages(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
