"""Extra columns whose names clash, in whatever case, with those that operators and stages use; nulls, empties, repeats, empty tables."""

import pytest

import corpus_pipeline as cp
from tallyloom.llm import decontaminate, language_id, language_model, line_dedup, mixing, near_dedup, quality, token_counts, toxicity
from tallyloom.llm.frames import remainder

EXTRA = [
    "mix", "Size", "Items", "Toxicity", "SPANS", "N_Words", "n_HIT", "Hits", "Offending", "Quality_Score", "Lang_Pred", "Lang_Score", "N_Lines", "N_Dropped", "Drops", "Row_Key", "N_Tokens", "Prefix_Tokens",
    "Truncated", "Odd_Id", "Set_A", "Set_B", "Taken", "TARGET", "Source_Size", "Kept_Id", "id", "node", "Key", "label",
]
ROWS = [
    (1, "Some words here\nshared line\nand the end of it", "a"), (2, "some words here\nshared line\nand the end of it", "a"), (2, "another text of this id altogether", "b"), (3, None, None), (4, "", "b"), (None, "no id at all", "a"),
    (3, None, None), (5, "you idiot fool. fine.", "b"), (5, "you idiot fool. fine.", "b"), *((i, f"text {i} with shared words\nshared line\nwords of {i} alone {'idiot fool' if i % 4 == 0 else 'good'}", "ab"[i % 2]) for i in range(10, 50)),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return frame.selectExpr("*", "'en' as lang", "length(text) as n_chars", *(f"{i} as `{c}`" for i, c in enumerate(EXTRA)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark for the stages."""
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(10, 50)], "doc_id long, toxic int, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("x", "another text of this id"), ("y", None), ("z", "")], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def operators(spark, docs, folder):
    labels, bench = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    toxic = toxicity.train(docs, labels)
    good = quality.train(docs, labels)
    return {
        "find_contamination": lambda d: decontaminate.find_contamination(d, bench), "decontaminate": lambda d: decontaminate.decontaminate(d, bench), "cut_spans": lambda d: decontaminate.decontaminate(d, bench, mode="span"),
        "shards": lambda d: decontaminate.find_contamination(d, bench, shard_bytes=8),
        "near_dedup": near_dedup.dedup, "groups": near_dedup.group, "toxicity": lambda d: toxicity.score(d, toxic), "locate": lambda d: toxicity.locate(d, toxic), "reject": lambda d: toxicity.reject(d, toxic),
        "quality": lambda d: quality.score(d, good), "keep_good": lambda d: quality.keep_good(d, good), "language_model": lambda d: language_model.score(d, remainder("doc_id", 5) != 1),
        "language_id": lambda d: language_id.identify(d, language_id.train(d)), "mixing": mixing.mix, "lines": lambda d: line_dedup.dedup_lines(d), "first_lines": lambda d: line_dedup.dedup_lines(d, min_docs=2, keep="first"),
        "counts": token_counts.count_tokens, "prefixes": token_counts.prefix_counts, "truncate": lambda d: token_counts.truncate(d, 5),
    }


NAMES = ["find_contamination", "decontaminate", "cut_spans", "shards", "near_dedup", "groups", "toxicity", "locate", "reject", "quality", "keep_good", "language_model", "language_id", "mixing", "lines", "first_lines", "counts", "prefixes", "truncate"]


@pytest.fixture(scope="module")
def known(spark, docs, folder):
    return operators(spark, docs, folder)


@pytest.mark.parametrize("name", NAMES)
def test_operator(spark, docs, known, tmp_path, name):
    out = known[name](docs)
    out.write.parquet(f"file://{tmp_path}/out")  # fails where two columns differ by case alone
    written = spark.read.parquet(f"file://{tmp_path}/out").collect()
    if name not in ("decontaminate", "near_dedup", "reject", "keep_good"):
        assert len(written) == len(ROWS)
    made = {c for c in out.columns if c not in docs.columns}
    for i, c in enumerate(EXTRA):  # what isn't replaced by a result of that name is as it was
        if c in out.columns and c not in made:
            assert {r[c] for r in written} == {i}
        elif name not in ("groups", "language_model"):
            assert c.lower() in {m.lower() for m in made}
    assert known[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(len(cp.STAGES)))
def test_stage(spark, docs, folder, k):
    name, stage = cp.STAGES[k]
    out = stage(spark, docs, folder)
    rows = out.collect()
    if k < len(cp.STAGES) - 1:
        assert out.columns == docs.columns and all(r[c] == i for r in rows for i, c in enumerate(EXTRA))
    if name in ("toxicity", "line_dedup"):
        assert sum(r.text is None for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    if name == "line_dedup":
        assert len(rows) == len(ROWS) and not any("shared line" in (r.text or "") for r in rows)
    if name == "near_dedup":
        ids = [r.doc_id for r in rows]
        assert ids.count(1) == 1 and ids.count(2) == 1 and ids.count(5) == 1 and ids.count(3) == 1 and ids.count(None) == 1
        assert [r.text for r in rows if r.doc_id == 2] == ["another text of this id altogether"]
    if name == "decontamination":
        assert len(rows) == len(ROWS) - 1
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_pipeline_of_an_empty_table(spark, docs, folder):
    docs.limit(0).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert cp.run(spark, folder).count() == 0
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    kept = cp.run(spark, folder).collect()
    assert kept and not any("idiot" in r.text for r in kept if r.doc_id and r.doc_id >= 10)
