import corpus_pipeline as cp
from tallyloom.llm import decontaminate, toxicity
from tallyloom.llm.frames import table

from .test_decontaminate import brute as contaminated
from .test_line_dedup import brute as deduplicated
from .test_mixing import check
from .test_near_dedup import brute as grouped

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()

    model = toxicity.train(docs, table(spark, SF, "labels"))
    scores = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    clean = cp.drop_toxic(spark, docs, SF).cache()
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {d for d, s in scores.items() if s < 0.5} and len(scores) == len(rows)

    lines = cp.drop_repeated_lines(spark, clean, SF).cache()
    assert lines.columns == columns
    want = {d: t for d, _, _, t in deduplicated([(r.doc_id, r.text) for r in clean.collect()], 10, 1)}
    assert {r.doc_id: r.text or "" for r in lines.collect()} == want

    near = cp.drop_near_copies(spark, lines, SF).cache()
    assert near.columns == columns
    want = {d for d, (_, _, kept) in grouped([(r.doc_id, r.text) for r in lines.collect()], 5).items() if kept}
    assert {r.doc_id for r in near.collect()} == want

    apart = cp.drop_contaminated(spark, near, SF).cache()
    assert apart.columns == columns
    bench = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    want = {x[0] for x in contaminated([(r.doc_id, r.text) for r in near.collect()], bench) if not x[-1]}
    assert {r.doc_id for r in apart.collect()} == want

    mixed = cp.mix_sources(spark, apart, SF)
    assert mixed.columns == [*columns, "size", "source_size", "target", "taken"]
    check([r for r in cp.mixing.mix(apart).collect()])
    whole = cp.run(spark, SF)
    assert sorted((r.doc_id, r.taken) for r in whole.collect()) == sorted((r.doc_id, r.taken) for r in mixed.collect())
