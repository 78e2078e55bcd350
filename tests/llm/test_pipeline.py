"""The pipeline against a version that decides every stage in plain Python."""

import corpus_pipeline
from loomgraph.llm import bpe, decontaminate, toxicity
from loomgraph.llm.tables import table
from tests import oracle
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_jaccard import brute as components

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    import __spark_entry__ as entry

    good = {r[0] for r in oracle.duck("0.001").execute(f"SELECT doc_id FROM ({entry.oracle_sql()['op7_quality_rules']}) WHERE kept").fetchall()}
    docs = sorted((r for r in table(spark, SF, "documents").collect() if r.doc_id in good), key=lambda r: r.doc_id)
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    if model is not None:
        texts = {r.doc_id: toxicity.plain(r.text) for r in docs}
        docs = [
            r for r in docs
            if model.probability(model.raw(texts[r.doc_id], model.token_scores(set(texts[r.doc_id].split())))) < toxicity.CUT
        ]
    kept = {d for d, _, c in components([(r.doc_id, r.text) for r in docs]) if d == c}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    docs = [r for r in docs if r.doc_id in kept and not windows(r.text, items)[1]]
    enc = bpe.encoding()
    want = sorted((r.doc_id, r.text, r.lang, r.source, enc.encode_ordinary(r.text or "")) for r in docs)
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.text, r.lang, r.source, r.ids) for r in out.collect()) == want
    assert len(want) > 50 and out.where("NOT round_trip").count() == 0


def test_stages_keep_columns_and_take_awkward_rows(spark, awkward):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == awkward.columns
    assert corpus_pipeline.STAGES[4][1](spark, awkward, SF).count() == 8


def test_texts_reach_a_worker_once(spark, awkward):
    """A second copy beside the kept column would double what every batch holds in the executor and its workers."""
    benchmark = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    for made in (toxicity.drop_toxic(awkward, None), decontaminate.drop_contaminated(awkward, benchmark), bpe.with_tokens(awkward)):
        sent = made._jdf.queryExecution().analyzed().collectLeaves().head().output().size()
        plan = made._jdf.queryExecution().optimizedPlan()
        while "MapInArrow" not in plan.nodeName():
            plan = plan.children().head()
        below = plan.children().head().output()
        assert below.size() <= sent
        assert sum(below.apply(i).name().lower().endswith(("text", "judged", "scanned", "taken")) for i in range(below.size())) == 1


def test_shift_tables_are_narrow():
    table = decontaminate.build_class(10, {b" ".join(b"w%d" % k for k in range(10)): {1}}).shift
    assert table.itemsize == 1 and table.max() == 8 and table.min() == 0
