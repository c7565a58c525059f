"""The pipeline: each stage on all that its predecessor kept, against the operators and brute force."""

from conftest import DATA
from .helpers import docs

import corpus_pipeline as cp
from nestquery.llm import decontaminate, langid, quality, sentencepieces
from nestquery.llm import ngram_join as nj
from nestquery.llm.queries import ORACLE, QUERIES
from nestquery.llm.tables import table

def test_stages(spark, oracle):
    d, lab, b = table(spark, DATA, "documents"), table(spark, DATA, "labels"), table(spark, DATA, "benchmark")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    stage = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]
    one = cp.quality_rules(spark, d, DATA).cache()
    assert one.columns == d.columns and ids(one) == sorted(r.doc_id for r in quality.quality_scores(d, lab).collect() if r.keep)
    two = stage["language ID"](spark, one, DATA).cache()
    assert two.columns == d.columns and ids(two) == sorted(r.doc_id for r in langid.language_scores(one).collect() if r.language)
    three = stage["n-gram Jaccard join"](spark, two, DATA).cache()
    kept = set(ids(two))
    pairs = [(x, y) for x, y in oracle(ORACLE["op5_ngram_join"].partition("found AS")[0].rstrip().rstrip(",") + " SELECT x.doc_id, y.doc_id FROM sets x JOIN texts s USING (c) JOIN (SELECT * FROM links UNION SELECT rep, rep FROM texts) ON s.rep = a JOIN texts t ON t.rep = b JOIN sets y ON y.c = t.c")[1] if x in kept and y in kept]
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        x, y = sorted((find(x), find(y)))
        root[y] = x
    assert three.columns == d.columns and ids(three) == sorted({find(i) for i in kept})
    four = stage["benchmark decontamination"](spark, three, DATA).cache()
    dirty = {r.doc_id for r in decontaminate.contaminated(three, b).collect()}
    assert four.columns == d.columns and ids(four) == sorted(set(ids(three)) - dirty)
    five = stage["SentencePiece encoding"](spark, four, DATA)
    want = {r.doc_id: r.token_ids for r in sentencepieces.encode(four).collect()}
    assert {r.doc_id: r.token_ids for r in five.collect()} == want
    assert {r.doc_id: r.token_ids for r in cp.run(spark, DATA).collect()} == want

def test_awkward_documents_pass_every_stage(spark):
    rows = [(1, None), (None, "a text without an id, which is kept where it says something"), (2, ""), (3, "a text of its own"), (3, "a text of its own"), (4, "word " * 30_000)]
    everything = [r[0] for r in rows]
    want = {
        "quality rules": [None, 3, 3, 4],  # too short to be judged; without labelled rows nothing is
        "language ID": [],  # no text of a length to make a dictionary of
        "n-gram Jaccard join": everything, "benchmark decontamination": everything, "SentencePiece encoding": everything,
    }
    for name, stage in cp.STAGES:
        for some in (rows, []):
            out = stage(spark, docs(spark, some), DATA)
            kept = sorted((r.doc_id for r in out.collect()), key=str)
            assert kept == sorted(want[name] if some else [], key=str), name
    assert nj.keep_one(docs(spark, rows)).count() == 6

def test_every_operator_is_registered():
    import __spark_entry__ as e

    assert set(QUERIES) | {"pipeline"} <= set(e.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)}

def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from nestquery.llm.tables import shared_dir

    unset = SimpleNamespace(get=lambda key, other: other)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master)))
    known = SimpleNamespace(get=lambda key, other: "hdfs://x/shared/")
    assert shared_dir(SimpleNamespace(conf=known, sparkContext=SimpleNamespace(master="yarn"))) == "hdfs://x/shared"
