from collections import defaultdict

import corpus_pipeline
from auditlake.llm import quality
from auditlake.llm.packing import Encoder

from .test_decontaminate import brute as contaminated
from .test_jaccard_join import brute as grouped
from .test_line_dedup import brute as lines
from .test_packing import want_pieces

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]

    def step(name, docs):
        out = stages[name](spark, docs, DATA)
        if name != "best-fit packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        return spark.createDataFrame(out.collect(), out.schema)

    text = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    one = step("quality classifier", docs)
    good = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert text(one) == [r for r in text(docs) if r[0] in good] and 0 < one.count() < docs.count()

    two = step("line dedup", one)
    assert text(two) == sorted((i, t) for i, _, _, t in lines(text(one)))

    three = step("n-gram Jaccard join", two)
    stay = {i for i, _, c in grouped(text(two), 5, 80, 100) if i == c}
    assert text(three) == [r for r in text(two) if r[0] in stay]

    four = step("benchmark decontamination", three)
    bad = {r[0] for r in contaminated(text(three), items) if r[5]}
    assert text(four) == [r for r in text(three) if r[0] not in bad]

    five = step("best-fit packing", four).collect()
    assert sorted(((*r[:5],) for r in five), key=repr) == want_pieces(text(four), Encoder()._exact, 1024)
    bins = defaultdict(list)
    for r in five:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all([0, *(sum(x) for x in sorted(b))][:-1] == [x[0] for x in sorted(b)] and sum(x[1] for x in b) <= 1024 for b in bins.values())

    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(tuple(r)[:5] for r in five)
