"""The pipeline's stages on their own input, and run()."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Names that the operators use, or did, for columns of their own.
CLASHING = ["score", "__score", "size", "id", "__id", "row", "key", "__key", "digest", "__d", "__digest", "own_id", "gone_id", "spans", "__spans", "__no", "__source", "st_words", "component_id", "keep_id", "shard", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    own = [f"own {c}" for c in CLASHING]
    long = "".join(f"word{i} " for i in range(200_000))
    odd = spark.createDataFrame([(10**6, None, "en", None, 0, *own), (10**6 + 1, "", "en", "s", 0, *own), (None, "no id", "en", "s", 5, *own),
                                 (10**6 + 2, long, "en", "s", len(long), *own), *[(10**6 + 3, "one row that repeats itself, word for word", "en", "s", 0, *own)] * 3], extra.schema)
    return extra.unionByName(odd)


def test_stages_keep_columns(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING), name
        now = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() > 0


def test_stages_take_empty_tables(spark, docs):
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_quality_keeps_clean_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF).select("doc_id", F.lit(1).alias("kept"))
    seen = labels.join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()
    share = {r.quality: r.share for r in seen}
    assert share[1] > 0.95 and share[0] < 0.2


def test_run_packs_what_the_mix_takes(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.where("n_words > 0").count() == out.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "packing"]


def test_stages_against_brute_force(spark):
    """Each stage on the rows that the last one kept, from the texts alone."""
    import re
    from collections import Counter

    from veriplex.llm import mixing, rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.score for r in rules.scored(docs, spark.read.parquet(f"{SF}/labels.parquet")).select("row.doc_id", "score").collect()}
    now = corpus_pipeline.quality(spark, docs, SF)
    left = {i for i, s in scores.items() if s >= rules.THRESHOLD}
    assert {r.doc_id for r in now.collect()} == left

    best = {}
    for i in left:
        key = re.sub(r"[\x20\x09-\x0D]", "", texts[i].text or "")
        best[key] = min(best.get(key, (0, 10**12)), (-len(texts[i].text or ""), i))
    now = corpus_pipeline.exact(spark, now, SF)
    left = {i for _, i in best.values()}
    assert sorted(r.doc_id for r in now.collect()) == sorted(left)

    def shingles(text):
        found = (text or "").encode().lower().split()
        return {tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))} if found else set()

    sets, root = {i: shingles(texts[i].text) for i in left}, {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(left)
    for n, a in enumerate(order):
        for b in order[:n]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    now = corpus_pipeline.near(spark, now, SF)
    left = {i for i in left if find(i) == i}
    assert sorted(r.doc_id for r in now.collect()) == sorted(left)

    words = lambda t: (t or "").encode().split()
    sizes = Counter()
    for i in left:
        sizes[texts[i].source] += len(words(texts[i].text))
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(sources, mixing.targets([sizes[s] for s in sources]), strict=True))
    kept = spark.createDataFrame([texts[i] for i in sorted(left)], docs.schema)
    mixed = corpus_pipeline.mix(spark, kept, SF).collect()
    taken, most = Counter(), Counter()
    for r in mixed:
        taken[r.source] += len(words(r.text))
        most[r.doc_id] += len(words(r.text))
        assert set(words(r.text)) <= set(words(texts[r.doc_id].text)) and r.n_chars == len(r.text)
    assert all(abs(taken[s] - goals[s]) <= 1 for s in goals) and all(n <= 2 * len(words(texts[i].text)) for i, n in most.items())

    again = spark.createDataFrame(mixed, docs.schema)
    total = Counter()
    for r in corpus_pipeline.packing(spark, again, SF).collect():
        total[r.doc_id] += r.n_words
    assert total == most
