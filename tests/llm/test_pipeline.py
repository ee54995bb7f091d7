import re

import pytest

import corpus_pipeline
from tesspan.llm import decontaminate, quality
from tesspan.llm.common import table

from .test_decontaminate import brute as brute_contaminated
from .test_jaccard_dedup import shingled, similar
from .test_simhash_dedup import brute as brute_near

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r.doc_id, r.text) for r in before.collect()]
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        kept = sorted(r.doc_id for r in after.collect())
        if name == "quality":
            model = quality.fitted(docs, table(spark, SF, "labels"))
            x = [quality.encode([(t or "").encode().split()]) for _, t in rows]
            want = [d for (d, _), bag in zip(rows, x) if model.scores(*bag)[0] >= 0.5]
        elif name == "exact_dedup":
            first = {}
            for d, t in rows:
                key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
                first[key] = min(d, first.get(key, d))
            want = first.values()
        elif name == "near_dedup":
            # of the components of close fingerprints one document each; of those, no two alike, and none gone without a link
            rest = {d for d, _, c in brute_near(rows) if d == c}
            sets = {d: shingled(t) for d, t in rows if d in rest}
            links = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])]
            assert set(kept) <= rest and not [x for x in links if set(x) <= set(kept)]
            assert all(any(d in x for x in links) for d in rest - set(kept))
            assert all(min(x) in kept or min(x) in {max(y) for y in links} for x in links)
            want = kept
        else:
            want = [r[0] for r in brute_contaminated(rows, items) if not r[5]]
        assert kept == sorted(want), name
        before = after
    out = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in out.collect()) == kept


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = table(spark, SF, "documents").limit(5)
    odd = docs.selectExpr("CAST(NULL AS bigint) AS doc_id", "CAST(NULL AS string) AS text", "lang", "source", "n_chars")
    out = stage(spark, docs.unionByName(odd).unionByName(docs), SF)
    assert out.count() >= 0
    assert stage(spark, docs.limit(0), SF).count() == 0
    if k < 4:
        assert out.columns == docs.columns


def test_clean_documents_stay(spark):
    rows = [(i, f"plain words number {i} " * (i + 1), "en", "s", 1) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert decontaminate.clean_documents(df, table(spark, SF, "benchmark")).count() == 6
