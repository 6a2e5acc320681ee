"""The pipeline on the smallest documents: every stage's decision against a plain version."""

import re
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def test_stages(spark):
    import corpus_pipeline as c
    from test_text_operators import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in c.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = c.written(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == c.COLUMNS and set(after) <= set(before)
        if name == "language_id":
            assert len(after) >= 0.98 * n
        if name == "near_duplicates":
            comp = brute_components([(i, r.text, "") for i, r in before.items()], 5, 80)
            assert set(after) == {i for i, (_, root) in comp.items() if i == root}
        if name == "decontamination":
            flat = lambda t: " ".join(t.lower().split())
            items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            exact = {i for i, r in before.items() if any(f" {x} " in f" {flat(r.text)} " for x in items)}
            assert exact <= set(before) - set(after) and len(before) - len(after) <= len(exact) + 3
        if name == "secret_scan":
            assert set(after) == set(before) and not any(re.search("[0-9a-f]{16}", r.text) for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
    out = c.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == docs.count() and all(r.round_trip and r.n_tokens * 4 == len(r.bpe_ids) for r in out)


def test_rows_without_or_with_repeated_ids(spark, tmp_path):
    """Null and repeated ids cost no document its place, in any stage."""
    import corpus_pipeline as c

    words = lambda i, n=60: " ".join(f"word{(i * 97 + k * 31) % 997}" for k in range(n))
    item = " ".join(f"bench{k}" for k in range(20))
    hexes = "deadbeefdeadbeef12"
    rows = [(None, words(1)), (None, words(2)), (5, words(3)), (5, words(4)), (6, words(5) + " " + hexes), (7, words(5) + " " + hexes), (None, words(6) + " " + item), (8, None), (8, ""), (None, words(1))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = []
    for name, stage in c.STAGES[1:-1]:
        docs = c.written(stage(spark, docs, str(tmp_path)), name)
        sizes.append(docs.count())
    # equal texts become one row, texts without words stay; the row with the passage goes; secrets go, their document stays
    assert sizes == [8, 7, 7]
    out = docs.collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 0, 5, 5, 6, 8, 8] and not any(hexes in (r.text or "") for r in out)
    tokens = c.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(tokens) == 7 and all(r.round_trip for r in tokens)
    none = docs.limit(0)
    for _, stage in c.STAGES:
        none = stage(spark, none, str(tmp_path)) if none.columns == c.COLUMNS else none
    assert none.count() == 0
