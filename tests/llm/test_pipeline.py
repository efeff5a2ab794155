import corpus_pipeline
from strataline.llm import catalog, language

from .helpers import DOCS, clashing, empty, odd_documents, words
from .test_packing import check
from .test_pii import brute as spans_of
from .test_simhash import classes, fingerprint
from .test_substring import brute as substring


def test_stages_match_brute_force(spark, tmp_path):
    passage = " ".join(f"passage{i}" for i in range(60))
    rows = [(i, f"{'stone river cloud north winter' if i % 2 else 'wind over the hills and far away'} number {i} {' '.join(f'w{i}x{j}' for j in range(30))}", "en", "s", 1) for i in range(30)]
    rows += [(30, passage + " first own words here", "en", "s", 1), (31, "second own words there and more of them " + passage, "en", "s", 1), (32, rows[3][1], "en", "s", 1), (33, "123 456", "en", "s", 1), (34, "wind over the hills and far away write to me@example.com please " + " ".join(f"w34x{j}" for j in range(30)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    # language: all but the text without letters
    kept = [(i, t) for i, t, *_ in rows if i != 33]
    assert sorted(r.doc_id for r in language.stage(spark, docs, "").collect()) == [i for i, _ in kept]
    group = classes({fingerprint(t) for _, t in kept}, 4)
    low = {}
    for i, t in kept:
        low.setdefault(group[fingerprint(t)], i)
    kept = [(i, t) for i, t in kept if low[group[fingerprint(t)]] == i]
    left = {i: n - m for i, n, m, _ in substring(kept)}
    cut = {i: t if left[i] == len(words(t)) else t.replace(" " + passage, "") for i, t in kept}
    expected = []
    for i, t in cut.items():
        for s, k, e in reversed(spans_of(t)):
            t = t[:s] + f"[{('EMAIL', 'IP', 'CARD', 'PHONE')[k]}]" + t[e:]
        expected.append(t)
    docs_left = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(cut, expected, strict=True)], DOCS).collect()
    check(corpus_pipeline.run(spark, str(tmp_path)).collect(), docs_left, 2048)


def test_odd_and_empty_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns; and a table without rows."""
    empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    clashing(odd_documents(spark)).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = {r.doc_id for r in got}
    assert {1, 7} <= ids <= {1, 2, 7, 8, 9, None}  # 3 is a copy of 1; 4, 5, 6 and the row of nulls have no letter
    assert sum(r.start == 0 for r in got if r.doc_id == 9) <= 2
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)


def test_catalog_is_whole():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 14))
    assert set(catalog.oracle_sql()) == {"op2_substring_dedup", "op7_warc", "op8_url_filter", "op10_quality", "op11_prefix_trie", "op12_structure_repair"}
    assert len(corpus_pipeline.STAGES) == 5
