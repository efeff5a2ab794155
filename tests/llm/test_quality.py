import math
from collections import Counter

import numpy as np

from strataline.llm import quality as Q

from .helpers import DATA, DOCS, clashing, empty, odd_documents, words


def brute(text):
    text = text or ""
    w, seen, dup, marked = words(text), set(), 0, set()
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    for i, x in enumerate(windows):
        if count[x] > 1:
            marked.update(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(marked) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), failed


def test_counts_match_brute_force(spark):
    extra = [(20, "a line here\nother\na line here\n\n \na line here", "en", "x", 1), (21, "w1 w2 w3 w4 w5 " * 3, "en", "x", 1), (22, "#*$%&|<> é# ", "en", "x", 1)]
    tm = lambda n, a: "".join(a[i.bit_count() & 1] for i in range(n))  # noqa: E731  (equal in every polynomial modulo 2**64)
    extra += [(23, tm(4096, "ab") + "\n" + tm(4096, "ba") + "\n" + "x y z " * 3, "en", "x", 1)]
    extra += [(24, " ".join([*"pqrs", tm(2048, "ab"), *"pqrs", tm(2048, "ba")]), "en", "x", 1), (25, "\x0b\x0c\n\x0b\x0c\n a\n a\n a \n", "en", "x", 1)]
    docs = odd_documents(spark, extra)
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = Q.quality(clashing(docs), labels).collect()
    expected = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == expected
    assert all(not r.kept for r in got if r.base_failed)


def test_target_separates(spark):
    good = [(i, " ".join(f"{a}{b}ing" for a in "bcdfg" for b in "aeiou") + f" {i}", "en", "s", 1) for i in range(60)]
    bad = [(100 + i, " ".join(f"Z{j}$$$%%% |" for j in range(40)) + f" {i}", "en", "s", 1) for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in Q.quality(docs, labels).collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(20))


def direct(rows, good):
    """(kept, llr) by id, from dictionaries of slots over all n-grams."""

    def slots(text):
        b = (text or "").encode()
        out = []
        for i in range(len(b) - 3):
            key = b[i]
            for c in b[i + 1 : i + 4]:
                key = key * 0x01000193 % 2**32 ^ c
            out.append(key * 0x9E3779B1 % 2**32 >> 32 - Q.SLOT_BITS)
        return out

    raw, target = Counter(), Counter()
    for i, text in rows:
        raw.update(slots(text))
        if i in good:
            target.update(slots(text))
    share = target.total() / raw.total()
    out = {}
    for i, text in rows:
        s = slots(text)
        llr = sum(math.log((target[x] + Q.PRIOR) / (raw[x] * share + Q.PRIOR)) for x in s) / len(s) if s else 0.0
        out[i] = (not brute(text)[5] and llr >= Q.THRESHOLD, llr)
    return out


def test_query_on_the_driver_tables(spark):
    """Every column of the registered query, the verdict from scratch."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.quality == 1 and not r.toxic}
    expected = direct([(r.doc_id, r.text) for r in docs], good)
    read = lambda name, *columns: spark.read.parquet(f"{DATA}/{name}.parquet").select(*columns)
    got = {r.doc_id: r for r in Q.quality(read("documents", "doc_id", "text"), read("labels", "doc_id", "quality", "toxic")).collect()}
    assert set(got) == set(expected)
    assert sorted(map(tuple, Q.op10_quality(spark, DATA).collect())) == sorted(tuple(r)[:-1] for r in got.values())
    for r in docs:
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(r.text)
        assert abs(x.llr - expected[r.doc_id][1]) < 1e-5
        assert x.kept == expected[r.doc_id][0] or abs(x.llr - Q.THRESHOLD) < 1e-5


def test_a_score_at_the_threshold_is_kept(spark):
    rows = [(i, " ".join(f"{a}{b}" for a in "abcdefg" for b in "xyz") + f" {i % 2}" * 2, "en", "s", 1) for i in range(8)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    low = min(r.llr for r in Q.quality(docs, labels, threshold=-9.0, prior=0.1).collect())
    got = {r.doc_id: r for r in Q.quality(docs, labels, threshold=low, prior=0.1).collect()}
    assert len({r.llr for r in got.values()}) == 2 and all(r.kept for r in got.values())
    above = {r.doc_id: r.kept for r in Q.quality(docs, labels, threshold=math.nextafter(low, 1), prior=0.1).collect()}
    assert above == {i: i % 2 == 0 for i in range(8)}


def test_empty_table_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.quality(empty(spark), labels).count() == 0
    assert {r.llr for r in Q.quality(odd_documents(spark), labels).collect()} == {0.0}


def test_slots_stay_within_documents():
    data = np.frombuffer(b"abcdefgh", np.uint8)
    a, first = Q.slots(data, np.array([0, 3, 8]), 10, 4)
    b, _ = Q.slots(data[3:], np.array([0, 5]), 10, 4)
    assert first.tolist() == [0, 0, 2] and a.tolist() == b.tolist()
