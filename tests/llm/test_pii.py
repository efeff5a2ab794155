import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from strataline.llm import common as C
from strataline.llm import pii as P

from .helpers import DATA, DOCS, clashing, empty, odd_documents, words

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["aB1@..-%+ x", "0123456789 -..", "+0123 ().-1", "12@.ab+ -()é"])
def test_base_spans_match_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
        assert P.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["a" * 100000 + "@", "1" * 100000, "+1" + " " * 100000, "1." * 50000, "@" * 100000, "a@" * 50000, "1 " * 50000, "(1" * 50000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    P.loose_spans(text, P.base_spans(text))
    assert time.time() - began < 10


def planted():
    rows = [(i + 20, f"noise {i} words here contact us: +1 (2{i % 10}{i // 10 % 10}) 555-{1000 + i} end", "en", "s", 1) for i in range(40)]
    rows += [(200 + i, f"some other text {i} contact us: 0{i}71 555 {1000 + i} tail", "en", "s", 1) for i in range(5)]
    return [*rows, (300, "in the year 1234567 things", "en", "s", 1), (301, "mail a.b@c.de or 1.2.3.4 or 4111111111111111", "en", "s", 1)]


def test_query(spark):
    docs = odd_documents(spark, planted())
    got = P.find(clashing(docs)).collect()
    expected = Counter()
    for r in docs.collect():
        spans = brute(r.text or "")
        count = [sum(k == j for _, k, _ in spans) for j in range(4)]
        expected[r.doc_id, *count, hashlib.sha256(P.joined(spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == expected
    assert all(r.n_added == (200 <= (r.doc_id or 0) < 205) for r in got)
    assert next(r for r in got if r.doc_id == 202).spans.startswith("phone:")
    assert P.find(empty(spark)).count() == 0


def test_scores_match_brute_force(spark):
    rng = random.Random(8)
    occ = [(p, p % 7, 3, rng.randint(0, 30), None) for p in range(6) for _ in range(40)]
    occ = [(p, s, k, i, i < 14) for p, s, k, i, _ in occ]
    totals = {s: 40 + 5 * s for s in range(7)}
    got = P.score_patterns(spark.createDataFrame(occ, "pattern long, slot int, kind int, instance long, seed boolean"), spark.createDataFrame(list(totals.items()), "slot int, total long"), confidence=0.3)
    links = Counter(occ)
    r = {(k, i): float(seed) for _, _, k, i, seed in links}
    for _ in range(P.ROUNDS):
        c, fillers = {}, Counter()
        for (p, s, k, i, _), n in links.items():
            c[p, k] = c.get((p, k), 0) + n * r[k, i] / totals[s]
            fillers[p, k] += r[k, i] >= 0.5
        c = {x: min(v, 0.999) for x, v in c.items() if fillers[x] >= P.SUPPORT and v >= 0.3}
        left = {}
        for p, _, k, i, seed in links:
            if not seed and (p, k) in c:
                left[k, i] = left.get((k, i), 1.0) * (1 - c[p, k])
        r = {x: 1.0 if v == 1.0 and x not in left else 1 - left[x] if x in left else float(any(s and (k, i) == x for _, _, k, i, s in links)) for x, v in r.items()}
    assert {(x.pattern, x.kind): round(x.confidence, 6) for x in got.collect()} == {x: round(v, 6) for x, v in c.items()}


@pytest.mark.parametrize("bits", [P.SLOT_BITS, 18])
def test_unrelated_words_do_not_lower_confidence(spark, monkeypatch, bits):
    """Many occurrences of a word and of a pair whose hashes begin with the same 18 bits as `us:` and `contact us:`."""
    monkeypatch.setattr(P, "SLOT_BITS", bits)
    tried = [f"q{i}" for i in range(1 << 21)]
    data = np.frombuffer("".join(tried).encode(), np.uint8)
    end = np.cumsum([len(x) for x in tried])
    key = C.span_hashes(data, np.concatenate([[0], end[:-1]]), end)
    contact, us = (C.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)])) for x in (b"contact", b"us:"))
    one = lambda w: C.mix(w + np.uint64(1)) >> np.uint64(46)
    two = lambda w: C.mix(contact * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(2)) >> np.uint64(46)
    word = tried[np.flatnonzero(one(key) == one(us))[0]]
    pair = "contact " + tried[np.flatnonzero(two(key) == two(us))[0]]
    extra = [(400 + i, f"{word} {pair} " * 50, "en", "s", 1) for i in range(4)]
    docs = spark.createDataFrame([(0, "", "en", "s", 1), *planted(), *extra], DOCS)
    assert sorted(r.doc_id for r in P.find(docs).collect() if r.n_added) == [200, 201, 202, 203, 204]


def test_context_totals_match_brute_force(spark):
    docs = odd_documents(spark, planted()).coalesce(1)
    expected = Counter()
    for r in docs.collect():
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        expected.update(w)
        expected.update(zip(w, w[1:], strict=False))
    raw = {}
    for x in expected:
        _, _, one, two = P._contexts(np.frombuffer((x if isinstance(x, str) else " ".join(x)).encode(), np.uint8), np.array([0, len((x if isinstance(x, str) else " ".join(x)).encode())]))
        raw[int((one if isinstance(x, str) else two).view(np.int64)[0])] = expected[x]
    some = dict(list(raw.items())[::2])
    got = P.context_totals(P._keyed(docs), spark.createDataFrame([(k,) for k in some], "pattern long"))
    assert {r.pattern: r.total for r in got.collect()} == some


def all_spans(rows):
    """The spans column of each row over again: contexts, totals, rounds and discovery from dictionaries."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    total, occ, base_of = Counter(), [], []
    for d, (_, text) in enumerate(rows):
        text, w = text or "", [(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", lower(text))]
        total.update((x,) for _, x in w)
        total.update((a, b) for (_, a), (_, b) in zip(w, w[1:], strict=False))
        base = brute(text)
        base_of.append(base)
        for s, k, e, seed in [(*x, True) for x in base] + [(*x, False) for x in P.loose_spans(text, base)]:
            at = max(i for i, (start, _) in enumerate(w) if start <= s)
            occ += [((*(x for _, x in w[at - back : at - back + min(back, 2)]),), d, s, k, e, text[s:e], seed) for back in (1, 2) if at >= back]
    confidence = {}
    for _ in range(P.ROUNDS):
        miss = {}
        for p, k, x in {(p, k, x) for p, _, _, k, _, x, seed in occ if not seed and (p, k) in confidence}:
            miss[k, x] = miss.get((k, x), 1.0) * (1 - confidence[p, k])
        sure = {(k, x) for _, _, _, k, _, x, seed in occ if seed}
        r = lambda k, x: 1.0 if (k, x) in sure else 1 - miss.get((k, x), 1.0)
        score, fillers = Counter(), {}
        for p, _, _, k, _, x, _ in occ:
            score[p, k] += r(k, x) / total[p]
            if r(k, x) >= 0.5:
                fillers.setdefault((p, k), set()).add(x)
        confidence = {y: min(v, 0.999) for y, v in score.items() if v >= P.CONFIDENCE and len(fillers.get(y, ())) >= P.SUPPORT}
    out = []
    for d, (i, _) in enumerate(rows):
        added = {(s, k, e) for p, dd, s, k, e, _, seed in occ if dd == d and not seed and (p, k) in confidence}
        out.append((i, P.joined({*base_of[d], *added})))
    return Counter(out)


@pytest.mark.parametrize("filler", [0, 5000, 40000])
def test_spans_match_brute_force_at_any_size(spark, filler):
    """The planted patterns are found however many other documents there are."""
    rng = random.Random(filler)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [*planted(), *((10**6 + i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(20)) + rng.choice(["", " 12345678", " +1 (222) 555-1234"]), "en", "s", 1) for i in range(filler))]
    got = P.find(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.spans) for r in got) == all_spans([r[:2] for r in rows])
    assert sorted(r.doc_id for r in got if r.n_added) == [200, 201, 202, 203, 204]


def test_query_on_the_driver_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = P.op4_pii(spark, DATA).collect()
    assert Counter((r.doc_id, r.spans) for r in got) == all_spans([(r.doc_id, r.text) for r in docs])


def test_stage_masks(spark):
    docs = clashing(odd_documents(spark, planted()))
    kept = P.stage(spark, docs, "")
    got = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert got[301] == "mail [EMAIL] or [IP] or [CARD]" and got[200] == "some other text 0 contact us: [PHONE] tail" and got[4] is None
    assert got[7] == next(r.text for r in docs.collect() if r.doc_id == 7)


def test_mask_merges_overlaps():
    assert P.mask("abcdef", [(1, 0, 3), (2, 3, 4)]) == "a[EMAIL]ef"


def test_empty_stage(spark):
    assert P.stage(spark, spark.createDataFrame([], DOCS), "").count() == 0
