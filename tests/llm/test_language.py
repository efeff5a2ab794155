import math
import random
import zlib

import numpy as np
import pytest

from strataline.llm import language as L

from .helpers import DATA, DOCS, clashing, empty, odd_documents

VOCABULARY = {
    "aa": ["stone", "river", "cloud", "north", "winter", "the", "of"],
    "bb": ["zażółć", "gęślą", "jaźń", "źdźbło", "się", "nie"],
    "cc": ["привет", "мир", "и", "это", "тест", "слово"],
}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    return [(i, " ".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randint(3, 80))), lang, "s", 1) for i in range(300) for lang in [sorted(VOCABULARY)[i % 3]]]


def test_held_out_accuracy_and_columns(spark, corpus):
    docs = clashing(spark.createDataFrame(corpus, DOCS))
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert len(got) == 300 and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in corpus)
    held = [(i, lang) for i, _, lang, *_ in corpus if got[i].held_out]
    assert len(held) > 30 and sum(got[i].lang_pred == lang for i, lang in held) == len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and not any(r.rejected for r in got.values())


def test_held_out_rows_teach_nothing(spark, corpus):
    held = [r for r in corpus if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    changed = [(i, text, "cc" if r in held else lang, s, n) for r in corpus for i, text, lang, s, n in [r]]
    one = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(corpus, DOCS)).collect()}
    two = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(changed, DOCS)).collect()}
    assert one == two


def test_odd_rows(spark, corpus):
    extra = [(1000, None, None, None, None), (1001, "", "aa", "s", 1), (1002, "123 ... !!", "aa", "s", 1), (None, "stone river", "aa", "s", 1), (1003, "ש" * 400, None, "s", 1), (1004, "stone river north " * 40 + "привет мир это " * 40, None, "s", 1), (1005, "stone " * 50000, "aa", "s", 1)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(corpus + extra, DOCS)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002))
    assert got[None].lang_pred == "aa" and got[None].held_out
    assert got[1003].rejected and not got[1004].rejected and got[1005].lang_pred == "aa"


@pytest.mark.parametrize("n", [1, 3, 8])
def test_rare_label_does_not_keep_unknown_languages(spark, corpus, n):
    """A label of few documents, all outside residue 1: foreign texts are rejected, its own are not."""
    rng = random.Random(n)
    ids = [i for i in range(5000, 9000) if zlib.crc32(str(i).encode()) % 5 > 1]
    vocabulary = ["hääyöaie", "kukka", "järvi", "ja", "on", "metsä", "talvi"]
    rare = [(i, " ".join(rng.choice(vocabulary) for _ in range(60)), "dd" if k < n else None, "s", 1) for k, i in enumerate(ids[: n + 20])]
    foreign = [(10000 + i, "".join(rng.choice(letters) for _ in range(800)), None, "s", 1) for i, letters in enumerate(["abcdefghijklmnopqrstuvwxyz  ", "ğışçöüqwx  ", "αβγδεζηθικλμ  ", "אבגדהוזחט  "] * 5)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(corpus + rare + foreign, DOCS)).collect()}
    assert all(got[i].rejected for i, *_ in foreign)
    assert all(got[i].lang_pred == "dd" and not got[i].rejected for i, *_ in rare)
    assert not any(got[i].rejected for i, *_ in corpus)


def test_language_of_residue_1_is_learned(spark, corpus):
    ids = [i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rng = random.Random(6)
    own = [" ".join(rng.choice(["hääyöaie", "kukka", "järvi", "ja", "on", "metsä", "talvi"]) for _ in range(60)) for _ in range(4)]
    rows = [(i, text, "dd", "s", 1) for i, text in zip(ids, own, strict=False)]
    new = [(7000, own[3], None, "s", 1), (7001, "ğışçöüqwx " * 40, None, "s", 1)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(corpus + rows + new, DOCS)).collect()}
    assert all(got[i].lang_pred == "dd" and not got[i].rejected for i in [*ids, 7000]) and got[7001].rejected
    assert not any(got[i].rejected for i, *_ in corpus)


def test_short_texts_calibrate(spark, corpus):
    rows = [(i, " ".join(text.split()[:3]), lang, s, n) for i, text, lang, s, n in corpus]
    foreign = [(10000 + i, "qzxj wvkq " * 30, None, "s", 1) for i in range(3)]
    got = {r.doc_id: r.rejected for r in L.identify(spark.createDataFrame(rows + foreign, DOCS)).collect()}
    assert [i for i, x in got.items() if x] == [10000, 10001, 10002]


def test_no_training_rows(spark):
    assert {r.lang_pred for r in L.identify(odd_documents(spark).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert L.identify(empty(spark)).count() == 0


def test_stage_keeps_clean_documents(spark, corpus):
    docs = clashing(spark.createDataFrame([*corpus, (999, "?? 12", None, None, 1)], DOCS))
    kept = L.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(300))


class Direct:
    """The models over again, from dictionaries."""

    def __init__(self, rows):
        self.level = {}
        for text, lang in rows:
            t = self.level.setdefault(lang, [None, {}, {}, {}, {}])
            for g in self.grams(text):
                t[4][g] = t[4].get(g, 0) + 1
        for t in self.level.values():
            for n in (3, 2, 1):
                for g in t[n + 1]:
                    t[n][g[1:]] = t[n].get(g[1:], 0) + 1

    @staticmethod
    def grams(text):
        s, letters = "   ", [c.lower() if c.isalpha() else " " for c in text]
        for i, c in enumerate(letters):
            if c != " " or (i and letters[i - 1] != " "):
                s += c
        return [s[i : i + 4] for i in range(len(s) - 3)]

    def log_prob(self, lang, g):
        p = 1 / 4096
        for n in range(1, 5):
            table, x = self.level[lang][n], g[-n:]
            ones, twos = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
            d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            after = [v for k, v in table.items() if k[:-1] == x[:-1]]
            if after:
                p = max(table.get(x, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * p
        return math.log(p)

    def predict(self, text):
        grams = self.grams(text)
        ce = {lang: -sum(self.log_prob(lang, g) for g in grams) / len(grams) for lang in sorted(self.level)}
        best = min(ce, key=ce.get)
        return best, 1 / sum(math.exp(-(x - ce[best]) * min(len(grams), 50)) for x in ce.values())


def test_predictions_match_brute_force(spark):
    """Language and score of every row, over overlapping vocabularies and texts of a few letters."""
    rng = random.Random(9)
    words = {"aa": ["der", "die", "und", "in"], "bb": ["de", "la", "en", "un"], "cc": ["the", "in", "an", "end"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 6))) + rng.choice(["", " 12", "!", "\n\t"]), lang, "s", 1) for i in range(90) for lang in [rng.choice(sorted(words))]]
    rows += [(100, "", "aa", "s", 1), (101, None, "aa", "s", 1), (102, "?? 1", None, "s", 1), (103, "End, DER\x00la", None, "s", 1)]
    direct = Direct([(t, lang) for i, t, lang, *_ in rows if lang and t and zlib.crc32(str(i).encode()) % 5])
    for r in L.identify(spark.createDataFrame(rows, DOCS)).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            lang, score = direct.predict(text)
            assert r.lang_pred == lang and abs(r.score - score) < 1e-9


def test_rare_ngrams_go_by_share(spark, monkeypatch):
    """With a floor, tables keep the n-grams of at least that share of the count, whatever the number of rows."""
    monkeypatch.setattr(L, "FLOOR_BITS", 4)
    rows = [("ab" * 50 + "q", "x")]
    for times in (1, 7):
        model = L.fit(spark.createDataFrame(rows * times, "text string, lang string"))
        assert model.files[4, "x"][1] == 2 and all(n <= 16 for _, n in model.files.values())


@pytest.mark.parametrize("floor", [None, 3, 6, 9])
def test_probabilities_sum_to_1(spark, monkeypatch, floor):
    """Over all symbols, after contexts that were seen, rarely seen and never seen, with n-grams dropped and without."""
    monkeypatch.setattr(L, "FLOOR_BITS", floor)
    rng = random.Random(2)
    text = " ".join(rng.choice(VOCABULARY["aa"] + ["q" + c for c in "abcdefgh"]) for _ in range(400))
    model = L.fit(spark.createDataFrame([(text, "x"), ("the end", "y")], "text string, lang string"))
    if floor == 3:
        assert model.files.get((4, "x"), ([], 0))[1] < 10
    for lang in ("x", "y"):
        for context in ("the", " th", "qa ", "   ", "zzz", "iv ", "nor"):
            head = sum(ord(c) << 12 * (3 - i) for i, c in enumerate(context))
            p = np.exp(model.log_prob(lang, head + np.arange(4096)))
            assert abs(p.sum() - 1) < 1e-9, (lang, context)


def test_parts_of_tables_are_one(spark, corpus):
    """Tables cut by many partitions, and by one, give the same scores, bit by bit, under any layout of the rows."""
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts, layout in ((1, 1), (37, 5), (4, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            docs = spark.createDataFrame(corpus, DOCS).repartition(layout)
            model = L.train(docs)
            seen.append({r.doc_id: (r.lang_pred, r.score, r.rejected, r.ce) for r in L.identify(docs, model).collect()})
            if parts == 37:
                assert max(len(p) for p, _ in model.files.values()) > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert seen[0] == seen[1] == seen[2]


@pytest.mark.parametrize("languages", [4, 40])
def test_models_stay_out_of_a_workers_memory(spark, languages):
    """What a worker holds itself does not grow with the number of languages: tables are mapped."""
    rng = random.Random(5)
    letters = [chr(0x61 + i) for i in range(26)] + [chr(0x100 + i) for i in range(100)]
    rows = [("".join(rng.choice(letters) for _ in range(3000)), f"l{k:02d}") for k in range(languages)]
    model = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    key = np.array([0x61626364], np.int64)
    for lang in model.langs:
        model.log_prob(lang, key)
        assert all(isinstance(a.base, np.memmap) or isinstance(a, np.memmap) for t in (1, 4, 14) for _, a in model._parts(t, lang))


class Counted:
    """Direct's models with contexts counted once, for whole tables."""

    def __init__(self, rows):
        self.level = Direct(rows).level
        self.facts, self.known = {}, {}
        for lang, tables in self.level.items():
            for n in range(1, 5):
                context = {}
                for g, v in tables[n].items():
                    t = context.setdefault(g[:-1], [0, 0])
                    t[0] += v
                    t[1] += 1
                ones, twos = sum(v == 1 for v in tables[n].values()), sum(v == 2 for v in tables[n].values())
                self.facts[lang, n] = context, min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def log_prob(self, lang, g):
        if (lang, g) not in self.known:
            p = 1 / 4096
            for n in range(1, 5):
                context, d = self.facts[lang, n]
                x = g[-n:]
                if x[:-1] in context:
                    total, types = context[x[:-1]]
                    p = max(self.level[lang][n].get(x, 0) - d, 0) / total + d * types / total * p
            self.known[lang, g] = math.log(p)
        return self.known[lang, g]

    predict = Direct.predict
    grams = staticmethod(Direct.grams)


def test_query_equals_brute_force_on_the_driver_tables(spark):
    """Every row of the table: language and score of the registered query."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    direct = Counted([(r.text, r.lang) for r in docs.values() if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 5])
    for r in L.op3_language_id(spark, DATA).collect():
        text = docs[r.doc_id].text
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            lang, score = direct.predict(text)
            assert r.lang_pred == lang and abs(r.score - score) < 1e-7, r.doc_id


def test_query_on_the_driver_tables(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = L.op3_language_id(spark, DATA).collect()
    assert len(got) == len(docs) and {r.doc_id for r in got} == set(docs)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.9 * len(held)


def test_kneser_ney_by_hand(spark):
    """Probabilities of all symbols after a context sum to at most 1 and equal a direct computation."""
    texts = ["abab", "abac", "ab"]
    model = L.fit(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"))
    grams = []
    for t in texts:
        padded = "   " + t
        grams += [padded[i : i + 4] for i in range(len(t))]
    level = {4: {}}
    for g in grams:
        level[4][g] = level[4].get(g, 0) + 1
    for n in (3, 2, 1):
        level[n] = {}
        for g in level[n + 1]:
            level[n][g[1:]] = level[n].get(g[1:], 0) + 1
    def prob(g):
        p = 1 / 4096
        for n in range(1, 5):
            table, x = level[n], g[-n:]
            ones, twos = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
            d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            total = sum(v for k, v in table.items() if k[:-1] == x[:-1])
            types = sum(k[:-1] == x[:-1] for k in table)
            if total:
                p = max(table.get(x, 0) - d, 0) / total + d * types / total * p
        return p
    for g in ("   a", "aba", "abab", "abac", "abad", "zzzz", " aba"):
        g = g.rjust(4)
        key = np.array([sum(ord(c) << 12 * (3 - i) for i, c in enumerate(g))], np.int64)
        assert np.isclose(np.exp(model.log_prob("x", key))[0], prob(g)), g
