import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import duckdb
import pytest

from strataline.llm import repair as R

from .helpers import DATA

TURNS = "conv_id long, turn long, role string, text string"


def brute(initials, faults, most=3):
    """The best (cost, edits) over all scripts, by exhaustion of a memoised recursion over rows and what was emitted."""

    @lru_cache(None)
    def rest(i, state, inserted):
        ways = []
        if i == len(initials) and state in ("", "a"):
            ways.append((0, ""))
        need = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if inserted < most:
            ways.append((3, "I", i, need, inserted + 1))
        if i < len(initials):
            ways.append((4, "D", i + 1, state, 0))
            if faults[i] not in "bd":
                more = 3 * (faults[i] == "t")
                ways.append((3 + more, "R", i + 1, need, 0))
                if initials[i] == need or initials[i] == "s" and state == "":
                    ways.append((more, "K", i + 1, initials[i], 0))
        best = None
        for w in ways:
            if len(w) == 2:
                found = w
            else:
                tail = rest(*w[2:])
                if tail is None:
                    continue
                found = (w[0] + tail[0], w[1] + tail[1])
            best = found if best is None or found < best else best
        return best

    return rest(0, "", 0)


def test_search_is_exhaustive_searchs():
    for n in range(4):
        for initials in product("sua-", repeat=n):
            for faults in product(".bt", repeat=n):
                got = R.search("".join(initials), "".join(faults))
                assert list(got.values()) == [brute(initials, faults)], (initials, faults)
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(4, 14)
        initials, faults = "".join(rng.choice("sua-") for _ in range(n)), "".join(rng.choice("....bdt") for _ in range(n))
        assert list(R.search(initials, faults).values()) == [brute(initials, faults)]


def expected(rows):
    """Findings and repaired turns of every conversation, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), ""
        for _, role, text in own:
            end = re.findall(r"[^\x20\x09-\x0D]", text)
            faults += "b" if not end else "d" if (role, text) in seen else "." if end[-1] in ".!?" else "t"
            seen.add((role, text))
        initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "-" for _, r, _ in own)
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = brute(tuple(initials), tuple(faults)) if len(own) < 150 else next(iter(R.search(initials, faults).values()))
        at, state, repaired = 0, "", []
        for edit in audit:
            need = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            if edit == "I":
                repaired.append((need, ""))
            else:
                _, role, text = own[at]
                at += 1
                if edit == "D":
                    continue
                repaired.append((role if edit == "K" else need, text))
            state = repaired[-1][0][0]
        assert at == len(own)
        illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(own) - 1))
        body = "\n".join(f"{r}:{t}" for r, t in repaired)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest()), repaired
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def odd_rows():
    rng = random.Random(8)
    texts = ["Done.", "Why?", "cut off", " \n", "", None, "ok! ", "日本。", "long " * 3000 + ".", "a ", "x\x0b"]
    roles = ["user", "user", "assistant", "assistant", "system", None, "", "tool", "unicorn"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "no id."), (None, None, "assistant", "neither."), (-7, 2, "user", "below zero"), (-7, -4, "assistant", "before.")]
    return rows


@pytest.mark.parametrize("size", [1024, 3])
def test_findings_and_turns(spark, size):
    rows = odd_rows()
    want = expected(rows)
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS + ", rank string, digest string").repartition(5)
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in R.findings(docs, size).collect()}
    assert got == {c: w[0] for c, w in want.items()}
    turns = {}
    for r in sorted(R.repair(docs, size).collect(), key=lambda r: (str(r.conv_id), r.seg, r.item)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {c: w[1] for c, w in want.items() if w[1]}


def test_half_of_the_rows_in_one_conversation(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c!", ""]) + (f" {t}." if t % 3 else "")) for t in range(700)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}.") for c in range(2, 180) for t in range(4)]
    want = expected(rows)
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in R.findings(spark.createDataFrame(rows, TURNS), 32).collect()}
    assert got == {c: w[0] for c, w in want.items()}


def damage(rows):
    out = []
    for c, t, role, text in rows:
        shown = [" " if x is None else str(x) for x in (c, t)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_query_with_odd_rows(spark, tmp_path):
    rows = odd_rows() + [(c, 1, "user", "only one.") for c in range(1000, 1060)]
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    want = {c: w[0] for c, w in expected(damage(rows)).items()}
    lost = {r[0] for r in rows} - set(want)
    assert lost
    want |= {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in lost}
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in R.op12_structure_repair(spark, str(tmp_path)).collect()}
    assert got == want


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    rel = con.sql(R.ORACLE_SQL)
    assert sorted(rel.fetchall()) == sorted(tuple(r) for r in R.op12_structure_repair(spark, DATA).select(*rel.columns).collect())


def test_empty(spark):
    none = spark.createDataFrame([], TURNS)
    assert R.findings(none).count() == 0 and R.repair(none).count() == 0
