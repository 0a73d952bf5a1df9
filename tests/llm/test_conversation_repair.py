"""Conversation repair against a plain version of its contract."""

import hashlib
import itertools
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from foliolake.llm import conversation_repair, edit_search, queries

SF = "/root/testdata/sf0.001"
PATTERN = re.compile(r"(s?(ua)+)?")


def plain_edits(rows):
    """(cost, audit, repaired rows) by trying every edit from the end; rows: (role, text, fault)."""

    @lru_cache(maxsize=None)
    def best(k, out, inserts):
        # ``out`` tells what came out: "" nothing, "s" a system row, "u" or "a" the last one.
        options = []
        if k == len(rows) and out in ("", "a"):
            options.append((0, "", ()))
        wanted = "a" if out == "u" else "u"
        full = {"u": "user", "a": "assistant"}[wanted]
        if inserts < 2:
            cost, audit, rest = best(k, wanted, inserts + 1)
            options.append((cost + 2, "I" + audit, (f"{full}:",) + rest))
        if k < len(rows):
            role, text, fault = rows[k]
            cost, audit, rest = best(k + 1, out, 0)
            options.append((cost + 3, "D" + audit, rest))
            if fault not in ("blank", "duplicate"):
                stay = int(fault == "truncated")
                cost, audit, rest = best(k + 1, wanted, 0)
                options.append((cost + 2 + stay, "R" + audit, (f"{full}:{text}",) + rest))
                if role[:1] == wanted:
                    options.append((cost + stay, "K" + audit, (f"{role}:{text}",) + rest))
                if role[:1] == "s" and out == "":
                    cost, audit, rest = best(k + 1, "s", 0)
                    options.append((cost + stay, "K" + audit, (f"{role}:{text}",) + rest))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    return best(0, "", 0)


def plain_repair(table):
    """{conv_id: result} of (conv_id, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in table:
        own = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, rows = set(), []
        for _, role, text in own:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
            seen.add((role, text))
            rows.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [f for _, _, f in rows]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, repaired = plain_edits(tuple(rows))
        assert PATTERN.fullmatch("".join(r[0] for r in repaired))
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r[c] for c in NAMES) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_the_plain_version(spark):
    table = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert got(queries.op12_conversation_repair(spark, SF)) == plain_repair(table)


@pytest.mark.parametrize("block", [3, 1024])
def test_odd_rows_and_conversations_over_many_parts(spark, block):
    draw = np.random.default_rng(5)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "umpire"]
    texts = ["Yes.", "no", "", " \n", None, "Why?", "a\tb!  ", "x" * 3000, "."]
    rows = [
        (int(c), None if t == 0 else int(t), roles[r], texts[x])
        for c, t, r, x in zip(draw.integers(0, 12, 400), draw.integers(0, 30, 400), draw.integers(0, 8, 400), draw.integers(0, 9, 400))
    ]
    rows += rows[:30] + [(None, k, "user", f"t {k % 3}.") for k in range(9)] + [(99, None, None, None)]
    rows += [(77, k, ["user", "assistant", "assistant"][k % 3], f"line {k % 90}" + "." * (k % 2)) for k in range(230)]
    drops = [c for c in range(100, 400) if zlib.crc32(f"{c}:1".encode()) % 20 == 0][:3]
    rows += [(c, 1, "user", "gone") for c in drops]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, present int")
    repaired = conversation_repair.repaired_conversations(conversation_repair.damaged(table), block)
    want = plain_repair(rows)
    assert drops and want[drops[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(repaired) == want


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversation_repair.repaired_conversations(conversation_repair.damaged(table)).collect() == []


def test_search_proves_the_least_edits():
    faults = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(6):
        for letters in itertools.product("suaoxUA", repeat=n) if n < 5 else itertools.product("suax", repeat=5):
            rows = tuple(
                ("user", "", "blank") if x == "x" else (faults[x.lower()], "t", "truncated" if x.isupper() else "") for x in letters
            )
            assert edit_search.repaired("".join(letters)) == plain_edits(rows)[:2]


def test_parts_compose(spark):
    draw = np.random.default_rng(3)
    for _ in range(60):
        letters = "".join(draw.choice(list("suaoxUASO"), 12))
        best = {edit_search.START: (0, "")}
        for low in range(0, 12, 5):
            new = {}
            for before, after, cost, audit in edit_search.transfers(letters[low : low + 5]):
                if before in best:
                    option = (best[before][0] + cost, best[before][1] + audit)
                    new[after] = min(new.get(after, option), option)
            best = new
        assert min(best[s] for s in (edit_search.START, edit_search.ANSWERED) if s in best) == edit_search.repaired(letters)


def test_a_long_part_is_searched_in_time():
    letters = "".join(np.random.default_rng(2).choice(list("suaoxUAO"), 1024))
    assert len(edit_search.transfers(letters)) >= 8
