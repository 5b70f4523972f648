import hashlib
import random
import re
import zlib
from functools import lru_cache

from changegraph.llm import conversation_repair
from changegraph.llm.conversation_repair import EVEN, START, damaged_and_repaired, edits, repaired

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(turns):
    """(cost, audit, states) by memoised recursion over turns and grammar states."""

    @lru_cache(None)
    def best(i, state, added):
        found = [(0, "")] if i == len(turns) and state in ("", "a") else []
        ahead = "a" if state == "u" else "u"
        if added < 3:
            c, a = best(i, ahead, added + 1)
            found.append((c + 2, "I" + a))
        if i < len(turns):
            initial, fault = turns[i]
            c, a = best(i + 1, state, 0)
            found.append((c + 3, "D" + a))
            if fault not in "bd":
                c, a = best(i + 1, ahead, 0)
                found.append((c + 2 + (fault == "t"), "R" + a))
                if initial == ahead or (initial == "s" and state == ""):
                    c, a = best(i + 1, initial, 0)
                    found.append((c + (fault == "t"), "K" + a))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def brute(data):
    out, groups = [], {}
    for conv, turn, role, text in data:
        groups.setdefault(conv, [])
        said = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", said(text))}.get(h, said(text))
        groups[conv] += [(turn, "user" if h == 4 else said(role), text)] * {0: 0, 3: 2}.get(h, 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            last = BLANK.findall(text)
            faults.append("b" if not last else "d" if (role, text) in seen else "t" if last[-1] not in ".!?" else "-")
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit = cheapest(tuple((r[1][:1], f) for r, f in zip(rows, faults)))
        lines = repaired(audit, START, [r[1] for r in rows], [r[2] for r in rows])
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(n, longest, seed):
    rnd = random.Random(seed)
    data = []
    for conv in range(n):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None)) if rnd.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rnd.choice(("Yes.", "No", "What? ", " \n", None, "a.b", "Fine!\t", "x")) if rnd.random() < 0.4 else f"t{rnd.random()}."
            data.append((conv, rnd.choice((turn, turn, turn, turn + 2, None)), role, text))
    return data + [(None, 1, "user", "hi."), (None, 2, "assistant", "hello."), (None, None, None, None), (-7, None, "system", "s.")] + data[:3]


SCHEMA = "conv_id long, turn long, role string, text string, segment long, pos long, fault string, final int"


def found(spark, data):
    out = damaged_and_repaired(spark.createDataFrame([(*r, 1, 2, "f", 3) for r in data], SCHEMA))
    return sorted((tuple(r)[:-1] for r in out.collect()), key=str)


def test_every_short_segment_is_aligned_at_least_cost():
    rnd = random.Random(9)
    for _ in range(1500):
        turns = tuple((rnd.choice("uasx"), rnd.choice("-----tbd")) for _ in range(rnd.randint(1, 7)))
        assert edits(turns, START, True)[EVEN] == cheapest(turns), turns


def test_equal_to_brute_force(spark):
    data = conversations(250, 9, 1)
    assert found(spark, data) == brute(data)


def test_segments_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "SEGMENT", 4)
    data = conversations(60, 40, 2)
    assert found(spark, data) == brute(data)


def test_nothing(spark):
    assert found(spark, []) == []
