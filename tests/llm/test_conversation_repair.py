"""Conversation repair against a plain search over whole label strings."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import conversation_repair as R, queries

SCHEMA = "conv_id long, turn long, role string, text string"
WSP = " \t\n\x0b\x0c\r"


def harmed(rows):
    out = []
    for c, t, role, text in rows:
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 1:
            text = ""
        elif case == 2:
            text = re.sub("[.!?]", "", text)
        elif case == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def cheapest(rows):
    """rows: (role, text, fault). Dijkstra by (cost, labels) over plain prefixes; the states are place, grammar state and inserts in this place."""
    heap, done = [(0, "", 0, 0, 0, ())], set()
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    while True:
        cost, labels, i, g, k, out = heapq.heappop(heap)
        if i == len(rows) and g in (0, 3):
            return cost, labels, list(out)
        if (i, g, k) in done:
            continue
        done.add((i, g, k))
        if k < 4:
            for role in ("user", "assistant"):
                if (g, role[0]) in step:
                    heapq.heappush(heap, (cost + 3, labels + "I", i, step[g, role[0]], k + 1, (*out, role + ":")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 4, labels + "D", i + 1, g, 0, out))
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            if (g, role[:1]) in step:
                heapq.heappush(heap, (cost + more, labels + "K", i + 1, step[g, role[:1]], 0, (*out, f"{role}:{text}")))
            for to in ("user", "assistant"):
                if (g, to[0]) in step:
                    heapq.heappush(heap, (cost + more + 3, labels + "R", i + 1, step[g, to[0]], 0, (*out, f"{to}:{text}")))


def plain(rows, original):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role, hashlib.sha256(text.encode()).digest(), text, t))
    out = {}
    for c in {r[0] for r in original}:
        turns = sorted(by[c])
        seen, marked, count = set(), [], defaultdict(int)
        for _, _, role, _, text, _ in turns:
            bare = text.strip(WSP)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault))
        n = [r[5] for r in turns if r[5] is not None]
        gaps = max(n) - min(n) + 1 - len(set(n)) if n else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, left = cheapest(marked) if turns else (0, "", [])
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def found(df):
    got = [(r["conv_id"], tuple(r)[1:]) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def made(seed, n, turns):
    rnd = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rnd.randrange(turns)):
            text = rnd.choice(["Yes.", "No", "", " \n", "Well!", "a b c?", f"text {t}.", f"text {t}", None, "é漢🙂.", "x. \t"])
            out.append((c, rnd.choice([t, t, t, t + 1, None]), rnd.choice(["user", "assistant", "assistant", "system", "tool", "", None, "user"]), text))
    return out


def test_shortest_paths():
    rnd = random.Random(5)
    kinds = {"d": ("user", "", "blank"), **{r[0] if r != "tool" else "o": (r, "t.", None) for r in ("system", "user", "assistant", "tool")}}
    kinds |= {k.upper(): (v[0], "t", "truncated") for k, v in kinds.items() if k != "d"}
    for _ in range(1500):
        s = "".join(rnd.choice("suaoSUAOduaua") for _ in range(rnd.randrange(9)))
        labels, state, cost = R.walk(s, R.FINISH, 0)
        want = cheapest([kinds[x] for x in s])
        assert (cost + 4 * s.count("d") + 3 * len(R.LAST[state]), "".join(labels) + R.LAST[state]) == want[:2], s
        cut = rnd.randrange(len(s) + 1)
        end = R.before(R.summary(s[cut:]), R.FINISH)
        a, middle, _ = R.walk(s[:cut], end, 0)
        b, last, _ = R.walk(s[cut:], R.FINISH, middle)
        assert (a + b, last) == (labels, state)


def test_rows_of_all_kinds(spark):
    rows = made(1, 400, 12) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hm."), (None, None, None, None), (7000, 5, "user", "a."), (7000, 5, "user", "a."), (7000, 5, "assistant", "b."), (7001, -3, "system", "only.")]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = R.damage(df).withColumns({"sid": F.lit("clash"), "label": F.lit("clash"), "block": F.lit(0), "digest": F.lit("clash")})
    want = {k: v for k, v in plain(harmed(rows), rows).items() if k in {r[0] for r in harmed(rows)}}
    got = found(R.repair(wide))
    assert got.keys() == want.keys()
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}
    assert R.repair(R.damage(df.limit(0))).count() == 0


@pytest.mark.parametrize("bits", [1, 3])
def test_long_conversations_in_segments(spark, monkeypatch, bits):
    """A third of all rows in one conversation, cut into many segments over all tasks."""
    monkeypatch.setattr(R, "SEGMENT", bits)
    rnd = random.Random(3)
    hot = [(1, t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice([f"t {t}.", f"t {t}", "Yes.", ""])) for t in range(300)] + [(1, 150, "user", f"same turn {i}") for i in range(30)]
    rows = hot + [(2, 7, "user", "again.")] * 200 + [(c + 10, t, r, x) for c, t, r, x in made(4, 60, 10)]
    assert found(R.repair(R.damage(spark.createDataFrame(rows, SCHEMA).repartition(8)))) == {k: v for k, v in plain(harmed(rows), rows).items() if k in {r[0] for r in harmed(rows)}}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op13_conversation_repair(spark, sf)) == plain(harmed(rows), rows)
