import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from quantflume.llm import queries, repair


def cheapest(rows):
    """(cost, audit) by trying every edit from the end on; at most two inserts in a row are ever of use."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @cache
    def best(i, state, inserted):
        options = [(0, "")] if i == len(rows) and state in (0, 3) else []
        if inserted < 2:
            c, a = best(i, 3 if state == 2 else 2, inserted + 1)
            options.append((c + 2, "I" + a))
        if i < len(rows):
            initial, must_go, cut = rows[i]
            c, a = best(i + 1, state, 0)
            options.append((c + 3, "D" + a))
            if not must_go:
                c, a = best(i + 1, 3 if state == 2 else 2, 0)
                options.append((c + 2 + cut, "R" + a))
                if (state, initial) in step:
                    c, a = best(i + 1, step[state, initial], 0)
                    options.append((c + cut, "K" + a))
        return min(options, default=(10**9, ""))

    return best(0, 0, 0)


def brute(rows):
    """The whole contract for (conv, turn, role, text) rows, in plain loops."""
    blank = " \t\n\x0b\x0c\r"
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        fault = []
        for k, (_, role, text) in enumerate(mine):
            bare = text.strip(blank)
            fault.append("b" if not bare else "d" if (role, text) in [r[1:] for r in mine[:k]] else "t" if bare[-1] not in ".!?" else "")
        turns = [t for t, _, _ in mine if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit = cheapest([(role[:1], f in ("b", "d"), f == "t") for (_, role, _), f in zip(mine, fault, strict=True)])
        lines, at, last = [], 0, ""
        for edit in audit:
            other = "assistant" if last == "u" else "user"
            role, text = (mine[at][1], mine[at][2]) if edit != "I" else (other, "")
            at += edit != "I"
            if edit != "D":
                role = other if edit == "R" else role
                lines.append(f"{role}:{text}")
                last = role[:1]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, key string").repartition(3)
    found = repair.repair_conversations(table, **more).collect()
    got = {r[0]: tuple(r[1:]) for r in found}
    assert len(got) == len(found)
    return got


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.op13_repair(spark, sf_dir).collect()}
    assert got == brute(rows)


def noisy(rng, convs, turns):
    roles = ["user", "assistant", "system", "tool", "", None, "u", "sys"]
    texts = ["Hi.", "Hi.", "what now", "fine!", "", " \t", None, "is it so?", "yes. ", "no"]
    return [(c, rng.choice([t, t, t, t, rng.randint(0, 5), None]), rng.choice(["user", "assistant"][t % 2 : t % 2 + 1] * 6 + roles), rng.choice([f"text {t}.", *texts])) for c in convs for t in range(rng.choice(turns))]


def test_noisy_conversations(spark):
    rng = random.Random(5)
    rows = noisy(rng, [*range(150), None], [0, 1, 2, 3, 5, 9, 17])
    rows += [(900, k, "user", "same.") for k in range(40)] + [(901, 7, "user", "one turn.")] * 30 + [(902, 0, "assistant", "x" * 200_000)]
    rows += [(c, 0, "user", "may be dropped.") for c in range(1000, 1060)]
    want = brute(rows)
    assert run(spark, rows) == want
    # in chunks of a few rows, and by bytes
    assert run(spark, rows, chunk=4) == want
    assert run(spark, rows, chunk_bytes=40) == want
    assert run(spark, []) == {}


def test_a_long_conversation_in_chunks(spark):
    rng = random.Random(6)
    rows = noisy(rng, [1, 2], [700])
    got = run(spark, rows, chunk=50)
    assert got == run(spark, rows)


@pytest.mark.parametrize("seed", range(30))
def test_search_finds_the_least_audit(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 9))]
    ((found, way),) = repair.search(rows).items()
    assert way == cheapest(rows)
    assert found in repair.ENDS
    # cut anywhere, chunks give the same way
    cuts = sorted(rng.sample(range(1, len(rows)), min(3, len(rows) - 1))) if len(rows) > 1 else []
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    tables, costs, ranks = [], [], []
    for part in parts:
        ways = {(s, e): w for s in range(4) for e, w in repair.search(part, s, chunk=True).items()}
        order = sorted({a for _, a in ways.values()})
        tables.append(ways)
        costs.append([[ways.get((s, e), (-1, ""))[0] for e in range(4)] for s in range(4)])
        ranks.append([[order.index(ways[s, e][1]) if (s, e) in ways else -1 for e in range(4)] for s in range(4)])
    cost, path, tail = repair.join_chunks(np.array(costs), np.array(ranks))
    assert (cost, "".join(t[p][1] for t, p in zip(tables, path, strict=True)) + tail) == way
