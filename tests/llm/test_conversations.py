from __future__ import annotations

import random
import re

from millrace.llm import conversations as c


def brute(rows):
    said = {}
    for conv, turn, role, text in set(rows):
        said.setdefault(conv, []).append((turn, role, text))

    def key(t):
        return tuple((x is not None, x if x is not None else "") if not isinstance(x, int) else (True, x) for x in t)

    whole = {conv: tuple((r, t) for _, r, t in sorted(turns, key=key)) for conv, turns in said.items()}
    kept = {}
    for conv, turns in whole.items():
        if any(len(o) > len(turns) and o[:len(turns)] == turns for o in whole.values()):
            continue
        if any(o == turns and (x is not None, x or 0) < (conv is not None, conv or 0) for x, o in whole.items()):
            continue
        kept[conv] = turns
    return kept


def make(rng):
    rows = []
    for conv in range(12):
        turns = [("user" if i % 2 == 0 else "assistant", f"say {rng.randrange(3)}") for i in range(rng.randint(1, 5))]
        rows += [(conv, i, *t) for i, t in enumerate(turns)]
    rows += [(50, i, "user", f"long {i}") for i in range(300)]
    rows += [(60 + n, i, "user", f"long {i}") for n in range(5) for i in range(10 * n + 1)]
    rows += [(70, i, "user", f"long {i}") for i in range(300)]
    rows += [(80, 0, None, None), (80, 1, "assistant", None), (81, 0, None, None), (82, 0, None, ""), (83, 0, "", None)]
    rows += [(None, 0, "user", "nobody's"), (None, 1, "assistant", "yes"), (84, 0, "user", "nobody's")]
    rows += [(85, None, "user", "first"), (85, 0, "user", "second"), (86, 0, "user", "first"), (87, 0, "user", "b"), (87, 0, "user", "a")]
    return rows + rows[:7]


def test_maximal_conversations_equal_brute_force(spark):
    rows = make(random.Random(3))
    log = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, n string, part int").repartition(5)
    got = {}
    for r in c.render(log).collect():
        got.setdefault(r["conv_id"], []).append((r["n"], r["rendered"], r["turns"], r["trained"]))
    want = brute(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert sorted(got[conv]) == [
            (i + 1, f"<|{role or ''}|>\n{text or ''}\n<|end|>\n", len(turns), role == "assistant") for i, (role, text) in enumerate(turns)]
    joined = {r["conv_id"]: r["text"] for r in c.join_turns(c.render(log)).collect()}
    assert joined[50] == "".join(x for _, x, _, _ in sorted(got[50]))


def test_empty_table_and_native_plan(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.render(none).collect() == []
    plan = c.render(none)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
