import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from opslens.llm import conversations as c

ROWS = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def plain_search(rows):
    """Least (cost, audit) by a table over all nodes, row by row."""
    best = {0: (0, "")}

    def inserts(best):
        for _ in range(2):
            for s, (cost, audit) in list(best.items()):
                t = 3 if s == 2 else 2
                best[t] = min(best.get(t, (9e9, "")), (cost + 3, audit + "I"))
        return best
    for initial, fault in rows:
        best, new = inserts(best), {}
        for s, (cost, audit) in best.items():
            ways = [(4, "D", s)]
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                if initial in {0: "su", 1: "u", 2: "a", 3: "u"}[s]:
                    ways.append((more, "K", {"s": 1, "u": 2, "a": 3}[initial]))
                ways.append((more + 3, "R", 3 if s == 2 else 2))
            for w, letter, t in ways:
                new[t] = min(new.get(t, (9e9, "")), (cost + w, audit + letter))
        best = new
    best = inserts(best)
    return min(best[s] for s in (0, 3) if s in best)


def plain(rows):
    """Damaged rows (conv, turn, role, text) -> the contract's rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks, seen = [], set()
        for turn, role, text in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
            seen.add((role, text))
            marks.append((role[:1], fault))
        cost, audit = plain_search(marks)
        kept, i = [], 0
        for letter in audit:
            if letter == "D":
                i += 1
            elif letter == "K":
                kept.append(f"{mine[i][1]}:{mine[i][2]}")
                i += 1
            else:
                last = kept[-1][0] if kept else ""
                kept.append(("assistant" if last == "u" else "user") + ":" + (mine[i][2] if letter == "R" else ""))
                i += letter == "R"
        turns = [t for t, _, _ in mine if t is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        faults = [f for _, f in marks]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3), illegal,
                     cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def found(df):
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_search_against_a_table():
    rng = np.random.default_rng(1)
    for n in [0, 1, 2, 3] + [int(x) for x in rng.integers(4, 14, 300)]:
        rows = [("sua x"[rng.integers(0, 5)], int(rng.choice([0, 0, 0, 1, 2, 3]))) for _ in range(n)]
        assert c.search(rows, 0, c.ENDS, True) == plain_search(rows)


def test_search_of_all_short_conversations():
    for n in range(5):
        for rows in itertools.product([("s", 0), ("u", 0), ("a", 0), ("u", 1), ("a", 3)], repeat=n):
            assert c.search(list(rows), 0, c.ENDS, True) == plain_search(rows)


def test_query(spark):
    from opslens.llm import queries

    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    want = plain(plain_damage(rows))
    empty = (0,) * 6 + ("", hashlib.sha256().hexdigest())
    assert found(queries.op11_conversations(spark, SF)) == {conv: want.get(conv, empty) for conv in {r[0] for r in rows}}


@pytest.mark.parametrize("piece", [1, 2, 7])
def test_cut_conversations(spark, piece):
    """Pieces of a few rows give what the whole gives."""
    rng = np.random.default_rng(8)
    rows = []
    for conv in range(30):
        for turn in range(int(rng.integers(1, 40))):
            t = None if rng.random() < 0.05 else turn - int(rng.random() < 0.1)
            rows.append((conv, t, str(rng.choice(["system", "user", "assistant", "tool"])), str(rng.choice(["Yes.", "No", " ", f"{turn}!", f"{turn}.", f"{turn}?"]))))
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    assert found(c.digest(c.repair(df, piece), df)) == plain(rows)


def test_edge_cases(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, 0, "user", "a." * 300_000), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"),
            (2, 5, "", ""), (2, 9, "uncle", "x."), (3, 0, "system", "only"), (4, 7, "ä", "é.\n\n"), (4, 7, "assistant", "z.")]
    df = spark.createDataFrame(rows, ROWS)
    filled = [(a, b, " " if r is None else r, " " if t is None else t) for a, b, r, t in rows]
    assert found(c.digest(c.repair(df), df)) == plain(filled)
    extra = df.selectExpr("*", "1 AS uid", "2 AS key", "3 AS again", "4 AS piece", "5 AS cost")
    assert found(c.digest(c.repair(extra), extra)) == plain(filled)
    assert c.digest(c.repair(df.limit(0)), df.limit(0)).count() == 0
    assert found(c.digest(c.repair(df.where("conv_id = 1")), df))[4] == (0,) * 6 + ("", hashlib.sha256().hexdigest())
    damaged = [tuple(r) for r in c.damaged(df).collect()]
    assert sorted(damaged, key=str) == sorted(plain_damage(rows), key=str)


def test_repaired_rows_follow_the_pattern(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    for r in c.repair(c.damaged(table)).where("n_pieces = 1").collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in r.repaired))
