import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from hilbertine.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, kind int, audit string, fault string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repairs(rows, faults):
    """(cost, audit, turns) of every way to edit the rows, with at most two turns inserted at a place."""
    gaps = [""] + ["I" * k for k in (1, 2)]
    edits = [["D"] if f in ("blank", "duplicate") else ["D", "K", "U", "A"] for f in faults]
    for chosen in itertools.product(*edits):
        for extra in itertools.product([(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")], repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for i in range(len(rows) + 1):
                audit += gaps[len(extra[i])]
                turns += [(r, "") for r in extra[i]]
                cost += 3 * len(extra[i])
                if i < len(rows):
                    e, (role, text) = chosen[i], rows[i]
                    audit += "R" if e in "UA" else e
                    cost += {"D": 4, "K": 0}.get(e, 3) + (3 if faults[i] == "truncated" and e != "D" else 0)
                    if e != "D":
                        turns.append(({"U": "user", "A": "assistant"}.get(e, role), text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in turns)):
                yield cost, audit, turns


def by_definition(originals, rows):
    out = {c: (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, *_ in originals}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        pairs, faults = [(r[2], r[3]) for r in own], []
        for i, (role, text) in enumerate(pairs):
            seen = [x for x in re.findall(r"[^\x20\x09-\x0D]", text)]
            faults.append("blank" if not seen else "duplicate" if (role, text) in pairs[:i] else "truncated" if seen[-1] not in ".!?" else "")
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, audit, made = min(repairs(pairs, faults), key=lambda w: w[:2])
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return sorted(out.values(), key=lambda r: (r[0] is not None, r[0] or 0))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "f") for r in rows], SCHEMA)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


TEXTS = ["One.", "Two!", "Three", "", None, " \n", "Four? ", "Five.\nSix", "One.", "é…"]


def random_rows(seed, convs=40, longest=4):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        turn = 0
        for _ in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(TEXTS)))
            turn += rng.choice([0, 1, 1, 1, 3])
    rows += [(None, None, "user", "One."), (None, 5, "assistant", "Two!"), (90, None, "user", "a."), (90, None, "assistant", "b."), (91, 7, None, None), (92, 1, "", "x.")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_every_way_to_edit(spark, seed):
    rows = random_rows(seed, longest=3)
    want = by_definition(rows, damaged(rows))
    table = frame(spark, rows)
    got = result(conversations.repair_report(table, conversations.damaged(table)))
    assert got == want
    assert {x for r in got for x in r[7]} == set("KRDI") and any(r[1] for r in got) and all(sum(r[k] for r in got) for k in range(2, 6))


def test_the_damage(spark):
    rows = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate([("user", "A. b"), ("assistant", "C!"), ("system", None), (None, "d")])]
    rows += [(None, 3, "user", "e."), (4, None, "user", "f."), (None, None, None, None)]
    got = [tuple(r) for r in conversations.damaged(frame(spark, rows)).select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, damaged(rows))) and len(got) != len(rows)


def quadratic(rows):
    """The same programme with whole audits as texts."""
    least = {0: (0, "")}

    def close(at):
        for s, t in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if s in at:
                at[t] = min([at[t] for _ in [0] if t in at] + [(at[s][0] + 3, at[s][1] + "I")])

    close(least)
    for initial, fault in rows:
        new = {}
        for s, (cost, audit) in least.items():
            ways = [(s, cost + 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                ways += [(conversations.KEPT[initial, s], cost + more, "K")] if (initial, s) in conversations.KEPT else []
                ways.append((3 if s == 2 else 2, cost + 3 + more, "R"))
            for t, c, letter in ways:
                new[t] = min([new[t] for _ in [0] if t in new] + [(c, audit + letter)])
        close(new)
        least = new
    return min(least[s] for s in (0, 3) if s in least)


@pytest.mark.parametrize("settle", [1, 2, 7, 256])
def test_settled_audits_are_whole(monkeypatch, settle):
    monkeypatch.setattr(conversations, "SETTLE", settle)
    rng = random.Random(settle)
    for _ in range(60):
        rows = [(rng.choice("uuaasx"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 60))]
        layer = conversations.Layer()
        for r in rows:
            layer.row(*r)
        assert layer.best() == quadratic(rows)


def test_a_long_conversation_and_a_long_text(spark):
    n = 20_000
    rows = [(1, t, ("user", "assistant")[t % 2] if t % 1000 else "tool", f"line {t}.") for t in range(n)] + [(2, 0, "user", "x" * 10_000_000 + "."), (2, 1, "assistant", "y.")]
    audits = conversations.audit_conversations(frame(spark, rows))
    got = {r.conv_id: r for r in audits.collect()}
    assert (got[1].cost, got[1].audit) == (60, "".join("R" if t % 1000 == 0 else "K" for t in range(n))) and (got[2].cost, got[2].audit) == (0, "KK")
    turns = conversations.repair_conversations(frame(spark, rows), audits)
    assert [r.place for r in turns.filter("conv_id = 1").select("place").collect()] == list(range(n))
    digest = {r.conv_id: r.repaired_sha256 for r in conversations.digests(turns).collect()}
    assert digest[2] == hashlib.sha256(("user:" + "x" * 10_000_000 + ".\nassistant:y.").encode()).hexdigest()


def test_repaired_turns(spark):
    rows = [(5, 0, "system", "Be brief."), (5, 2, "assistant", "Hello."), (5, 3, "user", "  "), (6, 1, "tool", "Odd.")]
    table = frame(spark, rows)
    turns = conversations.repair_conversations(table, conversations.audit_conversations(table)).collect()
    assert [(r.place, r.turn, r.role, r.text, r.edit) for r in turns if r.conv_id == 5] == [(0, 0, "system", "Be brief.", "K"), (1, None, "user", "", "I"), (2, 2, "assistant", "Hello.", "K")]
    assert not [r for r in turns if r.conv_id == 6]  # deleting one costs less than completing it


def test_query_and_sql_on_edges(spark, tmp_path):
    rows = random_rows(9, convs=150, longest=8)
    path = f"{tmp_path}/conversations.parquet"
    frame(spark, rows).write.parquet(path)
    got = result(queries.queries()["op11_conversation_repair"](spark, str(tmp_path)))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}/*.parquet'")
    want = con.sql(queries.oracle_sql()["op11_conversation_repair"]).select(", ".join(COLUMNS)).fetchall()
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0)) and len(got) > 150


def test_empty(spark):
    table = frame(spark, [])
    assert conversations.repair_report(table, conversations.damaged(table)).count() == 0
    only_lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    lost = frame(spark, [(only_lost, 0, "user", "gone.")])
    assert result(conversations.repair_report(lost, conversations.damaged(lost))) == [(only_lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
