import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from nodetide.llm import repair

INITIALS = re.compile("(s?(ua)+)?")


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def exhaustive(turns):
    """The least (cost, audit) of all edits with up to two insertions in each gap, and its repaired turns."""
    found = []
    gaps = ["", "u", "a", "ua", "au"]
    marks = faults(turns)
    choices = [[("D", None)] if m in ("blank", "duplicate") else [("K", t[1]), ("R", "user"), ("R", "assistant"), ("D", None)] for t, m in zip(turns, marks)]
    for edits in itertools.product(*choices):
        base = sum({"K": 0, "R": 1, "D": 2}[e] + (5 if e != "D" and m == "truncated" else 0) for (e, _), m in zip(edits, marks))
        for put in itertools.product(gaps, repeat=len(turns) + 1):
            k = sum(map(len, put))
            if k > 3:
                continue
            audit, said = "", []
            for i in range(len(turns) + 1):
                for c in put[i]:
                    audit, said = audit + "I", [*said, ({"u": "user", "a": "assistant"}[c], "")]
                if i < len(turns):
                    e, role = edits[i]
                    audit += e
                    if e != "D":
                        said = [*said, (role, turns[i][2])]
            if INITIALS.fullmatch("".join(r[:1] or "?" for r, _ in said)):
                found.append((base + 5 * k, audit, said))
    return min(found, key=lambda f: f[:2])


def repaired_directly(turns):
    """Dynamic programme over whole strings."""
    best = {0: (0, "", ())}
    marks = faults(turns)

    def better(states, state, entry):
        if state not in states or entry[:2] < states[state][:2]:
            states[state] = entry

    def inserted(best):
        for _ in range(3):
            out = dict(best)
            for s, (c, a, said) in best.items():
                role = repair.GIVEN[s]
                better(out, repair.NEXT[s][role[0]], (c + 5, a + "I", (*said, (role, ""))))
            best = out
        return best

    for (_, role, text), mark in zip(turns, marks):
        out = {}
        for s, (c, a, said) in inserted(best).items():
            better(out, s, (c + 2, a + "D", said))
            if mark in ("blank", "duplicate"):
                continue
            more = 5 if mark == "truncated" else 0
            if role[:1] in repair.NEXT[s]:
                better(out, repair.NEXT[s][role[:1]], (c + more, a + "K", (*said, (role, text))))
            given = repair.GIVEN[s]
            better(out, repair.NEXT[s][given[0]], (c + 1 + more, a + "R", (*said, (given, text))))
        best = out
    return min((e for s, e in inserted(best).items() if s in (0, 3)), key=lambda e: e[:2])


def run(turns, **kw):
    conversation = repair.Conversation(**kw)
    for (turn, role, text), fault in zip(turns, faults(turns)):
        conversation.add(turn, role, text, fault)
    return conversation.end()


def digest(said):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()


def random_turns(rng, n):
    roles = ["user", "assistant", "system", "tool", ""]
    texts = ["Yes.", "No!", "cut off", "", " \t", "Is it?", "ü."]
    return [(i, rng.choices(roles, [5, 5, 2, 1, 1])[0], rng.choice(texts) + (str(rng.randrange(3)) + "." if rng.random() < .6 else "")) for i in range(n)]


def test_against_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        turns = random_turns(rng, rng.randrange(0, 4))
        cost, audit, said = exhaustive(turns)
        got = run(turns)
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, digest(said))


def test_against_whole_strings():
    rng = random.Random(4)
    for _ in range(150):
        turns = random_turns(rng, rng.randrange(1, 60))
        cost, audit, said = repaired_directly(turns)
        got = run(turns)
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, digest(said))


def test_colliding_hashes_do_not_matter():
    rng = random.Random(5)
    hit = 0
    for _ in range(60):
        turns = random_turns(rng, 40)
        audits = repair.Audits(hash_of=lambda h, e: (h + ord(e)) % 3)
        got = run(turns, audits=audits)
        hit += audits.collisions
        assert (got["cost"], got["audit"]) == repaired_directly(turns)[:2]
    assert hit


def test_no_collisions_else():
    rng = random.Random(6)
    for _ in range(40):
        audits = repair.Audits()
        run(random_turns(rng, 200), audits=audits)
        assert audits.collisions == 0


def test_long_conversation_takes_linear_memory():
    turns = [(i, "user" if i % 3 else "assistant", f"turn {i}" + "." * (i % 5 > 0)) for i in range(20_000)]
    audits = repair.Audits()
    got = run(turns, audits=audits)
    assert len(audits.parent) < 12 * len(turns) and len(got["audit"].replace("I", "")) == len(turns)


def plain(rows):
    """Damage and repair of whole conversations in Python."""
    groups = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        kept = groups.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        marks = faults(turns)
        known = [t for t, _, _ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, said = repaired_directly(turns)
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[marks.count(f) for f in repair.FAULTS],
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest(said), list(said))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    made = [(c, t, r, x) for c in range(60) for t, r, x in random_turns(rng, rng.randrange(1, 14))]
    made += [(None, t, r, x) for t, r, x in random_turns(rng, 9)] + [(70, None, "user", "a."), (70, None, None, None), (70, 3, "user", "b."), (70, 3, "assistant", "c.")]
    made += [(71, 1, "user", "word " * 200_000 + "."), (71, 2, "assistant", "é!"), (71, 2, "assistant", "é!")] + [made[0], made[0]]
    dropped = next(t for t in range(1000) if zlib.crc32(f"72:{t}".encode()) % 20 == 0)
    return [*made, (72, dropped, "user", "gone.")]


def test_damage_and_repair_with_spark(spark, rows):
    df = spark.createDataFrame([(c, t, r, x, "clash", 1) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, kind string, copy int")
    hurt = repair.damaged(df)
    want = plain(rows)
    got = {r["conv"]: tuple(r)[1:] for r in repair.audit(hurt).collect()}
    assert got == {c: v[:-1] for c, v in want.items()}
    said = {}
    for r in repair.repaired(hurt).orderBy("conv", "place").collect():
        said.setdefault(r["conv"], []).append((r["role"], r["text"]))
    assert said == {c: v[-1] for c, v in want.items() if v[-1]}


def test_one_exchange(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plan = repair.audit(repair.damaged(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.audit(repair.damaged(df)).count() == 0 and repair.repaired(repair.damaged(df)).count() == 0
    assert repair.audit(repair.damaged(df)).select(F.col("conv")).schema["conv"].dataType.simpleString() == "string"
