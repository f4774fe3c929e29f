"""Structure repair of conversations: the cheapest edits that give turns `system? (user assistant)+`, with an audit of them.

Roles count by their initials. A turn is kept (cost 0), given the role user or assistant (1) or deleted (2); an empty user or
assistant turn may be inserted anywhere (5). Blank and duplicate turns have to be deleted; a truncated one that stays costs
5 more. Of equally cheap audits the least by ASCII is taken.

The dynamic programme goes over a conversation's turns once, with the best audit of each state of the grammar. Audits are
persistent: a node is one edit with its parent, so the states share their common prefixes. Every node has a rolling hash of
its whole audit and binary-lifting ancestors: of two equally cheap audits the longest common prefix is found by halving
steps over ancestors of equal hash, the next edit decides, and the prefix is verified by its node: states never hold the same
audit twice, so equal audits are one node, and equal hashes of two nodes are a collision. A digest of the repaired turns
goes along with each state, so no text is kept: what a conversation needs in memory are its nodes.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from nodetide.llm.common import _arrow_schema, partitions, prepare

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAULTS = ("blank", "duplicate", "truncated")
#: Grammar: state -> the initial that may follow and the state after it; the end is allowed in START and DONE.
START, SYSTEM, USER, DONE = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": DONE}, DONE: {"u": USER}}
#: The role that a rerole or insertion gives in a state.
GIVEN = {START: "user", SYSTEM: "user", USER: "assistant", DONE: "user"}
LEGAL = {"su", "ua", "au"}
#: White space of the contract: blank, tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
MASK, BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Audits as linked nodes; node 0 is the empty one."""

    def __init__(self, hash_of: Callable[[int, str], int] | None = None):
        self.parent, self.depth, self.edit = array("q", [0]), array("q", [0]), [""]
        self.hash, self.up = array("q", [0]), [array("q", [0])]
        self.hash_of = hash_of or (lambda h, e: (h * BASE + ord(e)) % MASK)
        self.collisions = 0

    def add(self, node: int, edit: str) -> int:
        """The audit of `node` and one more edit."""
        new = len(self.parent)
        self.parent.append(node)
        self.depth.append(self.depth[node] + 1)
        self.edit.append(edit)
        self.hash.append(self.hash_of(self.hash[node], edit))
        if self.depth[new] >> len(self.up):
            self.up.append(array("q", bytes(8 * new)))
        at = node
        for k, level in enumerate(self.up):
            level.append(at)
            at = self.up[k][at] if k + 1 < len(self.up) else 0
        return new

    def _at_depth(self, node: int, depth: int) -> int:
        step = self.depth[node] - depth
        for k in range(step.bit_length()):
            if step >> k & 1:
                node = self.up[k][node]
        return node

    def _same(self, x: int, y: int) -> bool:
        """Whether two prefixes are equal: by hash, verified by the node."""
        if self.hash[x] != self.hash[y]:
            return False
        self.collisions += x != y
        return x == y

    def less(self, x: int, y: int) -> bool:
        """Whether audit x comes before audit y by ASCII."""
        depth = min(self.depth[x], self.depth[y])
        a, b = self._at_depth(x, depth), self._at_depth(y, depth)
        if self._same(a, b):
            return self.depth[x] < self.depth[y]
        for k in reversed(range(len(self.up))):
            if not self._same(self.up[k][a], self.up[k][b]):
                a, b = self.up[k][a], self.up[k][b]
        return self.edit[a] < self.edit[b]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.parent[node]
        return "".join(reversed(out))


class Conversation:
    """Takes the turns of one conversation in order and ends with its result."""

    def __init__(self, audits: Audits | None = None):
        self.audits = audits or Audits()
        self.best = {START: (0, 0, hashlib.sha256(), 0)}  # state -> cost, node, digest, turns
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal, self.before = 0, None
        self.first_turn = self.last_turn = None
        self.distinct_turns = 0

    def _offer(self, states: dict, state: int, cost: int, node: int, edit: str, source: tuple, said: tuple | None) -> None:
        """Enter an audit (node and edit) for a state if it is cheaper, or as cheap and less, than what is there.

        Entries are (cost, node, digest and turns of the source, what the edit says); a node is made where it is entered or compared.
        """
        there = states.get(state)
        if there is not None and there[0] < cost:
            return
        new = self.audits.add(node, edit)
        if there is None or cost < there[0] or self.audits.less(new, there[1]):
            states[state] = (cost, new, source, said)

    @staticmethod
    def _said(states: dict) -> dict:
        """The entries with their digests carried on."""
        out = {}
        for state, (cost, node, (digest, turns), said) in states.items():
            if said is not None:
                digest = digest.copy()
                digest.update((("\n" if turns else "") + said[0] + ":" + said[1]).encode("utf-8", "surrogatepass"))
                turns += 1
            out[state] = (cost, node, digest, turns)
        return out

    def _insertions(self) -> None:
        """Let every state be reached by inserted turns too; one turn at a time, two are the most that can help."""
        fresh = list(self.best)
        for _ in range(2):
            offers = {s: (c, n, (d, t), None) for s, (c, n, d, t) in self.best.items()}
            before = {s: entry[1] for s, entry in offers.items()}
            for state in fresh:
                cost, node, digest, turns = self.best[state]
                role = GIVEN[state]
                self._offer(offers, NEXT[state][role[0]], cost + INSERT, node, "I", (digest, turns), (role, ""))
            fresh = [s for s, entry in offers.items() if before.get(s) != entry[1]]
            self.best = self._said(offers)

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.distinct_turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        self._insertions()
        states: dict = {}
        stays = TRUNCATED if fault == "truncated" else 0
        for state, (cost, node, digest, turns) in self.best.items():
            source = (digest, turns)
            self._offer(states, state, cost + DELETE, node, "D", source, None)
            if fault in ("blank", "duplicate"):
                continue
            to = NEXT[state].get(initial)
            if to is not None:
                self._offer(states, to, cost + stays, node, "K", source, (role, text))
            given = GIVEN[state]
            self._offer(states, NEXT[state][given[0]], cost + REROLE + stays, node, "R", source, (given, text))
        self.best = self._said(states)

    def end(self) -> dict:
        self._insertions()
        ends = [self.best[s] for s in (START, DONE) if s in self.best]
        best = ends[0]
        for other in ends[1:]:
            if (other[0], 0) < (best[0], 0) or other[0] == best[0] and self.audits.less(other[1], best[1]):
                best = other
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.distinct_turns
        return {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": best[0], "audit": self.audits.text(best[1]),
                "repaired_sha256": best[2].hexdigest()}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", kinds: int = 20) -> DataFrame:
    """Columns conv, turn, role, text of the turns after the damage that the checksum of `conv:turn` chooses; nulls are one blank.

    A dropped turn leaves a row without role, so that its conversation is not forgotten.
    """
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = (F.crc32(F.concat(known(conv), F.lit(":"), known(turn)).cast("binary")) % kinds).cast("int")
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), known(role).alias("role"), known(text).alias("text"), kind.alias("kind"))
    return rows.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).when(F.col("kind") != 0, F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _in_order(turns: DataFrame) -> DataFrame:
    """The turns with their faults, each conversation whole and in order in one partition. One shuffle: all keys begin with conv."""
    dealt = turns.repartition(partitions(turns.sparkSession), "conv")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    seen = F.col("seen")  # equal turns one after the other, the first before the others
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (F.when(F.col("role").isNull(), None).when(bare == "", "blank").when(seen > 1, "duplicate")
             .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated"))
    numbered = dealt.withColumn("seen", F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(order[0])))
    return numbered.withColumn("fault", fault).sortWithinPartitions("conv", *order, "seen").drop("seen")


def _repairs(schema: pa.Schema):
    """Ends each conversation where the next begins, whatever batches its turns come in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_one = None, None
        for batch in batches:
            keys, made = [], []
            for conv, turn, role, text, fault in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if open_one is None or conv != key:
                    if open_one is not None:
                        keys.append(key)
                        made.append(open_one.end())
                    key, open_one = conv, Conversation()
                if role is not None:
                    open_one.add(turn, role, text, fault)
            if keys:
                yield _batch(schema, keys, made)
        if open_one is not None:
            yield _batch(schema, [key], [open_one.end()])

    return run


def _batch(schema: pa.Schema, keys: list, made: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), *[pa.array([m[f.name] for m in made], f.type) for f in list(schema)[1:]]], schema=schema)


def audit(turns: DataFrame) -> DataFrame:
    """One row for every conversation of `turns` (columns conv, turn, role, text as of `damaged`): its faults and cheapest repair.

    Turns go by number, null numbers first, then by role and text; equal rows are alike. A null conv is a conversation. Rows
    without role only name their conversation. Empty and very long texts are texts like others: only their digests are kept.
    A conversation is one sequence and its digest one stream, so one task takes it turn by turn: it keeps some 200 bytes a
    turn, and no texts. An empty table gives an empty result.
    """
    spark = turns.sparkSession
    prepare(spark)
    kind = turns.schema["conv"].dataType.simpleString()
    schema = spark.createDataFrame([], f"conv {kind}, {RESULT}").schema
    return _in_order(turns.select("conv", "turn", "role", "text")).mapInArrow(_repairs(_arrow_schema(schema)), schema)


def _edited(schema: pa.Schema):
    """Applies the audit, which comes before the turns of its conversation. All roles follow from the edits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, state, place = "", 0, START, 0
        for batch in batches:
            out = {f.name: [] for f in schema}

            def say(conv, edit: str, turn, role: str, text: str) -> None:
                nonlocal state, place
                state = NEXT[state][role[0]]
                for name, value in zip(out, (conv, place, edit, turn, role, text)):
                    out[name].append(value)
                place += 1

            def inserted(conv) -> None:
                nonlocal at
                while edits[at:at + 1] == "I":
                    say(conv, "I", None, GIVEN[state], "")
                    at += 1

            for conv, turn, role, text, repair in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if repair is not None:
                    edits, at, state, place = repair, 0, START, 0
                    inserted(conv)
                elif role is not None:
                    edit = edits[at]
                    at += 1
                    if edit != "D":
                        say(conv, edit, turn, GIVEN[state] if edit == "R" else role, text)
                    inserted(conv)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def repaired(turns: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """The turns of all conversations after the repair: conv, place (from 0), edit, turn (null for inserted ones), role, text.

    A conversation's audit is sorted before its turns, so a task holds one audit and one batch of turns at a time.
    """
    spark = turns.sparkSession
    prepare(spark)
    audits = audit(turns) if audits is None else audits
    kind = turns.schema["conv"].dataType.simpleString()
    schema = spark.createDataFrame([], f"conv {kind}, place long, edit string, turn long, role string, text string").schema
    null = F.lit(None)
    both = turns.select("conv", "turn", "role", "text", null.cast("string").alias("repair"), F.lit(1).alias("part")).unionByName(audits.select(
        "conv", null.cast("long").alias("turn"), null.cast("string").alias("role"), null.cast("string").alias("text"), F.col("audit").alias("repair"),
        F.lit(0).alias("part")))
    dealt = both.repartition(partitions(spark), "conv").sortWithinPartitions("conv", "part", F.col("turn").asc_nulls_first(), "role", "text").drop("part")
    return dealt.mapInArrow(_edited(_arrow_schema(schema)), schema)
