"""Conversation repair: the cheapest edits that give a conversation its structure, by a survivor-coalescence Viterbi.

A conversation streams through a decoder in order. Its survivors, one per state, are the heads of a tree of backpointers whose
nodes count the references to them; as soon as all survivors share an ancestor, the edits up to it are final: they are emitted and
their nodes and texts go. So memory holds the unresolved part only, whatever a conversation's length. Equal costs are
decided by the complete unresolved suffixes: every column ranks its survivors' suffixes, and as no suffix that ends with a
row's letter is the beginning of another, (rank of the suffix before, letters since) compares the whole of two longer ones.

Spark sorts the rows of a conversation into one stream, since the digest of a repaired conversation is one pass over it; equal rows are
found before by a window over (conversation, role, text). A large conversation makes a long stream, never a large memory.

Defined results: a null role or text is one space, thus a null text is blank; a null conv_id is a conversation of its own; rows of
one turn follow by role, then text; an empty role has no initial, so it can't be kept; an empty table gives no row; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches

#: White space as the contract has it: \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user's, after an assistant's. Finished: nothing yet, after an assistant's.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINISHED = (0, 3)
#: Whom a new or changed turn of a state must name, and where it leads.
ASKED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: (state, other, cost): whatever completes ``state`` completes ``other`` too at so much more, so ``state`` may go if it costs more than that.
DOMINATED = ((0, 3, DELETE), (0, 2, DELETE + INSERT), (1, 3, 0), (1, 2, INSERT), (1, 0, INSERT + DELETE))

SCHEMA = "conv_id long, place long, edit string, turn long, was string, role string, text string, fault string, cost long"
ARROW = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("was", pa.string()),
                   ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("cost", pa.int64())])
SUMMARY = pa.schema([*[(n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])
#: Rows of an outgoing batch.
OUT = 512


class Node:
    """An edit, known by the edit before it; ``refs`` counts later edits and survivors that point here."""

    __slots__ = ("before", "edit", "role", "row", "cost", "refs")

    def __init__(self, before: Node | None, edit: str, role: str | None, row: tuple | None, cost: int):
        self.before, self.edit, self.role, self.row, self.cost, self.refs = before, edit, role, row, cost, 0
        if before is not None:
            before.refs += 1


class Decoder:
    """Viterbi over one conversation; ``push`` and ``finish`` return the edits that became final, in order."""

    def __init__(self) -> None:
        self.root = Node(None, "", None, None, 0)
        #: state -> (cost, rank of the suffix up to the last row, inserts since, node of the last row)
        self.heads: dict[int, tuple[int, int, str, Node]] = {0: (0, 0, "", self.root)}
        self.root.refs += 1
        self.held = 0  # rows whose edit isn't final
        self._inserts()

    def _inserts(self) -> None:
        """Let turns be inserted after the last row; two in a row at most can matter."""
        at = self.heads
        for s in (0, 1, 3, 2):  # all ways to "user" before the one to "assistant"
            if s in at:
                cost, rank, new, node = at[s]
                t = ASKED[s][1]
                other = at.get(t)
                if other is None or (cost + INSERT, rank, new + "I") < other[:3]:
                    if other is not None:
                        self._leave(other[3])
                    node.refs += 1
                    at[t] = (cost + INSERT, rank, new + "I", node)
        for s, other, more in DOMINATED:
            if s in at and other in at and at[s][0] > at[other][0] + more:
                self._leave(at.pop(s)[3])

    def _leave(self, node: Node | None) -> None:
        """Take one reference away; nodes that nothing refers to go, and so on backwards."""
        while node is not None:
            node.refs -= 1
            if node.refs or node is self.root:
                return
            node = node.before

    def _inserted(self, head: tuple, state: int) -> Node:
        """The node of a head with its inserts, the last of which led to ``state``."""
        node, n = head[3], len(head[2])
        for k in range(n):
            user = (state == 2) == ((n - k) % 2 == 1)
            node = Node(node, "I", "user" if user else "assistant", None, INSERT)
        return node

    def push(self, row: tuple) -> list[Node]:
        """``row``: (turn, role, text, fault)."""
        _, role, _, fault = row
        initial, late, must_go = role[:1], TRUNCATED if fault == "truncated" else 0, fault in ("blank", "duplicate")
        best: dict[int, tuple] = {}
        for s, (cost, rank, new, _) in self.heads.items():
            found = [(s, cost + DELETE, rank, new + "D")]
            if not must_go:
                kept = NEXT[s].get(initial)
                if kept is not None:
                    found.append((kept, cost + late, rank, new + "K"))
                if kept != ASKED[s][1]:
                    found.append((ASKED[s][1], cost + REROLE + late, rank, new + "R"))
            for t, *key in found:
                if t not in best or key < best[t][0]:
                    best[t] = (key, s)
        old, made, bases = self.heads, {}, {}
        order = {tuple(k[1:]): n for n, k in enumerate(sorted((b[0] for b in best.values()), key=lambda k: k[1:]))}
        for t, (key, s) in best.items():
            if s not in bases:
                bases[s] = self._inserted(old[s], s)
            edit = key[2][-1]
            now = ASKED[s][0] if edit == "R" else role if edit == "K" else None
            node = Node(bases[s], edit, now, row, key[0] - old[s][0])
            node.refs += 1
            made[t] = (key[0], order[tuple(key[1:])], "", node)
        for head in old.values():
            self._leave(head[3])
        self.heads = made
        self.held += 1
        self._inserts()
        return self._final()

    def _final(self) -> list[Node]:
        """The edits that all survivors share, from the root on; the node before the first branch becomes the root."""
        ahead, node = {}, None
        if self.root.refs > 1 or any(h[3] is self.root for h in self.heads.values()):
            return []
        # the branch under the root is found from any survivor; walk only as far as the part of the tree that stays
        node = next(iter(self.heads.values()))[3]
        while node is not self.root:
            ahead[id(node.before)] = node
            node = node.before
        out, here = [], self.root
        while here.refs == 1 and id(here) in ahead:
            here = ahead[id(here)]
            out.append(here)
            self.held -= here.row is not None
        here.before = None
        self.root = here
        return out

    def finish(self) -> list[Node]:
        """The rest of the cheapest conversation that is finished."""
        s = min((s for s in FINISHED if s in self.heads), key=lambda s: self.heads[s][:3])
        node, out = self._inserted(self.heads[s], s), []
        while node is not self.root:
            out.append(node)
            node = node.before
        return out[::-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, gone of the contract's damaged rows; a dropped row stays as ``gone``, without its text."""
    s = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    s = s.withColumn("harm", F.crc32(key) % 20)
    text = (F.when(F.col("harm").isin(0, 1), "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return s.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    (F.col("harm") == 0).alias("gone"), F.explode(copies).alias("copy"))


def fault() -> Column:
    """The first fault of a row, given ``nth``: how many rows up to it have its role and text."""
    bare = F.rtrim("text", F.lit(SPACE))
    return (F.when(F.length(bare) == 0, "blank").when(F.col("nth") > 1, "duplicate")
            .when(~F.substring(bare, -1, 1).isin(*ENDS), "truncated").otherwise(""))


def _plain(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                F.lit(False).alias("gone"), F.lit(1).alias("copy"))


def edits(rows: DataFrame, marked: bool = False) -> DataFrame:
    """Every edit of every conversation of ``rows`` (conv_id, turn, role, text; if ``marked``, also gone and copy as ``damaged`` gives them): ``SCHEMA``.

    edit is K, R, D or I; was and role are a turn's role before and after, text stays. ``fault`` and ``turn`` tell about the row that was
    there. A conversation whose rows are all gone has one row with a null edit. A conversation's edits lie together and in order.
    """
    short_batches(rows.sparkSession)
    if not marked:
        rows = _plain(rows)
    order = [F.col("turn").asc_nulls_first(), F.col("copy")]
    same = Window.partitionBy("conv_id", "gone", "role", F.xxhash64("text"), "text").orderBy(*order)
    rows = rows.repartition("conv_id").withColumn("nth", F.row_number().over(same))  # the window reuses the partitioning
    rows = rows.select("conv_id", "turn", "role", "text", "copy", "gone", fault().alias("fault"))
    rows = rows.sortWithinPartitions("conv_id", order[0], "role", "text", "copy")
    return rows.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(_decode, SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _decode(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now, decoder, place, any_row = None, None, 0, False

    def tell(done: list[Node]) -> None:
        nonlocal place
        for n in done:
            turn, was, text, why = n.row or (None, None, "", "")
            out.append((now, place, n.edit, turn, was, n.role, text, why, n.cost))
            place += 1

    def close() -> None:
        if decoder is not None:
            tell(decoder.finish())
            if not any_row:
                out.append((now, None, None, None, None, None, None, None, 0))

    for batch in part:
        for conv, turn, role, text, gone, why in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if decoder is None or conv != now:
                close()
                now, decoder, place, any_row = conv, Decoder(), 0, False
            if not gone:
                any_row = True
                tell(decoder.push((turn, role, text, why)))
            if len(out) >= OUT:
                yield _batch(out, ARROW)
                out.clear()
    close()
    if out:
        yield _batch(out, ARROW)


def summary(found: DataFrame) -> DataFrame:
    """One row per conversation of ``edits``' rows, read in the order they come in: counts of faults, cost, the edits' initials, digest of the repaired turns."""
    kinds = {pa.int64(): "long", pa.string(): "string"}
    return found.mapInArrow(_summarise, ", ".join(f"{f.name} {kinds[f.type]}" for f in SUMMARY))


def _summarise(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now, seen = None, None  # seen: state of the conversation that is being read

    def close() -> None:
        if seen is not None:
            gaps = seen["hi"] - seen["lo"] + 1 - seen["turns"] if seen["turns"] else 0
            out.append((now, gaps, seen["blank"], seen["duplicate"], seen["truncated"], seen["illegal"], seen["cost"], bytes(seen["audit"]).decode(), seen["sha"].hexdigest()))

    for batch in part:
        for conv, _, edit, turn, was, role, text, why, cost in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if seen is None or conv != now:
                close()
                now, seen = conv, {"lo": None, "hi": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                                   "audit": bytearray(), "sha": hashlib.sha256(), "last": None, "some": False}
            if edit is None:
                continue
            seen["audit"] += edit.encode()
            seen["cost"] += cost
            if edit != "I":
                if turn is not None and turn != seen["hi"]:
                    seen["lo"] = turn if seen["lo"] is None else seen["lo"]
                    seen["hi"] = turn
                    seen["turns"] += 1
                if why:
                    seen[why] += 1
                if seen["last"] is not None:
                    seen["illegal"] += seen["last"] + was[:1] not in ("su", "ua", "au")
                seen["last"] = was[:1]
            if edit != "D":
                seen["sha"].update(f"{chr(10) if seen['some'] else ''}{role}:{text}".encode())
                seen["some"] = True
        if len(out) >= OUT:
            yield _batch(out, SUMMARY)
            out.clear()
    close()
    if out:
        yield _batch(out, SUMMARY)
