"""Conversation structure repair on an automaton of shared suffixes.

A conversation should alternate: nothing, or an optional system turn and then pairs of user and assistant.  Each turn is
put down as one sign, its role and its first fault: blank (no text but white space), duplicate (role and text
were there before), truncated (the text does not end a sentence).  Repairs keep a turn (0), give it the role user or
assistant (1), delete it (2; blank and duplicate turns must go), or insert an empty turn (5); a truncated turn that stays
adds 5.  Of the cheapest repairs the one whose edits read least in ASCII holds.

The cost to go depends on the rest of a conversation alone.  Conversations are therefore put together from their ends: the
automaton has one node for each distinct suffix of signs, and a node is solved once for each state of the
grammar.  It holds the cost to go and the first edit of the best audit suffix, whose rest is the suffix of the next
node.  Signs are sorted by their reverse, so that a task meets the nodes in the order of a walk through the
automaton: what a conversation shares with the one before it is on the path already.  Ranges are cut by (reverse, conv_id),
so that conversations with one and the same signs, however many, are dealt over tasks; only the nodes on the border of
two ranges are solved in both.  Nodes whose costs differ by a constant share their edits.

Turns are numbered in a window over the conversation and hashed in one sorted stream behind their audit: a task holds one
batch of texts, and of a conversation one sign and one edit a turn.  One conversation is one row in the result and one
digest over all its texts, so that it ends in one task, whatever its length; it is never held as a whole.

Defined cases: null roles and texts are one space, so are null ids and turns where they are spelled out; a null conv_id is a conversation; null turns come
first; turns of equal number go by role, then text; repeated rows are turns of their own; a role counts by its first
letter (other letters than s, u, a cannot be kept); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.llm.common import keep, released, utf8

#: Costs of the edits; a truncated turn that is not deleted costs LATE more.
REROLE, DELETE, INSERT, LATE = 1, 2, 5, 5
#: States of the grammar: nothing yet, after system, after user, after assistant.  Where a role leads, and which role comes next.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT, EXPECTED = (2, 2, 3, 2), ("user", "user", "assistant", "user")
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_NEVER = 1 << 40


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults made by the checksum of `conv_id:turn`: rows dropped, emptied, cut, repeated, given to the user."""
    rows = _rows(conversations)
    spelled = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("__k", F.crc32(spelled) % 20).where("__k <> 0")
    text = F.when(F.col("__k") == 1, F.lit("")).when(F.col("__k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("__k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("__k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("__c")).drop("__c")


def _rows(conversations: DataFrame) -> DataFrame:
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *named)


def signed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, turn, role, text, sign, new_turn, illegal): turns numbered from 1, each with its sign.

    Signs: the role's letter (x: another letter), in upper case if truncated; b blank, d duplicate.
    """
    rows = _rows(conversations).repartition("conv_id")
    in_order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(in_order[0])) > 1
    rows = rows.withColumn("seen", seen).withColumn("letter", F.substring("role", 1, 1))
    w = Window.partitionBy("conv_id").orderBy(*in_order, "seen")
    letter = F.when(F.col("letter").isin("s", "u", "a"), F.col("letter")).otherwise(F.lit("x"))
    ends = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    sign = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit("b")).when(F.col("seen"), F.lit("d")).when(ends, letter).otherwise(F.upper(letter))
    pair = F.concat(F.lag("letter").over(w), F.col("letter"))
    return rows.select(
        "conv_id", F.row_number().over(w).alias("i"), "turn", "role", "text", sign.alias("sign"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(w))).alias("new_turn"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
    )


def _facts(turns: DataFrame, every: DataFrame) -> DataFrame:
    """One row for each conversation of `every`: counts of faults, and its signs from the last to the first."""
    narrow = turns.select("conv_id", "i", "turn", "sign", "new_turn", "illegal")
    none = [F.lit(None).cast(narrow.schema[c].dataType).alias(c) for c in narrow.columns[1:]]
    rows = narrow.unionByName(every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", *none))
    signs = F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "sign"))))
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if(F.col("new_turn")), F.lit(0)).alias("gaps"), F.count_if(F.col("sign") == "b").alias("blank"), F.count_if(F.col("sign") == "d").alias("duplicate"),
        F.count_if(F.col("sign").isin("S", "U", "A", "X")).alias("truncated"), F.count_if(F.col("illegal")).alias("illegal"),
        F.reverse(F.array_join(F.transform(signs, lambda x: x["sign"]), "")).alias("back"),
    )


class Suffixes:
    """The automaton along one path: node k stands for the last k signs."""

    def __init__(self) -> None:
        self.solved: dict = {}  # (sign, costs of the next node) -> costs and edits; costs are taken from the least of a node
        self.back, end = "", self._settle([(0, ""), (_NEVER, ""), (_NEVER, ""), (0, "")])
        self.nodes, self.base, self.audit = [end[1:]], [end[0]], None

    @staticmethod
    def _settle(first: list) -> tuple[int, tuple, str]:
        """Insertions before the best other edit of each state.  Of equal costs the lesser letter: letters alone decide, as each leads on differently."""
        best = list(first)
        for q in (2, 3):
            best[q] = min(first[q], (INSERT + first[5 - q][0], "I"))
        for q in (0, 1):
            best[q] = min(first[q], (INSERT + best[2][0], "I"))
        low = min(c for c, _ in best)
        return low, tuple(c - low for c, _ in best), tuple(e for _, e in best)

    def _node(self, sign: str, after: tuple) -> tuple:
        found = self.solved.get((sign, after))
        if found is None:
            first = [(DELETE + after[q], "D") for q in range(4)]
            if sign not in "bd":
                late, role = LATE if sign.isupper() else 0, sign.lower()
                for q in range(4):
                    kept = [(late + after[MOVES[q, role]], "K")] if (q, role) in MOVES else []
                    first[q] = min([first[q], *kept, (REROLE + late + after[NEXT[q]], "R")])
            found = self.solved[sign, after] = self._settle(first)
        return found

    def solve(self, back: str) -> tuple[int, str]:
        """Cost and audit of the conversation whose signs, from the last to the first, are `back`."""
        if back == self.back and self.audit is not None:
            return self.base[-1] + self.nodes[-1][0][0], self.audit
        most, k = min(len(back), len(self.back)), 0
        if back[:most] == self.back[:most]:
            k = most
        else:  # the shared path, by halves
            lo, hi = 0, most
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if back[:mid] == self.back[:mid] else (lo, mid - 1)
            k = lo
        del self.nodes[k + 1 :], self.base[k + 1 :]
        for sign in back[k:]:
            low, costs, edits = self._node(sign, self.nodes[-1][0])
            self.nodes.append((costs, edits))
            self.base.append(self.base[-1] + low)
        self.back, state, audit = back, 0, []
        for k in range(len(back), -1, -1):
            edits = self.nodes[k][1]
            while edits[state] == "I":
                audit.append("I")
                state = NEXT[state]
            e = edits[state]
            audit.append(e)
            if e == "K":
                state = MOVES[state, back[k - 1].lower()]
            elif e == "R":
                state = NEXT[state]
        self.audit = "".join(audit)
        return self.base[-1] + self.nodes[-1][0][0], self.audit


def _audited(facts: DataFrame) -> DataFrame:
    def solve(batches):
        automaton = Suffixes()
        for batch in batches:
            done = [automaton.solve(b) for b in batch.column("back").to_pylist()]
            out = {c: batch.column(c) for c in batch.schema.names if c != "back"}
            yield pa.RecordBatch.from_pydict(out | {"cost": pa.array([c for c, _ in done], pa.int64()), "audit": pa.array([a for _, a in done], pa.string())})

    # ranges by the first signs only, so that what the driver samples is small
    dealt = facts.repartitionByRange(F.substring("back", 1, 64), "conv_id").sortWithinPartitions("back")
    return dealt.mapInArrow(released(solve), f"conv_id long, {', '.join(f'{c} long' for c in FACTS)}, cost long, audit string")


def audit(conversations: DataFrame, every: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The signed turns, written, and (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    `every`: conversations that must be in the result though no turn may be left of them.
    """
    turns = keep(signed_turns(conversations), "signed-turns")
    return turns, _audited(_facts(turns, conversations if every is None else every))


def _in_order(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Each audit, as row 0, before the turns it repairs."""
    facts = [c for c in audits.columns if c not in ("conv_id", "audit")]
    heads = audits.select("conv_id", F.lit(0).alias("i"), F.lit("").alias("role"), F.col("audit").alias("text"), *facts)
    rows = turns.select("conv_id", "i", "role", "text", *[F.lit(None).cast(audits.schema[c].dataType).alias(c) for c in facts])
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "i")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(head, None, None, None) where a conversation begins, then (None, edit, role, text as UTF-8) for each turn of the repaired one."""
    todo, at, state = "", 0, 0

    def inserted():
        nonlocal at, state
        while at < len(todo) and todo[at] == "I":
            yield None, "I", EXPECTED[state], b""
            at, state = at + 1, NEXT[state]

    for batch in batches:
        number = batch.column("i").to_pylist()
        heads = iter(batch.filter(pc.equal(batch.column("i"), 0)).to_pylist())
        for i, role, text in zip(number, batch.column("role").to_pylist(), utf8(batch.column("text")), strict=True):
            if i == 0:
                yield from inserted()
                yield next(heads), None, None, None
                todo, at, state = text.decode(), 0, 0
                continue
            yield from inserted()
            edit, at = todo[at], at + 1
            if edit == "K":
                yield None, "K", role, text
                state = MOVES[state, role[0]]
            elif edit == "R":
                yield None, "R", EXPECTED[state], text
                state = NEXT[state]
    yield from inserted()


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns of the repaired conversations, from 0."""

    def run(batches):
        out, size, conv, n = [], 0, None, 0
        for head, edit, role, text in _edits(batches):
            if head is not None:
                conv, n = head["conv_id"], 0
                continue
            out.append({"conv_id": conv, "position": n, "edit": edit, "role": role, "text": text.decode(errors="replace")})
            n, size = n + 1, size + len(text)
            if size > 1 << 24 or len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, kinds)

    kinds = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return _in_order(turns, audits).mapInArrow(released(run), "conv_id long, position long, edit string, role string, text string")


def digests(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The audits with `repaired_sha256`: the digest of `role:text` of the repaired turns, joined by line ends."""

    def run(batches):
        rows, head, digest, first = [], None, None, True
        for new, _, role, text in _edits(batches):
            if new is not None:
                if head is not None:
                    rows.append(head | {"repaired_sha256": digest.hexdigest()})
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows = []
                head, digest, first = {k: v for k, v in new.items() if k not in ("i", "role", "text")} | {"audit": new["text"]}, hashlib.sha256(), True
            else:
                digest.update(("" if first else "\n").encode() + role.encode() + b":")
                digest.update(text)
                first = False
        if head is not None:
            rows.append(head | {"repaired_sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, kinds)

    counts = (*FACTS, "cost")
    kinds = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return _in_order(turns, audits).mapInArrow(released(run), f"conv_id long, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")


def repair(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Counts of faults, cost, audit and digest of the repaired form of each conversation."""
    return digests(*audit(conversations, every))
