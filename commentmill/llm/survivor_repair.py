"""Conversation structure repair by Viterbi decoding with survivor coalescence.

The rows of a conversation are read by turn. Four states say which roles may follow: nothing yet, a
system turn, a user turn, an assistant turn. Each row is kept, given another role or deleted, and
empty turns may be inserted, so that the roles' initials give ``(s?(ua)+)?`` at the least cost.

Each state has one survivor, the cheapest way to it, unless another state's survivor and a detour are
cheaper in any case. Survivors are nodes of a tree of backpointers that count their references. A node that no survivor needs goes; where all survivors descend from
one child of the root, that child's edit is final, is emitted and forgotten. So memory holds what is
still undecided, not the conversation. Equally cheap ways are compared by their whole undecided
edits, from their last common node on; the ASCII-least one survives. Two such ways to one state are
never prefixes of each other, as the longer one would have paid for its inserts.

Rows come sorted inside the partition of their conversation and stream through. Which rows repeat an
earlier row is found before, by digests that are counted per conversation, so that no set of seen
texts is kept.

Edits: K (keep, 0), R (another role, 2), D (delete, 3; required for blank and repeated rows), I (insert
an empty turn, 2). A row that stays truncated costs 1 more. A row's faults in order: ``blank`` (no
character but ASCII white space), ``duplicate`` (role and text seen earlier), ``truncated`` (its last
such character is none of ``.!?``).

Defined cases: a null role or text is one space; an empty role's initial is a space; null turns come
first; rows of one turn are ordered by role and text; null ids are one conversation; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from commentmill.llm.bloom_dedup import probe_listed
from commentmill.llm.common import attach, materialized

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE = b" \t\n\x0b\x0c\r"
#: States: nothing yet, after a system, a user, an assistant turn; the roles that may follow each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The state an inserted or reroled turn leads to, and its role.
MADE = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
LEGAL = ("su", "ua", "au")
#: What it costs at most to go on from the first state as one would from the second: an insert on the
#: way between user and assistant turns, or deleting a system turn that only a beginning may have.
DETOUR = {(ASSISTANT, USER): INSERT, (ASSISTANT, SYSTEM): 0, (ASSISTANT, START): DELETE,
          (USER, ASSISTANT): INSERT, (USER, SYSTEM): INSERT, (USER, START): INSERT + DELETE}
#: Most inserts that a cheapest way can have in one place.
INSERTS = 2
#: Most bytes of the edits of one batch.
BATCH = 1 << 22


@dataclass(eq=False, repr=False)
class Node:
    """An edit: its letter, what it leaves of the row, and the way before it."""

    parent: Node | None
    letter: str
    role: str | None
    row: tuple | None
    depth: int
    refs: int = 0
    kids: set = field(default_factory=set)


def _less(a: Node, more_a: str, b: Node, more_b: str) -> bool:
    """Whether a's undecided edits and ``more_a`` come before b's."""
    x, y = more_a[::-1], more_b[::-1]
    xs, ys = [x], [y]
    while a is not b:
        if a.depth >= b.depth:
            xs.append(a.letter)
            a = a.parent
        else:
            ys.append(b.letter)
            b = b.parent
    return "".join(xs)[::-1] < "".join(ys)[::-1]


class Decoder:
    """One conversation. ``push`` takes a row and gives the edits that are final by then."""

    def __init__(self):
        self.root = Node(None, "", None, None, 0, refs=1)
        self.survivors: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.held = self.most_held = 0

    def _grown(self, node: Node, state: int, inserts: int) -> tuple[Node, int]:
        for _ in range(inserts):
            state, role = MADE[state]
            node = self._child(node, "I", role, None)
        return node, state

    def _child(self, node: Node, letter: str, role: str | None, row: tuple | None) -> Node:
        kid = Node(node, letter, role, row, node.depth + 1)
        node.kids.add(kid)
        node.refs += 1
        self.held += 1
        return kid

    def _release(self, node: Node) -> None:
        """A survivor less at the node; what nobody needs goes, upward."""
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            up = node.parent
            up.kids.discard(node)
            up.refs -= 1
            self.held -= 1
            node = up

    def push(self, row: tuple, initial: str, must_go: bool, truncated: bool) -> list[Node]:
        best: dict[int, tuple] = {}

        def offer(to: int, cost: int, node: Node, state: int, inserts: int, letter: str, role: str | None) -> None:
            word = "I" * inserts + letter
            old = best.get(to)
            if old is None or cost < old[0] or (cost == old[0] and _less(node, word, old[1], old[6])):
                best[to] = (cost, node, state, inserts, letter, role, word)

        more = TRUNCATED if truncated else 0
        for state, (cost, node) in self.survivors.items():
            at = state
            for inserts in range(INSERTS + 1):
                paid = cost + INSERT * inserts
                offer(at, paid + DELETE, node, state, inserts, "D", None)
                if not must_go:
                    kept = NEXT[at].get(initial)
                    if kept is not None:
                        offer(kept, paid + more, node, state, inserts, "K", None)
                    to, role = MADE[at]
                    offer(to, paid + REROLE + more, node, state, inserts, "R", role)
                at = MADE[at][0]
        for (near, far), more in DETOUR.items():
            if near in best and far in best and best[near][0] + more < best[far][0]:
                del best[far]  # no way through it can be among the cheapest
        old, self.survivors = self.survivors, {}
        for to, (cost, node, state, inserts, letter, role, _) in best.items():
            grown, _ = self._grown(node, state, inserts)
            kid = self._child(grown, letter, role, row)
            kid.refs += 1
            self.survivors[to] = (cost, kid)
        for _, node in old.values():
            self._release(node)
        self.most_held = max(self.most_held, self.held)
        return self._decided()

    def _decided(self) -> list[Node]:
        """Edits that all survivors share; the last of them becomes the root."""
        out = []
        while self.root.refs == 1 and self.root.kids:
            (kid,) = self.root.kids
            self.root.kids.clear()
            kid.parent = None
            self.root = kid
            self.held -= 1
            out.append(kid)
        return out

    def finish(self) -> tuple[int, list[Node]]:
        """The cost of the cheapest whole way, and its edits that are still to come."""
        best = None
        for state, (cost, node) in self.survivors.items():
            inserts = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[state]
            paid, word = cost + INSERT * inserts, "I" * inserts
            if best is None or paid < best[0] or (paid == best[0] and _less(node, word, best[1], best[3])):
                best = (paid, node, state, word)
        cost, node, state, word = best
        node, _ = self._grown(node, state, len(word))
        out = []
        while node is not self.root:
            out.append(node)
            node = node.parent
        return cost, out[::-1]


def _first_fault(text: Column, repeated: Column) -> Column:
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return (F.when(last == "", "blank").when(repeated, "duplicate")
            .when(~last.isin(".", "!", "?"), "truncated"))


def _plain(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    one = F.lit(" ")
    return df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), one).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), one).alias("text"))


def with_faults(turns: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with ``later``: whether an earlier turn of the conversation has
    the same role and text. Only digests are grouped; a Bloom filter of those that occur at several
    turns keeps the other rows where they are, and hot groups' lines are broadcast."""
    keyed = turns.withColumn("said", F.sha2(F.concat_ws(
        "\n", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")), F.length("role"), "role", "text"), 256))
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    groups = keyed.groupBy("said").agg(F.min(order).alias("first"), F.max(order).alias("last"),
                                       F.count("*").alias("copies"))
    again = materialized(groups.filter("first != last").select("said", F.col("first.turn").alias("first_turn"), "copies"))
    probed, _ = probe_listed(keyed, again.select("said"), "said")
    names = ["conv", "turn", "role", "text", "later"]
    likely = attach(probed.filter("__maybe"), again, "said", "copies", turns.count(), "left").withColumn(
        "later", F.col("copies").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn")))
    alone = probed.filter(~F.col("__maybe")).withColumn("later", F.lit(False))
    return likely.select(*names).unionByName(alone.select(*names))


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The edits of every conversation, one row each: conv, at (from 0), edit, turn, role and text of
    what stands there now (null where deleted), fault, illegal (this row's and the row before's
    initials are not one of su, ua, au), cost. Inserted turns have no turn number."""
    turns = with_faults(_plain(df, conv_col, turn_col, role_col, text_col))
    ordered = (turns.withColumn("fault", _first_fault(F.col("text"), F.col("later"))).repartition("conv")
               .sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text"))
    kind = turns.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, at bigint, edit string, turn bigint, role string, text string, fault string, illegal boolean, cost int"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        def final(nodes: list[Node]) -> None:
            nonlocal at, held
            for node in nodes:
                if node.letter == "I":
                    out = (None, node.role, "", None, False, INSERT)
                else:
                    turn, role, text, fault, illegal = node.row
                    cost = {"K": 0, "R": REROLE, "D": DELETE}[node.letter]
                    if node.letter == "D":
                        out = (turn, None, None, fault, illegal, cost)
                    else:
                        out = (turn, node.role or role, text, fault, illegal, cost + TRUNCATED * (fault == "truncated"))
                        held += len(text)
                rows.append((conv, at, node.letter, *out))
                at, held = at + 1, held + 64

        decoder, conv, before, at = None, None, None, 0
        for batch in batches:
            for new, turn, role, text, fault in zip(
                    *[batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "fault")], strict=True):
                if decoder is None or new != conv:
                    if decoder:
                        final(decoder.finish()[1])
                    decoder, conv, before, at = Decoder(), new, None, 0
                if fault != "blank" and before == (turn, role, text):
                    fault = "duplicate"  # equal rows of one turn stand side by side
                initial = role[:1] or " "
                illegal = before is not None and (before[1][:1] or " ") + initial not in LEGAL
                before = (turn, role, text)
                final(decoder.push((turn, role, text, fault, illegal), initial, fault in ("blank", "duplicate"),
                                   fault == "truncated"))
                if held >= BATCH:
                    yield batch_of()
                    rows, held = [], 0
        if decoder:
            final(decoder.finish()[1])
        yield batch_of()

    return ordered.mapInArrow(run, schema)


def audit(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit (the edits'
    initials), repaired_sha256 (of role:text, newline-joined). ``conversations`` lists the ids (one
    column); those without an edit get zeros and empty texts."""
    name = conversations.columns[0]
    kind = edits.schema["conv"].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = f"conv {kind}, {', '.join(f'{c} bigint' for c in counts)}, audit string, repaired_sha256 string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = ("conv", "edit", "turn", "role", "text", "fault", "illegal", "cost")
    ordered = edits.repartition("conv").sortWithinPartitions("conv", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, done = None, None, []

        def ended() -> tuple:
            n = {c: state[c] for c in counts}
            n["gaps"] = state["hi"] - state["lo"] + 1 - state["distinct"] if state["lo"] is not None else 0
            return (conv, *[n[c] for c in counts], "".join(state["edits"]), state["sha"].hexdigest())

        for batch in batches:
            for new, edit, turn, role, text, fault, illegal, cost in zip(
                    *[batch.column(c).to_pylist() for c in columns], strict=True):
                if state is None or new != conv:
                    if state:
                        done.append(ended())
                    conv = new
                    state = dict.fromkeys((*counts, "distinct", "turns"), 0) | {
                        "lo": None, "hi": None, "edits": [], "sha": hashlib.sha256()}
                state["edits"].append(edit)
                state["illegal"] += illegal
                state["cost"] += cost
                if fault:
                    state[fault] += 1
                if edit != "D":
                    state["sha"].update(f"{chr(10) if state['turns'] else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    state["turns"] += 1
                if edit != "I" and turn is not None and turn != state["hi"]:  # rows come by turn
                    state["lo"] = turn if state["lo"] is None else state["lo"]
                    state["hi"], state["distinct"] = turn, state["distinct"] + 1
            done_now, done = done, []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                list(zip(*done_now, strict=True)) or [()] * len(arrow), arrow, strict=True)], schema=arrow)
        last = [ended()] if state else []
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
            list(zip(*last, strict=True)) or [()] * len(arrow), arrow, strict=True)], schema=arrow)

    found = ordered.mapInArrow(run, schema)
    every = conversations.select(F.col(name).alias("__conv")).distinct()
    return every.join(found, F.col("__conv").eqNullSafe(F.col("conv")), "left").select(
        F.col("__conv").alias(name), *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by their own number, for tests of a repair: of twenty,
    one is dropped, one emptied, one loses its ``.!?``, one stands twice, one is said by the user."""
    one = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    kind = F.col("kind")
    rows = turns.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"),
                        (F.crc32(name) % 20).alias("kind")).filter(kind != 0)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
