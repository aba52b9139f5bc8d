"""Repair of conversation structure: faults, and the cheapest edits by a suffix-shared automaton of signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from filmfold.llm.common import written
from filmfold.operators.skew import plain_join

#: Rows of one piece of a signature. A conversation of any length is a run of pieces.
PIECE = 512
#: Costs of edits, and of a row left as it is without an end mark.
REROLE, DELETE, INSERT, OPEN = 3, 4, 3, 3
FAR = 1 << 40  # no way

#: Grammar states: nothing yet, after a system row, after a user row, after an answer. The first and the last may end.
START, SYSTEM, USER, ANSWER = range(4)
#: Where a row of that role leads, and what an inserted or changed row must be.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ANSWER}, ANSWER: {"u": USER}}
WANTED = {START: "u", SYSTEM: "u", USER: "a", ANSWER: "u"}
NAMES = {"u": "user", "a": "assistant"}
END = (0, FAR, FAR, 0)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows as they come damaged, with 0 copies for a dropped row.

    A checksum of the ids picks the damage: row dropped, text emptied, end marks
    removed, row repeated, or role set to user; most rows stay. Nulls are one
    space, but stay null as ids.
    """
    key = F.concat(_text("conv_id"), F.lit(":"), _text("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(_text("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(_text("text"), ".!?", "")).otherwise(_text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, copies, role, blank, open, repeats: one short row for each distinct row of a conversation.

    Equal rows of one turn are counted where they are read, before they travel,
    so that a row repeated any number of times is one. ``repeats`` says whether
    an earlier turn has it too: a table of the first turns of those rows only
    that stand in several turns.
    """
    first = F.substring("role", 1, 1)
    words = r"[^\x20\x09-\x0D]"
    blank = ~F.rlike("text", F.lit(words))
    short = rows.select(
        "conv_id", "turn", _digest().alias("digest"), "copies",
        F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("role"), blank.alias("blank"),
        (~blank & ~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))).alias("open"))
    short = written(short.groupBy("conv_id", "turn", "digest", "role", "blank", "open").agg(
        F.sum("copies").alias("copies")), "conv-rows")
    order = F.struct(F.col("turn").isNotNull(), "turn")
    found = short.filter("copies > 0").groupBy("conv_id", "digest").agg(
        F.min(order).alias("first"), F.max(order).alias("last")).filter("first <> last").select(
        F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("first.turn").alias("first_turn"))
    found = written(found, "conv-repeats")
    again = F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    joined = short.join(found, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    return joined.select(*short.columns, again.alias("repeats"))


class Piece:
    """The running piece of a conversation: its signature and what is counted over its rows.

    A signature has a character a row: ``-`` for one that must go (blank, or
    seen before), else its role, in upper case if the row lacks an end mark.
    """

    def __init__(self, conv, row, number: int):
        self.conv, self.number, self.place = conv, number, row
        self.marks: list[str] = []
        self.blank = self.duplicate = self.open = self.illegal = self.turns = 0
        self.first_role = self.last_role = ""
        self.first_turn = self.least = self.most = None

    def add(self, turn, role: str, mark: str) -> None:
        if self.last_role:
            self.illegal += self.last_role + role not in ("su", "ua", "au")
        else:
            self.first_role, self.first_turn = role, turn
        if turn is not None and (not self.marks or turn != self.most):
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.last_role = role
        self.marks.append(mark)


_PIECES = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("turn", pa.int64()), ("digest", pa.binary()),
    ("skip", pa.int64()), ("sig", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("turns", pa.int64()), ("least", pa.int64()), ("most", pa.int64()),
    ("first_turn", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()),
])
_PIECE_COLUMNS = ("conv_id long, part int, number long, turn long, digest binary, skip long, sig string, blank long, "
                  "duplicate long, truncated long, illegal long, turns long, least long, most long, first_turn long, "
                  "first_role string, last_role string")


def pieces(rows: DataFrame, length: int = PIECE) -> DataFrame:
    """Signatures of conversations in pieces of at most ``length`` rows, numbered in order by (part, number).

    Rows are range partitioned by conversation, turn and digest, so a long
    conversation is many tasks; each streams its range. A piece says where it
    begins (turn, digest and how many copies of that row come before it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, piece, out = TaskContext.get().partitionId(), 0, None, []

        def done() -> None:
            out.append({
                "conv_id": piece.conv, "part": part, "number": piece.number, "turn": piece.place[0],
                "digest": piece.place[1], "skip": piece.place[2], "sig": "".join(piece.marks), "blank": piece.blank,
                "duplicate": piece.duplicate, "truncated": piece.open, "illegal": piece.illegal, "turns": piece.turns,
                "least": piece.least, "most": piece.most, "first_turn": piece.first_turn,
                "first_role": piece.first_role, "last_role": piece.last_role})

        for batch in batches:
            for conv, turn, digest, copies, role, blank, open_end, repeats in zip(*(batch[c].to_pylist() for c in (
                    "conv_id", "turn", "digest", "copies", "role", "blank", "open", "repeats"))):
                if piece is None or piece.conv != conv:
                    if piece is not None:
                        done()
                    number += 1
                    piece = Piece(conv, (turn, digest, 0), number)
                for copy in range(copies):
                    if len(piece.marks) >= length:
                        done()
                        number += 1
                        piece = Piece(conv, (turn, digest, copy), number)
                    seen = not blank and (repeats or copy > 0)
                    piece.add(turn, role, "-" if blank or seen else role.upper() if open_end else role)
                    piece.blank += blank
                    piece.duplicate += seen
                    piece.open += open_end and not seen
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, _PIECES)
                        out.clear()
        if piece is not None:
            done()
        if out:
            yield pa.RecordBatch.from_pylist(out, _PIECES)

    order = ["conv_id", "turn", "digest"]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _PIECE_COLUMNS), "conv-pieces")


class Node(NamedTuple):
    """One suffix of a signature: by grammar state the cost to go, the best edits here and the state after them."""

    cost: tuple[int, ...]
    edits: tuple[str, ...]
    to: tuple[int, ...]


def _node(rows: list[list[tuple[int, str, int]]]) -> Node:
    """The node from each state's ways to go on (cost, letter, next state), of which the first cheapest counts, and
    insertions, which sort behind D and before K and R.

    Every letter leads from a state to one other, so taking the first letter in
    order of the cheapest ways, place by place, gives the first edits in order.
    """
    cost = [min(way[0] for way in ways) for ways in rows]
    ahead = [NEXT[state][WANTED[state]] for state in range(4)]
    for _ in range(3):
        cost = [min(FAR, c, INSERT + cost[ahead[state]]) for state, c in enumerate(cost)]
    choice = []
    for state, ways in enumerate(rows):
        if INSERT + cost[ahead[state]] == cost[state]:
            ways = [*ways, (cost[state], "I", ahead[state])]
        choice.append(min((w for w in ways if w[0] <= cost[state]), key=lambda w: w[1], default=None))
    edits, to = [], []
    for state in range(4):
        letters = ""
        while choice[state] and choice[state][1] == "I":
            letters, state = letters + "I", choice[state][2]
        edits.append(letters + (choice[state][1] if choice[state] else ""))
        to.append(choice[state][2] if choice[state] else state)
    return Node(tuple(cost), tuple(edits), tuple(to))


def last_node(after: tuple[int, ...]) -> Node:
    """The node of the empty suffix, given the costs of going on behind the piece."""
    return _node([[(cost, "", state)] for state, cost in enumerate(after)])


def node_before(mark: str, behind: Node) -> Node:
    """The node of a suffix that has one row more."""
    role, left, rows = mark.lower(), OPEN if mark.isupper() else 0, []
    for state in range(4):
        ways = [(DELETE + behind.cost[state], "D", state)]
        if mark != "-":
            if role in NEXT[state]:
                ways.append((left + behind.cost[NEXT[state][role]], "K", NEXT[state][role]))
            wanted = NEXT[state][WANTED[state]]
            ways.append((left + REROLE + behind.cost[wanted], "R", wanted))
        rows.append([(min(c, FAR), letter, to) for c, letter, to in ways])
    return _node(rows)


class Automaton:
    """Signatures that end alike share their nodes: given in the order of their reversals, only the path to the last one is held."""

    def __init__(self, after: tuple[int, ...]):
        self.marks = ""  # the last signature, from its end
        self.path = [last_node(after)]

    def solve(self, reverse: str) -> list[Node]:
        """Nodes from the end of a signature to its beginning."""
        same = 0
        for a, b in zip(self.marks, reverse):
            if a != b:
                break
            same += 1
        del self.path[same + 1:]
        for mark in reverse[same:]:
            self.path.append(node_before(mark, self.path[-1]))
        self.marks = reverse
        return self.path


def audit(path: list[Node], state: int) -> tuple[str, int]:
    """The best edits from a state on, and the state in which they end."""
    found = []
    for node in reversed(path):
        found.append(node.edits[state])
        state = node.to[state]
    return "".join(found), state


_SOLVED = pa.schema([("sig", pa.string()), ("after", pa.list_(pa.int64())), ("cost", pa.list_(pa.int64())),
                     ("edits", pa.list_(pa.string())), ("to", pa.list_(pa.int64()))])


def solved(wanted: DataFrame) -> DataFrame:
    """sig, after, cost, edits, to: each distinct signature once, for all conversations that have it.

    ``after`` holds the costs to go behind the piece, by state. Signatures are
    range partitioned and sorted by their reversals, so those with a common end
    stand together and share the automaton's nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, last = None, None
        for batch in batches:
            out = []
            for reverse, after in zip(batch["reverse"].to_pylist(), batch["after"].to_pylist()):
                if after != last:
                    machine, last = Automaton(tuple(after)), after
                path = machine.solve(reverse)
                ways = [audit(path, state) if path[-1].cost[state] < FAR else ("", state) for state in range(4)]
                out.append({"sig": reverse[::-1], "after": after, "cost": list(path[-1].cost),
                            "edits": [w[0] for w in ways], "to": [w[1] for w in ways]})
            yield pa.RecordBatch.from_pylist(out, _SOLVED)

    order = ["after", "reverse"]
    return wanted.distinct().select("after", F.reverse("sig").alias("reverse")).repartitionByRange(*order) \
        .sortWithinPartitions(*order).mapInArrow(
            run, "sig string, after array<long>, cost array<long>, edits array<string>, to array<long>")


def _costs(values) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def with_ends(parts: DataFrame) -> DataFrame:
    """Add ``after`` to pieces: what it costs to go on behind each, less the least of it.

    A conversation of one piece ends there. For others, the costs between each
    two states of a piece are worked out for all distinct pieces at once, and
    then taken together from the conversation's last piece to its first, four
    numbers at a time.
    """
    counted = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"))
    counted = written(counted, "conv-long")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    one = parts.join(counted, same, "left_anti").withColumn("after", _costs(END))
    many = parts.join(counted, same, "left_semi")
    ends = [_costs([0 if state == end else FAR for end in range(4)]) for state in range(4)]
    matrix = solved(many.select("sig", F.explode(F.array(*ends)).alias("after")))
    matrix = matrix.withColumn("end", F.array_position("after", F.lit(0).cast("long"))).groupBy("sig").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("end", "cost"))), lambda x: x["cost"]).alias("by_end"))
    many = plain_join(many, matrix, ["sig"])
    columns = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, cost, begun = None, END, False
        for batch in batches:
            found = []
            for name, table in zip(batch["conv_id"].to_pylist(), batch["by_end"].to_pylist()):
                if not begun or name != conv:
                    conv, cost, begun = name, END, True
                found.append(list(cost))
                through = [min(min(FAR, table[end][state] + cost[end]) for end in range(4)) for state in range(4)]
                least = min(through)
                cost = tuple(FAR if c >= FAR else c - least for c in through)
            yield batch.select(columns).append_column("after", pa.array(found, pa.list_(pa.int64())))

    backward = many.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("number"))
    return written(one.unionByName(backward.mapInArrow(run, f"{_PIECE_COLUMNS}, after array<long>")), "conv-ends")


_REPAIRED = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("repaired_sha256", pa.string())])
_WEIGHT = {"K": 0, "D": DELETE, "R": REROLE, "I": INSERT}


class Repair:
    """One conversation as its pieces and rows stream by: sums, edits and the digest of the repaired rows."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.letters, self.audit = conv, START, 0, "", []
        self.marks, self.at, self.waiting = "", 0, None
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.least = self.most = None
        self.last_role, self.sha, self.lines, self.grammar = "", hashlib.sha256(), 0, START

    def piece(self, row: dict) -> None:
        for name in self.sums:
            self.sums[name] += row[name]
        if row["first_role"]:
            if self.last_role:
                self.sums["illegal"] += self.last_role + row["first_role"] not in ("su", "ua", "au")
            self.sums["turns"] -= self.most is not None and row["first_turn"] == self.most
            self.last_role = row["last_role"]
        self.least = row["least"] if self.least is None else self.least
        self.most = row["most"] if row["most"] is not None else self.most
        self.letters, self.marks, self.at = row["edits"][self.state], row["sig"], 0
        self.state = row["to"][self.state]
        self.audit.append(self.letters)
        self.inserts()
        self.go_on()

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def inserts(self) -> None:
        while self.letters.startswith("I"):
            self.cost += INSERT
            self.made("")
            self.letters = self.letters[1:]

    def made(self, text: str) -> None:
        role = WANTED[self.grammar]
        self.line(NAMES[role], text)
        self.grammar = NEXT[self.grammar][role]

    def rows(self, role: str, text: str, copies: int) -> None:
        """Equal rows of one turn, which may lie in several pieces."""
        if self.waiting:
            copies += self.waiting[2]
        self.waiting = (role, text, copies)
        self.go_on()

    def go_on(self) -> None:
        while self.waiting and self.at < len(self.marks):
            role, text, copies = self.waiting
            self.row(role, text)
            self.waiting = (role, text, copies - 1) if copies > 1 else None

    def row(self, role: str, text: str) -> None:
        letter, mark = self.letters[0], self.marks[self.at]
        self.cost += _WEIGHT[letter] + (OPEN if letter != "D" and mark.isupper() else 0)
        if letter == "K":
            self.line(role, text)
            self.grammar = NEXT[self.grammar][mark.lower()]
        elif letter == "R":
            self.made(text)
        self.letters, self.at = self.letters[1:], self.at + 1
        self.inserts()

    def result(self) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.sums.pop("turns")
        self.sums.pop("turns", None)
        return self.sums | {"conv_id": self.conv, "gaps": gaps, "cost": self.cost, "audit": "".join(self.audit),
                            "repaired_sha256": self.sha.hexdigest()}


def repair(rows: DataFrame, length: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    ``rows`` has conv_id, turn, role, text and copies (how often the row
    stands there; 0 for none, which still names its conversation). Rows are
    taken by turn, nulls first, and by the digest of role and text in one turn.
    The cheapest edits make the roles follow ``(s?(ua)+)?``; of equally cheap
    ones the first in ASCII order is taken.

    Signatures and counts come from short rows; only the last step moves texts,
    once, and streams a conversation's rows past the edits of its pieces. That
    step is one task a conversation, as its digest is one chain; everything
    before is spread over tasks however long a conversation is.

    Repeated rows count as often as they stand there; a null conv_id is a
    conversation. A conversation without rows has zeros, no edits and the digest
    of nothing. Other columns are ignored. No rows give none.
    """
    parts = with_ends(pieces(signatures(rows), length))
    plans = plain_join(parts, solved(parts.select("sig", "after")).drop("cost"), ["sig", "after"])
    kind = "struct<" + ",".join(f"{n}:{t}" for n, t in (
        ("sig", "string"), ("edits", "array<string>"), ("to", "array<long>"), *((c, "long") for c in (
            "blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "first_turn")),
        ("first_role", "string"), ("last_role", "string"))) + ">"
    # A row's place: behind the piece that begins with it, before those that begin among its copies.
    steps = plans.select("conv_id", "turn", "digest", F.when(F.col("skip") == 0, 0).otherwise(2).alias("step"),
        "part", "number", F.struct(
        "sig", "edits", "to", "blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "first_turn",
        "first_role", "last_role").cast(kind).alias("piece"), F.lit("").alias("role"), F.lit("").alias("text"),
        F.lit(0).cast("long").alias("copies"))
    texts = rows.filter("copies > 0").select(
        "conv_id", "turn", _digest().alias("digest"), F.lit(1).alias("step"), F.lit(0).alias("part"),
        F.lit(0).cast("long").alias("number"), F.lit(None).cast(kind).alias("piece"), "role", "text", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out = None, []
        for batch in batches:
            for conv, copies, piece, role, text in zip(*(batch[c] for c in ("conv_id", "copies", "piece", "role", "text"))):
                conv = conv.as_py()
                if current is None or current.conv != conv:
                    if current is not None:
                        out.append(current.result())
                    current = Repair(conv)
                if copies.as_py():
                    current.rows(role.as_py(), text.as_py(), copies.as_py())
                else:
                    current.piece(piece.as_py())
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, _REPAIRED)
                    out = []
        if current is not None:
            out.append(current.result())
        if out:
            yield pa.RecordBatch.from_pylist(out, _REPAIRED)

    together = steps.unionByName(texts).repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "digest", "step", "part", "number")
    return together.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                    "cost long, audit string, repaired_sha256 string")
