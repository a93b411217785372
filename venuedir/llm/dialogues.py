"""Faults of conversations, and the cheapest edits that restore their structure.

Every turn is reduced to one letter for its role and fault. Conversations with the same letters
share one search: distinct signatures are sorted from their ends, so that neighbours share
their suffixes as in an automaton minimised from the end, and a suffix's cost-to-go and best
edit are computed once per grammar state. Texts only travel once, sorted by conversation,
when the edits are applied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuedir.llm.common import slices, staged, table
from venuedir.operators.skew import lookup

SPACE = " \t\n\x0b\f\r"
ENDINGS = ".!?"
#: Costs of the edits; an undeleted truncated turn adds one more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What follows what in ``(s?(ua)+)?``: start, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ACCEPTING = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}

# A signature has one letter per turn: X has to go; s, u, a, o (any other role) are sound, capitals truncated.
GONE = "X"


def own_fault(text: Column) -> Column:
    """The fault that a turn has by itself: ``blank``, ``truncated`` (does not end like a sentence), or NULL."""
    last = F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)
    return F.when(last == "", "blank").when(~last.isin(*ENDINGS), "truncated")


def _letter(role: Column, flaw: Column) -> Column:
    initial = F.substring(role, 1, 1)
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(flaw.isin("blank", "duplicate"), GONE).when(flaw == "truncated", F.upper(plain)).otherwise(plain)


# --- the search over suffixes -----------------------------------------------------


@dataclass(slots=True)
class Suffix:
    """Cost-to-go and best first edit of one suffix in each grammar state; ``then`` is the state after that edit."""

    cost: tuple
    edit: tuple
    then: tuple


_NEVER = 1 << 60


def _closed(cost: list, edit: list, then: list) -> Suffix:
    """Let turns be inserted before the suffix; three rounds reach every chain of states."""
    for _ in range(3):
        for state, ways in NEXT.items():
            for role, to in ways.items():
                if role in ROLES and (cost[to] + INSERT, "I") < (cost[state], edit[state]):
                    cost[state], edit[state], then[state] = cost[to] + INSERT, "I", to
    return Suffix(tuple(cost), tuple(edit), tuple(then))


def end_suffix() -> Suffix:
    cost = [0 if s in ACCEPTING else _NEVER for s in range(4)]
    return _closed(cost, ["" if s in ACCEPTING else "~" for s in range(4)], [s for s in range(4)])


def grown(letter: str, after: Suffix) -> Suffix:
    """The suffix with one more turn in front.

    Each edit letter has one successor in a given state, so the ASCII-least of the cheapest
    edits is the start of the ASCII-least audit.
    """
    cost, edit, then = [], [], []
    extra = TRUNCATED if letter.isupper() else 0
    for state, ways in NEXT.items():
        options = [(DELETE + after.cost[state], "D", state)]
        if letter != GONE:
            role = letter.lower()
            if role in ways:
                options.append((extra + after.cost[ways[role]], "K", ways[role]))
            options += [(REROLE + extra + after.cost[to], "R", to) for r, to in ways.items() if r in ROLES]
        best = min(options)
        cost.append(best[0])
        edit.append(best[1])
        then.append(best[2])
    return _closed(cost, edit, then)


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of signatures that come sorted by their reversed letters; one stack of suffixes is held."""
    stack, before = [end_suffix()], ""
    for batch in batches:
        costs, audits = [], []
        for back in batch.column("back").to_pylist():
            same = 0
            for x, y in zip(back, before, strict=False):
                if x != y:
                    break
                same += 1
            del stack[same + 1:]
            for letter in back[same:]:
                stack.append(grown(letter, stack[-1]))
            before = back
            costs.append(stack[-1].cost[START])
            state, audit, depth = START, [], len(back)
            while True:
                here = stack[depth]
                edit = here.edit[state]
                if not edit:
                    break
                audit.append(edit)
                state = here.then[state]
                depth -= edit != "I"
            audits.append("".join(audit))
        yield pa.RecordBatch.from_arrays([batch.column("back"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())],
                                         ["back", "cost", "audit"])


def audits(signatures: DataFrame, column: str = "signature") -> DataFrame:
    """``(signature, cost, audit)`` of every distinct signature.

    Range partitions of the reversed signatures keep shared suffixes together; a suffix that a
    border cuts apart is computed once on each side.
    """
    back = signatures.select(F.reverse(column).alias("back")).where("back is not null").distinct()
    planned = back.repartitionByRange("back").sortWithinPartitions("back").mapInArrow(_plans, "back string, cost long, audit string")
    return planned.select(F.reverse("back").alias(column), "cost", "audit")


# --- conversations to signatures -----------------------------------------------------


def turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
          copy: str | None = None) -> DataFrame:
    """Turns as ``(key, turn, role, text, copy, h)`` in a shape all steps share; NULL role and text become one space.

    ``h`` hashes the text; it orders turns of equal number and role. ``copy`` tells repeated turns apart.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    return conversations.select(
        F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        body.alias("text"), (F.col(copy) if copy else F.lit(0)).cast("int").alias("copy"),
        F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(7), body).alias("b")).alias("h"))


ORDER = ["key", "turn", "role", "h", "copy"]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation out of its sorted turns; nothing but its signature and counters is held."""
    kind = None
    out: list[tuple] = []
    key, state = None, None

    def rows():
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind), pa.array(["".join(s) for s in columns[1]], pa.string()),
             *[pa.array(c, pa.int64()) for c in columns[2:]]],
            ["key", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"])

    def close():
        low, high, distinct, _, letters, counts, illegal = state
        gaps = 0 if low is None else high - low + 1 - distinct
        out.append((key, letters, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal))

    for batch in batches:
        kind = batch.schema.field("key").type
        for new, turn, initial, letter, flaw in zip(*[batch.column(c).to_pylist() for c in ("key", "turn", "initial", "letter", "flaw")],
                                                    strict=True):
            if state is None or new != key:
                if state is not None:
                    close()
                    if len(out) >= 1000:
                        yield rows()
                        out.clear()
                key, state = new, [None, None, 0, None, [], {"blank": 0, "duplicate": 0, "truncated": 0}, 0]
            if turn is not None:
                state[2] += turn != state[1]
                state[0] = turn if state[0] is None else state[0]
                state[1] = turn
            if state[4]:
                state[6] += state[3] + initial not in ("su", "ua", "au")
            state[3] = initial
            state[4].append(letter)
            if flaw is not None:
                state[5][flaw] += 1
    if state is not None:
        close()
    if out:
        yield rows()


def signatures(rows: DataFrame) -> DataFrame:
    """``(key, signature, gaps, blank, duplicate, truncated, illegal)`` per conversation with at least one turn.

    Turns come in the order of their number (NULL first), then of role and text hash. A turn is a
    duplicate if its role and text came before; that is found by a window per (key, role, text), so that no
    conversation's texts are held. Texts stay behind: only their hashes are shuffled.
    """
    kind = rows.schema["key"].dataType.simpleString()
    seen = F.row_number().over(Window.partitionBy("key", "role", "h").orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    narrow = rows.select("key", "turn", "role", "copy", "h", own_fault(F.col("text")).alias("_own"))
    narrow = narrow.withColumn("flaw", F.when(F.col("_own") == "blank", "blank").when(seen, "duplicate").otherwise(F.col("_own")))
    narrow = narrow.select(*ORDER, F.substring("role", 1, 1).alias("initial"), "flaw", _letter(F.col("role"), F.col("flaw")).alias("letter"))
    ordered = narrow.repartition("key").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ORDER])
    return ordered.select("key", "turn", "initial", "letter", "flaw").mapInArrow(
        _summaries, f"key {kind}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


def reports(rows: DataFrame) -> DataFrame:
    """:func:`signatures` with ``cost`` and ``audit``; a signature that very many conversations share is joined skew-tolerantly."""
    found = staged(signatures(rows), "signatures")
    return lookup(found, audits(found), ["signature"])


# --- edits applied ---------------------------------------------------------------------


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(key, first, edit, role, text)`` of all turns, deleted ones too, and ``(key, True, None, ..)`` before each conversation.

    The audit comes as the first row of its conversation, the turns follow in order. Of texts, one slice is held.
    """
    audit, at, state = "", 0, START

    def insertions(key):
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = next(r for r in NEXT[state] if r in ROLES)
            state = NEXT[state][role]
            at += 1
            yield key, False, "I", ROLES[role], ""

    key, open_ = None, False
    for part in slices(batches, "text"):
        for new, plan, role, text in zip(*[part.column(c).to_pylist() for c in ("key", "audit", "role", "text")], strict=True):
            if plan is not None:
                if open_:
                    yield from insertions(key)
                key, open_, audit, at, state = new, True, plan, 0, START
                yield key, True, None, None, None
                continue
            yield from insertions(key)
            edit, kept = audit[at], role
            at += 1
            if edit != "D":
                letter = role[:1]
                if edit == "R":
                    letter = next(r for r in NEXT[state] if r in ROLES)
                    kept = ROLES[letter]
                state = NEXT[state][letter]
            yield key, False, edit, kept, text
    if open_:
        yield from insertions(key)


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Turns behind the audit of their conversation, whole conversations in one partition; the only shuffle of texts."""
    plan = found.select("key", "audit", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "h", "copy", "text")])
    both = plan.unionByName(rows.withColumn("audit", F.lit(None).cast("string")))
    order = [F.col("key").asc_nulls_first(), F.col("audit").isNull(), *[F.col(c).asc_nulls_first() for c in ORDER[1:]]]
    return both.repartition("key").sortWithinPartitions(*order).select("key", "audit", "role", "text")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, out, size, place = None, [], 0, 0

    def peek():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("key").type
            yield batch

    def rows():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kind, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)],
            ["key", "turn", "edit", "role", "text"])

    for key, first, edit, role, text in _applied(peek()):
        if first:
            place = 0
        elif edit != "D":
            out.append((key, place, edit, role, text))
            place, size = place + 1, size + len(text) + 50
            if size > 4_000_000:
                yield rows()
                out, size = [], 0
    if out:
        yield rows()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, out, key, digest, lines = None, [], None, None, 0

    def peek():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("key").type
            yield batch

    def rows():
        keys, sums = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(sums, pa.string())], ["key", "repaired_sha256"])

    for new, first, edit, role, text in _applied(peek()):
        if first:
            if digest is not None:
                out.append((key, digest.hexdigest()))
                if len(out) >= 1000:
                    yield rows()
                    out = []
            key, digest, lines = new, hashlib.sha256(), 0
        elif edit != "D":
            digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
            lines += 1
    if digest is not None:
        out.append((key, digest.hexdigest()))
    if out:
        yield rows()


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(key, turn, edit, role, text)``: conversations after the edits of ``found``, turns numbered anew from 0."""
    kind = rows.schema["key"].dataType.simpleString()
    return _with_audits(rows, found).mapInArrow(_repaired, f"key {kind}, turn long, edit string, role string, text string")


def repair_conversations(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(repaired turns, reports)`` of a table of conversations.

    The report has one row per conversation: its faults, gaps and illegal neighbours, the least cost and the
    audit, one letter per edit (Keep, Rerole, Delete, Insert), ASCII-least among the cheapest. NULL role and text are one
    space, NULL keys one conversation, NULL turns come first; turns of equal number are ordered by role and text hash, and repeated
    rows are duplicates of the first. Empty tables give empty ones; further columns are ignored. A result row holds one letter per
    turn of its conversation, so only these, never its texts, are held at once.
    """
    rows = turns(conversations, key, turn, role, text)
    found = staged(reports(rows), "reports")
    return repaired_turns(rows, found).withColumnRenamed("key", key), found.withColumnRenamed("key", key)


# --- the registered query --------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted damage, chosen by a checksum of conversation and turn."""
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    harm = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), harm.alias("harm")).where("harm <> 0")
    body = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ENDINGS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"),
                       F.explode(copies).alias("copy"))


def op13_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and digest of the repaired text of every damaged conversation."""
    conversations = table(spark, sf_dir, "conversations")
    rows = turns(damaged(conversations), copy="copy")
    found = staged(reports(rows), "reports")
    digests = _with_audits(rows, found).mapInArrow(_digests, "key long, repaired_sha256 string")
    whole = found.drop("signature").join(digests, found["key"].eqNullSafe(digests["key"])).drop(digests["key"])
    ids = conversations.select(F.col("conv_id")).distinct()
    result = ids.join(whole, ids["conv_id"].eqNullSafe(whole["key"]), "left").drop("key")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return result.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
