"""Repair of conversations by a shortest path over scalar big-integer weights.

A repair keeps, renames or deletes each row and inserts empty turns, so that the initials of the roles read ``(s?(ua)+)?``. It is
a path through states (start, after s, after u, after a): each row moves from state to state by at most two inserts and its
own edit. The weight of a step is one integer: the cost in its high digits, and below them, in a slot of fixed width that belongs to
the row's position, the letters of its edits in base 8 with zeros behind them. Weights add up and the smallest sum is the
cheapest repair and, of equally cheap ones, that whose letters come first. No slot's letters begin another's, so
comparing slots is comparing the whole strings.

A conversation may hold any number of rows. Rows are numbered by range partitions and cut into blocks of ``BLOCK``. What a block can
cost from each state to each other is a small table; tables of neighbours are combined ``FAN`` at a time, backwards to the least cost
from each block's end, then forwards to the state in which each block begins. With both known, each block is solved on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from seqlattice.llm.names import col
from seqlattice.operators.ordering import row_numbers
from seqlattice.session import materialize

BLOCK = 256
FAN = 256

START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = range(4)
# The state after an inserted or renamed turn, and the states in which a row with this initial may stay.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_STAYS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
_INITIALS = ["s", "u", "a", ""]
_DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
_LETTER = {v: k for k, v in _DIGIT.items()}
# Letters of a slot and bits of it.
_WIDE, _BITS = 3, 9
_NEVER = 1 << 40
# After the last row: what still has to be inserted.
END = "$"

_LONGS = ArrayType(LongType())
_WAY = StructType().add("cost", LongType()).add("letters", StringType()).add("leads", StringType()).add("names", StringType())


def code(initial: str, must_go: bool, cut: bool) -> str:
    """One character for all that a row's edits depend on."""
    return chr(65 + _INITIALS.index(initial if initial in _STAYS else "") + 4 * must_go + 8 * cut)


def _slot(letters: str) -> int:
    return sum(_DIGIT[x] << 3 * (_WIDE - 1 - k) for k, x in enumerate(letters))


@lru_cache(maxsize=64)
def steps(row: str) -> tuple[tuple[int, int, int, int], ...]:
    """``state, next state, cost, slot``: the best step over a row for each pair of states."""
    found: dict[tuple[int, int], tuple[int, int]] = {}

    def offer(state: int, to: int, cost: int, letters: str) -> None:
        found[state, to] = min(found.get((state, to), (_NEVER, 0)), (cost, _slot(letters)))

    for state in _STATES:
        if row == END:
            need = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
            offer(state, START, 2 * need, "I" * need)
            continue
        bits = ord(row) - 65
        initial, must_go, cut = _INITIALS[bits & 3], bits & 4, bits >> 3
        at = state
        for inserts in range(3):
            lead, cost = "I" * inserts, 2 * inserts
            offer(state, at, cost + 3, lead + "D")
            if not must_go:
                offer(state, _NEXT[at], cost + 2 + cut, lead + "R")
                if at in _STAYS[initial]:
                    offer(state, _STAYS[initial][at], cost + cut, lead + "K")
            at = _NEXT[at]
    return tuple((a, b, *v) for (a, b), v in sorted(found.items()))


def _relax(rows: str, best: list[int | None]) -> list[int | None]:
    """The smallest weight with which each state is reached after ``rows``."""
    high = _BITS * len(rows)
    for k, row in enumerate(rows):
        low = high - _BITS * (k + 1)
        after: list[int | None] = [None] * 4
        for state, to, cost, slot in steps(row):
            if best[state] is not None:
                weight = best[state] + (cost << high) + (slot << low)
                if after[to] is None or weight < after[to]:
                    after[to] = weight
        best = after
    return best


@lru_cache(maxsize=4096)
def solve(rows: str, after: tuple[int, ...], start: int) -> tuple[int, int, tuple[str, ...]]:
    """Cost, last state and each row's letters of the best way through ``rows`` from ``start``, if leaving by a state costs ``after``."""
    best: list[int | None] = [None] * 4
    best[start] = 0
    high = _BITS * len(rows)
    ways = [(w + (after[s] << high), s) for s, w in enumerate(_relax(rows, best)) if w is not None]
    if not ways:
        return _NEVER, START, ("",) * len(rows)
    weight, last = min(ways)
    digits = weight & ((1 << high) - 1)
    letters = []
    for k in range(len(rows)):
        slot = digits >> (high - _BITS * (k + 1)) & ((1 << _BITS) - 1)
        letters.append("".join(_LETTER[slot >> 3 * (_WIDE - 1 - j) & 7] for j in range(_WIDE) if slot >> 3 * (_WIDE - 1 - j) & 7))
    return (weight >> high) - after[last], last, tuple(letters)


def walk(rows: str, letters: tuple[str, ...], start: int) -> tuple[list[str], list[str]]:
    """For each row the initials of turns inserted before it, and its own: ``k`` as it is, ``u`` or ``a`` renamed, empty if deleted."""
    state, leads, names = start, [], []
    for row, slot in zip(rows, letters):
        lead, name = "", ""
        for letter in slot:
            if letter == "I":
                state = _NEXT[state]
                lead += "ua"[state == ASSISTANT]
            elif letter == "R":
                state = _NEXT[state]
                name = "ua"[state == ASSISTANT]
            elif letter == "K":
                state = _STAYS[_INITIALS[ord(row) - 65 & 3]][state]
                name = "k"
        leads.append(lead)
        names.append(name)
    return leads, names


@lru_cache(maxsize=4096)
def _costs(rows: str) -> list[int]:
    """Least cost of a block from each state to each other."""
    out = []
    for start in _STATES:
        best = [_NEVER] * 4
        best[start] = 0
        for row in rows:
            after = [_NEVER] * 4
            for state, to, cost, _ in steps(row):
                after[to] = min(after[to], best[state] + cost)
            best = after
        out += [min(b, _NEVER) for b in best]
    return out


def _product(tables: list[np.ndarray]) -> list[int]:
    total = np.full((4, 4), _NEVER)
    np.fill_diagonal(total, 0)
    for t in tables:
        total = np.minimum((total[:, :, None] + np.array(t).reshape(4, 4)[None]).min(axis=1), _NEVER)
    return total.reshape(-1).tolist()


def _backward(tables: list[np.ndarray], after: np.ndarray) -> list[list[int]]:
    """The least cost after each of consecutive tables, ``after`` being that after the last."""
    out = [np.array(after)]
    for t in tables[:0:-1]:
        out.append(np.minimum((np.array(t).reshape(4, 4) + out[-1][None]).min(axis=1), _NEVER))
    return [o.tolist() for o in reversed(out)]


@F.pandas_udf(_LONGS)
def _costs_of(rows: pd.Series) -> pd.Series:
    return rows.map(_costs)


@F.pandas_udf(_LONGS)
def _product_of(tables: pd.Series) -> pd.Series:
    return tables.map(_product)


@F.pandas_udf(ArrayType(_LONGS))
def _backward_of(tables: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([_backward(t, a) for t, a in zip(tables, after)])


@F.pandas_udf(_LONGS)
def _ends_of(rows: pd.Series, after: pd.Series) -> pd.Series:
    """The last state of a block for each first one."""
    return pd.Series([[solve(r, tuple(int(x) for x in a), s)[1] for s in _STATES] for r, a in zip(rows, after)])


@F.pandas_udf(_LONGS)
def _chain_of(maps: pd.Series) -> pd.Series:
    def chain(found: list[np.ndarray]) -> list[int]:
        at = list(_STATES)
        for m in found:
            at = [int(m[s]) for s in at]
        return at

    return maps.map(chain)


@F.pandas_udf(_LONGS)
def _forward_of(maps: pd.Series, start: pd.Series) -> pd.Series:
    """The first state of each of consecutive blocks."""

    def forward(found: list[np.ndarray], at: int) -> list[int]:
        out = []
        for m in found:
            out.append(int(at))
            at = m[at]
        return out

    return pd.Series([forward(m, s) for m, s in zip(maps, start)])


@F.pandas_udf(_WAY)
def _solved(rows: pd.Series, after: pd.Series, start: pd.Series) -> pd.DataFrame:
    out = []
    for r, a, s in zip(rows, after, start):
        cost, _, letters = solve(r, tuple(int(x) for x in a), int(s))
        leads, names = walk(r, letters, int(s))
        out.append((cost, ",".join(letters), ",".join(leads), ",".join(names)))
    return pd.DataFrame(out, columns=["cost", "letters", "leads", "names"])


def _sweep(table: DataFrame, blocks: int, whole: Column, spread: object, top: Column) -> DataFrame:
    """``conv, block, got`` for ``conv, block, value``: ``got`` starts as ``top`` for a conversation's only block.

    ``whole(values)`` combines the values of ``FAN`` neighbours, ``spread(values, got)`` hands theirs down to them.
    """
    if blocks <= 1:
        return table.select("conv", "block", top.alias("got"))
    family = table.groupBy("conv", F.floor(F.col("block") / FAN).alias("above")).agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("kids"))
    family = materialize(family)
    upper = _sweep(family.select("conv", F.col("above").alias("block"), whole(F.col("kids.value")).alias("value")), -(-blocks // FAN), whole, spread, top)
    upper = upper.select("conv", F.col("block").alias("above"), F.col("got").alias("given"))
    down = family.join(upper, ["conv", "above"]).select("conv", F.col("kids.block").alias("blocks"), spread(F.col("kids.value"), F.col("given")).alias("gots"))
    return down.select("conv", F.explode(F.arrays_zip("blocks", "gots")).alias("kid")).select("conv", F.col("kid.blocks").alias("block"), F.col("kid.gots").alias("got"))


class Repair(NamedTuple):
    """Written tables of a repair; ``conv`` is the text of a conversation's id, one space for a null.

    ``counts``: ``conv, gaps, blank, duplicate, truncated`` of conversations with rows. ``audits``: ``conv, illegal, cost, audit``.
    ``turns``: ``conv, pos, sub, role, text``, the repaired rows in the order of ``pos`` and ``sub``.
    """

    counts: DataFrame
    audits: DataFrame
    turns: DataFrame


def spaced(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with seeded faults, by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes it a user's.

    Nulls are one space, a null turn stays null for the order.
    """
    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    plain = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    changed = plain.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return changed.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "kind")


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """The cheapest repair of each conversation.

    A conversation's rows are taken by turn, nulls first, then by role and by the SHA-256 of the text. The first fault of a
    row counts: blank (no ``[^\\x20\\x09-\\x0D]``), duplicate (a row before has its role and text), truncated (its last such character is not
    ``[.!?]``). Keep costs 0, Rerole to user or assistant 2, Delete 3, which blank and duplicate rows need, Insert of a user's or assistant's empty
    turn 2; a truncated row that is not deleted adds 1. ``audit`` has the initials of the edits in order, of equally cheap repairs the smallest in
    ASCII; it fixes the repaired rows. A row whose role is empty has no initial and cannot stay as it is.

    Null roles, texts and ids are one space, repeated rows are duplicates, an empty table gives empty tables, and other columns
    are not read. ``rows`` is read twice, the texts once; texts are moved for the rows that stay.
    """
    plain = rows.select(spaced(id_col).alias("conv"), col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"))
    plain = plain.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    slim = plain.select("conv", "turn", "role", "digest", blank.alias("blank"), (~ended).alias("open"), F.monotonically_increasing_id().alias("salt"))
    numbered = row_numbers(slim, ["conv"], ["turn", "role", "digest", "salt"], "pos")
    numbered = materialize(numbered.select("conv", "turn", "role", "digest", "blank", "open", (F.col("pos") - 1).alias("pos")))

    first = numbered.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    known = numbered.join(first, ["conv", "pos"], "left").withColumn("again", ~F.col("blank") & F.col("first").isNull())
    known = known.withColumn("truncated", F.col("open") & ~F.col("blank") & ~F.col("again"))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    number = number + 4 * (F.col("blank") | F.col("again")).cast("int") + 8 * F.col("truncated").cast("int")
    known = materialize(known.select("conv", "pos", "turn", "role", "digest", "blank", "again", "truncated", F.char(number + 65).alias("code")))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    sums = [F.sum(F.col(c).cast("long")).alias(n) for c, n in (("blank", "blank"), ("again", "duplicate"), ("truncated", "truncated"))]
    counts = materialize(known.groupBy("conv").agg(gaps.alias("gaps"), *sums, F.count(F.lit(1)).alias("rows")))

    # The first row of a block is also seen by the block before, for the pair of roles between them.
    block = F.floor(F.col("pos") / BLOCK)
    seen = F.when((F.col("pos") > 0) & (F.col("pos") % BLOCK == 0), F.array(block, block - 1)).otherwise(F.array(block))
    item = ["pos", "code", "turn", "role", "digest"]
    ends = counts.select("conv", F.col("rows").alias("pos"), F.lit(END).alias("code"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"))
    every = known.select("conv", *item, F.explode(seen).alias("block")).unionByName(ends.withColumn("block", block))
    blocks = every.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct(*item))).alias("items"))
    initials = F.transform(F.filter("items", lambda x: x["code"] != END), lambda x: F.substring(x["role"], 1, 1))
    illegal = F.filter(F.col("initials"), lambda x, k: (k > 0) & ~F.concat(F.element_at("initials", F.greatest(k, F.lit(1))), x).isin("su", "ua", "au"))
    own = F.filter("items", lambda x: F.floor(x["pos"] / BLOCK) == F.col("block"))
    blocks = blocks.withColumn("initials", initials).select("conv", "block", own.alias("items"), F.size(illegal).cast("long").alias("illegal"))
    blocks = materialize(blocks.withColumn("codes", F.array_join("items.code", "")))

    deep = int(blocks.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]) + 1
    none = F.array(*[F.lit(0).cast("long")] * 4)
    if deep > 1:
        after = _sweep(blocks.select("conv", "block", _costs_of("codes").alias("value")), deep, _product_of, _backward_of, none)
        blocks = materialize(blocks.join(after.withColumnRenamed("got", "after"), ["conv", "block"]))
        begin = _sweep(blocks.select("conv", "block", _ends_of("codes", "after").alias("value")), deep, _chain_of, _forward_of, F.lit(START).cast("long"))
        blocks = blocks.join(begin.withColumnRenamed("got", "start"), ["conv", "block"])
    else:
        blocks = blocks.select("*", none.alias("after"), F.lit(START).cast("long").alias("start"))
    solved = materialize(blocks.select("conv", "block", "items", "illegal", _solved("codes", "after", "start").alias("way")))

    letters = F.struct("block", F.translate("way.letters", ",", "").alias("letters"))
    audits = solved.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("way.cost").alias("cost"), F.array_join(F.sort_array(F.collect_list(letters))["letters"], "").alias("audit"))

    edits = solved.select("conv", F.explode(F.arrays_zip(F.col("items"), F.split("way.leads", ",").alias("lead"), F.split("way.names", ",").alias("name"))).alias("edit"))
    edits = edits.select("conv", *[F.col(f"edit.items.{c}").alias(c) for c in ("pos", "turn", "role", "digest")], F.col("edit.lead").alias("lead"), F.col("edit.name").alias("name"))
    texts = plain.dropDuplicates(["conv", "turn", "role", "digest"])
    stay = edits.filter("name <> ''").alias("e").join(texts.alias("t"), F.expr("e.conv = t.conv AND e.turn <=> t.turn AND e.role = t.role AND e.digest = t.digest"))
    stay = stay.select("e.conv", "e.pos", "e.lead", F.when(F.col("e.name") == "u", "user").when(F.col("e.name") == "a", "assistant").otherwise(F.col("e.role")).alias("role"), "t.text")
    gone = edits.filter("name = '' AND lead <> ''").select("conv", "pos", "lead", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    new = F.transform(F.filter(F.split("lead", ""), lambda x: x != ""), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("role").isNotNull(), F.array(F.struct("role", "text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    turns = stay.unionByName(gone).select("conv", "pos", F.posexplode(F.concat(new, own)).alias("sub", "turn"))
    return Repair(counts.drop("rows"), materialize(audits), turns.select("conv", "pos", "sub", "turn.role", "turn.text"))


def text_hashes(turns: DataFrame) -> DataFrame:
    """``conv, repaired_sha256`` of the lines ``role:text`` of each conversation in order.

    A hash is a chain, so one task reads a conversation's turns; it holds one batch of them.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, found = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                line = f"{role}:{text}".encode()
                if c != conv:
                    if found is not None:
                        done.append((conv, found.hexdigest()))
                    conv, found = c, hashlib.sha256(line)
                else:
                    found.update(b"\n" + line)
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in range(2)], ["conv", "repaired_sha256"])
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([found.hexdigest()])], ["conv", "repaired_sha256"])

    ordered = turns.repartition("conv").sortWithinPartitions("conv", "pos", "sub")
    return ordered.select("conv", "role", "text").mapInArrow(chain, "conv string, repaired_sha256 string")
