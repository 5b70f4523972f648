"""Repairing the structure of conversations by Wagner-Fischer alignment with the role grammar.

A well-formed conversation's role initials match ``(s?(ua)+)?``. Turns are edited at least cost:
Keep 0, Rerole to user or assistant 2, Delete 3 (required for blank and repeated turns), Insert an
empty user or assistant turn 2; a truncated turn that stays adds 1. Of the cheapest edits
the one whose initials are least in ASCII order is taken.

The alternating grammar string of every length ends alike, so one Wagner-Fischer table serves
all lengths: cell (i, r) is the cost of aligning the turns from i on with the last r characters. A
quick repair gives an incumbent cost, and cells that cannot stay within it (Ukkonen's band:
surplus characters cost 2 each, surplus turns 3) are not opened. Each feasible length of the
least cost is traced, and the audits are compared.

Rows are ordered by one range-partitioned sort and numbered by prefix sums over its partitions,
and conversations are cut into segments of at most 1024 turns, so no conversation, however long, is
sorted, held or aligned in one task. A segment is aligned for every state that it can be
entered and left in; a fold over a long conversation's few states picks the parts.

Defined results: a null role or text is one space. Turns with the same number are ordered by role
and text; null numbers come first. Rows of a null conversation id are one conversation. A
conversation that loses all its rows has zeros, an empty audit and no lines. An empty table
gives an empty result. Extra columns are ignored. A conversation's repaired text and audit
are single values, so they are limited to Spark's 2 GB a value.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changegraph.llm.text import materialise

SEGMENT = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, a user turn or the end may follow, an assistant turn must follow.
START, SYSTEM, EVEN, ODD = range(4)
LEGAL = ("su", "ua", "au")
_INF = np.int64(1) << 40


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage of (conv_id, turn, role, text) by crc32 of ``conv_id:turn`` modulo 20."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), copies.alias("_n"))
    return out.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_copy")


def _char(last: str, r: int) -> str:
    """The character that is the r-th from the end of an alternating string with this end."""
    return last if r % 2 else ("u" if last == "a" else "a")


class Alignment:
    """The Wagner-Fischer table of a segment against all alternating strings that end in ``last``.

    turns: (initial, fault) with fault in ``b`` (blank), ``d`` (duplicate), ``t`` (truncated) or ``-``. ``open_end``:
    insertions may follow the last turn. most: cells above this cost are not needed."""

    def __init__(self, turns: tuple[tuple[str, str], ...], last: str, open_end: bool, most: int | None = None):
        self.turns, self.last, self.open_end = turns, last, open_end
        n = len(turns)
        forced = np.array([f in "bd" for _, f in turns], dtype=np.int64)
        after = np.concatenate([np.cumsum(forced[::-1])[::-1], [0]])  # deletions that must follow
        clean = np.arange(n, -1, -1) - after
        width = 2 * n + 4 if most is None else int(n + most // INSERT + 2)
        r = np.arange(width)
        match = {c: np.array([_char(last, x) == c for x in r]) for c in "ua"}
        row = INSERT * r if open_end else np.where(r == 0, 0, _INF)
        self.rows = [row.astype(np.int64)]
        for i in range(n - 1, -1, -1):
            below = self.rows[-1]
            row = below + DELETE
            initial, fault = turns[i]
            if fault not in "bd":
                cost = np.where(match[initial], KEEP, REROLE) if initial in match else np.full(width, REROLE)
                row[1:] = np.minimum(row[1:], below[:-1] + cost[1:] + TRUNCATED * (fault == "t"))
            row = np.minimum.accumulate(row - INSERT * r) + INSERT * r
            if most is not None:
                spare = most - DELETE * int(after[i])
                row[(r < clean[i] - spare // DELETE) | (r > clean[i] + spare // INSERT)] = _INF
            self.rows.append(np.minimum(row, _INF))
        self.rows.reverse()

    def cost(self, i: int, r: int) -> int:
        return int(self.rows[i][r])

    def lengths(self, i: int, parity: int, least: int) -> tuple[int, list[int]]:
        """The least cost from turn i on over lengths of this parity from ``least`` on, and all such lengths."""
        first = least + (least + parity) % 2
        costs = self.rows[i][first::2]
        low = int(costs.min())
        return low, [] if low >= _INF else (first + 2 * np.flatnonzero(costs == low)).tolist()

    def audit(self, i: int, r: int) -> str:
        """The ASCII-least of the cheapest edits from cell (i, r) on."""
        out, n = [], len(self.turns)
        while i < n or r:
            here = self.cost(i, r)
            if i < n and here == DELETE + self.cost(i + 1, r):
                out.append("D")
                i += 1
            elif r and (i < n or self.open_end) and here == INSERT + self.cost(i, r - 1):
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.turns[i][0] == _char(self.last, r) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def _incumbent(turns: tuple[tuple[str, str], ...]) -> int:
    """The cost of a plain repair: delete what must go, rerole the others in their order, insert a last turn."""
    cost, ahead, none = 0, "u", True
    for initial, fault in turns:
        if fault in "bd":
            cost += DELETE
            continue
        cost += TRUNCATED * (fault == "t")
        if none and initial == "s":
            none = False
            continue
        none = False
        cost += REROLE * (initial != ahead)
        ahead = "a" if ahead == "u" else "u"
    if ahead == "a":
        cost += INSERT
    elif not none and all(i == "s" or f in "bd" for i, f in turns):
        cost += 2 * INSERT
    return cost


@lru_cache(maxsize=20_000)
def edits(turns: tuple[tuple[str, str], ...], entry: int, ends: bool) -> dict[int, tuple[int, str]]:
    """The cheapest edits of a segment by the state it is left in: {state: (cost, audit)}.

    ends: it is the conversation's last segment, so what is left has to be a whole conversation (state EVEN stands for all)."""
    n = len(turns)
    out: dict[int, tuple[int, str]] = {}

    def offer(state: int, cost: int, audit: str) -> None:
        if cost < _INF and (state not in out or (cost, audit) < out[state]):
            out[state] = (cost, audit)

    most = _incumbent(turns) if ends and entry == START else None
    system = [i for i, (initial, fault) in enumerate(turns) if initial == "s" and fault not in "bd"] if entry == START else []
    for state, last in ((EVEN, "a"),) if ends else ((EVEN, "a"), (ODD, "u")):
        t = Alignment(turns, last, ends, most)
        phase = int((entry == ODD) != (state == ODD))  # parity of the length
        least = 0 if entry in (EVEN, ODD) else (1 if state == ODD else 2)
        low, lengths = t.lengths(0, phase, least)
        for r in lengths:
            offer(state, low, t.audit(0, r))
        for i in system:  # what stands before the system turn goes
            low, lengths = t.lengths(i + 1, phase, least)
            low += DELETE * i + TRUNCATED * (turns[i][1] == "t")
            if state not in out or low <= out[state][0]:
                for r in lengths:
                    offer(state, low, "D" * i + "K" + t.audit(i + 1, r))
    if ends:
        if entry == START:
            offer(EVEN, DELETE * n, "D" * n)
        return out
    if entry in (START, SYSTEM):
        offer(entry, DELETE * n, "D" * n)
    for i in system:
        offer(SYSTEM, DELETE * (n - 1) + TRUNCATED * (turns[i][1] == "t"), "D" * i + "K" + "D" * (n - 1 - i))
    return out


def repaired(audit: str, entry: int, roles: list[str], texts: list[str]) -> list[str]:
    """The lines ``role:text`` that the edits leave."""
    out, ahead, i = [], "a" if entry == ODD else "u", 0
    name = {"u": "user", "a": "assistant"}
    for op in audit:
        if op == "K":
            out.append(f"{roles[i]}:{texts[i]}")
        elif op in "RI":
            out.append(f"{name[ahead]}:{texts[i] if op == 'R' else ''}")
        if op in "RI" or op == "K" and roles[i][:1] == ahead:
            ahead = "a" if ahead == "u" else "u"
        i += op != "I"
    return out


def number_rows(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds ``pos``, each row's number (from 0) within its key by ``order``; no key is gathered in one task."""
    by = [F.col(key).asc_nulls_first(), *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = materialise(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")), "ordered")
    parts = placed.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_p")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_p")) - F.col("_n")
    parts = parts.select("_key", "_p", (before - F.col("_first")).alias("_shift"))  # a row for a key and a partition
    out = placed.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("pos", F.col("_id") + F.col("_shift")).drop("_key", "_part", "_p", "_id", "_shift")


_OUT = "conv_id long, segment long, illegal long, cost long, audit string, lines array<string>"
_WAYS = "conv_id long, segment long, illegal long, entry int, state int, cost long, audit string"


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of conversations (conv_id, turn, role, text).

    ``lines`` is the repaired conversation, ``audit`` the initials of its edits in order."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    rows = number_rows(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = rows.withColumns({"_said": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), "_last": last})
    first = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("_said").alias("_key")).agg(F.min("pos").alias("_first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_key"))).drop("_conv", "_key")
    fault = F.when(F.col("_last") == "", "b").when(F.col("_first") < F.col("pos"), "d").when(~F.col("_last").isin(".", "!", "?"), "t").otherwise("-")
    rows = rows.select("conv_id", "turn", "pos", "role", "text", fault.alias("fault"))

    # The last turn of a full segment goes with the next segment too, where it only stands before the others.
    at = F.array(F.struct(F.floor(F.col("pos") / SEGMENT).alias("segment"), F.lit(False).alias("before")))
    edge = F.array(F.struct((F.floor(F.col("pos") / SEGMENT) + 1).alias("segment"), F.lit(True).alias("before")))
    spread = rows.withColumn("_at", F.explode(F.when(F.col("pos") % SEGMENT == SEGMENT - 1, F.concat(at, edge)).otherwise(at)))
    turn = F.struct("pos", "role", F.when(F.col("_at.before"), F.lit("")).otherwise(F.col("text")).alias("text"), "fault", F.col("_at.before").alias("before"))
    counted = [F.count_if((F.col("fault") == f) & ~F.col("_at.before")).alias(n) for f, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]
    segments = spread.groupBy("conv_id", F.col("_at.segment").alias("segment")).agg(F.sort_array(F.collect_list(turn)).alias("turns"), *counted)
    segments = materialise(segments.where(F.exists("turns", lambda t: ~t["before"])), "segments")

    facts = rows.groupBy("conv_id").agg(F.min("turn").alias("_low"), F.max("turn").alias("_high"), F.countDistinct("turn").alias("_turns"), F.max("pos").alias("_pos"))
    facts = facts.select("conv_id", F.coalesce(F.col("_high") - F.col("_low") + 1 - F.col("_turns"), F.lit(0)).cast("long").alias("gaps"), F.floor(F.col("_pos") / SEGMENT).alias("final"))
    facts = materialise(facts, "facts")

    def turned(turns):
        own = [t for t in turns if not t["before"]]
        roles = [t["role"] for t in turns]
        pairs = (a[:1] + b[:1] for a, b in zip(roles, roles[1:]))
        return own, tuple((t["role"][:1], t["fault"]) for t in own), sum(p not in LEGAL for p in pairs)

    def whole(batches):
        """Conversations of one segment."""
        for batch in batches:
            out = []
            for conv, turns in zip(batch["conv_id"].to_pylist(), batch["turns"].to_pylist(), strict=True):
                own, key, illegal = turned(turns)
                cost, audit = edits(key, START, True)[EVEN]
                out.append({"conv_id": conv, "segment": 0, "illegal": illegal, "cost": cost, "audit": audit, "lines": repaired(audit, START, [t["role"] for t in own], [t["text"] for t in own])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("lines", pa.list_(pa.string()))]))

    def ways(batches):
        """What a segment of a longer conversation costs by the states around it."""
        for batch in batches:
            out = []
            for conv, segment, final, turns in zip(*(batch[c].to_pylist() for c in ("conv_id", "segment", "final", "turns")), strict=True):
                _, key, illegal = turned(turns)
                for entry in (START,) if not segment else range(4):
                    for state, (cost, audit) in edits(key, entry, segment == final).items():
                        out.append({"conv_id": conv, "segment": segment, "illegal": illegal, "entry": entry, "state": state, "cost": cost, "audit": audit})
            edits.cache_clear()
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("illegal", pa.int64()), ("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        """The way through a long conversation: the least cost, then the least audit. Rows hold the audits' ranks, not the audits."""
        n = int(pdf["segment"].max()) + 1
        way: list[dict] = [{} for _ in range(n)]
        for r in pdf.itertuples():
            way[r.segment].setdefault(int(r.entry), []).append((int(r.cost), int(r.rank), int(r.state)))
        rest = {EVEN: 0}
        best: list[dict] = [{} for _ in range(n)]
        for k in range(n - 1, -1, -1):
            for entry, options in way[k].items():
                found = [(c + rest[s], rank, s) for c, rank, s in options if s in rest]
                if found:
                    best[k][entry] = min(found)
            rest = {entry: b[0] for entry, b in best[k].items()}
        out, entry = [], START
        for k in range(n):
            state = best[k][entry][2]
            out.append((pdf["conv_id"].iloc[0], k, entry, state))
            entry = state
        return pd.DataFrame(out, columns=["conv_id", "segment", "entry", "state"])

    def assembled(batches):
        for batch in batches:
            lines = []
            for audit, entry, turns in zip(*(batch[c].to_pylist() for c in ("audit", "entry", "turns")), strict=True):
                own = [t for t in turns if not t["before"]]
                lines.append(repaired(audit, entry, [t["role"] for t in own], [t["text"] for t in own]))
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("conv_id", "segment", "illegal", "cost", "audit")] + [pa.array(lines, pa.list_(pa.string()))], names=["conv_id", "segment", "illegal", "cost", "audit", "lines"])

    sized = facts.select(F.col("conv_id").alias("_conv"), "final")
    segments = segments.join(sized, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    short = segments.where("final = 0").select("conv_id", "turns").mapInArrow(whole, _OUT)
    long = segments.where("final > 0")
    if long.isEmpty():
        parts = short
    else:
        options = materialise(long.select("conv_id", "segment", "final", "turns").mapInArrow(ways, _WAYS), "ways")
        rank = F.row_number().over(Window.partitionBy("conv_id", "segment", "entry").orderBy("audit"))
        path = options.withColumn("rank", rank).select("conv_id", "segment", "entry", "state", "cost", "rank").groupBy("conv_id").applyInPandas(chosen, "conv_id long, segment long, entry int, state int")
        same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
        taken = options.join(path, same(options, path, ("conv_id", "segment", "entry", "state")), "left_semi")
        rows_of = long.select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), "turns")
        taken = taken.join(rows_of, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_segment"))).drop("_conv", "_segment")
        parts = short.unionByName(taken.mapInArrow(assembled, _OUT))

    in_order = F.sort_array(F.collect_list(F.struct("segment", "audit", "lines")))
    edited = parts.groupBy(F.col("conv_id").alias("_conv")).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), in_order.alias("_parts"))
    totals = segments.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    out = totals.join(edited, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    out = out.join(facts.select(F.col("conv_id").alias("_conv"), "gaps"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    audit = F.array_join(F.transform("_parts", lambda p: p["audit"]), "")
    lines = F.flatten(F.transform("_parts", lambda p: p["lines"]))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"), lines.alias("lines"))


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """A row an original conv_id: what its damaged rows show and how they are repaired; without any rows left zeros and nothing."""
    found = repair_conversations(damage(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.sha2(F.coalesce(F.array_join("lines", "\n"), F.lit("")).cast("binary"), 256)
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest.alias("repaired_sha256"), F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"))
