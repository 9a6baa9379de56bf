"""The states of vendors under guards on who acted before, however long one vendor's history is.

A vendor is proposed (pending), verified, approved or rejected; nobody verifies what they proposed, nor approves what they proposed or verified.
What an action does so depends on the state and on two names. A block of a history is summed up as a function: run once from every status
with unknown names, forking where a guard asks whether an unknown name is the actor. A status meets few such questions before
the names are known, so a summary is a handful of cases. Three passes, all dealt by (vendor, block): sum up the blocks; run each vendor's
summaries in order, which gives the state at each block's start; answer each block's actions from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Actions whose numbers agree in all but so many make a block.
BLOCK = 4096
STATUSES = ("none", "pending", "verified", "approved", "rejected")
#: Who may do what.
MAY = {"propose": ("ap", "local"), "add": ("procurement", "local"), "verify": ("procurement", "local"), "refuse": ("procurement", "local"), "approve": ("approver", "admin", "local"), "reject": ("approver", "admin", "local")}
NOT_ALLOWED, KNOWN, NOT_PENDING, NOT_VERIFIED, OWN_PROPOSAL, OWN_WORK, NO_REASON = (
    "not allowed", "already on the vendor list", "not waiting for verification", "not waiting for approval", "you proposed this supplier", "you proposed or verified this supplier", "give a reason",
)


class State(NamedTuple):
    """proposer and verifier are names, None for nobody, or UNKNOWN ones of a summary."""

    status: str = "none"
    proposer: str | None = None
    verifier: str | None = None


PROPOSER, VERIFIER = "\u0000proposer", "\u0000verifier"


def act(state: State, action: str, actor: str | None, role: str | None, note: str | None, same: Callable[[str | None, str | None], bool]) -> tuple[State, str | None]:
    """The state after an action, and the reason if it is refused. same compares a name of the state with the actor's."""
    if role not in MAY.get(action, ()):
        return state, NOT_ALLOWED
    if action == "propose":
        return (State("pending", actor, None), None) if state.status == "none" else (state, KNOWN)
    if action == "add":
        return State("verified", actor, actor), None
    if action in ("verify", "refuse"):
        if state.status != "pending":
            return state, NOT_PENDING
        if same(state.proposer, actor):
            return state, OWN_PROPOSAL
        if action == "refuse":
            return (State("rejected", state.proposer, state.verifier), None) if note else (state, NO_REASON)
        return State("verified", state.proposer, actor), None
    if state.status != "verified":
        return state, NOT_VERIFIED
    if same(state.proposer, actor) or same(state.verifier, actor):
        return state, OWN_WORK
    if action == "reject":
        return (State("rejected", state.proposer, state.verifier), None) if note else (state, NO_REASON)
    return State("approved", state.proposer, state.verifier), None


class Case(NamedTuple):
    """A state that a block leaves behind if the unknown names are, or are not, these."""

    state: State
    known: dict[str, str | None]
    others: dict[str, list[str | None]]


def summary(actions: list[tuple]) -> list[list]:
    """The function that a block's actions (action, actor, role, note) are, as JSON: by status, cases of (known, others, state)."""
    out = []
    for status in STATUSES:
        cases = [Case(State(status, PROPOSER, VERIFIER), {}, {PROPOSER: [], VERIFIER: []})]
        for action, actor, role, note in actions:
            after: list[Case] = []
            open_ = list(cases)
            while open_:
                case = open_.pop()
                asked: list[str] = []

                def same(name: str | None, who: str | None, case: Case = case, asked: list[str] = asked) -> bool:
                    if name in (PROPOSER, VERIFIER):
                        if name in case.known:
                            return case.known[name] == who
                        if who not in case.others[name]:
                            asked.append(name)
                        return False
                    return name == who

                state, _ = act(case.state, action, actor, role, note, same)
                if asked:  # both answers, each from here again
                    name = asked[0]
                    open_.append(Case(case.state, {**case.known, name: actor}, case.others))
                    open_.append(Case(case.state, case.known, {**case.others, name: [*case.others[name], actor]}))
                else:
                    after.append(Case(state, case.known, case.others))
            cases = after
        out.append([[c.known, c.others, list(c.state)] for c in cases])
    return out


def through(state: State, block: list[list]) -> State:
    """The state after a block that was summed up."""
    names = {PROPOSER: state.proposer, VERIFIER: state.verifier}
    for known, others, left in block[STATUSES.index(state.status)]:
        if all(names[k] == v for k, v in known.items()) and all(names[k] not in v for k, v in others.items() if k not in known):
            return State(left[0], *(names.get(n, n) for n in left[1:]))
    raise ValueError("no case of a summary holds")


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, tuple]]:
    """(key, row) of sorted batches."""
    for b in batches:
        yield from zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), zip(*(c.to_pylist() for c in b.columns), strict=True), strict=True)


def histories(actions: DataFrame, block: int = BLOCK) -> DataFrame:
    """seq, vendor, status after it and reason (null if accepted) of actions (vendor, seq, action, actor, role, note), in order of seq, which
    is unique. A null actor is a name like any other; a null or unknown action or role is not allowed. A history of no more actions than
    a block's is answered as it stands; only longer ones are cut into blocks and summed up."""
    vendor = actions.schema["vendor"].dataType.simpleString()
    every = actions.select("vendor", F.floor(F.col("seq") / block).cast("long").alias("block"), F.col("seq").cast("long"), "action", "actor", "role", "note")
    # one row for so many actions, so this is the small side
    long = F.broadcast(actions.groupBy("vendor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select(F.col("vendor").alias("long_of")))
    is_long = F.col("vendor").eqNullSafe(F.col("long_of"))
    rows, short = every.join(long, is_long, "left_semi"), every.join(long, is_long, "left_anti")

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"vendor": key[0], "block": key[1], "does": json.dumps(summary(held))}], schema)

        schema = None
        for k, row in _runs(batches, "vendor", "block"):
            if schema is None:
                schema = pa.schema([("vendor", pa.int64() if isinstance(k[0], int) else pa.string()), ("block", pa.int64()), ("does", pa.string())])
            if k != key and key is not None:
                yield done()
                held = []
            key = k
            held.append(row[3:])
        if key is not None:
            yield done()

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), State()
        for b in batches:
            states = []
            for v, does in zip(b.column("vendor").to_pylist(), b.column("does").to_pylist(), strict=True):
                if v != last:
                    last, state = v, State()
                states.append(state)
                state = through(state, json.loads(does))
            parts = [pa.array([s[k] for s in states], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("vendor"), b.column("block"), *parts], ["vendor", "block", "status", "proposer", "verifier"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, State()
        for b in batches:
            status, reasons = [], []
            for k, row in _runs(iter([b]), "vendor", "block"):
                if k != key:
                    key, state = k, State(*row[7:])
                state, reason = act(state, *row[3:7], lambda name, who: name == who)
                status.append(state.status)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([b.column("vendor"), b.column("seq"), pa.array(status, pa.string()), pa.array(reasons, pa.string())], ["vendor", "seq", "status", "reason"])

    dealt = rows.repartition("vendor", "block").sortWithinPartitions("vendor", "block", "seq")
    summed = dealt.mapInArrow(sum_up, f"vendor {vendor}, block long, does string")
    starts = summed.repartition("vendor").sortWithinPartitions("vendor", "block").mapInArrow(start, f"vendor {vendor}, block long, status string, proposer string, verifier string")
    with_start = rows.join(starts.withColumnRenamed("vendor", "of").withColumnRenamed("block", "at"), (F.col("vendor").eqNullSafe(F.col("of"))) & (F.col("block") == F.col("at")))
    columns = with_start.select(*rows.columns, "status", "proposer", "verifier").repartition("vendor", "block").sortWithinPartitions("vendor", "block", "seq")
    whole = short.withColumn("block", F.lit(0).cast("long")).select(*rows.columns, F.lit("none").alias("status"), *(F.lit(None).cast("string").alias(c) for c in ("proposer", "verifier")))
    answers = f"vendor {vendor}, seq long, status string, reason string"
    return whole.repartition("vendor").sortWithinPartitions("vendor", "seq").mapInArrow(answer, answers).unionByName(columns.mapInArrow(answer, answers))
