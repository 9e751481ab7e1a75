"""The memory of conversations over arriving mentions: keyed state that is forgotten after a while."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skillgrid.operators.dialogue import HISTORY, TTL

OUT = "conv_id long, turn long, place int, at long, label string, id string, nombre string, since long, changes long, previous_id string, previous string, first_id string, first string"
ORDER = ("at", "turn", "place", "label", "id", "nombre")


def advance(state: dict, mention: dict, history: int = HISTORY, ttl: int = TTL) -> dict:
    """One mention later: changes the state {since, updated, labels: {label: [changes, entities]}} and gives what
    is in mind then."""
    at = mention["at"]
    if not state or at - state["updated"] > ttl:
        state.clear()
        state |= {"since": at, "labels": {}}
    state["updated"] = at
    kept = state["labels"].setdefault(mention["label"], [0, []])
    entity = [mention["id"], mention["nombre"]]
    same = lambda e: ("=", e[0]) if e[0] else ("~", (e[1] or "").strip(" ").lower())
    if kept[1] and same(kept[1][-1]) == same(entity):
        kept[1][-1] = entity
    else:
        kept[0] += 1
        kept[1] = [*kept[1], entity][-history:]
    changes, entities = kept
    previous = entities[-2] if len(entities) > 1 else [None, None]
    return mention | {"since": state["since"], "changes": changes, "previous_id": previous[0], "previous": previous[1], "first_id": entities[0][0], "first": entities[0][1]}


def remembered(mentions: DataFrame, history: int = HISTORY, ttl: int = TTL, lateness: str = "0 seconds") -> DataFrame:
    """What dialogue.memory() gives, of a stream of mentions (conv_id, turn, place, at, label, id, nombre) whose `at`
    counts seconds. The state of a conversation is its labels' last `history` entities; it goes once the watermark
    says that nothing can keep it alive. A conversation's mentions must arrive in their order; those of one batch are
    sorted. Mentions that come later than `lateness` after younger ones of any conversation are dropped with the
    state that would have taken them."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else {}
        rows = [{c: None if pd.isna(r[c]) else r[c] for c in ("conv_id", *ORDER)} for b in batches for r in b.to_dict("records")]
        rows = [r | {c: int(r[c]) for c in ("conv_id", "turn", "place", "at") if r[c] is not None} for r in rows if r["label"]]
        rows.sort(key=lambda r: [(r[c] is not None, r[c] if r[c] is not None else 0) for c in ORDER])
        made = [advance(state, r, history, ttl) for r in rows]
        if state:
            held.update((json.dumps(state),))
            held.setTimeoutTimestamp(max((state["updated"] + ttl) * 1000 + 1, held.getCurrentWatermarkMs() + 1))
        if made:
            yield pd.DataFrame(made, columns=[f.split()[0] for f in OUT.split(", ")]).astype({c: "Int64" for c in ("conv_id", "turn", "place", "at", "since", "changes")})

    timed = mentions.withColumn("when", F.timestamp_seconds("at")).withWatermark("when", lateness)
    columns = ["conv_id", *ORDER, "when"]
    return timed.select(*columns).groupBy("conv_id").applyInPandasWithState(run, OUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)
