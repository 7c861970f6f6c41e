"""Keyed dialogue state: transition tables as data, an ordered fold for batches, routing of events.

An event has a `text` and a `button`, either may be missing. A machine maps
(state, event) to the next state and an action; what no row of its table covers
leaves the state as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "Start"
# States, labels and commands of the two dialogues.
TITLE, CHOICE, FEEDBACK = "ReceiveAnimeName", "ReceiveUserChoice", "ReceiveUserFeedback"
MORE, GIVE, EXIT = "More Recommendations", "Feedback", "Exit the dialog :("
NONE, CHOOSING, REPLY, OVER = "NONE", "CHOOSING", "TYPING_REPLY", "END"
RATE = "rate anime"
MENU = re.compile(r"^(Rate anime|Evaluate the recommendation)$")

Machine = Callable[[str, str | None, str | None], tuple[str, str]]


def recommendation_dialogue(state: str, text: str | None, button: str | None) -> tuple[str, str]:
    """Ask for a title, recommend, offer three buttons, take feedback."""
    if button is not None:
        if state != CHOICE:
            return state, "ignored"
        return {MORE: (TITLE, "prompt"), GIVE: (FEEDBACK, "prompt"), EXIT: (START, "goodbye")}.get(button, (state, "nothing"))
    if text == "/cancel":
        return START, "cancelled"
    if state == START:
        return {"/help": (START, "help"), "/start": (TITLE, "register")}.get(text or "", (START, "unable"))
    if state == TITLE:
        return (CHOICE, "recommend") if text is not None else (TITLE, "ask_again")
    if state == FEEDBACK:
        return (START, "thank") if text is not None else (FEEDBACK, "ask_again")
    return state, "unable"


def feedback_dialogue(state: str, text: str | None, button: str | None) -> tuple[str, str]:
    """A menu, then feedback texts until Done."""
    if text is None:
        return state, "ignored"
    if state in (NONE, OVER):
        return (CHOOSING, "menu") if text == "/helpme" else (state, "other")
    if text == "Done":
        return OVER, "done"
    if text.startswith("/"):
        return state, "command"
    if state == CHOOSING:
        if not MENU.match(text):
            return state, "search"
        return REPLY, "ask_rating" if text.lower() == RATE else "ask_evaluation"
    return CHOOSING, "store"


def fold(events: DataFrame, machine: Machine, start: str, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """event_id, key, state_before, state_after, action: each key's events in order.

    Rows come sorted and are streamed, so a task holds one state at a time,
    however many events a key has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, start, False
        for batch in batches:
            out = []
            for event, who, text, button in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or who != now:
                    now, state, begun = who, start, True
                after, action = machine(state, text, button)
                out.append((event, who, state, after, action))
                state = after
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["event_id", key, "state_before", "state_after", "action"])

    ordered = events.repartition(key).sortWithinPartitions(key, *order)
    return ordered.select("event_id", key, "text", "button").mapInArrow(run, f"event_id long, {key} long, state_before string, state_after string, action string")


def route(kind: Column, routes: list[tuple[str, str]], otherwise: str) -> Column:
    """The route of the first pattern that matches."""
    out = F.lit(otherwise)
    for pattern, name in reversed(routes):
        out = F.when(kind.rlike(pattern), F.lit(name)).otherwise(out)
    return out
