"""Live segmentation: messages in, finalized spans out, with the open tail of each conversation as state.

Arrival order is seq order; timestamps may go back and then only give negative gaps, so there is no watermark.
A span goes out once nothing that may still come can change it, so that spans don't depend on how the stream is cut into batches: they are those of the whole log.
What is still open is the state: a segment that may grow, and before it what may yet join it, some 80 messages at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palim.operators.segmentation import STUB_LOW_INFO_CHARS, STUB_SPLIT_EVERY
from palim.schemas import CLASSIFY_MAX, HARD_GAP_MINUTES, MERGE_BELOW, SOFT_GAP_MINUTES, SPLIT_ABOVE, TRIGGER_MESSAGES

MINUTE = 60_000_000
OUTPUT = "conversation_id string, start_seq long, end_seq long, classification string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: New messages of a conversation looked at together.
PART = 4096


def gap_kind(gap_us: int) -> str:
    return "hard" if gap_us > HARD_GAP_MINUTES * MINUTE else "soft" if gap_us >= SOFT_GAP_MINUTES * MINUTE else "none"


def starts_to_ranges(n: int, starts: list[int]) -> list[tuple[int, int]]:
    first = [0, *sorted({i for i in starts if 0 < i < n})]
    return [(a, b - 1) for a, b in zip(first, [*first[1:], n])]


def primitive(messages: list[tuple], inside: bool = False) -> list[dict]:
    """messages: (seq, us, n_chars) in order. Reviewed segments with the origin of the boundary before each. inside: the first message begins a later part of a segment that was split."""
    cuts = [0] + [i for i in range(1, len(messages)) if gap_kind(messages[i][1] - messages[i - 1][1]) != "none"]
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(messages)]):
        n = b - a
        parts = starts_to_ranges(n, list(range(STUB_SPLIT_EVERY, n, STUB_SPLIT_EVERY))) if n > SPLIT_ABOVE or (inside and not a) else [(0, n - 1)]
        for k, (x, y) in enumerate(parts):
            low = y - x + 1 <= CLASSIFY_MAX and sum(m[2] for m in messages[a + x : a + y + 1]) < STUB_LOW_INFO_CHARS
            origin = "llm_locked" if k else "rule_" + gap_kind(messages[a][1] - messages[a - 1][1]) if a else None
            out.append({"start": messages[a + x][0], "end": messages[a + y][0], "n": y - x + 1, "kind": "low_info" if low else "informative", "origin": origin})
    return out


def merged(segments: list[dict]) -> list[dict]:
    """Informative neighbours over soft boundaries join while their total is below 30; joined ones are split anew."""
    out, i = [], 0
    while i < len(segments):
        j, total = i, segments[i]["n"]
        if segments[i]["kind"] == "informative":
            while total < MERGE_BELOW and j + 1 < len(segments) and segments[j + 1]["origin"] == "rule_soft" and segments[j + 1]["kind"] == "informative":
                j += 1
                total += segments[j]["n"]
        if j > i:
            start = segments[i]["start"]
            out += [{"start": start + a, "end": start + b, "kind": "informative"} for a, b in starts_to_ranges(total, list(range(STUB_SPLIT_EVERY, total, STUB_SPLIT_EVERY)))]
        else:
            out.append({k: segments[i][k] for k in ("start", "end", "kind")})
        i = j + 1
    return out


def triggered(messages: list[tuple], ended: bool) -> bool:
    gap = any(b[1] - a[1] >= SOFT_GAP_MINUTES * MINUTE for a, b in zip(messages, messages[1:]))
    return bool(messages) and (ended or len(messages) >= TRIGGER_MESSAGES or gap)


def advance(messages: list[tuple], ended: bool, inside: bool = False) -> tuple[list[dict], list[tuple], bool]:
    """Spans that are final, the messages still open, and whether those begin inside a split segment.

    The last segment may grow, and with it change its kind; what stands before it waits only if the two may join.
    """
    if not triggered(messages, ended):
        return [], messages, inside
    segments = primitive(messages, inside)
    if ended:
        return merged(segments), [], False
    growing, done, i = segments[-1], [], 0
    while i < len(segments) - 1:
        j, total = i, segments[i]["n"]
        while segments[i]["kind"] == "informative" and total < MERGE_BELOW and segments[j + 1]["origin"] == "rule_soft":
            if j + 1 == len(segments) - 1:
                rest = [m for m in messages if m[0] >= segments[i]["start"]]
                return done, rest, segments[i]["origin"] == "llm_locked" or (inside and not i)
            if segments[j + 1]["kind"] != "informative":
                break
            j += 1
            total += segments[j]["n"]
        done += merged(segments[i : j + 1])
        i = j + 1
    return done, [m for m in messages if m[0] >= growing["start"]], growing["origin"] == "llm_locked" or (inside and len(segments) == 1)


class Segmenter(StatefulProcessor):
    """Typed state of a conversation: its open messages, and whether they begin inside a split segment and the end was seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "seq long, us long, n_chars long")
        self.marks = handle.getValueState("marks", "inside boolean, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        messages = [tuple(m) for m in self.open.get()] if self.open.exists() else []
        inside, ended = self.marks.get() if self.marks.exists() else (False, False)
        # A batch of rows of any length goes through in parts of some thousand: spans leave as soon as they are final.
        new = pd.concat(list(rows)) if not isinstance(rows, pd.DataFrame) else rows
        ended = ended or bool(new["eof"].any())
        last = messages[-1][0] if messages else -1
        fresh = new[new["seq"].notna() & (new["seq"] > last)].sort_values("seq").drop_duplicates("seq")
        done: list[dict] = []
        for a in range(0, max(1, len(fresh)), PART):
            part = fresh.iloc[a : a + PART]
            messages += [(int(s), int(u), int(c)) for s, u, c in zip(part["seq"], part["us"], part["n_chars"])]
            spans, messages, inside = advance(messages, ended and a + PART >= len(fresh), inside)
            done += spans
        self.open.put(messages) if messages else self.open.clear()
        self.marks.update((inside, ended and bool(messages)))
        yield pd.DataFrame([(key[0], d["start"], d["end"], d["kind"]) for d in done], columns=["conversation_id", "start_seq", "end_seq", "classification"])

    def close(self) -> None:
        pass


def stream_spans(messages: DataFrame) -> DataFrame:
    """messages: a stream of conversation_id, seq, us, n_chars, eof (a row without seq only marks the end)."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return messages.groupBy("conversation_id").transformWithStateInPandas(Segmenter(), OUTPUT, "append", "none")
