"""Streams: outputs merged strictly in plan order, and server-sent events folded into answers.

``ordered_outputs`` is the incremental form of an ordered fold: outputs may arrive
in any order and in any micro-batch; those that are next in plan order are given
on, the others wait in the operator's state.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, MutableMapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

READY = "run_id string, seq long, content string"


def release(next_seq: int, waiting: MutableMapping[int, str], arrived: Iterable[tuple[int, str]]) -> tuple[int, MutableMapping[int, str], list[tuple[int, str]]]:
    """The state after ``arrived`` outputs, and what is ready. An output that was given on already, or waits already, is ignored."""
    for seq, content in arrived:
        if seq >= next_seq:
            waiting.setdefault(seq, content)
    ready = []
    while next_seq in waiting:
        ready.append((next_seq, waiting.pop(next_seq)))
        next_seq += 1
    return next_seq, waiting, ready


class _Waiting(MutableMapping):
    """A map state as a mapping: an output is read or written by itself, so the state may be larger than memory."""

    def __init__(self, state):
        self.state = state

    def __contains__(self, seq) -> bool:
        return self.state.containsKey((seq,))

    def __getitem__(self, seq: int) -> str:
        if seq not in self:
            raise KeyError(seq)
        return self.state.getValue((seq,))[0]

    def __setitem__(self, seq: int, content: str) -> None:
        self.state.updateValue((seq,), (content,))

    def __delitem__(self, seq: int) -> None:
        self.state.removeKey((seq,))

    def __iter__(self):
        return (k[0] for k in self.state.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self)


class InOrder(StatefulProcessor):
    """One run's reorder buffer: the number that comes next, and the outputs that came before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next, self.waiting = handle.getValueState("next", "seq long"), _Waiting(handle.getMapState("waiting", "seq long", "content string"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        next_seq = self.next.get()[0] if self.next.exists() else 1
        arrived = ((int(s), c) for b in rows for s, c in zip(b["seq"], b["content"]))
        next_seq, _, ready = release(next_seq, self.waiting, arrived)
        self.next.update((next_seq,))
        if ready:
            yield pd.DataFrame({"run_id": pd.Series([key[0]] * len(ready), dtype=object), "seq": [r[0] for r in ready], "content": pd.Series([r[1] for r in ready], dtype=object)})

    def close(self) -> None:
        pass


def stream_session(spark: SparkSession, partitions: int = 2) -> SparkSession:
    """A session for streams with such state beside ``spark``, whose own settings stay as they are."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return session


def ordered_outputs(stream: DataFrame) -> DataFrame:
    """run_id, seq, content of a stream (of ``stream_session``), each run's outputs in order 1, 2, ... without gaps."""
    return stream.select("run_id", "seq", "content").groupBy("run_id").transformWithStateInPandas(InOrder(), READY, "Append", "None")


class EventFold:
    """A server-sent event stream, folded as it arrives: ``feed`` takes any piece of it, ``result`` gives the answer so far."""

    def __init__(self):
        self.rest, self.content, self.done, self.error = "", [], False, None
        self.out: dict[str, Any] = {"content": None, "finish_reason": None, "prompt_tokens": None, "cached_tokens": None, "completion_tokens": None}

    def feed(self, piece: str) -> bool:
        """Take a piece; whether the stream has said that it is over, or is broken."""
        text = self.rest + piece
        keep = "\r" if text.endswith("\r") else ""  # its newline may still come
        blocks = text.removesuffix("\r").replace("\r\n", "\n").replace("\r", "\n").split("\n\n")
        self.rest = blocks.pop() + keep
        for block in blocks:
            self.block(block)
        return self.done or self.error is not None

    def block(self, block: str) -> None:
        data = "\n".join(line[5:].removeprefix(" ") for line in block.split("\n") if line.startswith("data:"))
        if not data or self.done or self.error is not None:
            return
        if data.strip() == "[DONE]":
            self.done = True
            return
        try:
            event = json.loads(data)
        except ValueError:
            event = None
        if not isinstance(event, dict):
            self.error = "malformed event"
        elif event.get("error"):
            self.error = f"error event: {event['error']}"
        else:
            for choice in event.get("choices") or ():
                if choice.get("index", 0) == 0:
                    self.content.append((choice.get("delta") or {}).get("content") or "")
                    self.out["finish_reason"] = choice.get("finish_reason") or self.out["finish_reason"]
            if usage := event.get("usage"):
                nested = (usage.get("prompt_tokens_details") or {}).get("cached_tokens")
                self.out |= {"prompt_tokens": usage.get("prompt_tokens"), "completion_tokens": usage.get("completion_tokens"), "cached_tokens": usage.get("cached_tokens") if nested is None else nested}

    def saved(self) -> str:
        """What is known besides the content, as JSON: the half-received event, the rest of the answer, and whether it is over."""
        return json.dumps([self.rest, self.done, self.error, self.out])

    @classmethod
    def restored(cls, saved: str) -> EventFold:
        """A fold that goes on from ``saved``; its content begins anew."""
        fold = cls()
        fold.rest, fold.done, fold.error, fold.out = json.loads(saved)
        return fold

    def result(self) -> dict[str, Any]:
        """The answer; ``error`` says why there is none (and it may be tried again)."""
        if self.rest:
            self.block(self.rest.replace("\r", "\n"))
            self.rest = ""
        error = self.error or (None if self.done and self.out["finish_reason"] else "the stream ended early")
        return self.out | {"content": None if error else "".join(self.content), "error": error}


def fold_events(text: str) -> dict[str, Any]:
    """The answer that a whole stream adds up to."""
    fold = EventFold()
    fold.feed(text)
    return fold.result()


ANSWER = "stream_id string, content string, finish_reason string, prompt_tokens long, cached_tokens long, completion_tokens long, error string"


class FoldPieces(StatefulProcessor):
    """One event stream: pieces fold as they come in order, wherever they are cut; the answer is given when the stream is over.

    State holds the half-received event and the pieces that came before their turn; content lies in a map, so it is written once, not at every piece.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next, self.known = handle.getValueState("next", "seq long"), handle.getValueState("known", "known string")
        self.waiting, self.content = _Waiting(handle.getMapState("waiting", "seq long", "content string")), _Waiting(handle.getMapState("content", "seq long", "content string"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        next_seq = self.next.get()[0] if self.next.exists() else 1
        if next_seq < 0:  # the answer has been given
            return
        fold = EventFold.restored(self.known.get()[0]) if self.known.exists() else EventFold()
        # A missing piece is the end of the connection; states hold no nulls.
        arrived = ((int(s), END if c is None or c != c else c) for b in rows for s, c in zip(b["seq"], b["piece"]))
        first, over = next_seq, False
        next_seq, _, ready = release(next_seq, self.waiting, arrived)
        for _, piece in ready:
            over = over or piece == END or fold.feed(piece)
        if fold.content:
            self.content[first] = "".join(fold.content)
        if over:
            fold.content = [self.content[k] for k in sorted(self.content)]
            out = fold.result()
            yield pd.DataFrame([(key[0], *(out[f.split()[0]] for f in ANSWER.split(", ")[1:]))], columns=[f.split()[0] for f in ANSWER.split(", ")]).astype({c: "Int64" for c in ("prompt_tokens", "cached_tokens", "completion_tokens")} | {c: object for c in ("stream_id", "content", "finish_reason", "error")})
            for k in [*self.content]:
                del self.content[k]
            self.known.clear()
            next_seq = -1
        else:
            self.known.update((fold.saved(),))
        self.next.update((next_seq,))

    def close(self) -> None:
        pass


#: What stands for the end of a connection in a state: no piece can be this.
END = "\0end"


def folded_streams(pieces: DataFrame) -> DataFrame:
    """ANSWER of each event stream of ``pieces`` (stream_id, seq 1, 2, ..., piece; null: the connection ended), a stream of ``stream_session``.

    Pieces may come in any order, more than once, and in any micro-batch, and may be cut anywhere, within an event too. One answer comes out for each stream, when it says
    that it is over, breaks, or its connection ends; it is that of ``fold_events`` of the whole. After a restart it goes on in the middle of an event.
    """
    return pieces.select("stream_id", "seq", "piece").groupBy("stream_id").transformWithStateInPandas(FoldPieces(), ANSWER, "Append", "None")


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType() if n.endswith("tokens") else T.StringType()) for n in ("content", "finish_reason", "prompt_tokens", "cached_tokens", "completion_tokens", "error")]))
def fold_sse(text: pd.Series) -> pd.DataFrame:
    """``fold_events`` of each stream."""
    rows = pd.DataFrame([fold_events(t or "") for t in text], columns=["content", "finish_reason", "prompt_tokens", "cached_tokens", "completion_tokens", "error"])
    return rows.astype({c: "Int64" for c in ("prompt_tokens", "cached_tokens", "completion_tokens")})

