"""Chat formatting on token level.

A turn is assembled from parts that are encoded separately, so that no token spans two of them: a reserved id opens the
turn, the role follows, a reserved id opens the text, the text follows, a reserved id ends the turn. Reserved ids lie
behind the vocabulary, so no text can produce them. The loss mask is a running sum of +1 where an assistant's text begins
and -1 where it ends.

In the printed form the reserved ids are control strings. A control string inside a role or a text gets a backslash
behind its first character (one more if there are some already), so the printed form can be read back as well; reading
back takes one away.

Turns are formatted row by row without a shuffle, so the longest conversation bounds no task. A conversation's digests
need its turns in order: they are streamed through one sort by conversation, turn by turn, with the running digest as only
state, so memory does not grow with a conversation, though one task has to read it.

Null roles and texts count as empty; rows of a null conversation are one conversation. Turns are ordered by number, then
role, then text; equal rows all count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import col, map_slices
from corpusloom.llm.tokens import rank_encoder

# Reserved ids behind the 50,257 of the vocabulary, and how they print.
TURN, TEXT, END = 50257, 50258, 50259
PRINTED = {TURN: "<|turn|>", TEXT: "<|text|>", END: "<|end|>"}
# Strings that this or a common chat template gives a meaning.
CONTROL = [*PRINTED.values(), "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]"]
LOSS_ROLE = "assistant"

_PLAIN = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROL))


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def format_turn(role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one turn."""
    encode = rank_encoder().encode_ordinary
    parts = [[TURN], encode(escape(role)), [TEXT], encode(escape(text)), [END]]
    ids = np.array([i for part in parts for i in part], dtype=np.int32)
    steps = np.zeros(len(ids) + 1, dtype=np.int8)
    if role == LOSS_ROLE:
        begin = sum(map(len, parts[:3]))
        steps[begin] += 1
        steps[begin + len(parts[3])] -= 1
    return ids, np.cumsum(steps[:-1]).astype(bool)


def decode(ids: np.ndarray) -> str:
    """Text of ids without reserved ones."""
    return rank_encoder().decode_bytes(ids.tolist()).decode("utf-8")


def read_turn(ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
    """Role, text, text under the mask, and printed length, from the output alone."""
    middle = int(np.flatnonzero(ids == TEXT)[0])
    role, text = decode(ids[1:middle]), decode(ids[middle + 1 : -1])
    printed = len(role) + len(text) + sum(len(PRINTED[i]) for i in (TURN, TEXT, END))
    return unescape(role), unescape(text), unescape(decode(ids[mask])) if mask.any() else "", printed


def format_turns(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, turn, ids, loss) per row; a conversation's ids are those of its turns in order."""
    text_of = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    source = rows.select(
        col(conv_id).alias("conv_id"), col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text")
    )
    kind = {f.name: f.dataType.simpleString() for f in source.schema}

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        made = [format_turn(r, t) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
        ids = pa.array([i for i, _ in made], pa.list_(pa.int32()))
        loss = pa.array([m.tolist() for _, m in made], pa.list_(pa.bool_()))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids, loss], names=["conv_id", "turn", "ids", "loss"])

    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, ids array<int>, loss array<boolean>"
    return map_slices(source, work, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss_text, printed_chars) from formatted turns."""
    kind = {f.name: f.dataType.simpleString() for f in formatted.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, loss = (c.to_pylist() for c in (batch.column(2), batch.column(3)))
            read = [read_turn(np.array(i, np.int32), np.array(m, bool)) for i, m in zip(ids, loss, strict=True)]
            if read:
                role, text, loss_text, printed = zip(*read, strict=True)
                columns = [pa.array(role), pa.array(text), pa.array(loss_text), pa.array(printed, pa.int64())]
                names = ["conv_id", "turn", "role", "text", "loss_text", "printed_chars"]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, text string, loss_text string, printed_chars bigint"
    return formatted.mapInArrow(run, schema)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.printed = 0

    def add(self, role: str, text: str, loss: str, printed: int) -> None:
        self.turns.update(f"{role}\n{text}\n".encode())
        self.loss.update(loss.encode())
        self.n_turns += 1
        self.loss_chars += len(loss)
        self.printed += printed

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.printed


DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, from what was read back."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        done: list[tuple] = []

        def emit(key_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", *[p.split()[0] for p in DIGESTS.split(", ")]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            values = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            for key, value in zip(keys, values, strict=True):
                if state is None or key != current:
                    if state is not None:
                        done.append((current, *state.row()))
                    current, state = key, _Digest()
                state.add(*value)
            if len(done) >= 1000:
                yield emit(key_type)
                done.clear()
        if state is not None:
            done.append((current, *state.row()))
            yield emit(key_type)

    return ordered.select("conv_id", "turn", "role", "text", "loss_text", "printed_chars").mapInArrow(
        run, f"conv_id {kind}, {DIGESTS}"
    )
