"""Chat formatting at the level of token ids."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmergrid.llm.common import frugal, groups_of
from kmergrid.llm.encoder import encoder, forget

#: fixed values: the control strings of the template, in the order of their reserved ids behind the vocabulary
BEGIN, END, OPEN, CLOSE, BODY = CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[TEXT]")

_CONTROL = re.compile(r"(<(?=\\*/?s>)|\[(?=\\*(?:/?INST|TEXT)\]))")
_ESCAPED = re.compile(r"(<(?=\\+/?s>)|\[(?=\\+(?:/?INST|TEXT)\]))\\")


def escape(text: str) -> str:
    """Put a backslash behind the first character of every control string, also of those that hold backslashes there."""
    return _CONTROL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    """Undo :func:`escape`: take one backslash out of each."""
    return _ESCAPED.sub(r"\1", text)


_ENCODED = "conv_id long, turn long, role_ids binary, text_ids binary, learn boolean"
_TURNS = "conv_id long, turn long, start long, ids array<int>, loss_mask array<byte>"


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


@frugal(forget)
def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, ordinary=True)
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role_ids", pa.binary()), ("text_ids", pa.binary()), ("learn", pa.bool_())])
    for batch in batches:
        conv, turn, roles, texts = (c.to_pylist() for c in batch.columns)
        for a, b in groups_of(texts):
            yield _batch([conv[a:b], turn[a:b], enc.encode([escape(r) for r in roles[a:b]]),
                          enc.encode([escape(t) for t in texts[a:b]]), [r == "assistant" for r in roles[a:b]]], schema)


def _assemble(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Splice the reserved ids between the segments of all turns of a batch; running sums give places and masks."""
    enc = encoder(path, ordinary=True)
    begin, end, open_, close, body = range(enc.vocabulary, enc.vocabulary + len(CONTROLS))
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])
    current, offset, seen = None, 0, False
    for whole in batches:
        for low in range(0, whole.num_rows, 1000):
            batch = whole.slice(low, 1000)
            conv, turn, roles, texts, learn = (c.to_pylist() for c in batch.columns)
            parts, lengths, starts = [], [], []
            for k in range(len(conv)):
                fresh = not seen or conv[k] != current
                current, seen = conv[k], True
                segments = [np.array([begin, open_] if fresh else [open_], np.int32), enc.ids(roles[k]).astype(np.int32), np.array([body], np.int32),
                            enc.ids(texts[k]).astype(np.int32), np.array([end if learn[k] else close], np.int32)]
                parts += segments
                lengths.append([len(s) for s in segments])
                offset = 0 if fresh else offset
                starts.append(offset)
                offset += sum(lengths[-1])
            ids, sizes = np.concatenate(parts), np.array(lengths)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            change = np.zeros(len(ids) + 1, np.int8)
            trained = np.flatnonzero(np.array(learn, bool))
            np.add.at(change, edges[trained * 5 + 3], 1)
            np.add.at(change, edges[trained * 5 + 4], -1)
            mask = np.cumsum(change[:-1], dtype=np.int8)
            rows = pa.array(edges[::5].astype(np.int32))
            yield pa.record_batch([pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array(starts, pa.int64()),
                                   pa.ListArray.from_arrays(rows, pa.array(ids)), pa.ListArray.from_arrays(rows, pa.array(mask))], schema=schema)


def format_conversations(conversations: DataFrame, path: str) -> DataFrame:
    """Token ids and loss masks of all conversations, a row per turn.

    The form is ``<s>`` once per conversation, then for each turn ``[INST]role[TEXT]text`` with ``[/INST]`` behind it, or
    ``</s>`` behind an assistant's.  Role and text are encoded by themselves and the control ids, which lie behind the
    vocabulary, are spliced in, so no text can produce them; control strings that occur in texts are escaped as well,
    for the sake of the form as text.  The mask covers just the texts of assistants.

    Returns ``conv_id, turn, start, ids, loss_mask``; ``start`` is the turn's place in the ids of its conversation, which
    are those of its rows in the order of ``start``.  Turns are encoded where they lie; only ids are shuffled, and a
    conversation of any length streams through its task.  A null text or role is an empty one, a null ``conv_id`` is a
    conversation of its own, null turns come first; rows with the same turn number are ordered by role and text ids.
    Other columns are not looked at.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
                                 F.coalesce("text", F.lit("")).alias("text"))
    encoded = turns.mapInArrow(functools.partial(_encode, path=path), _ENCODED)
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role_ids", "text_ids")
    return ordered.mapInArrow(functools.partial(_assemble, path=path), _TURNS)


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, ordinary=True)
    first = enc.vocabulary
    length = [len(c) for c in CONTROLS]
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    decode = functools.partial(enc.tokenizer.decode, skip_special_tokens=False)

    def finished() -> list:
        return [current, turns, whole.hexdigest(), chars, loss.hexdigest(), formatted]

    current, turns, chars, formatted, done = None, 0, 0, 0, []
    whole, loss = hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        conv, ids_, masks = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
        for k, c in enumerate(conv):
            if turns and c != current:
                done.append(finished())
                turns, chars, formatted = 0, 0, 0
                whole, loss = hashlib.sha256(), hashlib.sha256()
            current, turns = c, turns + 1
            ids, mask = ids_[k].values.to_numpy(), masks[k].values.to_numpy()
            marks = np.flatnonzero(ids >= first)
            formatted += sum(length[i] for i in ids[marks] - first)
            at = {int(ids[m]) - first: int(m) for m in marks}
            role = decode(ids[at[2] + 1:at[4]].tolist())
            text = decode(ids[at[4] + 1:len(ids) - 1].tolist())
            formatted += len(role) + len(text)
            whole.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            if mask.any():
                learned = unescape(decode(ids[mask.astype(bool)].tolist()))
                chars += len(learned)
                loss.update(learned.encode())
        if done:
            yield _batch(list(zip(*done, strict=True)), schema)
            done = []
    if turns:
        yield _batch([[x] for x in finished()], schema)


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """Per conversation, from the ids alone: number of turns, digests of the turns and of what the loss mask covers.

    Returns ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``; the last is the length of the
    conversation's form as text, control strings and escapes included.  A digest of a conversation is sequential, so
    its turns go through one task, as a stream.
    """
    ordered = formatted.select("conv_id", "start", "ids", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return ordered.mapInArrow(functools.partial(_digest, path=path),
                              "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
