r"""Prefix-target expansion of conversations into training examples.

Every assistant turn becomes one example: all turns before it as context, the
reply under the loss mask. A turn reads ``<|role|>text<|/|>``; control strings
inside texts get a backslash after their first character and one more for each
they already have there, which reading back takes away again.

Turns of a conversation are sorted into one task and pass through it one by
one; the task holds the conversation's text so far and a bounded output batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAIL = r"\||/?s>|/?INST\]|</?SYS>>"  # what makes < or [ a control string
_CONTROL = re.compile(rf"([<\[])(\\*)(?={TAIL})")
_ESCAPED = re.compile(rf"([<\[])(\\*)\\(?={TAIL})")
_TURN = re.compile(r"<\|((?:[^|\\]|\\.)*)\|>(.*?)<\|/\|>", re.S)
END = "<|/|>"
FLUSH_CHARS = 8_000_000


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _mark(role: str) -> str:
    return "<|" + role.replace("\\", "\\\\").replace("|", "\\p").replace("/", "\\s") + "|>"


def _unmark(mark: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"p": "|", "s": "/"}.get(m[1], m[1]), mark)


def read_turns(text: str) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn of an example's text."""
    return [(_unmark(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def expand(turns: DataFrame) -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text) in order of conversation
    and position, which later per-partition steps may rely on.

    Returns ``conv_id, example, text, loss_start, loss_end`` (code points of
    ``text``). Turns after the last assistant turn, and conversations without
    one, give an example without a trainable part, so that no turn is lost.
    Null role and text count as empty; ties in ``turn`` go by role, then text;
    repeated rows are turns of their own; a row without a conv_id is a
    conversation of its own, with one turn. Other columns are left out; an empty
    table gives no example.
    """
    kind = dict(turns.dtypes)["conv_id"]
    names = ["conv_id", "example", "text", "loss_start", "loss_end"]

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            types = [id_type, pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        out, size, conv, number, parts, length, open_turns = [], 0, None, 0, [], 0, 0

        def close():
            return [(conv, number, "".join(parts), length, length)] if open_turns else []

        for batch in batches:
            id_type = batch.schema.field(0).type
            for new, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if not parts or new is None or new != conv:
                    out += close()
                    conv, number, parts, length, open_turns = new, 0, [], 0, 0
                mark, said = _mark(role or ""), escape(text or "")
                parts.append(mark + said + END)
                begin = length + len(mark)
                length += len(parts[-1])
                open_turns += 1
                if role == "assistant":
                    parts = ["".join(parts)]
                    out.append((conv, number, parts[0], begin, begin + len(said)))
                    size, number, open_turns = size + length, number + 1, 0
                    if size >= FLUSH_CHARS:
                        yield made(out)
                        out, size = [], 0
        out += close()
        if out:
            yield made(out)

    # rows without a conv_id are dealt by what they say
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id", alone)
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        examples, f"conv_id {kind}, example int, text string, loss_start bigint, loss_end bigint")


def digests(examples: DataFrame) -> DataFrame:
    """What reading ``expand``'s output back gives per conversation:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    kind = dict(examples.dtypes)["conv_id"]

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        out, conv, last, loss, chars, formatted = [], None, None, hashlib.sha256(), 0, 0

        def close():
            if last is None:
                return []
            turns, spoken = read_turns(last), hashlib.sha256()
            for role, text in turns:
                spoken.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            return [(conv, len(turns), spoken.hexdigest(), chars, loss.hexdigest(), formatted)]

        for batch in batches:
            id_type = batch.schema.field(0).type
            for new, text, a, b in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "text", "loss_start", "loss_end"))):
                if last is None or new is None or new != conv:
                    out += close()
                    conv, loss, chars, formatted = new, hashlib.sha256(), 0, 0
                reply = unescape(text[a:b])
                loss.update(reply.encode("utf-8", "surrogatepass"))
                chars, formatted, last = chars + len(reply), formatted + len(text), text
            if len(out) >= 5000:
                yield made(out)
                out = []
        out += close()
        if out:
            yield made(out)

    return examples.mapInArrow(read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                     "loss_sha256 string, formatted_chars bigint")
