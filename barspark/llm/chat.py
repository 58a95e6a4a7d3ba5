"""Chat formatting by columnar byte assembly, and reading the format back.

A turn is "### ", the role, a newline, the text, and a line "</turn>". Inside a text a
backslash goes before every backslash and before every control string ("</turn>",
"### "); in a role, backslash and newline are written \\\\ and \\n. So the format reads back
to the same turns whatever the texts hold.

Rows come to a task by conversation, in turn order, and are laid out a slice at a time:
segment lengths, their cumulative offsets, and scatter indices of every header, text and
escape are computed in numpy and copied into one buffer, which Arrow takes as a column with
the conversations' offsets. A task holds one slice and the conversation that is still open,
which is one value of the result in any case.

Defined cases: a null text or role is empty; rows of a null conversation form one; rows
with the same turn are ordered by role, then text, and repeated rows are turns of their
own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import columns

HEAD, END = "### ", "</turn>"
FOOT = np.frombuffer(f"\n{END}\n".encode(), np.uint8)
BACKSLASH = ord("\\")
CONTROLS = [np.frombuffer(x.encode(), np.uint8) for x in (END, HEAD)]
FORMATTED = "n_turns long, formatted string, loss_starts array<int>, loss_ends array<int>"
TURNS = "turns array<struct<role: string, text: string>>, loss_text string, formatted_chars long"


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def escapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes get a backslash before them."""
    out = data == BACKSLASH
    for control in CONTROLS:
        at = np.flatnonzero(data[: max(0, len(data) - len(control) + 1)] == control[0])
        for k, c in enumerate(control[1:], 1):
            at = at[data[at + k] == c]
        ends = offsets[np.searchsorted(offsets, at, "right")] if len(at) else at  # of the texts they begin in
        out[at[at + len(control) <= ends]] = True
    return out


def _inside(lengths: np.ndarray) -> np.ndarray:
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def assemble(roles: list[str], role_of: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer; where each begins (one more at the end), and where its text begins and ends."""
    heads = [np.frombuffer(f"{HEAD}{escape_role(r)}\n".encode(), np.uint8) for r in roles]
    head_flat = np.concatenate(heads) if heads else np.empty(0, np.uint8)
    head_len = np.array([len(h) for h in heads], np.int64)
    head_at = (np.cumsum(head_len) - head_len)[role_of]
    head_len = head_len[role_of]
    marked = escapes(data, offsets)
    before = np.concatenate([[0], np.cumsum(marked)])
    text_len = np.diff(offsets) + before[offsets[1:]] - before[offsets[:-1]]
    begins = np.concatenate([[0], np.cumsum(head_len + text_len + len(FOOT))])
    text_at = begins[:-1] + head_len
    out = np.empty(int(begins[-1]), np.uint8)
    inside = _inside(head_len)
    out[np.repeat(begins[:-1], head_len) + inside] = head_flat[np.repeat(head_at, head_len) + inside]
    to = np.repeat(text_at - offsets[:-1] - before[offsets[:-1]], np.diff(offsets)) + np.arange(len(data)) + before[1:]
    out[to] = data
    out[to[marked] - 1] = BACKSLASH
    out[((text_at + text_len)[:, None] + np.arange(len(FOOT))).ravel()] = np.tile(FOOT, len(text_at))
    return out, begins, text_at, text_at + text_len


def _record(chunks: list[tuple], id_type, names: list[str]) -> pa.RecordBatch:
    """A batch of the conversations in (ids, buffer, begins, text begins, text ends, learns) chunks: one buffer and its offsets."""
    ids = [x for c in chunks for x in c[0]]
    at = np.cumsum([0] + [len(c[1]) for c in chunks])
    joined = [np.concatenate([c[k] + s if k < 5 else c[k] for c, s in zip(chunks, at)]) for k in (2, 3, 4, 5)]
    data = chunks[0][1] if len(chunks) == 1 else np.concatenate([c[1] for c in chunks])
    begins, text_at, text_end, learns = joined
    first = np.array([0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)])
    cuts = np.append(begins, len(data))[first]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    before = np.repeat(points[cuts[:-1]], np.diff(first))
    lists = pa.array(np.concatenate([[0], np.cumsum(learns)])[first], pa.int32())
    starts, ends = (pa.ListArray.from_arrays(lists, pa.array((points[x] - before)[learns], pa.int32())) for x in (text_at, text_end))
    columns_ = [pa.array([ids[k] for k in first[:-1]], id_type), pa.array(np.diff(first), pa.int64()), columns.large_strings(data, cuts).cast(pa.string()), starts, ends]
    return pa.RecordBatch.from_arrays(columns_, names=names)


def _format(batches, names: list[str], masked: str):
    open_: list[tuple] = []  # what has come of the conversation that may go on
    id_type = None
    for batch in batches:
        id_type = batch.schema.field(0).type
        ids = batch.column(0).to_pylist()
        coded = batch.column(1).fill_null("").dictionary_encode()
        roles = coded.dictionary.to_pylist()
        learning = np.array([r == masked for r in roles], bool)
        data, offsets = columns.buffers(batch.column(2))
        for i, j in columns.slices(offsets):
            role_of = np.asarray(coded.indices)[i:j]
            out, begins, text_at, text_end = assemble(roles, role_of, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            part, learns = ids[i:j], learning[role_of]
            last = next((k for k in range(j - i - 1, 0, -1) if part[k] != part[k - 1]), 0)  # where the slice's last conversation begins
            if last or open_ and open_[-1][0][-1] != part[0]:
                done = [*open_, (part[:last], out[: begins[last]], begins[:last], text_at[:last], text_end[:last], learns[:last])]
                yield _record([c for c in done if c[0]], id_type, names)
                open_ = []
            open_.append((part[last:], out[begins[last] :], begins[last:-1] - begins[last], text_at[last:] - begins[last], text_end[last:] - begins[last], learns[last:]))
    if open_:
        yield _record(open_, id_type, names)


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", masked: str = "assistant") -> DataFrame:
    """One row per conversation: conv_col, n_turns, formatted, and the code point ranges of the loss mask (the masked role's texts)."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[conv_col], *T._parse_datatype_string(FORMATTED).fields])
    rows = df.select(conv_col, F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(turn_col).alias("turn"))
    rows = rows.repartition(conv_col).sortWithinPartitions(conv_col, "turn", "role", "text").drop("turn")
    return rows.mapInArrow(lambda batches: _format(batches, schema.names, masked), schema)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for turn in formatted.split(f"\n{END}\n")[:-1]:
        role, _, text = turn.partition("\n")
        out.append((unescape_role(role[len(HEAD) :]), unescape(text)))
    return out


def read_back(df: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What format_conversations wrote, read from its text and mask: conv_col, turns, loss_text, formatted_chars."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[conv_col], *T._parse_datatype_string(TURNS).fields])
    kinds = (pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.string(), pa.int64())

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for text, starts, ends in zip(*(c.to_pylist() for c in part.columns[1:])):
                    turns = [{"role": r, "text": t} for r, t in parse(text)]
                    rows.append((turns, "".join(unescape(text[a:b]) for a, b in zip(starts, ends)), len(text)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=schema.names)

    return df.select(conv_col, "formatted", "loss_starts", "loss_ends").mapInArrow(run, schema)
