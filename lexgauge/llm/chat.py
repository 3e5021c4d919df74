"""Conversations as token sequences with a loss mask.

The template is assembled from ids: every turn is one reserved id for its role,
the ids of its text, encoded on their own, and a reserved end-of-turn id.
Reserved ids lie above the vocabulary, so no text can produce them, and the
encoder treats special strings inside texts as ordinary characters.  For
readers that work on strings the control strings of the template are escaped
inside texts as well: a backslash goes before each of them and before each
backslash, which is undone exactly when texts are read back.

The loss mask marks the ids of assistant texts.  Each boundary of a marked span
adds one or takes one away, and the prefix sum of these marks is the mask.

Null role and null text count as empty; a role without an id of its own is
spelt out between two reserved ids; turns are ordered by turn, then role and
text, nulls first, and turns that repeat are kept; rows with a null conv_id form
one conversation; an empty table gives an empty result; other columns are not
read.  A conversation is one sequence, so the longest one must fit a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgauge.llm.common import whole_groups

#: Control strings of the rendered template (fixed values).
START, END = "<s>", "</s>"
ROLE_STRINGS = {
    "system": "[SYS]",
    "user": "[INST]",
    "assistant": "[/INST]",
    "tool": "[TOOL]",
}
NAMED = ("[ROLE]", "[/ROLE]")
CONTROL = [START, END, *ROLE_STRINGS.values(), *NAMED]
_TO_ESCAPE = re.compile("|".join(re.escape(c) for c in ["\\", *CONTROL]))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

SCHEMA = "conv_id bigint, n_turns bigint, input_ids array<int>, loss_mask array<tinyint>, formatted_chars bigint"


def escape(text: str) -> str:
    """A backslash before every control string and every backslash."""
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> str:
    """The template as one string, for readers without token ids."""
    out = [START]
    for role, text in turns:
        mark = ROLE_STRINGS.get(role) or NAMED[0] + escape(role) + NAMED[1]
        out += [mark, escape(text), END]
    return "".join(out)


class Template:
    """Reserved ids above a vocabulary of ``size`` ids."""

    def __init__(self, size: int) -> None:
        self.start, self.end, self.role_open, self.role_close = size, size + 1, size + 2, size + 3
        self.roles = {role: size + 4 + i for i, role in enumerate(ROLE_STRINGS)}
        self.names = {i: role for role, i in self.roles.items()}
        self.first = size


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def assemble(turns: list[tuple[str, np.ndarray, np.ndarray]], template: Template) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one conversation from (role, role ids, text ids) per turn."""
    parts = [np.array([template.start])]
    edges: list[tuple[int, int]] = []
    size = 1
    for role, role_ids, text_ids in turns:
        mark = template.roles.get(role)
        head = [mark] if mark is not None else [template.role_open, *role_ids, template.role_close]
        parts += [np.array(head), text_ids, np.array([template.end])]
        size += len(head)
        if role == "assistant":
            edges.append((size, size + len(text_ids)))
        size += len(text_ids) + 1
    marks = np.zeros(size + 1, np.int64)
    for begin, stop in edges:
        marks[begin] += 1
        marks[stop] -= 1
    return np.concatenate(parts).astype(np.int32), np.cumsum(marks)[:size].astype(np.int8)


def format_chats(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation: input_ids, loss_mask and the length of the rendered text."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)
        template = Template(encoder.get_vocab_size())

        def ids(texts: list[str]) -> list[np.ndarray]:
            # Few at a time: an encoding holds far more than its ids.
            return [
                np.array(coded.ids, np.int32)
                for begin in range(0, len(texts), 128)
                for coded in encoder.encode_batch_fast(texts[begin : begin + 128], add_special_tokens=False)
            ]

        for table in whole_groups(stream, ["conv_id"], 1000):
            conv = table.column("conv_id").to_pylist()
            roles, texts = table.column("role").to_pylist(), table.column("text").to_pylist()
            # Texts are encoded with their control strings escaped, so decoding gives the rendered text.
            text_ids, names = ids([escape(t) for t in texts]), sorted(set(roles))
            by_role = dict(zip(names, ids([escape(r) for r in names])))
            role_ids = [by_role[r] for r in roles]
            edges = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
            rows = []
            for a, b in zip(edges, edges[1:]):
                input_ids, mask = assemble(list(zip(roles[a:b], role_ids[a:b], text_ids[a:b])), template)
                rows.append((conv[a], b - a, input_ids, mask, len(render(list(zip(roles[a:b], texts[a:b]))))))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.list_(pa.int32())),
                    pa.array(columns[3], pa.list_(pa.int8())),
                    pa.array(columns[4], pa.int64()),
                ],
                ["conv_id", "n_turns", "input_ids", "loss_mask", "formatted_chars"],
            )

    empty = F.lit("")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, SCHEMA)


def parse(ids: np.ndarray, mask: np.ndarray, encoder, template: Template) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns, and the texts under the mask, of one assembled sequence."""
    ids = np.asarray(ids, np.int64)

    def text(a: int, b: int) -> str:
        return unescape(encoder.decode(ids[a:b].tolist(), skip_special_tokens=False)) if b > a else ""

    special = np.flatnonzero(ids >= template.first)
    turns: list[tuple[str, str]] = []
    k = 1
    while k < len(special):
        at = int(special[k])
        if ids[at] == template.role_open:
            role, begin = text(at + 1, int(special[k + 1])), int(special[k + 1]) + 1
            k += 1
        else:
            role, begin = template.names[int(ids[at])], at + 1
        turns.append((role, text(begin, int(special[k + 1]))))
        k += 2
    marks = np.diff(np.concatenate(([0], np.asarray(mask, np.int8), [0])))
    spans = zip(np.flatnonzero(marks == 1).tolist(), np.flatnonzero(marks == -1).tolist())
    return turns, [text(a, b) for a, b in spans]


def digest_chats(chats: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of what ``format_chats`` wrote, taken from its ids and mask alone."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)
        template = Template(encoder.get_vocab_size())
        for batch in stream:
            rows = []
            for ids, mask in zip(batch.column("input_ids"), batch.column("loss_mask")):
                turns, losses = parse(
                    ids.values.to_numpy(zero_copy_only=False), mask.values.to_numpy(zero_copy_only=False), encoder, template
                )
                loss = "".join(losses)
                whole = hashlib.sha256()
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode())
                rows.append((len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.string()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.string()),
                    batch.column("formatted_chars"),
                ],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return chats.select("conv_id", "input_ids", "loss_mask", "formatted_chars").mapInArrow(
        run,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
