"""Chat formatting (operator 5): whole conversations rendered once, encoded once, masked by offsets.

A conversation becomes MARK role MARK text MARK role MARK text ... MARK. ``<|`` inside roles and texts gets a backslash
before the bar (``<\\|``; with n backslashes there already, n + 1), so no text can contain a mark and the change can be
undone. The whole string is encoded once, by numpy BPE; the bytes that its ids stand for give the tokens' offsets. The
spans of the turns that count for the loss and the spans of the tokens are both sorted, so binary search finds for each
token the turn that it meets. A mark is a token of its own, so no token reaches from one turn into another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm import bpe, ragged

MARK = "<|endoftext|>"
#: Conversations encoded together.
GROUP = 64

_BAR = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _BAR.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], roles: set[str]) -> tuple[str, np.ndarray]:
    """The conversation as one string, and the (start, end) in bytes of each text whose role counts."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = MARK + escape(role) + MARK, escape(text)
        at += len(head.encode())
        size = len(body.encode())
        if role in roles:
            spans.append((at, at + size))
        at += size
        parts += [head, body]
    return "".join(parts) + MARK, np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    fields = formatted.split(MARK)[1:-1]
    return [(unescape(r), unescape(t)) for r, t in zip(fields[::2], fields[1::2], strict=True)]


def mask(spans: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens meet a span. ``spans``: sorted (start, end) pairs; ``ends``: where each token ends and the next begins."""
    start = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    filled = spans[spans[:, 1] > spans[:, 0]]
    at = np.searchsorted(filled[:, 1], start, "right")
    inside = at < len(filled)
    inside[inside] = filled[at[inside], 0] < ends[inside]
    return inside


def format_conversations(
    turns: DataFrame, tokenizer: str, roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, token_ids, token_ends, loss_mask``.

    ``token_ends``: where each token ends in the UTF-8 bytes of ``formatted``; ``loss_mask`` has one flag per token.
    Turns come in the order of ``turn`` (nulls first); rows of one turn follow role and text. Null roles and texts count
    as empty; rows of null conversation ids form one conversation. Other columns are not read. One shuffle by
    conversation; a task sorts on disk if it must and holds one conversation's text at a time.
    """
    held = turns.sparkSession.sparkContext.broadcast(bpe.load(tokenizer))
    if MARK not in held.value.specials:
        raise ValueError(f"{tokenizer}: it has no {MARK}")
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    id_type = rows.schema["c"].dataType.simpleString()
    wanted = set(roles)

    def encode(group: list[tuple[object, list[tuple[str, str]]]], encoder: bpe.Encoder, id_arrow) -> pa.RecordBatch:
        rendered = [render(t, wanted) for _, t in group]
        texts = pa.array([text for text, _ in rendered], pa.string())
        data, offsets = ragged.utf8(texts)
        n, ids = encoder.encode(data, offsets)
        ends = np.cumsum(encoder.v.widths[ids])
        spans = np.concatenate([s + at for (_, s), at in zip(rendered, offsets[:-1].tolist(), strict=True)])
        flags, bounds = mask(spans, ends), pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        own_ends = ends - np.repeat(offsets[:-1], n)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, _ in group], id_arrow),
                pa.array([len(t) for _, t in group], pa.int64()),
                texts,
                pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(bounds, pa.array(own_ends, pa.int32())),
                pa.ListArray.from_arrays(bounds, pa.array(flags, pa.bool_())),
            ],
            names=[conv_col, "n_turns", "formatted", "token_ids", "token_ends", "loss_mask"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(held.value, keep_ids=True)
        group: list[tuple[object, list[tuple[str, str]]]] = []
        size, id_arrow = 0, None
        for batch in batches:
            id_arrow = batch.column(0).type
            for c, r, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not group or group[-1][0] != c:
                    if len(group) >= GROUP or size > 1 << 22:
                        yield encode(group, encoder, id_arrow)
                        group, size = [], 0
                    group.append((c, []))
                group[-1][1].append((r, x))
                size += len(x)
        if group:
            yield encode(group, encoder, id_arrow)

    return rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").mapInArrow(
        run, f"`{conv_col}` {id_type}, n_turns long, formatted string, token_ids array<int>, token_ends array<int>, loss_mask array<boolean>"
    )


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the output says, read back from it: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    The loss text is that of the tokens under the mask, by their ends; the turns are parsed from the formatted text.
    """
    source = formatted.select(conv_col, "formatted", "token_ends", "loss_mask")
    id_type = source.schema[conv_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ends, flags = batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                turns, raw = parse(text), text.encode()
                # tokens under the mask that stand behind each other are one stretch; marks divide the turns
                edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
                first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
                starts = np.concatenate([[0], ends[:-1]])[first]
                loss = "".join(unescape(raw[a:b].decode()) for a, b in zip(starts.tolist(), ends[last].tolist(), strict=True))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=[conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return source.mapInArrow(read, f"`{conv_col}` {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
