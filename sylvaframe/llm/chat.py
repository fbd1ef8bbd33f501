"""Chat formatting with a loss mask that is aligned to tokens.

A conversation is rendered with a template whose control strings are special tokens
of the tokenizer; the same strings inside texts and roles are escaped, reversibly.
The rendering is encoded once, with offsets. The assistant's texts are sorted spans
of the rendering, the offsets are sorted spans too, and a binary search of the one in
the other gives the tokens that count in the loss.

The output has one row per part of a conversation: rendering, token ids, token
offsets and mask. A part ends between turns once it is long enough, so a conversation
of any number of turns passes in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, written

TOKENIZER = "byte_bpe_50k.json"
# Fixed values of the template: the strings that mark a turn, and further control strings that texts must not smuggle in.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (TURN, TEXT, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
ESCAPE = "\\"
#: Characters after which a part ends at the next turn.
PART_CHARS = 500_000
LOSS_ROLE = "assistant"

# A control string with any number of escapes after its first character.
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS))
_MARK = re.compile("|".join(map(re.escape, (TURN, TEXT, END))))


def escape(text: str) -> str:
    """One more escape after the first character of each control string, escaped or not."""
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    """The inverse of escape."""
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == ESCAPE else m[0], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering of (role, text) turns and the spans of the texts that count in the loss, without empty ones."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LOSS_ROLE and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(rendering: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendering."""
    pieces = _MARK.split(rendering)
    return [(unescape(role), unescape(text)) for role, text in zip(pieces[1::3], pieces[2::3])]


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token, whether its characters overlap a span. Offsets (n, 2) and spans are sorted; spans are disjoint."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    start, end = np.array(spans).T
    # The first span that ends after the token begins must begin before the token ends.
    at = np.searchsorted(end, offsets[:, 0], "right")
    return (at < len(spans)) & (start[np.minimum(at, len(spans) - 1)] < offsets[:, 1])


def masked_text(rendering: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the mask, one for each run of tokens whose characters touch; still escaped."""
    spans: list[list[int]] = []
    for a, b in offsets[mask].tolist():
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return [rendering[a:b] for a, b in spans]


_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The byte-level tokenizer at path with the control strings as special tokens, loaded once per Python worker. It isn't trained: ids are appended."""
    if path not in _loaded:
        from tokenizers import AddedToken, Tokenizer, processors

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in (TURN, TEXT, END)])
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        _loaded[path] = t
    return _loaded[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


OUT = "conv_id long, part int, n_turns int, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"


def format_conversations(rows: DataFrame, tokenizer_path: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per part of each conversation of rows (conv_id, turn, role, text).

    Null texts and roles count as empty; rows are ordered by turn (null first), then role and text, so ties and repeated rows have one
    order; a null conv_id is a conversation of its own; other columns are ignored; an empty table gives an empty result.
    Rows of a conversation are sorted into one partition and pass through it as a stream: what a task holds is one part, not a conversation."""
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        turns: list[tuple[str, str]] = []
        held, current, part = 0, None, 0
        done: list[tuple] = []

        def close() -> None:
            text, spans = render(turns)
            e = encoder.encode(text, add_special_tokens=False)
            offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
            done.append((current, part, len(turns), text, e.ids, offsets[:, 0].tolist(), offsets[:, 1].tolist(), token_mask(offsets, spans).tolist()))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
            columns = [pa.array(c, k) for c, k in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if turns and (conv != current or held >= part_chars):
                    close()
                    part = part + 1 if conv == current else 0
                    turns, held = [], 0
                    if sum(len(x[3]) for x in done[-8:]) > 1_000_000 or len(done) >= 256:
                        yield batch_of()
                elif conv != current:
                    part = 0
                current = conv
                turns.append((role, text))
                held += len(role) + len(text) + 24
        if turns:
            close()
        if done:
            yield batch_of()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    dealt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    dealt = dealt.repartition(partitions_for(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, OUT)


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def summarise(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from rows of format_conversations: turns parsed from the rendering, and the text under the mask. Parts pass as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, current = False, None
        turns = loss = None
        counts = [0] * 5
        done: list[tuple] = []

        def close() -> None:
            n, chars, size, tokens, masked = counts
            done.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens, masked))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3]
            columns = [pa.array(c, k) for c, k in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SUMMARY.split(", ")])

        for batch in batches:
            for conv, text, starts, ends, mask in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if not started or conv != current:
                    if started:
                        close()
                    started, current, counts = True, conv, [0] * 5
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                found = parse(text)
                for role, body in found:
                    turns.update(f"{role}\n{body}\n".encode())
                mask = np.array(mask, bool)
                for x in masked_text(text, np.array([starts, ends], np.int64).T.reshape(-1, 2), mask):
                    x = unescape(x)
                    loss.update(x.encode())
                    counts[1] += len(x)
                counts[0] += len(found)
                counts[2] += len(text)
                counts[3] += len(mask)
                counts[4] += int(mask.sum())
            if len(done) >= 4096:
                yield batch_of()
        if started:
            close()
        if done:
            yield batch_of()

    dealt = formatted.repartition(partitions_for(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.select("conv_id", "formatted", "starts", "ends", "mask").mapInArrow(run, SUMMARY)


def write_and_read(rows: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """format_conversations, written to the shared folder and read back, summarised."""
    return summarise(written(format_conversations(rows, tokenizer_path), "chat"))
