"""Chat formatting at token level.

Each turn becomes the token ids of a reserved header, of its text and of a reserved end. Segments are
encoded one by one, so no merge crosses a boundary; reserved ids are spliced in between, and the loss
mask comes from prefix sums over the lengths of the segments. Control strings that occur inside a text
are escaped, so a text can never forge a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import shared_decoder
from .common import mapped, prepare
from .tokenfiles import shared_encoder

#: Reserved segments, in the order of their ids after the vocabulary, as they stand in the formatted text.
HEADERS = {"user": "### User: ", "assistant": "### Assistant: ", "system": "### System: "}
OTHER, OTHER_END, END = "### Role: ", "</role>", "</turn>\n"
RESERVED = [*HEADERS.values(), OTHER, OTHER_END, END]
CONTROL = [x.strip() for x in RESERVED]
#: The role whose text the model learns.
LEARNED = "assistant"

_ESCAPE = re.compile(r"\\|(?=" + "|".join(map(re.escape, CONTROL)) + r").", re.S)
_UNESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Backslashes doubled, and one put after the first character of each control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    """The inverse of escape()."""
    return _UNESCAPE.sub(r"\1", text)


def segments(role: str, text: str) -> list[tuple[str, bool, bool]]:
    """(string, reserved, learned) for each segment of a turn."""
    head = [(HEADERS[role], True, False)] if role in HEADERS else [(OTHER, True, False), (escape(role), False, False), (OTHER_END, True, False)]
    return [*head, (escape(text), False, role == LEARNED), (END, True, False)]


def assemble(turns: list[list[tuple[str, bool, bool]]], encode, first: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of turns, and for each the ends of runs of the loss mask; ``encode`` is given all texts at once and tells ids and how many each has, ``first`` is the first reserved id."""
    number = {s: first + i for i, s in enumerate(RESERVED)}
    found, counts = encode([s for t in turns for s, reserved, _ in t if not reserved])
    flat = [x for t in turns for x in t]
    reserved, learned = np.array([x[1] for x in flat], bool), np.array([x[2] for x in flat], bool)
    size = np.ones(len(flat), np.int64)
    size[~reserved] = counts
    ends = np.cumsum(size)
    ids = np.empty(ends[-1] if len(ends) else 0, np.int64)
    special = np.zeros(len(ids), bool)
    special[ends[reserved] - 1] = True
    ids[special] = [number[s] for s, r, _ in flat if r]
    ids[~special] = found
    # One step up where a learned segment starts, one down where it ends: the mask is their prefix sum.
    edges = np.zeros(len(ids) + 1, np.int8)
    np.add.at(edges, (ends - size)[learned], 1)
    np.add.at(edges, ends[learned], -1)
    mask = np.cumsum(edges[:-1], dtype=np.int8)
    cuts = ends[np.cumsum([len(t) for t in turns]) - 1][:-1] if turns else []
    masks = [np.flatnonzero(np.diff(np.r_[0, m, 0])) for m in np.split(mask, cuts)]
    return np.split(ids, cuts), masks


def kind_of(first: int) -> str:
    """The type of an id where ``first`` is the first reserved one."""
    return "<u2" if first + len(RESERVED) <= 1 << 16 else "<u4"


def format_turns(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per turn of (conv_id, turn, role, text): conv_id, turn, tie, formatted, ids, learned.

    ``ids`` are little-endian, 2 bytes each if the vocabulary allows; ``learned`` are the ends of the runs under the loss mask
    (start, end, start, ...). The formatted conversation is the concatenation of its turns by (turn, tie), nulls first; ``tie`` is the MD5 of
    role, line feed and text. Null role or text counts as empty, repeated rows stay, null conv_id is a conversation of its own;
    other columns are not read. Turns are encoded where they lie: no shuffle, and no bound on turns in a conversation.
    """
    prepare(turns.sparkSession)

    def work(batches: Iterator[dict]) -> Iterable[dict]:
        enc = shared_encoder(tokenizer, True)
        first = enc.lib.get_vocab_size(with_added_tokens=True)
        kind = kind_of(first)
        for b in batches:
            pairs = [(r or "", t or "") for r, t in zip(b["role"], b["text"], strict=True)]
            segs = [segments(r, t) for r, t in pairs]
            ids, learned = assemble(segs, lambda x: enc.encode(pa.array(x, pa.string())), first)
            tie = [hashlib.md5(f"{r}\n{t}".encode("utf-8", "surrogatepass")).digest() for r, t in pairs]
            formatted = ["".join(s for s, _, _ in t) for t in segs]
            yield {"conv_id": b["conv_id"], "turn": b["turn"], "tie": tie, "formatted": formatted, "ids": [x.astype(kind).tobytes() for x in ids], "learned": learned}

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return mapped(rows, work, "conv_id long, turn long, tie binary, formatted string, ids binary, learned array<int>")


def read_back(ids: list[np.ndarray], learned: list[list[int]], decode_batch, first: int) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the mask) of formatted turns, from their ids and masks alone."""
    size = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
    special = np.flatnonzero(flat >= first)
    turn = np.repeat(np.arange(len(ids)), size)[special]
    inner = np.flatnonzero(turn[1:] == turn[:-1])  # a segment stands between two reserved ids of one turn
    texts = list(map(unescape, decode_batch(flat[flat < first], special[inner + 1] - special[inner] - 1)))
    of = np.searchsorted(turn[inner], np.arange(len(ids)), "right") - 1  # the last one is the turn's text
    heads = special[np.searchsorted(turn, np.arange(len(ids)))]
    runs = [np.concatenate([x[a:b] for a, b in zip(m[::2], m[1::2], strict=True)] or [x[:0]]) for x, m in zip(ids, learned, strict=True)]
    under = decode_batch(np.concatenate([*runs, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(x) for x in runs], np.int64))
    roles = {h: r for r, h in HEADERS.items()}
    for i, learned_text in enumerate(under):
        mark = RESERVED[flat[heads[i]] - first]
        yield texts[of[i] - 1] if mark == OTHER else roles[mark], texts[of[i]], unescape(learned_text)


def chat_digests(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per conversation of format_turns(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens.

    Everything but the formatted length is read back from ids and masks, and only these are shuffled. Turns come sorted and
    are digested one after another, so a task holds one batch however long a conversation is.
    """

    def work(batches: Iterator[dict]) -> Iterable[dict]:
        decoder = shared_decoder(tokenizer)
        first = len(decoder.raw_size)
        kind = kind_of(first)
        out: dict[str, list] = {k: [] for k in names}
        now, state = object(), None

        def close() -> None:
            if state:
                all_text, loss, counts = state
                for k, v in zip(names, [now, counts[0], all_text.hexdigest(), counts[1], loss.hexdigest(), *counts[2:]], strict=True):
                    out[k].append(v)

        for b in batches:
            ids = [np.frombuffer(x, kind) for x in b["ids"]]
            told = read_back(ids, b["learned"], decoder.decode_batch, first)
            for conv, chars, own, m, (role, text, learned) in zip(b["conv_id"], b["chars"], ids, b["learned"], told, strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, (hashlib.sha256(), hashlib.sha256(), [0] * 5)
                state[0].update(f"{role}\n{text}\n".encode())
                state[1].update(learned.encode())
                for i, x in enumerate((1, len(learned), chars, len(own), sum(m[1::2]) - sum(m[::2]))):
                    state[2][i] += x
            if len(out["conv_id"]) >= 1000:
                yield out
                out = {k: [] for k in names}
        close()
        yield out

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
    light = formatted.select("conv_id", "turn", "tie", F.length("formatted").alias("chars"), "ids", "learned")
    ordered = light.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "tie").select("conv_id", "chars", "ids", "learned")
    return mapped(ordered, work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")
