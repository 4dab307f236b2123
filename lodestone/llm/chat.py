"""3. Chat formatting at token level: segments are encoded one by one, reserved ids spliced in, masks from prefix sums."""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = os.environ.get("LODESTONE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = ("<|endoftext|>", "<|start|>", "<|message|>", "<|end|>")
ROLES = ("system", "user", "assistant")
TRAINED_ROLE = "assistant"
SCHEMA = "conv_id long, n_turns int, n_tokens int, n_trained int, ids array<int>, mask array<tinyint>"


def escape(text: str) -> str:
    """Puts one more backslash into every '<|', '<\\|', ...: no control string is left, and it can be undone."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def encoder(ranks_path: str = RANKS):
    """Byte-pair encoding of a public vocabulary; the reserved ids follow its last one."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    first = max(ranks.values()) + 1
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), {s: first + i for i, s in enumerate(SPECIAL)}


#: Runs of what the pattern calls blank that its backtracking should not see.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
SEAM = re.compile(r"(?<=[^\s]) (?=[^\s])")


def encode(enc, text: str, step: int = 1 << 16) -> list[int]:
    """Ordinary encoding of texts of any length and kind. A long text is cut only where the pattern cuts as well: before
    single blanks, and around a long run of blanks, which but for its last one (if more follows) is a piece of its own."""
    if len(text) <= step:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for run in BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += _in_steps(enc, text[at : run.start()], step) + enc._encode_single_piece(text[run.start() : end])
        at = end
    return out + _in_steps(enc, text[at:], step)


def _in_steps(enc, text: str, step: int) -> list[int]:
    out, at = [], 0
    while at < len(text):
        cut = SEAM.search(text, at + step)
        end = cut.start() if cut else len(text)
        out += enc.encode_ordinary(text[at:end])
        at = end
    return out


def assemble(enc, reserved, turns):
    """ids and mask of one conversation: ``<|start|>role<|message|>content<|end|>`` a turn, then ``<|endoftext|>``.

    Content and the closing mark of the trained role count for the loss (mask 1)."""
    segments, trained = [], []
    for role, text in turns:
        segments += [[reserved["<|start|>"]], encode(enc, escape(role)), [reserved["<|message|>"]], encode(enc, escape(text)), [reserved["<|end|>"]]]
        trained += [0, 0, 0, *([role == TRAINED_ROLE] * 2)]
    segments.append([reserved["<|endoftext|>"]])
    trained.append(0)
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    steps = np.zeros(ends[-1] + 1, np.int64)  # +1 where a trained segment starts, -1 where it ends
    on = np.array(trained, bool)
    np.add.at(steps, (ends - sizes)[on], 1)
    np.add.at(steps, ends[on], -1)
    return np.concatenate([np.asarray(s, np.int32) for s in segments]), np.cumsum(steps[:-1]).astype(np.int8)


def disassemble(enc, reserved, ids) -> list[tuple[str, str]]:
    """The turns that :func:`assemble` was given."""
    names, turns, part, role = {v: k for k, v in reserved.items()}, [], [], ""
    for i in ids:
        mark = names.get(int(i))
        if mark is None:
            part.append(int(i))
        elif mark == "<|message|>":
            role, part = unescape(enc.decode(part)), []
        elif mark == "<|end|>":
            turns.append((role, unescape(enc.decode(part))))
            part = []
        else:
            part = []
    return turns


def _format(ranks_path):
    def run(batches):
        enc, reserved = encoder(ranks_path)
        for batch in batches:
            ids, masks, kept, n_turns = [], [], batch.column("conv_id"), []
            for turns in batch.column("turns").to_pylist():
                i, m = assemble(enc, reserved, [(t["role"], t["text"]) for t in turns])
                ids.append(i)
                masks.append(m)
                n_turns.append(len(turns))
            sizes = np.array([len(i) for i in ids], np.int32)
            bounds = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            flat_ids, flat_masks = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((ids, np.int32), (masks, np.int8)))
            yield pa.RecordBatch.from_arrays(
                [kept, pa.array(n_turns, pa.int32()), pa.array(sizes), pa.array([int(m.sum()) for m in masks], pa.int32()), pa.ListArray.from_arrays(bounds, pa.array(flat_ids)), pa.ListArray.from_arrays(bounds, pa.array(flat_masks))],
                names=["conv_id", "n_turns", "n_tokens", "n_trained", "ids", "mask"],
            )

    return run


def format_chat(conversations: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """One row a conversation: (conv_id, n_turns, n_tokens, n_trained, ids, mask).

    Turns are in the order of ``turn``, ties by role and text; an identical repeated row counts once. Control strings
    in content or roles are escaped reversibly and encoded as ordinary text, so reserved ids come from the template
    only. Texts may be of any length, runs of one character too. A null or empty text is an empty turn, a null role the role "". A null turn comes first. Rows without
    conv_id are dropped. Extra columns are ignored. An empty table gives no rows. Conversations are held whole in a
    task, as their ids are in the result.
    """
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns")).mapInArrow(_format(ranks_path), SCHEMA)
