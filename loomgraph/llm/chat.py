"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, ``<|im_start|>role\\ntext<|im_end|>\\n`` per
turn, and encoded once with character offsets.  The spans of the assistant's
texts and the tokens' spans are both sorted, so each text finds its first and
last token by binary search; the mask covers these tokens, and the loss spans
are the intersections of both, merged.

Control strings inside texts are escaped reversibly: every ``<|`` becomes
``<||``, in roles a line break becomes ``<|n`` as well.  No escaped text can
then contain ``<|im_``, nor any other special string of the tokenizer.

The output is one text per conversation by contract, so a conversation is
gathered in one task (turns sorted by turn, then role and text); there is no
limit on its length, and nothing else is gathered.

Defined cases: null texts and roles are empty; rows without conv_id form one
conversation of that id; rows that repeat a turn number all stay, ordered by
role and text; a null turn comes first; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

MODEL = public_tokenizers.path("byte_bpe_50k.json")
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
_ESCAPED = re.compile(r"<\|([|n])")
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def escape(text: str) -> str:
    return text.replace("<|", "<||")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "<|n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<|" if m[1] == "|" else "\n", text)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str = MODEL) -> Tokenizer:
    made = Tokenizer.from_file(path)
    made.add_special_tokens([AddedToken(START, special=True), AddedToken(END, special=True)])
    return made


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the sorted spans of the texts of ``loss_role``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def align(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Mask over tokens, and the merged intersections of their spans with ``spans``."""
    mask = np.zeros(len(offsets), dtype=np.int8)
    loss: list[tuple[int, int]] = []
    starts, ends = offsets[:, 0], offsets[:, 1]
    for s, e in spans:
        first, last = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
        mask[first:last] = 1
        new = True  # a text never merges with the one before
        for a, b in zip(np.maximum(starts[first:last], s).tolist(), np.minimum(ends[first:last], e).tolist(), strict=True):
            if a >= b:
                continue
            if not new and a <= loss[-1][1]:
                loss[-1] = (loss[-1][0], max(loss[-1][1], b))
            else:
                loss.append((a, b))
                new = False
    return mask, loss


def format_conversations(turns: DataFrame, model: str = MODEL, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, input_ids, loss_mask (per token) and loss_spans (characters of ``formatted``)."""
    whole = turns.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
        ).alias("turns")
    )
    source = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(model)
        for full in batches:
            for first in range(0, full.num_rows, 256):
                batch = full.slice(first, 256)
                texts, ids, masks, spans = [], [], [], []
                for roles, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    text, wanted = render(list(zip(roles, said, strict=True)), loss_role)
                    coded = tok.encode(text, add_special_tokens=False)
                    mask, loss = align(np.array(coded.offsets, dtype=np.int64).reshape(-1, 2), wanted)
                    texts.append(text)
                    ids.append(coded.ids)
                    masks.append(mask)
                    spans.append([{"start": a, "end": b} for a, b in loss])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32())),
                        pa.array(masks, pa.list_(pa.int8())), pa.array(spans, pa.list_(_SPAN)),
                    ],
                    names=["conv_id", "formatted", "input_ids", "loss_mask", "loss_spans"],
                )

    return source.mapInArrow(
        run,
        f"conv_id {kind}, formatted string, input_ids array<int>, loss_mask array<tinyint>, "
        "loss_spans array<struct<start: bigint, end: bigint>>",
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; raises if anything lies between them."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"unexpected text at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"unexpected text at {at}")
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its loss spans say."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
                rows.append((len(turns), digest(said), len(loss), digest(loss), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        run,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(role, '<|', '<||'), chr(10), '<|n')) + length(replace(text, '<|', '<||'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
