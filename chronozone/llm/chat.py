"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; what follows in each conversation is its completion, with a
mask of the places that count in training: the text and end mark of the assistant's turns, nothing else.  Two turns are
common if role and text are equal, null with null.

A turn is rendered as ``<|im_start|>role``, a line feed, its text, ``<|im_end|>`` and a line feed.  In texts and roles a
``<`` that backslashes and a ``|`` follow gets one more backslash, so a text can't forge a mark and ``unescape`` restores it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"
_FORGED, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str | None) -> str:
    return _FORGED.sub(r"<\\\1|", text or "")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of turns (role, text) and the trained spans in it, in code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}\n", f"{escape(text)}{END}"
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}\n")
        at += len(out[-1])
    return "".join(out), spans


def common(chosen: list, rejected: list) -> int:
    """Turns that both begin with."""
    return next((k for k, (a, b) in enumerate(zip(chosen, rejected)) if a != b), min(len(chosen), len(rejected)))


def _mask(spans: list[tuple[int, int]]) -> str:
    return ",".join(f"{s}:{e}" for s, e in spans)


SCHEMA = "pair_id long, n_common long, n_chosen long, n_rejected long, prompt string, chosen string, chosen_mask string, rejected string, rejected_mask string"
_COLUMNS = [x.split(" ")[0] for x in SCHEMA.split(", ")]
Turns = list[tuple[str | None, str | None]]


def pair_row(pair_id: int, chosen: Turns, rejected: Turns) -> tuple:
    """A pair in the columns of ``SCHEMA``."""
    k = common(chosen, rejected)
    (good, good_mask), (bad, bad_mask) = render(chosen[k:]), render(rejected[k:])
    return pair_id, k, len(chosen), len(rejected), render(chosen[:k])[0], good, _mask(good_mask), bad, _mask(bad_mask)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == "pair_id" or k.startswith("n_") else pa.string()) for k, v in zip(_COLUMNS, columns)], _COLUMNS)


def _gathered(turns: DataFrame, key: str, side: str) -> DataFrame:
    """The turns of each key in order: by side, then turn, role and text, nulls first."""
    rows = turns.where(F.col(key).isNotNull()).select(key, side, "turn", "role", "text")
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(side, "turn", "role", "text"))).alias("turns"))


def format_sides(turns: DataFrame) -> DataFrame:
    """Turns with ``pair_id`` and ``side`` (0 chosen, 1 rejected) to a row of each pair.

    Turns are ordered by ``turn``, then role and text, nulls first, so repeated turn numbers have a place.  A pair of which one side is
    missing has an empty prompt and an empty completion on that side; identical conversations leave two empty completions.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for pair_id, found in zip(batch.column("pair_id").to_pylist(), batch.column("turns").to_pylist()):
                rows.append(pair_row(pair_id, *([(t["role"], t["text"]) for t in found if t["side"] == s] for s in (0, 1))))
            yield _batch(rows)

    return _gathered(turns, "pair_id", "side").mapInArrow(run, SCHEMA)


def swapped(own: Turns, other: Turns) -> Turns:
    """A conversation with the last answer of another in place of its own last answer (empty if the other has none)."""
    last = next((k for k in range(len(own) - 1, -1, -1) if own[k][0] == TRAINED), None)
    answer = next((text for role, text in reversed(other) if role == TRAINED), None) or ""
    return own if last is None else [*own[:last], (TRAINED, answer), *own[last + 1 :]]


def format_swapped(turns: DataFrame) -> DataFrame:
    """Every conversation against itself with a wrong last answer, that of its neighbour (ids 2k and 2k + 1 are neighbours).

    For tables that name no preferences.  ``pair_id`` is the conversation's id.  A conversation without an answer has only a prompt.
    """
    both = turns.where("conv_id is not null").select(F.shiftright("conv_id", 1).alias("k"), "conv_id", "turn", "role", "text")

    def run(batches):
        for batch in batches:
            rows = []
            for found in batch.column("turns").to_pylist():
                own: dict[int, Turns] = {}
                for t in found:
                    own.setdefault(t["conv_id"], []).append((t["role"], t["text"]))
                rows += [pair_row(i, x, swapped(x, own.get(i ^ 1, []))) for i, x in own.items()]
            yield _batch(rows)

    return _gathered(both, "k", "conv_id").mapInArrow(run, SCHEMA)


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Conversations (``conv_id, turn, role, text``) and ``pair_id, chosen_id, rejected_id`` to a row of each pair.

    A conversation may be in many pairs.  Turns without a ``conv_id`` belong to none.
    """
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("conv_id")))).alias("s")).select("pair_id", "s.side", "s.conv_id")
    return format_sides(turns.select("conv_id", "turn", "role", "text").join(sides, "conv_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every conversation, chosen, against itself with its neighbour's last answer, rejected."""
    return format_swapped(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role, text FROM conversations
), last AS (
  SELECT conv_id, max(i) AS i FROM o WHERE role = 'assistant' GROUP BY conv_id
), answer AS (
  SELECT o.conv_id, o.i, coalesce(o.text, '') AS text FROM o JOIN last ON o.conv_id = last.conv_id AND o.i = last.i
), t AS (
  SELECT conv_id AS pair_id, 0 AS side, i, role, text FROM o
  UNION ALL
  SELECT o.conv_id, 1, o.i, role, CASE WHEN a.conv_id IS NULL THEN o.text ELSE coalesce(b.text, '') END FROM o LEFT JOIN answer a ON o.conv_id = a.conv_id AND o.i = a.i LEFT JOIN answer b ON xor(o.conv_id, 1) = b.conv_id
), c AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(min(coalesce(a.i, b.i)) FILTER (WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text OR a.i IS NULL OR b.i IS NULL), count(*)) AS n_common
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i GROUP BY 1
), r AS (
  SELECT t.*, n_common, '<|im_start|>' || regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') || chr(10) AS head, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' AS body
  FROM t JOIN c USING (pair_id)
), p AS (
  SELECT *, length(head) + coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY pair_id, side, i >= n_common ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM r
)
SELECT pair_id, any_value(n_common) AS n_common, count(*) FILTER (WHERE side = 0) AS n_chosen, count(*) FILTER (WHERE side = 1) AS n_rejected,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE side = 0 AND i < n_common), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE side = 0 AND i >= n_common), '') AS chosen,
  coalesce(string_agg(s || ':' || (s + length(body)), ',' ORDER BY i) FILTER (WHERE side = 0 AND i >= n_common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE side = 1 AND i >= n_common), '') AS rejected,
  coalesce(string_agg(s || ':' || (s + length(body)), ',' ORDER BY i) FILTER (WHERE side = 1 AND i >= n_common AND role = 'assistant'), '') AS rejected_mask
FROM p GROUP BY pair_id
"""
