"""Chat formatting with a grammar round trip.

Turns are rendered under a template, the rendered text is parsed again by a deterministic parser, and what it
recovers is compared with the source. Only where they differ is the content escaped, step by
step, until they are identical. A turn's frame begins and ends where the parser is between turns, so a conversation is
the concatenation of its frames, and frames can be checked one by one.

Grammar::

    conversation := turn*
    turn := "[INST] " text " [/INST]"               user
          | text "</s>"                             assistant
          | "<<ROLE>>" role "<</ROLE>>" text "</s>" any other role

In a text or role, a backslash stands before a character that is meant as it is. Escaping doubles
backslashes and puts one behind the first character of each control string, so that none is left whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from routeloom.llm.common import small_arrow_batches

_USER, _USER_END = "[INST] ", " [/INST]"
_ROLE, _ROLE_END, _END = "<<ROLE>>", "<</ROLE>>", "</s>"
_CONTROL = re.compile(r"\\|\[/?INST\]|</?s>|<</?ROLE>>")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class Parser:
    """Reads rendered text, in pieces of any size; ``feed`` gives the turns that are complete, as
    ``(role, text, start, end)``, where start and end bound the text as rendered, from the beginning."""

    def __init__(self) -> None:
        self.rest, self.at = "", 0

    def feed(self, piece: str) -> list[tuple[str, str, int, int]]:
        buf, pos, turns = self.rest + piece, 0, []
        while turn := self._turn(buf, pos):
            role, start, end, after = turn
            turns.append((unescape(role), unescape(buf[start:end]), self.at + start, self.at + end))
            pos = after
        self.rest, self.at = buf[pos:], self.at + pos
        return turns

    @staticmethod
    def _turn(buf: str, pos: int):
        left = buf[pos : pos + len(_ROLE)]
        if not left or (len(left) < len(_ROLE) and left != _USER and (_USER.startswith(left) or _ROLE.startswith(left))):
            return None
        if left.startswith(_USER):
            role, start, mark = "user", pos + len(_USER), _USER_END
        elif left == _ROLE:
            stop = buf.find(_ROLE_END, pos)
            if stop < 0:
                return None
            role, start, mark = buf[pos + len(_ROLE) : stop], stop + len(_ROLE_END), _END
        else:
            role, start, mark = "assistant", pos, _END
        end = buf.find(mark, start)
        return None if end < 0 else (role, start, end, end + len(mark))


def _frame(role: str, text: str) -> str:
    if role == "user":
        return f"{_USER}{text}{_USER_END}"
    return f"{text}{_END}" if role == "assistant" else f"{_ROLE}{role}{_ROLE_END}{text}{_END}"


def render_turn(role: str, text: str) -> str:
    """The frame of a turn, escaped no further than the round trip needs."""
    for shown in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        if shown[0] in ("user", "assistant") and role != shown[0]:
            continue
        frame, parser = _frame(*shown), Parser()
        turns = parser.feed(frame)
        if not parser.rest and [t[:2] for t in turns] == [(role, text)]:
            return frame
    raise AssertionError("an escaped turn is always read back as it was")


def _ordered(turns: DataFrame) -> DataFrame:
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, frame`` per row of ``turns`` (conv_id, turn, role, text), each conversation's rows
    together and in order of turn, then role, then text. The formatted conversation is its frames, one behind the other.

    A conversation is streamed, never gathered: it may be longer than memory. Null roles and texts
    are empty; rows without conv_id make one conversation; null turns come first; repeated rows are kept; other columns are ignored.
    """
    small_arrow_batches(turns.sparkSession)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render_turn(r.as_py(), t.as_py()) for r, t in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["conv_id", "turn", "frame"])

    kinds = dict(turns.dtypes)
    return _ordered(turns).mapInArrow(frames, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, frame string")


def read_back(frames: DataFrame) -> DataFrame:
    """What the parser recovers from formatted conversations: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``. The loss mask covers what assistants say. ``frames``: as :func:`format_turns` gives them."""
    conv_type = dict(frames.dtypes)["conv_id"]
    kinds = [to_arrow_type(frames.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parser, n, turns, loss_n, loss, size = None, None, 0, None, 0, None, 0
        for batch in batches:
            done = []
            for conv, frame in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if parser is None or conv != now:
                    if parser is not None:
                        done.append((now, n, turns.hexdigest(), loss_n, loss.hexdigest(), size))
                    now, parser, n, turns, loss_n, loss, size = conv, Parser(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                piece = frame.as_py()
                size += len(piece)
                for role, text, _, _ in parser.feed(piece):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        loss_n += len(text)
                        loss.update(text.encode())
            yield table(done)
        if parser is not None:
            yield table([(now, n, turns.hexdigest(), loss_n, loss.hexdigest(), size)])

    def table(rows) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return frames.mapInArrow(digests, f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Both turns of the conversation that is added to the query's input.
CLASH = "</s>[INST] ok [/INST]"


def query(spark, sf_dir):
    """Digests of all conversations and of conversation -1, read back from the formatted text."""
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    clash = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in ((0, "user"), (1, "assistant"))])).alias("t"),
    ).select("conv_id", "t.turn", "t.role", F.lit(CLASH).alias("text"))
    return read_back(format_turns(own.unionByName(clash)))


SQL = f"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '{CLASH}'), (-1::BIGINT, 1::BIGINT, 'assistant', '{CLASH}')),
x AS (
  SELECT *, length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, '\\[/?INST\\]|</?s>|<</?ROLE>>')) AS more,
         regexp_matches(text, '\\\\(.|\\n)') OR CASE WHEN role = 'user' THEN contains(text, ' [/INST]')
           ELSE contains(text, '</s>') OR (role = 'assistant' AND (starts_with(text, '[INST] ') OR starts_with(text, '<<ROLE>>'))) END AS clash
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + CASE WHEN clash THEN more ELSE 0 END
           + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 21 + length(role) END)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""
