"""Chat formatting with a grammar round trip.

A turn is rendered as  ### Role: body</turn>\n  . The parser is deterministic: it reads the header up to the
first unescaped colon and blank, the body up to the first unescaped </turn>, and takes a backslash off what
follows it. A text is first rendered as it is; where the reparsed turn differs from the source, its backslashes
are escaped, then its control strings too, until the turn parsed is identical. The loss mask of a turn is the
character range of its body if the role is assistant.

Rows are dealt by conv_id and sorted by turn; tasks stream over them with running digests, so a conversation
of any length needs the memory of one Arrow batch. A turn is parsed in one pass and needs a few times its own size.

Defined results: null text and null role are empty; texts of any length are formatted whole; null conv_id is a conversation of its own; equal turns are
ordered by role, then text; null turns come first; an empty table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import table

OPEN, COLON, CLOSE = "### ", ": ", "</turn>"
#: Fixed values of the contract: the conversation added to the table.
ADDED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
_CONTROL = re.compile(r"### |: |</turn>")
_STOPS = {end: re.compile(rf"\\.|{re.escape(end)}", re.S) for end in (COLON, CLOSE)}


def _hard(s: str) -> str:
    s = s.replace("\\", "\\\\")
    for control in (OPEN, COLON, CLOSE):
        s = s.replace(control, "\\" + control)
    return s


_STEPS = (lambda s: s, lambda s: s.replace("\\", "\\\\"), _hard)


def unescape(s: str) -> str:
    """s without the backslash before each escaped character; a backslash pair is one."""
    return "\\".join(part.replace("\\", "") for part in s.split("\\\\")) if "\\" in s else s


def _until(text: str, at: int, end: str) -> int:
    """Where the first unescaped `end` from a place on begins, or -1. One pass, one match at a time."""
    if text.find("\\", at) < 0:
        return text.find(end, at)
    return next((m.start() for m in _STOPS[end].finditer(text, at) if m[0] == end), -1)


def parse_turn(text: str, at: int = 0) -> tuple[str, str, tuple[int, int], int] | None:
    """Role, text, range of the body and end of the turn that starts at a place of the rendered text; None if none does."""
    colon = _until(text, at + len(OPEN), COLON) if text.startswith(OPEN, at) else -1
    body = colon + len(COLON)
    close = _until(text, body, CLOSE) if colon >= 0 else -1
    if close < 0 or not text.startswith("\n", close + len(CLOSE)):
        return None
    return unescape(text[at + len(OPEN) : colon]), unescape(text[body:close]), (body, close), close + len(CLOSE) + 1


def render_turn(role: str, text: str) -> str:
    """The least escaped form that parses back to the same turn and nothing else."""
    for step in _STEPS:
        out = f"{OPEN}{step(role)}{COLON}{step(text)}{CLOSE}\n"
        got = parse_turn(out)
        if got and got[:2] == (role, text) and got[3] == len(out) and (step is _STEPS[-1] or not _CONTROL.search(role + text)):
            return out
    raise ValueError("a turn can't be rendered reversibly")


def parse(text: str) -> list[tuple[str, str, tuple[int, int]]]:
    """All turns of a rendered conversation: role, text, range of the body."""
    at, turns = 0, []
    while at < len(text):
        got = parse_turn(text, at)
        if not got:
            raise ValueError(f"no turn at {at}")
        turns.append(got[:3])
        at = got[3]
    return turns


def _sorted_rows(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn, in order: conv_id, turn_no, start (in the conversation's text), formatted, mask_start, mask_end (null unless assistant)."""

    def run(batches):
        conv, no, start = object(), 0, 0
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if c != conv:
                    conv, no, start = c, 0, 0
                made = render_turn(role, text)
                a, b = parse_turn(made)[2] if role == "assistant" else (None, None)
                out.append((c, no, start, made, a if a is None else start + a, b if b is None else start + b))
                no, start = no + 1, start + len(made)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["conv_id", "turn_no", "start", "formatted", "mask_start", "mask_end"])

    return _sorted_rows(conversations).mapInArrow(run, "conv_id long, turn_no long, start long, formatted string, mask_start long, mask_end long")


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, from the rendered text alone: what the parser reads back, and what the mask holds."""

    def run(batches):
        conv, none = object(), object()
        first, n = True, 0
        turns_sha = loss_sha = None
        loss = chars = 0

        def row():
            return (conv, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars)

        for batch in batches:
            out = []
            for c, start, made, a, b in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "start", "formatted", "mask_start", "mask_end")), strict=True):
                if first or c != conv:
                    if not first:
                        out.append(row())
                    first, conv, n, loss, chars = False, c, 0, 0, 0
                    turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                for role, text, _ in parse(made):
                    turns_sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                if a is not None:
                    part = unescape(made[a - start : b - start])
                    loss_sha.update(part.encode("utf-8", "surrogatepass"))
                    loss += len(part)
                chars += len(made)
            yield _batch(out)
        if not first:
            yield _batch([row()])

    def _batch(out):
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(rows.columns, r, strict=True)]) for r in ADDED])))
    return digests(formatted_turns(rows.unionByName(added)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(### |: |</turn>)', '\\\1', 'g') AS hard, replace(text, '\', '\\') AS soft FROM c),
f AS (SELECT *, length('### ' || role || ': ' || CASE WHEN regexp_matches(text, '### |: |</turn>') THEN hard ELSE soft END || '</turn>' || chr(10)) AS n FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
