"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: ``<s>``, then ``[INST]`` role ``[/INST]`` text ``</s>`` for each turn. Control strings inside
roles and texts get a backslash after their first character and backslashes are doubled, so reading back is exact.
The four control strings are special tokens of the tokenizer, which never joins characters across them; the rendered text
is encoded once, with offsets. The spans of trained turns are sorted, and each token finds the span that it meets by binary search: tokens that
meet one are under the loss.

Turns come sorted and stream through a task, so a conversation with very many turns needs no more memory than others: it is
rendered in segments that end with a turn, which encode as the whole does. A conversation with more than LARGE characters, of which
a ten-thousandth of all characters is the least, is cut at quantiles of its turns into chunks that are rendered and encoded by different tasks. Only
:func:`read_back` brings such a conversation's turns and trained texts together again, as a digest of the whole has to be taken in order; they stream through a task.

Defined cases: null texts and roles are empty. Turns are ordered by turn, role and text, nulls first; rows that repeat a turn are turns of their own. A null
conv_id is one conversation. A conversation without trained turns has an empty mask. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

BEGIN, HEAD, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (BEGIN, HEAD, TEXT, END)
TRAINED = ("assistant",)
#: Characters after which a segment ends with its turn.
SEGMENT = 1 << 20
#: Characters of a conversation that is cut into chunks, and chunks at most.
LARGE, CHUNKS = 1 << 26, 256
#: Rendered characters that are encoded together.
TOGETHER = 1 << 22
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
FORMATTED = "conv_id long, chunk int, segment int, text string, ids binary, offsets binary, loss binary"


def escape(s: str) -> str:
    s = s.replace("\\", "\\\\")
    for c in CONTROL:
        s = s.replace(c, c[0] + "\\" + c[1:])
    return s


def unescape(s: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", s)


def render(turns: list[tuple[str, str]], first: bool = True, trained: tuple[str, ...] = TRAINED) -> tuple[str, list[tuple[int, int]]]:
    """The text of these turns and the spans of those that are trained."""
    out, spans, at = [BEGIN] if first else [], [], len(BEGIN) if first else 0
    for role, text in turns:
        head, body = HEAD + escape(role) + TEXT, escape(text)
        start = at + len(head)
        if role in trained:
            spans.append((start, start + len(body)))
        out += [head, body, END]
        at = start + len(body) + len(END)
    return "".join(out), spans


def turns_of(text: str) -> list[tuple[str, str]]:
    """Read back what was rendered."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet a span. offsets: start and end of each token; spans: sorted and apart."""
    s = np.array(spans, np.int64).reshape(-1, 2)
    s = s[s[:, 1] > s[:, 0]]
    if not len(s) or not len(offsets):
        return np.zeros(len(offsets), bool)
    k = np.searchsorted(s[:, 1], offsets[:, 0], side="right")  # the first span that ends behind the token's start
    at = np.minimum(k, len(s) - 1)
    return (k < len(s)) & (s[at, 0] < offsets[:, 1])


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.processors import ByteLevel

    t = Tokenizer.from_file(path)
    t.post_processor = ByteLevel(trim_offsets=False)
    t.add_special_tokens(list(CONTROL))
    return t


def _format(tokenizer: str, trained: tuple[str, ...]):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple] = []
        size = 0

        def encoded() -> pd.DataFrame:
            rows = []
            found = _tokenizer(tokenizer).encode_batch([w[3] for w in waiting], add_special_tokens=False)
            for (conv, chunk, segment, text, spans), e in zip(waiting, found):
                offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                rows.append((conv, chunk, segment, text, np.array(e.ids, "<u4").tobytes(), offsets.tobytes(), mask(offsets, spans).tobytes()))
            waiting.clear()
            return pd.DataFrame(rows, columns=[c.split()[0] for c in FORMATTED.split(", ")])

        part, turns, segment, chars = None, [], 0, 0
        for f in frames:
            for id_, chunk, role, text in zip(f["conv_id"].tolist(), f["chunk"].tolist(), f["role"], f["text"]):
                if part is not None and ((id_, chunk) != part or chars > SEGMENT):
                    waiting.append((*part, segment, *render(turns, part[1] == segment == 0, trained)))
                    size += chars
                    turns, segment, chars = [], segment + 1 if (id_, chunk) == part else 0, 0
                    if size > TOGETHER:
                        yield encoded()
                        size = 0
                part = id_, chunk
                turns.append((role or "", text or ""))
                chars += len(role or "") + len(text or "") + 20
        if part is not None:
            waiting.append((*part, segment, *render(turns, part[1] == segment == 0, trained)))
        if waiting:
            yield encoded()

    return task


def format_conversations(conversations: DataFrame, tokenizer: str, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Rows of FORMATTED and whether the conversation was cut: rendered text, little-endian token ids (uint32), offsets (int32 start and end, in characters) and loss mask (a byte for each token).

    Segments of a chunk follow one another within a partition. tokenizer: path of its file, on every executor.
    """
    spark = conversations.sparkSession
    rows = conversations.select(common.sealed("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    sizes = common.cut(rows.groupBy("conv_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 20).alias("chars"), F.count("*").alias("n")))
    total = sizes.agg(F.sum("chars")).first()[0] or 0
    large = sizes.where((F.col("chars") > max(LARGE, total // 10_000)) & (F.col("n") > 1))  # 10,000 at most
    formatted = lambda x, *parts: x.repartition(common.partitions(spark), *parts).sortWithinPartitions("conv_id", "chunk", "turn", "role", "text").select("conv_id", "chunk", "role", "text").mapInPandas(_format(tokenizer, trained), FORMATTED)
    if large.isEmpty():
        out = formatted(rows.withColumn("chunk", F.lit(0)), "conv_id").withColumn("cut", F.lit(False))
    else:
        of = F.broadcast(large.select("conv_id"))
        ends = rows.join(of, "conv_id").groupBy("conv_id").agg(F.percentile_approx("turn", [k / CHUNKS for k in range(1, CHUNKS)], 100 * CHUNKS).alias("ends"))
        chunk = F.size(F.filter(F.array_distinct(F.coalesce("ends", F.array())), lambda x: x < F.col("turn")))
        hot = rows.join(F.broadcast(common.cut(ends)), "conv_id").withColumn("chunk", F.coalesce(chunk, F.lit(0))).drop("ends")
        cold = rows.join(of, "conv_id", "left_anti").withColumn("chunk", F.lit(0))
        out = formatted(cold, "conv_id").withColumn("cut", F.lit(False)).unionByName(formatted(hot, "conv_id", "chunk").withColumn("cut", F.lit(True)))
    return out.withColumn("conv_id", common.opened("conv_id"))


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DECODED = "conv_id long, chunk int, segment int, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long"


def trained_text(text: str, offsets: np.ndarray, loss: np.ndarray) -> list[str]:
    """What is under the mask: a string for each run of tokens."""
    edges = np.flatnonzero(np.diff(np.r_[False, loss, False].astype(np.int8)))
    return [unescape(text[offsets[a, 0] : offsets[b - 1, 1]]) for a, b in zip(edges[::2], edges[1::2])]


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a digest needs of each segment: turns and trained texts, read back from the text, the offsets and the mask."""
    for f in frames:
        rows = []
        for conv, chunk, segment, text, offsets, loss in zip(f["conv_id"], f["chunk"], f["segment"], f["text"], f["offsets"], f["loss"]):
            turns = turns_of(text)
            said = "".join(trained_text(text, np.frombuffer(offsets, np.int32).reshape(-1, 2), np.frombuffer(loss, bool)))
            rows.append((conv, chunk, segment, len(turns), "".join(f"{role}\n{t}\n" for role, t in turns).encode(), len(said), said.encode(), len(text)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _DECODED.split(", ")])


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state = None

    def row() -> tuple:
        conv, n, turns, chars, loss, formatted = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _DIGESTS.split(", ")])

    for f in frames:
        done = []
        for conv, chunk, segment, n, turns, chars, loss, formatted in zip(*(f[c] for c in f)):
            if chunk == segment == 0:
                if state:
                    done.append(row())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += n
            state[2].update(turns)
            state[3] += chars
            state[4].update(loss)
            state[5] += formatted
        yield frame(done)
    if state:
        yield frame([row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, from the formatted rows alone: counts and digests of the turns and of what is under the mask."""
    rows = formatted.withColumn("conv_id", common.sealed("conv_id"))
    whole = rows.where(~F.col("cut")).drop("cut").mapInPandas(lambda frames: _digests(_decoded(frames)), _DIGESTS)
    parts = rows.where("cut").drop("cut").mapInPandas(_decoded, _DECODED)
    parts = parts.repartition(common.partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "chunk", "segment").mapInPandas(_digests, _DIGESTS)
    return common.cut(whole.union(parts)).withColumn("conv_id", common.opened("conv_id"))


_ESCAPED = r"replace(replace(replace(replace(replace({0}, '\', '\\'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>')"
ORACLE = rf"""
with c as (
  select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(17 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) as bigint) as formatted_chars
from t group by conv_id
"""
