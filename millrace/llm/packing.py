"""Cost-balanced packing of documents into sequences.

A document's tokens are its ids and an end token. Whole multiples of the sequence length fill sequences of their own; what is
left of each document is packed in blocks of a bounded number of documents: the number of sequences is what the block's
tokens need, a piece costs length + length**2 / scale (a linear part and attention within the piece), and documents go, in
descending order of cost, to the sequence of lowest cost with remaining capacity. A document that fits nowhere whole is
cut over the sequences with most room. A block's last, partly filled sequence goes on to the next block of its task; at the
end of a task it is cut into sequences whose lengths are powers of two, which need no padding.

No shuffle: a task packs the documents that it reads, in blocks, so memory is bounded and any number of tasks work alike.
Sequence ids hold the partition's number in the upper bits. The pieces are checkpointed, so a task that runs again later, perhaps over
rows in another order, doesn't make other sequences.

Defined cases: a null or empty text is its end token only. A null id packs like any other. Repeated rows are packed each on its
own. A very long text is cut like any other. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm import common

LENGTH = 2048
END = 1
BLOCK = 4096
#: Tokens at which attention costs as much as the linear part.
SCALE = 1024
#: Distinct words that a Python worker remembers before it starts afresh (about 200 bytes each).
KNOWN = 500_000
#: Marks that form one pre-token behind letters.
_TAIL = b".,;:!?%$#&*"
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Words:
    """Ids of texts by a tokenizer whose pre-tokenizer never joins what ASCII white space parts.

    Ids of a text are then those of its words one after another, and each distinct word is encoded once. Words run through the
    tokenizer's own normalizer, pre-tokenizer and model; those that hold a special token's text through all of it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.t.get_added_tokens_decoder().values()]
        self.whole: dict[bytes, bytes] = {}
        self.plain = self._plain()

    def _plain(self) -> bool:
        """Whether this tokenizer lower-cases letters and parts them from marks behind them; if it doesn't, whole words are encoded."""
        t = self.t
        if t.normalizer is None or t.pre_tokenizer is None:
            return False
        split = [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str("Ab" + _TAIL.decode()))]
        return split == ["ab", _TAIL.decode()]

    def _encode(self, word: bytes) -> bytes:
        if any(s in word for s in self.special):
            ids = self.t.encode(word.decode(), add_special_tokens=False).ids
        else:
            text = self.t.normalizer.normalize_str(word.decode()) if self.t.normalizer else word.decode()
            pieces = [p for p, _ in self.t.pre_tokenizer.pre_tokenize_str(text)] if self.t.pre_tokenizer else [text]
            ids = [t.id for p in pieces for t in self.t.model.tokenize(p)]
        return array("I", ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        low = word.lower()
        core = low.rstrip(_TAIL)
        if not (self.plain and core.isalpha() and core.isascii()):
            return self._encode(word)
        if (b := self.whole.get(core)) is None:  # letters are one pre-token, marks behind them another
            b = self.whole[core] = array("I", [t.id for t in self.t.model.tokenize(core.decode())]).tobytes()
        if len(core) == len(low):
            return b
        tail = low[len(core) :]
        if (t := self.whole.get(tail)) is None:
            t = self.whole[tail] = self._encode(tail)
        return b + t

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.encode().split()
        if len(self.whole) > KNOWN:
            self.whole = {}
        for w in set(words).difference(self.whole):
            self.whole[w] = self._word(w)
        return b"".join(map(self.whole.__getitem__, words))


@lru_cache(1)
def _words(path: str) -> Words:
    return Words(path)


def cost(length, scale: int = SCALE):
    return length + length * length / scale


def assign(lengths: np.ndarray, room: np.ndarray, scale: int = SCALE) -> list[tuple[int, int, int, int]]:
    """(piece, start in the piece, length, sequence): descending pieces to the cheapest sequence with room for them, else cut.

    The sequences must have room for all pieces together; room is used up in place.
    """
    spent = np.zeros(len(room))
    placed = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, at = int(lengths[i]), 0
        while n:
            open_ = np.where(room >= n, spent, np.inf)
            k = int(open_.argmin())
            if open_[k] == np.inf:
                k = int(room.argmax())
            part = min(n, int(room[k]))
            placed.append((i, at, part, k))
            room[k] -= part
            spent[k] += cost(part, scale)
            at, n = at + part, n - part
    return placed


def powers(n: int) -> list[int]:
    """Powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Packer:
    def __init__(self, length: int, first: int, scale: int):
        self.length, self.next, self.scale, self.rows = length, first, scale, []

    def _put(self, doc, start: int, n: int, sequence: int, offset: int) -> None:
        id_, ids = doc
        self.rows.append((id_, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, sequence, offset))

    def block(self, docs: list[tuple[object, bytes]], carried: list[tuple[tuple, int, int]], last: bool) -> list:
        """Pack whole documents and carried pieces; returns the pieces of the sequence that isn't full."""
        pieces = list(carried)
        for doc in docs:
            n = len(doc[1]) // 4
            for start in range(0, n - self.length + 1, self.length):
                self._put(doc, start, self.length, self.next, 0)
                self.next += 1
            if n % self.length:
                pieces.append((doc, n - n % self.length, n % self.length))
        total = sum(p[2] for p in pieces)
        room = [self.length] * (total // self.length) + (powers(total % self.length) if last else [total % self.length] * (total % self.length > 0))
        placed = assign(np.array([p[2] for p in pieces], np.int64), np.array(room, np.int64), self.scale)
        left = []
        fill = [0] * len(room)
        for i, at, n, k in placed:
            doc, start, _ = pieces[i]
            if not last and k == len(room) - 1 and room[k] < self.length:
                left.append((doc, start + at, n))
                continue
            self._put(doc, start + at, n, self.next + k, fill[k])
            fill[k] += n
        self.next += len(room)
        return left

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. tokenizer: path of its file, on every executor."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = _words(tokenizer), np.array([END], "<u4").tobytes()
        packer = _Packer(length, TaskContext.get().partitionId() << 36, scale)
        waiting: list[tuple[object, bytes]] = []
        carried: list = []
        size = 0
        for frame in frames:
            for id_, text in zip(frame["id"], frame["text"]):
                ids = words.ids(text or "") + end
                waiting.append((id_, ids))
                size += len(ids)
                if len(waiting) >= block or size > 1 << 26:
                    carried = packer.block(waiting, carried, False)
                    waiting, size = [], 0
                    yield packer.take()
        packer.block(waiting, carried, True)
        yield packer.take()
        words.whole = {}

    rows = common.cut(common.texts(docs, id_col, text_col).mapInPandas(common.tidied(task), OUT))
    return rows.withColumn("doc_id", common.opened("doc_id"))
