"""Hierarchical multi-length packing of tokenised documents into training sequences.

1. Each document becomes token ids plus an end id; windows of ``length`` ids are cut off as full
   sequences, and the rest (1 to length-1 ids) is one piece.
2. Pieces are routed to tiers by length: tier w takes pieces of more than w/2 up to w ids.
3. Only the histogram of piece lengths (at most ``length`` numbers, whatever the corpus) reaches the
   driver. There, tiers are planned from the longest down: a window opens with a piece of its tier,
   and its gap is filled by the longest pieces of the shorter tiers that fit. A short window that
   comes out exactly full stays at its own length; all others grow to ``length``.
4. A piece's place among those of equal length picks its slot in the plan.
5. Sequences of each length are dealt evenly to step groups, so that groups hold equal token counts.

Nulls: a null text is empty and gives one piece, the end id. Null ids, repeated rows and extra
columns are allowed. An empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dense_rank_within, kept_by_worker, stage

#: Texts with these separators are encoded whole: Python splits at them, the tokenizer does not.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Most bytes of words and ids that each memory of a worker holds; beyond it, the memory starts anew (only speed changes).
MEMO = 80 << 20
#: About the bytes of an entry besides its word and ids.
ENTRY = 200
SALTS = 256


#: Runs of lower-case Latin-1 letters, and what stands between them and white space.
_LATIN_RUNS = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+")
#: The printable stand-ins of bytes above 127 in byte-level vocabularies: the code point itself where
#: it is printable, else the next free one from 256 on (the 33 control bytes come first, then space).
_BARE = [*range(161, 173), *range(174, 256)]
_FREE = [b for b in range(256) if b not in range(33, 127) and b not in _BARE]
_BYTE = {b: chr(b if b in _BARE else 256 + _FREE.index(b)) for b in range(128, 256)}
_LATIN_BYTES = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(128, 256)}


class _Memo(dict):
    """word -> ids; forgets everything at ``MEMO`` bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        self.held += ENTRY + len(word) + len(ids)
        if self.held > MEMO:
            self.forget()
        self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.held = 0


class WordEncoder:
    """Ids of a text as little-endian uint32 bytes, word by word.

    The tokenizer lower-cases, drops white space and never joins across it, nor across an end of a
    run of letters unless an apostrophe is near. So the ids of a text are those of its words in
    order, and those of a word are those of its runs. Both repeat, so each is encoded once per
    worker; runs of Latin-1 letters skip normalisation and go straight to the merge model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.runs, self.latin, self.words = _Memo(self._run), _Memo(self._latin), _Memo(self.whole)

    def whole(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _run(self, run: str) -> bytes:
        if not run.isalpha():
            return self.whole(run)
        return _pack([t.id for t in self.model.tokenize(run if run.isascii() else run.translate(_LATIN_BYTES))])

    def _latin(self, word: str) -> bytes:
        if "'" in word or "<|" in word:
            return self.whole(word)
        return b"".join(map(self.runs.__getitem__, _LATIN_RUNS.findall(word)))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._text(t) for t in texts]

    def forget(self) -> None:
        for memo in (self.runs, self.latin, self.words):
            memo.forget()

    def _text(self, text: str) -> bytes:
        if any(c in text for c in _ODD):
            return self.whole(text)
        if _is_latin(text) and "<|" not in text:
            return b"".join(map(self.latin.__getitem__, text.lower().split()))
        return b"".join(map(self.words.__getitem__, text.split()))


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, WordEncoder] = {}


def _forget() -> None:
    for e in _encoders.values():
        e.forget()


kept_by_worker.append(_forget)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece of every document."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    tail = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            ids = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            rows, start, n, crc, of = [], [], [], [], []
            for i, b in enumerate(ids):
                b += tail
                total = len(b) // 4
                for s in range(0, total, length):
                    part = b[4 * s : 4 * (s + length)]
                    rows.append(i)
                    start.append(s)
                    n.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    of.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, n, crc, of)]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    # The worker keeps its memories for the next task; other operators make it forget them (``kept_by_worker``).
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


def plan(counts: dict[int, int], length: int, tiers: tuple[int, ...]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(window, how many, [(piece length, how many a window), ...]) that use every piece once.

    ``counts``: piece length -> number of pieces. The work depends on ``length`` only, since every
    pattern uses up at least one piece length or all of a window's kind.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    order = sorted(left)
    out: list[tuple[int, int, list[tuple[int, int]]]] = []

    def fill(first: int, window: int) -> tuple[list[tuple[int, int]], int]:
        pattern, gap = [(first, 1)], window - first
        while gap > 0:
            at = bisect_right(order, gap) - 1
            while at >= 0 and left[order[at]] - (order[at] == first) <= 0:
                at -= 1
            if at < 0:
                break
            k = order[at]
            used = sum(c for x, c in pattern if x == k)
            take = min(gap // k, left[k] - used)
            if take <= 0:  # all of these are in the pattern already
                smaller = [x for x in order[:at] if left[x] - sum(c for y, c in pattern if y == x) > 0]
                if not smaller:
                    break
                k = smaller[-1]
                take = min(gap // k, left[k])
            pattern.append((k, take))
            gap -= k * take
        return pattern, gap

    for window in sorted(tiers, reverse=True):
        for first in [k for k in reversed(order) if window // 2 < k <= window or window == min(tiers) and k <= window]:
            while left.get(first, 0) > 0:
                pattern, gap = fill(first, window)
                size = window
                if gap and window != length:
                    pattern, gap = fill(first, length)
                    size = length
                need: dict[int, int] = {}
                for k, c in pattern:
                    need[k] = need.get(k, 0) + c
                many = min(left[k] // c for k, c in need.items())
                out.append((size, many, list(need.items())))
                for k, c in need.items():
                    left[k] -= many * c
                if any(left[k] == 0 for k in need):
                    order = [k for k in order if left[k] > 0]
    return out


def place(p: list[tuple[int, int, list[tuple[int, int]]]], lengths: np.ndarray, ranks: np.ndarray, per_step: int) -> dict[str, np.ndarray]:
    """Sequence, offset, window and step group of pieces, given their length and their rank among equal lengths."""
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    totals: dict[int, int] = {}
    base = 0
    for window, many, items in p:
        at = 0
        for k, c in items:
            slots.setdefault(k, []).append((seen.get(k, 0), base, c, at, totals.get(window, 0)))
            seen[k] = seen.get(k, 0) + many * c
            at += k * c
        slots_window = window
        for k, _ in items:
            slots[k][-1] = (*slots[k][-1], slots_window)
        totals[window] = totals.get(window, 0) + many
        base += many
    groups = max(1, -(-sum(w * n for w, n in totals.items()) // per_step))
    out = {n: np.zeros(len(lengths), np.int64) for n in ("sequence_id", "offset", "window", "step_group")}
    for k in np.unique(lengths):
        mine = np.flatnonzero(lengths == k)
        table = np.array(slots[int(k)], dtype=np.int64)
        hit = table[np.searchsorted(table[:, 0], ranks[mine], side="right") - 1]
        inside, each = ranks[mine] - hit[:, 0], hit[:, 2]
        out["sequence_id"][mine] = hit[:, 1] + inside // each
        out["offset"][mine] = hit[:, 3] + inside % each * k
        out["window"][mine] = hit[:, 5]
        nth = hit[:, 4] + inside // each
        of = np.array([totals[w] for w in hit[:, 5]], dtype=np.int64)
        out["step_group"][mine] = nth * groups // of
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, shortest: int = 256, step_sequences: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group.

    ``length`` and ``shortest`` are powers of two; the tiers are the powers of two between them. A
    step group holds about ``step_sequences * length`` tokens.
    """
    tiers = tuple(1 << i for i in range(shortest.bit_length() - 1, length.bit_length()))
    cut = stage(pieces(docs, tokenizer, length, end_id, id_col, text_col), "pieces")
    # At most ``length`` rows.
    counts = {r[0]: r[1] for r in cut.groupBy("length").agg(F.count("*")).collect()}
    p = plan(counts, length, tiers)
    order = [F.xxhash64("doc_id", "start"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    ranked = dense_rank_within(cut, ["length"], F.xxhash64("doc_id", "start"), order, "_rank", SALTS)
    per_step = step_sequences * length

    def slot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = b.pop("_rank").to_numpy()
            yield b.assign(**place(p, b["length"].to_numpy(), rank, per_step))

    schema = ranked.drop("_rank").schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint,window:bigint,step_group:bigint"
    return ranked.mapInPandas(slot, schema)
