"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of documents, in keyed-hash order or in a given one. A
window is one sequence. In every window a queue may spend a quantum, its target
share of LENGTH tokens; the part of a token that it can't spend carries on as
its deficit, from window to window, and a queue that has run out leaves its
share to the others by theirs. Documents are cut where a quantum ends, so every
window has its target proportions but for rounding. A queue whose quantum is
under a LEAST-th of a window saves up and spends that much at a time, so that
documents of small sources aren't cut into single tokens.

What all queues have spent by the end of a window follows from their totals
alone (``Schedule``), so any document's pieces follow from its place in its
queue, and no state goes from task to task: deficits carry on across partitions
as they do across windows. Slices of a window stand one after another; the
stream of them is cut into sequences, each full but the last.

Targets: ``shares`` by source; without them each source's own share of all
tokens, with which all queues end together and all windows can meet their
targets. The QUEUES - 1 largest sources are queues of their own, all others
share one more.

Tokens are made once, kept as 16-bit ids in the shared folder, and joined back
to the pieces by row for the check sums.

Edge cases: a null text is empty and has only its end id; a null source is a
queue like any other; rows that repeat, share an id or have none are packed
each; a document longer than its quanta is cut; an empty table gives an empty
result; extra columns of the input are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bucket_bits, running_total, written
from lodestone.operators.dictionary import ranked

END_ID = 2
LENGTH = 4096
QUEUES = 256
#: Words that came twice, as many as a task remembers of late and as many older ones; hash slots that tell a second time.
MEMO = 200_000
SLOTS = 1 << 22
#: Rows whose texts and ids a task holds as Python objects at a time.
HELD = 256
#: Letters whose lower case and normal form are settled letter by letter, then ASCII signs (no apostrophe).
_SIMPLE = re.compile("([a-z\u00e0-\u00f6\u00f8-\u00ff]+)([.,;:!?&%$#*|<>\"()+=-]*)")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell bytes by characters: printable ones of Latin-1 by themselves, the others by those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class WordIds(dict):
    """Ids of a white-space-free word as little-endian 16-bit integers.

    The tokenizer drops white space and never joins what stands on both of its
    sides, nor letters with the ASCII signs after them, so ids of a text are
    those of its parts one after another.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spelling = byte_letters()
        self.runs: dict[str, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.once = bytearray(SLOTS)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def letters(self, word: str) -> bytes:
        """Ids of a run of simple lower-case letters."""
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.spelling)
        return struct.pack("<%dH" % len(out := self.model.tokenize(spelled)), *[t.id for t in out])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.made(word)
            at = hash(word) % SLOTS
            if not self.once[at]:
                self.once[at] = 1
                return ids
        if len(self) >= MEMO:
            self.older, self.once = dict(self), bytearray(SLOTS)
            self.clear()
        self[word] = ids
        return ids

    def made(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        m = _SIMPLE.fullmatch(text.lower())
        if m is None:
            return self.whole(text)
        return self[m[1].encode()] + self.signs(m[2]) if m[2] else self.letters(m[1])

    def signs(self, run: str) -> bytes:
        if run not in self.runs:
            if len(self.runs) > 10_000:
                self.runs.clear()
            self.runs[run] = self.whole(run)
        return self.runs[run]

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text and the end id."""
        data = (text or "").encode("utf-8", "replace")
        if b"<|" in data:  # special tokens reach over white space-free words
            return self.whole(data.decode()) + b"\x02\x00"
        return b"".join(map(self.__getitem__, data.split())) + b"\x02\x00"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of this Python process."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def tokenized(docs: DataFrame, tokenizer: str | None = None, order: Column | None = None) -> DataFrame:
    """row, doc_id, source, n_tokens, ids (binary, 16-bit little-endian), place (order as text), written to the shared folder."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        for b in (whole.slice(first, HELD) for whole in batches for first in range(0, whole.num_rows, HELD)):
            ids = [known.ids(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("source"), b.column("place"), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["row", "doc_id", "source", "place", "n_tokens", "ids"])

    place = F.lit(None).cast("string") if order is None else order.cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), place.alias("place"), "text")
    return written(rows.mapInArrow(run, "row long, doc_id long, source string, place string, n_tokens long, ids binary"))


#: A queue of small quanta saves up for this part of a sequence (32 tokens of 4,096) before it spends any; windows to a block of the schedule's table.
LEAST = 128
ROWS = 2048


class Schedule:
    """What each queue has spent by the end of each window, from the queues' tokens and shares alone.

    A queue whose quantum is under ``least`` spends that many tokens at a time,
    when its deficit has grown to them; queues begin with deficits spread over
    that range, so they don't all pay in one window.
    """

    def __init__(self, tokens: list[int], shares: list[float], length: int) -> None:
        self.tokens, self.length = np.array(tokens, np.int64), length
        self.share = np.array(shares, float) / sum(shares)
        self.own_ends = self.tokens / self.share  # of the queues, in tokens of a stream in which none runs out
        self.times = np.concatenate([[0.0], np.sort(self.own_ends)])
        self.served = np.minimum(self.tokens, self.share * self.times[:, None]).sum(1)
        self.served[-1] = self.tokens.sum()
        self.least = max(1, length // LEAST)
        small = self.share * length < self.least
        self.lump = np.where(small, self.least, 1)
        self.phase = np.where(small, np.arange(len(tokens)) * 0.6180339887498949 % 1, 0.5)

    def _spent(self, queue: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What queues have spent when n tokens are served, of both arrays' common shape."""
        time = np.interp(n, self.served, self.times)
        own, lump = self.tokens[queue], self.lump[queue]
        out = np.floor(self.share[queue] * time / lump + self.phase[queue]).astype(np.int64) * lump
        return np.where((n >= self.served[-1]) | (time >= self.own_ends[queue] * (1 - 1e-12)), own, np.minimum(own, out)) * (n > 0)

    def spent(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of each queue in all windows up to each of windows: (windows, queues); none before window 0."""
        n = (windows[:, None] + 1) * self.length
        return self._spent(np.arange(len(self.tokens))[None, :], np.broadcast_to(n, (len(windows), len(self.tokens))))

    def window(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Window of the token at a place (from 0) of its queue."""
        due = np.minimum((at // self.lump[queue] + 1 - self.phase[queue]) * self.lump[queue], self.tokens[queue])
        w = np.floor(np.interp(np.maximum(due, 0) / self.share[queue], self.times, self.served) / self.length).astype(np.int64)
        w = np.minimum(w, (self.served[-1].astype(np.int64) - 1) // self.length)
        while True:
            early, late = self._spent(queue, w * self.length) > at, self._spent(queue, (w + 1) * self.length) <= at
            if not (early.any() or late.any()):
                return w
            w = w - early + late

    def _touched(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and window of every window that a document's tokens lie in; as many at most as it has lumps or quanta."""
        lump = self.lump[queue]
        first, last = self.window(queue, start), self.window(queue, start + size - 1)
        by_lump = lump > 1
        many = np.where(by_lump, (start + size - 1) // lump - start // lump + 1, last - first + 1)
        doc = np.repeat(np.arange(len(queue)), many)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        w = first[doc] + k
        some = np.flatnonzero(by_lump[doc])
        d = doc[some]
        w[some] = self.window(queue[d], np.maximum(start[d], (start[d] // lump[d] + k[some]) * lump[d]))
        keep = np.concatenate([[True], (doc[1:] != doc[:-1]) | (w[1:] != w[:-1])])[: len(doc)]
        return doc[keep], w[keep]

    def pieces(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cuts of documents (queue, first place in it, tokens): document, begin in it, length, window, place in the stream.

        Work and memory follow the documents' own tokens, whatever the stream's length; the table of all
        queues' spendings is taken ROWS windows at a time.
        """
        doc, w = self._touched(queue, start, size)
        q = queue[doc]
        named, at = np.unique(w, return_inverse=True)
        base = np.zeros(len(doc), np.int64)  # place in the stream where the queue's slice of the window begins
        order = np.argsort(at, kind="stable")
        for block in range(0, len(named), ROWS):
            mine = order[np.searchsorted(at[order], block) : np.searchsorted(at[order], block + ROWS)]
            before, after = self.spent(named[block : block + ROWS] - 1), self.spent(named[block : block + ROWS])
            slices = np.cumsum(after - before, axis=1) - (after - before)
            row = at[mine] - block
            base[mine] = before.sum(1)[row] + slices[row, q[mine]]
        before, after = self._spent(q, w * self.length), self._spent(q, (w + 1) * self.length)
        begin, end = np.maximum(start[doc], before), np.minimum(start[doc] + size[doc], after)
        place = base + begin - before
        keep = np.flatnonzero(end > begin)
        doc, w, begin, end, place = doc[keep], w[keep], begin[keep], end[keep], place[keep]
        # slices may reach over the end of a sequence
        cuts = (place + end - begin - 1) // self.length - place // self.length + 1
        i = np.repeat(np.arange(len(doc)), cuts)
        k = np.arange(len(i)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        left = np.where(k == 0, place[i], (place[i] // self.length + k) * self.length)
        right = np.minimum(place[i] + end[i] - begin[i], (left // self.length + 1) * self.length)
        return doc[i], begin[i] - start[doc[i]] + left - place[i], right - left, w[i], left


def queues(lengths: DataFrame, shares: dict[str | None, float] | None = None) -> tuple[list[tuple[str | None, int]], int]:
    """The largest sources with their tokens, QUEUES - 1 at most, and the tokens of all others; those that shares names come first."""
    per = written(lengths.groupBy("source").agg(F.sum("n_tokens").alias("t")))
    named = F.coalesce(F.col("source").isin([k for k in shares or {} if k is not None]), F.lit(None in (shares or {})))
    top = [(r["source"], r["t"]) for r in per.orderBy(named.desc(), F.desc("t"), "source").limit(QUEUES - 1).collect()]
    return sorted(top, key=lambda r: (r[0] is None, r[0] or "")), int(per.agg(F.sum("t").alias("n")).first()["n"] or 0) - sum(t for _, t in top)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long"


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, with_ids: bool = False, shares: dict[str | None, float] | None = None, order: Column | None = None, seed: int = 7) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window (whose quantum it is of) and, if asked for, ids (array<int>).

    shares: target share of each source; a source that it doesn't name gets the
    least share named. order: a column that sorts each queue's documents; a
    keyed hash where there is none.
    """
    tokens = tokenized(docs, tokenizer, order)
    lengths = tokens.select("row", "doc_id", "source", "n_tokens", "place")
    own, rest = queues(lengths, shares)
    if not own:
        return docs.sparkSession.createDataFrame([], PIECE + (", ids array<int>" if with_ids else ""))
    totals = [t for _, t in own] + ([rest] if rest else [])
    least = min(shares.values()) if shares else 0
    share = [float(t) for t in totals] if shares is None else [float(shares.get(k, least)) for k, _ in own] + ([float(least)] if rest else [])
    numbers = docs.sparkSession.createDataFrame([(k, i) for i, (k, _) in enumerate(own)], "name string, queue int")  # QUEUES rows at most
    rows = lengths.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name")), "left").drop("name").withColumn("queue", F.coalesce("queue", F.lit(len(own))))
    if order is not None:
        rows = ranked(rows, ["place", "row"], "_h")
        bucket = F.shiftright("_h", 9)
    else:
        rows = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "row"), 1))
        bucket = F.shiftrightunsigned("_h", 63 - bucket_bits(lengths.count()))
    placed = running_total(rows, ["queue"], [F.col("_h"), F.col("row")], bucket, F.col("n_tokens"), "queue_end")
    plan = Schedule(totals, share, length)
    cut = tokens.join(placed.select("row", "queue", (F.col("queue_end") - F.col("n_tokens")).alias("at")), "row").select("doc_id", "source", "n_tokens", "queue", "at", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, HELD):
                b = whole.slice(first, HELD)
                n, queue, at = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "queue", "at"))
                doc, start, size, window, place = plan.pieces(queue, at, n)
                ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), "<u2").astype("<u4")
                data = memoryview(ids.view(np.uint8))
                left = 4 * ((np.cumsum(n) - n)[doc] + start)
                crc = [zlib.crc32(data[i:j]) for i, j in zip(left.tolist(), (left + 4 * size).tolist(), strict=True)]
                picked = pa.array(doc)
                columns = [b.column("doc_id").take(picked), *(pa.array(x, pa.int64()) for x in (start, size, crc, n[doc], place // length, place % length)), b.column("source").take(picked), pa.array(window, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[i // 4 : i // 4 + k].tolist() for i, k in zip(left.tolist(), size.tolist(), strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * with_ids)

    return cut.mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))
