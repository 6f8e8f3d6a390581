"""Best-fit packing of tokenised documents into sequences of fixed capacity.

1. Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
2. The counts of pieces by length, at most ``capacity`` numbers, go to the
   driver. Best-fit decreasing runs over these counts: bins with equal room are
   ranges of sequence numbers, so a step places a whole range of pieces. The
   plan is a list of runs whose number depends on the capacity only.
3. Pieces get their rank within their length and join the plan's runs on it. A
   length that holds many of the pieces is dealt over salted groups; the counts
   of these groups (at most ``GROUPS + capacity``) give each group's first rank.

Null texts are empty; an empty text is its end token. A very long text is cut at
blanks and encoded part by part. Repeated rows are packed
as often as they occur. A null doc_id is carried along. An empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.storage import staged
from marketloom.llm.textops import Hasher, flat, lean, resident, segments, spaced, words

#: Words that a worker remembers with their ids; then it forgets them all.
CACHE_WORDS = 1_000_000
#: New words that are kept apart before they are merged with the rest.
FRESH_WORDS = 30_000
#: What parts words here.
_BLANKS = np.zeros(256, bool)
_BLANKS[[10, 32]] = True
#: Words that are encoded in one call, with a mark before each.
JOINT, MARK = 64, "\x01"
#: Texts on which splitting at blanks must agree with the tokenizer before it is used.
PROBES = ["", " ", "a b", " a\n\nb ", "Hello wörld,  x\t\ty", "\u3000x\u00a0y", "don't 12 345!", "😀 a\x01b \x01"]
#: A length with more than 1/GROUPS of all pieces is dealt over several groups.
GROUPS = 16_384
#: Bytes of texts that are split and encoded together; a longer text is taken in parts of this size.
STEP = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of texts by the tokenizers library, remembered per blank-separated word.

    Splitting at blanks and newlines first is exact for tokenizers that drop
    white space before merging, as no token then reaches over it. Words are known by
    64-bit hashes in sorted arrays, so only a new word becomes a Python string, and
    ``CACHE_WORDS`` of them take some 48 MB. A word whose length or first bytes differ
    from those of the word known by its hash is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A mark that is one token by itself lets many words share one call.
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._forget()
        ids, at = self.encode(*flat(pa.array(PROBES)))
        want = [e.ids for e in self.tokenizer.encode_batch(PROBES, add_special_tokens=False)]
        if [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] != want:
            raise ValueError(f"{path} doesn't drop white space before it merges")

    def _forget(self) -> None:
        # Most words, and those that came since they were last merged.
        self.known, self.fresh = ((np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2))
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.looks = np.zeros(0, np.uint64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words in the store, -1 where they aren't in it."""
        place = np.full(len(hashes), -1, np.int64)
        for held, places in (self.known, self.fresh):
            if len(held):
                at = np.minimum(np.searchsorted(held, hashes), len(held) - 1)
                place = np.where(held[at] == hashes, places[at], place)
        return place

    def _learn(self, hashes: np.ndarray, words: list[str], looks: np.ndarray) -> None:
        """Appends the ids of new words, of sorted hashes, to the store."""
        joint = [k for k, w in enumerate(words) if self.mark is not None and MARK not in w]
        alone = [k for k, w in enumerate(words) if self.mark is None or MARK in w]
        texts = [f" {MARK} ".join(["", *(words[k] for k in joint[i : i + JOINT])]) for i in range(0, len(joint), JOINT)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *ids])
        at = np.flatnonzero(ids == self.mark) if joint else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(ids))) - 1
        more = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([words[k] for k in alone], add_special_tokens=False)]
        place = np.empty(len(words), np.int64)
        place[joint + alone] = len(self.size) + np.arange(len(words))
        self.size = np.concatenate([self.size, size, np.array([len(m) for m in more], np.int64)])
        self.ids = np.concatenate([self.ids, np.delete(ids, at), *more])
        self.first = np.cumsum(self.size) - self.size
        self.looks = np.concatenate([self.looks, looks[joint + alone]])
        self.fresh = _merged(self.fresh, (hashes, place))
        if len(self.fresh[0]) > FRESH_WORDS:
            self.known, self.fresh = _merged(self.known, self.fresh), (hashes[:0], place[:0])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts that lie in ``data``, in one array, and the n + 1 offsets of the texts in it."""
        if len(offsets) == 2 and len(data) > STEP:
            found = [self._encode(data[a:b], np.array([0, b - a]))[0] for a, b in spaced(data, STEP, _BLANKS)]
            return np.concatenate(found), np.array([0, sum(map(len, found))])
        return self._encode(data, offsets)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, owner = words(data, offsets, _BLANKS)
        hashes, example, code = np.unique(Hasher(data).spans(start, end), return_index=True, return_inverse=True)
        looks = _looks(data, start, end)
        place = self._find(hashes)
        new = np.flatnonzero(place < 0)
        raw = data.tobytes() if len(new) else b""
        if len(new):
            if len(self.size) + len(new) > CACHE_WORDS:
                self._forget()
                new = np.arange(len(hashes))
            at = example[new]
            self._learn(hashes[new], [raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], looks[at])
            place = self._find(hashes)
        place = place[code]
        n, first = self.size[place], self.first[place]
        odd = np.flatnonzero(self.looks[place] != looks)
        own = [np.array(self.tokenizer.encode(data[start[k] : end[k]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for k in odd]
        n[odd] = [len(x) for x in own]
        first[odd] = len(self.ids) + np.cumsum(n[odd]) - n[odd]
        ids = np.concatenate([self.ids, *own]) if own else self.ids
        to = np.append(0, np.cumsum(n))
        at = np.repeat(first - to[:-1], n) + np.arange(to[-1])
        return ids[at], to[np.searchsorted(owner, np.arange(len(offsets)))]


def _looks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length and first eight bytes of each word, in one number."""
    out = (end - start).astype(np.uint64) << np.uint64(32)
    for k in range(8):
        out = out * np.uint64(0x100000001B3) ^ np.where(start + k < end, data[np.minimum(start + k, end - 1)], 0).astype(np.uint64)
    return out


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(a[0], b[0])
    return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


def _encoder(path: str) -> WordEncoder:
    return resident(f"words {path}", lambda: WordEncoder(path))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of every document's ids: doc_id, piece, start, length, ids_crc32."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in lean(batches, keep=True):
            data, offsets = flat(batch.column(1))
            for i, j in segments(offsets, STEP):
                ids, at = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                length = np.diff(at) + 1
                count = -(-length // capacity)
                doc = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                size = np.minimum(length[doc] - start, capacity)
                first = (np.cumsum(length) - length)[doc] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first_rank, n, first_sequence, offset).

    The piece of rank ``first_rank + i`` goes to sequence ``first_sequence + i``.
    """
    rooms: list[int] = []  # sorted rooms that some open bins have
    bins: dict[int, list[list[int]]] = {}  # room -> ranges [first, n]
    runs, opened = [], 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in bins:
                insort(rooms, room)
                bins[room] = []
            last = bins[room][-1] if bins[room] else None
            if last and last[0] + last[1] == first:
                last[1] += n
            else:
                bins[room].append([first, n])

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = bins[room][-1]
                take = min(n, left)
                bins[room][-1][1] -= take
                if take == n:
                    bins[room].pop()
                    if not bins[room]:
                        del bins[room]
                        rooms.pop(k)
                first += n - take
                runs.append((length, rank, take, first, capacity - room))
                add(room - length, first, take)
            else:
                # New bins take as many of this length as fit, as each one best fits the bin just opened.
                deep = min(capacity // length, left)
                take = left // deep
                for d in range(deep):
                    runs.append((length, rank + d * take, take, opened, d * length))
                add(capacity - deep * length, opened, take)
                opened += take
                take *= deep
            left, rank = left - take, rank + take
    return runs


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (length of 1 to capacity; read several times) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = max(1, -(-total // GROUPS))
    dealt = spark.createDataFrame([(n, -(-c // share)) for n, c in counts.items()], "length long, groups long")
    runs = spark.createDataFrame(plan_best_fit(counts, capacity), "length long, first_rank long, n long, first_sequence long, at long")
    salted = pieces.join(F.broadcast(dealt), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups"))
    )
    group = Window.partitionBy("length", "salt")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("size"))
    firsts = firsts.select("length", "salt", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    # At most GROUPS + capacity rows.
    ranked = salted.withColumn("place", F.row_number().over(group.orderBy("doc_id", "piece", "start", "ids_crc32")))
    ranked = ranked.join(F.broadcast(firsts), ["length", "salt"]).withColumn("rank", F.col("first") + F.col("place") - 1)
    r = runs.withColumnRenamed("length", "run_length")
    fits = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    placed = ranked.join(F.broadcast(r), fits)
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        F.col("at").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    return pack(staged(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
