"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch's distinct words become one flat array of symbols. Each round looks up
every neighbouring pair's rank, takes the smallest rank of each word (a
segmented minimum), merges its leftmost non-overlapping occurrences at once, and
compacts the array; words without a mergeable pair leave. Merging occurrences
together equals the library's one-by-one order only if no merge can open a pair
of a better or equal rank; for pieces where it can, a round merges the leftmost
occurrence alone. Ids of words are remembered by each worker up to a bound.

The vocabulary is read from the model file. Models must be BPE with byte
fallback, an identity normaliser, a dummy prefix and no removal of white space.

Null texts are empty and encode to the end id alone. Texts of any length are
encoded whole. A null doc_id and repeated rows are carried along; an empty table
gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
CACHE_WORDS = 600_000
NO_RANK = np.iinfo(np.int64).max
#: Characters of texts that are split and encoded together.
STEP = 1_000_000
ENCODED = "doc_id long, ids array<int>, decoded string"
#: Texts on which a model must agree with the library before it is used.
PROBES = ("", " ", "  a  b ", "Hello wörld,\n\n x\t", "ﬁ １２ Å Ａ", "\u3000x\u00a0y \u200bz", "aaaa    bbbb", "\x00\x7f 😀", "don't 1234567")
_loaded: dict[str, PieceModel] = {}


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.end_id = sp.eos_id()
        normal = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes_of: list[bytes] = [b""] * n
        self.is_byte = np.zeros(n, bool)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                self.is_byte[i] = True
            elif not sp.is_control(i):
                self.bytes_of[i] = " ⁇ ".encode() if sp.is_unknown(i) else piece.replace(BLANK, " ").encode()
        self.starts_blank = np.array([sp.id_to_piece(i).startswith(BLANK) for i in range(n)])
        # Symbols: ids of pieces; then characters that only occur inside pieces; then one for all other characters.
        symbol = dict(normal)
        for piece in normal:
            for c in piece:
                symbol.setdefault(c, len(symbol) + n)
        self.other = n + len(symbol) + 1
        self.pieces = n
        singles = sorted((ord(c), s) for c, s in symbol.items() if len(c) == 1)
        self.chars = np.array([c for c, _ in singles], np.uint32)
        self.char_symbols = np.array([s for _, s in singles], np.int64)
        rank = {p: -sp.get_score(i) for p, i in normal.items()}
        pairs = []
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                if a in symbol and b in symbol:
                    pairs.append((symbol[a], symbol[b], rank[piece], i))
        left, right, ranks, merged = (np.array(x) for x in zip(*pairs, strict=True))
        self.width = self.other + 1
        order = np.argsort(left * self.width + right)
        self.keys = (left * self.width + right)[order]
        _, dense = np.unique(ranks, return_inverse=True)
        self.ranks, self.merged = dense[order].astype(np.int64), merged[order].astype(np.int64)
        of = np.full(self.width, -1, np.int64)
        of[merged] = dense
        self.alone = np.zeros(len(np.unique(ranks)), bool)  # ranks merged one occurrence at a time
        for side in (left, right):
            opens = (of[side] >= 0) & (dense <= of[side])
            self.alone[of[side][opens]] = True
        self._blanks(normal, rank)
        # A newline that no longer piece holds parts words as well.
        self.newline_parts = not any("\n" in p and len(p) > 1 for p in normal)
        if any(BLANK in p.lstrip(BLANK) for p in normal):
            raise ValueError("a piece reaches over a blank")
        self.known: dict[str, bytes] = {"": b""}
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        for text, ids in zip(PROBES, self.encode(list(PROBES)), strict=True):
            ids = np.frombuffer(ids, "<i4")
            if ids.tolist() != sp.encode(text, add_eos=True) or self.decode(ids) != sp.decode(ids.tolist()):
                raise ValueError(f"{path} isn't a BPE model without normalisation and with a blank before each text")

    def _blanks(self, normal: dict[str, int], rank: dict[str, float]) -> None:
        """Runs of blanks whose pieces all have the worst rank merge last, from the left.

        The result of a run is whole longest pieces and what the rest merges to, which
        is looked up by its length in ``blank_rest`` (-1: part of an earlier piece).
        """
        runs = {len(p): i for p, i in normal.items() if not p.strip(BLANK)}
        self.blank, self.longest, self.blank_rest = runs.get(1, -1), max(runs, default=1), None
        worst = max(rank.values())
        if self.longest == 1 or any(rank[BLANK * k] != worst for k in runs if k > 1) or any(p.startswith(BLANK * 2) and p.strip(BLANK) for p in normal):
            return

        def merged(n: int) -> list[int]:
            sizes = [1] * n
            while (i := next((i for i in range(len(sizes) - 1) if sizes[i] + sizes[i + 1] in runs), None)) is not None:
                sizes[i : i + 2] = [sizes[i] + sizes[i + 1]]
            return sizes

        if any(merged(self.longest + r) != [self.longest, *merged(r)] for r in range(self.longest + 1)):
            return
        self.blank_longest = runs[self.longest]
        self.blank_rest = np.full((self.longest, self.longest), -1, np.int64)
        for r in range(self.longest):
            at = 0
            for k in merged(r):
                self.blank_rest[r, at] = runs[k]
                at += k
        gone = np.isin(self.merged, [i for k, i in runs.items() if k > 1])
        self.keys, self.ranks, self.merged = self.keys[~gone], self.ranks[~gone], self.merged[~gone]

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        symbols = np.where(self.chars[at] == codes, self.char_symbols[at], self.other)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return symbols, np.repeat(np.arange(len(words)), sizes), codes

    def _pairs(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that start at the given places."""
        after = np.minimum(at + 1, max(len(symbol) - 1, 0))
        key = symbol[at] * self.width + symbol[after]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = (self.keys[k] == key) & (word[at] == word[after]) & (after > at)
        return np.where(fits, self.ranks[k], NO_RANK), self.merged[k]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the number of each word's ids; words are not empty."""
        symbol, word, codes = self._symbols(words)
        where = np.arange(len(symbol))  # first character of each symbol
        rank, into = self._pairs(symbol, word, where)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            over = least == NO_RANK
            if over.any():
                done.append((where[over], symbol[over]))
            best = (rank == least) & ~over
            # Every other one of touching occurrences, from the left.
            place = np.arange(len(best))
            run_start = np.maximum.accumulate(np.where(best & ~np.r_[False, best[:-1]], place, 0))
            take = best & ((place - run_start) % 2 == 0)
            single = take & self.alone[np.where(take, rank, 0)]
            if single.any():
                hit = np.flatnonzero(single)
                first = np.r_[True, word[hit][1:] != word[hit][:-1]]
                take[hit[~first]] = False
            i = np.flatnonzero(take)
            symbol[i] = into[i]
            keep = ~over
            keep[i + 1] = False
            to = np.cumsum(keep) - 1
            symbol, word, where, rank, into = (x[keep] for x in (symbol, word, where, rank, into))
            # Only pairs beside a merge have changed.
            now = to[i]
            changed = np.zeros(len(symbol), bool)
            changed[now] = changed[now[now > 0] - 1] = True
            now = np.flatnonzero(changed)
            rank[now], into[now] = self._pairs(symbol, word, now)
        where, symbol = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (where, symbol)
        order = np.argsort(where, kind="stable")
        where, symbol = where[order], symbol[order]
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))[where]
        if self.blank_rest is not None:
            symbol, owner, where = self._merge_blanks(symbol, owner, where)
        return self._fall_back(symbol, owner, codes, where, len(words))

    def _merge_blanks(self, symbol: np.ndarray, owner: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, ...]:
        blank = symbol == self.blank
        follows = np.r_[False, blank[1:] & blank[:-1] & (owner[1:] == owner[:-1])]
        if not follows.any():
            return symbol, owner, where
        place = np.arange(len(symbol))
        starts = np.flatnonzero(blank & ~follows)
        ends = np.flatnonzero(blank & ~np.r_[follows[1:], False]) + 1
        run = np.maximum(np.searchsorted(starts, place, "right") - 1, 0)
        at, size = place - starts[run], (ends - starts)[run]
        whole, rest = size - size % self.longest, size % self.longest
        in_rest = self.blank_rest[rest, np.clip(at - whole, 0, self.longest - 1)]
        in_whole = np.where(at % self.longest == 0, self.blank_longest, -1)
        symbol = np.where(blank, np.where(at < whole, in_whole, in_rest), symbol)
        keep = symbol >= 0
        return symbol[keep], owner[keep], where[keep]

    def _fall_back(self, symbol: np.ndarray, owner: np.ndarray, codes: np.ndarray, where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces (single characters) become the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(symbol >= self.pieces)
        if len(odd):
            utf8 = [chr(c).encode("utf-8", "surrogatepass") for c in codes[where[odd]]]
            size = np.ones(len(symbol), np.int64)
            size[odd] = [len(b) for b in utf8]
            first = np.cumsum(size) - size
            out = np.repeat(symbol, size)
            spots = np.repeat(first[odd], size[odd]) + np.concatenate([np.arange(len(b)) for b in utf8])
            out[spots] = self.byte_ids[np.frombuffer(b"".join(utf8), np.uint8)]
            symbol, owner = out, np.repeat(owner, size)
        return symbol.astype(np.int32), np.bincount(owner, minlength=n)

    def split(self, text: str) -> list[str]:
        """Words with their leading blanks; no piece reaches over their borders."""
        if not text:
            return []
        if self.newline_parts and text[0] != " " and "  " not in text and BLANK not in text:
            return (BLANK + text.replace(" ", f" {BLANK}").replace("\n", " \n ")).split(" ")
        parts = rf"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n" if self.newline_parts else rf"{BLANK}+[^{BLANK}]*|[^{BLANK}]+"
        return re.findall(parts, BLANK + text.replace(" ", BLANK))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end id."""
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known = {"": b""}
                new = set().union(*split) - {""}
            words = list(new)
            ids, sizes = self.merge(words)
            data, ends = ids.astype("<i4").tobytes(), (np.cumsum(sizes) * 4).tolist()
            for w, a, b in zip(words, [0, *ends], ends, strict=False):
                self.known[w] = data[a:b]
        end = np.array([self.end_id], "<i4").tobytes()
        return [b"".join(map(self.known.__getitem__, s)) + end for s in split]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(ids, np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of many id lists that lie behind one another; their bytes are taken from one table at once."""
        size = self.size[ids]
        to = np.append(0, np.cumsum(size))
        data = self.table[np.repeat(self.first[ids] - to[:-1], size) + np.arange(to[-1])].tobytes()
        filled = np.append(np.flatnonzero(size), len(ids))
        head = filled[np.searchsorted(filled, ends[:-1])]
        out = []
        for a, b, h in zip(ends[:-1].tolist(), ends[1:].tolist(), head.tolist(), strict=True):
            try:
                text = data[to[a] : to[b]].decode("utf-8")
            except UnicodeDecodeError:
                text = self._decode_bytes(ids[a:b])
            out.append(text[1:] if h < b and self.starts_blank[ids[h]] else text)
        return out

    def _decode_bytes(self, ids: np.ndarray) -> str:
        """Bytes that form no character become U+FFFD each."""
        out, run = [], bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + k]).decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    k = 1
                    out.append("�")
                i += k
            run.clear()

        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.bytes_of[i]
            else:
                flush()
                out.append(self.bytes_of[i].decode("utf-8"))
        flush()
        return "".join(out)


def model(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (with the end id) and the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts: list[str] = []
                size = 0
                while at + len(texts) < batch.num_rows and (not texts or size < STEP):
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                ids = m.encode(texts)
                flat = np.frombuffer(b"".join(ids), "<i4")
                ends = np.cumsum([0, *(len(b) // 4 for b in ids)])
                decoded = m.decode_all(flat, ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(decoded, pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)
