"""Byte-level BPE with vectorised pre-tokenisation and exact decoding.

Pre-tokenisation never runs a regular expression.  Code points are mapped to
class symbols (letter, number, space with something behind it, ...) that
already hold the one or two characters of lookahead the split needs.  What is
left is a ten-state transducer.  Its transition functions are closed under
composition, and that closure is small, so a function is one byte and
composing two is one table lookup: an inclusive scan over these bytes gives the
state before every character, hence every boundary, at once.

Slices between boundaries feed pair merging through a bounded cache: the
neighbours whose joined bytes have the lowest rank are merged first, the leftmost
of equal ones.  Short slices look the lowest pair up in a list, long ones keep
all pairs in a heap.  Byte offsets of all tokens follow from their lengths, and
decoding joins the bytes of the ids, so the round trip is exact for any text.

Defined results: a null text is encoded as an empty one (no tokens); an empty
table gives no rows; texts of any length are processed whole; repeated rows and
null ids are processed row by row; all other columns pass through ``encode``,
columns named as its two outputs are replaced; ``token_digests`` returns its own
columns only.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.textbatch import code_points, map_slices, replace_column

CACHE_ENTRIES = 300_000
CACHE_LONGEST = 64
#: Slices of more bytes are merged with a heap.
HEAP_FROM = 128
NO_RANK = 1 << 62

# The characters of Unicode property White_Space.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

# Symbols of the transducer.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BREAK, BLANK, STOP = range(9)
# States: what the character before belongs to.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, AFTER_BREAK, ONE_LEFT, TWO_LEFT, SUFFIX = range(10)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a token begins at this character."""
    if symbol == LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return SUFFIX, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if symbol == OTHER:
        return IN_OTHERS, state not in (IN_OTHERS, AFTER_SPACE)
    if symbol in (SHORT, LONG):  # an apostrophe that can begin a suffix
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
    if symbol == SPACE:
        return AFTER_SPACE, True
    if symbol == BREAK:
        return AFTER_BREAK, True
    if symbol == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return START, True


class Transducer:
    """The closure of the transition functions and its composition table."""

    def __init__(self) -> None:
        states = range(10)
        functions = [tuple(states)] + [tuple(_step(s, x)[0] for s in states) for x in range(9)]
        functions = list(dict.fromkeys(functions))
        known = {f: i for i, f in enumerate(functions)}
        grown = True
        while grown:
            grown = False
            for f in list(functions):
                for g in list(functions):
                    h = tuple(g[f[s]] for s in states)
                    if h not in known:
                        known[h] = len(functions)
                        functions.append(h)
                        grown = True
        if len(functions) > 255:
            raise ValueError("the transition functions need more than one byte")
        self.of_symbol = np.array([known[tuple(_step(s, x)[0] for s in states)] for x in range(9)], dtype=np.uint8)
        size = len(functions)
        self.size = size
        self.compose = np.zeros(size * 256, dtype=np.uint8)
        for i, f in enumerate(functions):
            for j, g in enumerate(functions):
                self.compose[i * 256 + j] = known[tuple(g[f[s]] for s in states)]
        self.apply_start = np.array([f[START] for f in functions], dtype=np.uint8)
        self.begins = np.array([[_step(s, x)[1] for x in range(9)] for s in states]).reshape(-1)

    def scan(self, functions: np.ndarray, width: int = 64) -> np.ndarray:
        """Inclusive scan under composition: blocks first, then block totals."""
        n = len(functions)
        if n <= width:
            out = functions.copy()
            for i in range(1, n):
                out[i] = self.compose[int(out[i - 1]) * 256 + int(out[i])]
            return out
        rows = -(-n // width)
        grid = np.zeros(rows * width, dtype=np.uint8)  # padded with the identity
        grid[:n] = functions
        grid = np.ascontiguousarray(grid.reshape(rows, width).T)
        for k in range(1, width):
            grid[k] = self.compose[grid[k - 1].astype(np.int32) * 256 + grid[k]]
        totals = self.scan(grid[-1], width)
        before = np.concatenate(([np.uint8(0)], totals[:-1])).astype(np.int32) * 256
        grid = self.compose[before[None, :] + grid]
        return np.ascontiguousarray(grid.T).reshape(-1)[:n]


_classes: np.ndarray | None = None
_transducer: Transducer | None = None
_SPACE_CP, _QUOTE = 0x20, 0x27


def class_table() -> np.ndarray:
    """Class of every code point: letter, number, other, space or other blank."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))[0]
            if kind == "L":
                table[cp] = LETTER
            elif kind == "N":
                table[cp] = NUMBER
        table[list(WHITE_SPACE)] = BREAK
        table[_SPACE_CP] = SPACE
        _classes = table
    return _classes


def boundaries(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of all tokens of texts joined by one separator each.

    ``flat`` and ``starts`` are as ``code_points`` returns them.
    """
    global _transducer
    if _transducer is None:
        _transducer = Transducer()
    machine = _transducer
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbol = class_table()[flat]
    stops = starts[1:] - 1
    symbol[stops] = STOP
    following = np.append(symbol[1:], np.uint8(STOP))
    blank = (symbol == SPACE) | (symbol == BREAK)
    ends = (following == SPACE) | (following == BREAK) | (following == STOP)
    symbol[blank & ends] = BLANK
    quotes = np.flatnonzero((flat == _QUOTE) & (symbol != STOP))
    if len(quotes):
        padded = np.concatenate((flat, np.zeros(2, dtype=flat.dtype)))
        marks = np.concatenate((symbol, np.full(2, STOP, dtype=np.uint8)))
        one, two = padded[quotes + 1], padded[quotes + 2]
        first, second = marks[quotes + 1] == LETTER, marks[quotes + 2] == LETTER
        short = first & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        long = first & second & np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])
        symbol[quotes[short]] = SHORT
        symbol[quotes[long]] = LONG
    scanned = machine.scan(machine.of_symbol[symbol])
    state = np.empty(n, dtype=np.uint8)
    state[0] = START
    state[1:] = machine.apply_start[scanned[:-1]]
    begins = machine.begins[state.astype(np.int16) * 9 + symbol]
    at = np.flatnonzero(begins)
    to = np.append(at[1:], n)
    inside = symbol[at] != STOP
    return at[inside], to[inside]


class ByteBpe:
    """Encoder and decoder over a rank table (bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.digits_of = [str(i) for i in range(len(self.bytes_of))]
        self.cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["ranks"])

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > HEAP_FROM:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        # scores[i] is the rank of parts i and i + 1 joined.
        scores = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (low := min(scores)) != NO_RANK:
            i = scores.index(low)
            parts[i] += parts.pop(i + 1)
            scores.pop(i)
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap; a part is named by its first byte and known by its end."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins at i
        begin = [i - 1 for i in range(n + 1)]  # of the part that ends at i

        def score(i: int) -> int:
            return ranks.get(piece[i : end[end[i]]], NO_RANK) if end[i] < n else NO_RANK

        best = [score(i) for i in range(n)]
        heap = [(r, i) for i, r in enumerate(best) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if best[i] != r:
                continue  # one of its parts has been merged since
            middle = end[i]
            end[i] = end[middle]
            best[middle] = NO_RANK
            begin[end[i]] = i
            for j in (begin[i], i) if i else (i,):
                best[j] = score(j)
                if best[j] != NO_RANK:
                    heapq.heappush(heap, (best[j], j))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        flat, starts = code_points(texts)
        begins, ends = boundaries(flat, starts)
        joined = " ".join(texts)
        pieces = [joined[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        cache = self.cache
        ids = list(map(cache.get, pieces))
        if None in ids:
            for k, piece in enumerate(pieces):
                if ids[k] is None:
                    got = cache.get(piece)
                    if got is None:
                        got = self.merge(piece.encode())
                        if len(piece) <= CACHE_LONGEST:
                            if len(cache) >= CACHE_ENTRIES:
                                cache.clear()
                            cache[piece] = got
                    ids[k] = got
        cut = np.searchsorted(begins, np.append(starts, len(flat) + 1)).tolist()
        return [list(chain.from_iterable(ids[a:b])) for a, b in zip(cut, cut[1:], strict=False)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Byte offset at which each token begins, and the end of the last."""
        return np.concatenate(([0], np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)))


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a base64 token and its id on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def encode(
    docs: DataFrame, ranks_path: str, *, text_col: str = "text", ids_col: str = "token_ids", offsets_col: str = "token_offsets"
) -> DataFrame:
    """``docs`` with token ids and the byte offsets of the tokens.

    Existing columns of these two names are replaced; name others to keep them.
    """
    docs = docs.drop(ids_col, offsets_col)
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe(load_ranks(ranks_path)))
    outputs = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(offsets_col, T.ArrayType(T.LongType()))]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = shared.value
        ids = coder.encode_batch([t or "" for t in batch.column(text_col).to_pylist()])
        batch = batch.append_column(ids_col, pa.array(ids, type=pa.list_(pa.int32())))
        places = [coder.offsets(x)[:-1] for x in ids]
        return batch.append_column(offsets_col, pa.array(places, type=pa.list_(pa.int64())))

    return docs.mapInArrow(map_slices(text_col, work), T.StructType([*docs.schema.fields, *outputs]))


def decode(tokens: DataFrame, ranks_path: str, *, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """``tokens`` with ``text_col`` set to the text that the ids stand for.

    Ids that do not form valid UTF-8 decode with replacement characters; null
    ids give a null text.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(ByteBpe(load_ranks(ranks_path)))
    fresh = text_col not in tokens.columns
    schema = T.StructType([*tokens.schema.fields, T.StructField(text_col, T.StringType())]) if fresh else tokens.schema

    def work(batches):
        for batch in batches:
            ids = batch.column(ids_col).to_pylist()
            texts = [None if x is None else shared.value.decode(x).decode("utf-8", "replace") for x in ids]
            values = pa.array(texts, type=pa.string())
            yield batch.append_column(text_col, values) if fresh else replace_column(batch, text_col, values)

    return tokens.mapInArrow(work, schema)


def token_digests(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: token count, digest of the ids and of the decoded bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe(load_ranks(ranks_path)))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = shared.value
        counts, id_digests, text_digests = [], [], []
        for ids in coder.encode_batch([t or "" for t in batch.column(text_col).to_pylist()]):
            counts.append(len(ids))
            id_digests.append(hashlib.sha256(" ".join(map(coder.digits_of.__getitem__, ids)).encode()).hexdigest())
            text_digests.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(id_col), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)],
            names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    source = docs.select(id_col, text_col)
    schema = T.StructType(
        [
            source.schema[id_col],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return source.mapInArrow(map_slices(text_col, work), schema)
