"""SentencePiece encoding and decoding by suffix-array matching (BPE models with byte fallback).

A slice of texts is cut into units, each a run of blanks and the run of other characters after it (no
piece of the models meant here goes from other characters back to blanks; otherwise a text is one
unit). The distinct units not met before are joined to one byte string, which is indexed: all its
positions are sorted by what follows, by doubling ranks. Every piece of the vocabulary is
binary-searched in the index and gives a range of occurrences; each occurrence is an edge from its
start to its end. The edges are sorted by end position and relaxed: an edge is taken if its piece may
follow the piece that ends where the edge starts. Two pieces may stand side by side if the merges of
their joined text would leave them as they are; with that rule exactly one edge into a position is
taken, and the pieces on the way back from the end are what the merges by rank give (tested against
the public library). Characters that no piece holds are edges of their own, emitted as byte pieces.

Memory is bounded by the slice (ENCODE_BYTES of text, LEARN_BYTES of new units) and by the units kept from earlier slices of the
task (MOST_UNITS, then the store starts anew). The vocabulary's tables are built on the driver from a
model file, a parameter, and travel with the task (2 MB).

Null and empty texts have no pieces. The blank mark U+2581 in a text counts as a blank, as the library
has it, so such a text decodes with blanks; every other text decodes to itself. Other columns stay; old
columns with the names of new ones are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, table, with_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MOST_UNITS = 250_000
ENCODE_BYTES = 1 << 21  # text encoded together
LEARN_BYTES = 1 << 19  # new units indexed together
LONG_UNIT = 400  # bytes; units beyond are relaxed one by one
END = 0xFF  # a byte that UTF-8 does not have
START, NONE = -2, -1
SLOTS = 1 << 18


class Vocabulary:
    """Tables of a BPE model. A rank orders pieces: single characters first, then merges by score."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)}
        text = {i: model.id_to_piece(i) for i in range(size) if i not in special}
        if model.encode(" a  b") == model.encode("a b"):
            raise ValueError("the model removes blanks; this encoder keeps them")
        self.bytes_of = {i: t.replace(MARK, " ").encode() for i, t in text.items()}
        for value in range(256):
            self.bytes_of[model.piece_to_id(f"<0x{value:02X}>")] = bytes([value])
        self.byte_id = np.array([model.piece_to_id(f"<0x{value:02X}>") for value in range(256)], np.int32)
        self.cuts = all(MARK not in t.lstrip(MARK) for t in text.values())
        order = sorted(text, key=lambda i: (len(text[i]) > 1, -model.get_score(i)))
        self.id_of = np.array(order, np.int32)  # by rank
        self.names = [self.bytes_of[i] for i in order]
        rank = {text[i]: r for r, i in enumerate(order)}
        # pairs of pieces that merge, and the last merge inside every piece
        pairs = {}
        for t, r in rank.items():
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = r
        self.unknown = len(order)  # the rank of a character that no piece is
        self.left, self.right = np.arange(self.unknown + 1), np.arange(self.unknown + 1)
        whole = np.ones(self.unknown, bool)
        for t, r in rank.items():
            if len(t) > 1:
                last = last_merge([rank.get(c, self.unknown) for c in t], pairs)
                whole[r] = last is not None
                if last is not None:
                    self.left[r], self.right[r] = last
        keys = np.array([a * (self.unknown + 1) + b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[by], np.array(list(pairs.values()), np.int64)[by]
        # pieces that merges can reach, as rows for the search; rows end in 00 or FF to bound a range
        self.usable = np.flatnonzero(whole)
        self.length = np.array([len(n) for n in self.names] + [0], np.int64)
        self.width = -(-int(self.length.max()) // 8) * 8
        self.low = np.array([self.names[r].ljust(self.width, b"\0") for r in self.usable], f"S{self.width}")
        self.high = np.array([self.names[r].ljust(self.width, b"\xff") for r in self.usable], f"S{self.width}")
        whole8 = lambda fill: np.array([int.from_bytes(self.names[r][:8].ljust(8, fill), "big") for r in self.usable], np.uint64)
        self.low8, self.high8 = whole8(b"\0"), whole8(b"\xff")
        self.longer = np.flatnonzero(self.length[self.usable] > 8)
        del self.names

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merges leave piece a before piece b as they are.

        The later of the two merges is undone again and again; if what then touches would merge
        earlier than the merge undone, the pair does not survive.
        """
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a < self.unknown) & (b < self.unknown))
        a, b = a[live].copy(), b[live].copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            key = a * (self.unknown + 1) + b
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            merged = np.where(self.pair_key[at] == key, self.pair_rank[at], np.iinfo(np.int64).max)
            broken = merged < limit
            ok[live[broken]] = False
            # undo the later merge: of a (then its right part touches b) or of b; a tie is b's, as the left is merged first
            inner_a, inner_b = self.right[a], self.left[b]
            can_a, can_b = inner_a != a, inner_b != b
            undo_a = can_a & (~can_b | (a > b))
            undo_b = can_b & ~undo_a
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, inner_a, a), np.where(undo_b, inner_b, b)
            stay = ~broken & (undo_a | undo_b)
            live, a, b, limit = live[stay], a[stay], b[stay], limit[stay]
        return ok


def last_merge(symbols: list[int], pairs: dict) -> tuple[int, int] | None:
    """The two pieces of the last merge, if merges by rank make the symbols one piece."""
    last = None
    while len(symbols) > 1:
        best = min(((pairs.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))))
        if best[0] == 1 << 60:
            return None
        i = best[1]
        last = symbols[i], symbols[i + 1]
        symbols[i:i + 2] = [best[0]]
    return last


def suffix_order(body: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the next ``width`` bytes (up to an END), and their first 8 bytes as sorted numbers.

    body is padded by width + 1. A position's rank is the slot of the first one that looks alike so
    far; only positions that still share a rank are sorted again, by the rank 8, 16, ... bytes on.
    """
    n = len(body) - width - 1
    words = np.lib.stride_tricks.as_strided(body, (n, 8), (1, 1))
    head = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(head)
    head = head[order]
    ended = np.zeros(n + width, bool)  # an END among the next 8 bytes: what follows doesn't count
    stops = np.flatnonzero(body[:n + 8] == END)
    for k in range(8):
        ended[np.maximum(stops - k, 0)] = True
    new = np.concatenate([[True], head[1:] != head[:-1]])
    rank = np.full(n + width, n, np.int64)  # past the body there are ENDs only
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    span = 8
    while span < width:
        shared = ~new
        shared[:-1] |= ~new[1:]
        slots = np.flatnonzero(shared)
        slots = slots[~ended[order[slots]]]
        if not len(slots):
            break
        at = order[slots]
        key = rank[at] * (n + width) + rank[at + span]
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[slots] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[slots] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        ended[:n] |= ended[span:span + n]
        span *= 2
    return order, head


class Encoder:
    """Encodes slices of texts in one task; remembers units."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pattern = re.compile(r" *[^ ]+| +" if vocabulary.cuts else r"[\s\S]+")
        self.pair_slot, self.pair_ok = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.forget()

    def forget(self) -> None:
        self.unit: dict[str, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """side_by_side through a table of pairs met before."""
        key = a.astype(np.int64) * (self.v.unknown + 1) + b
        slot = (key * 0x9E3779B1 >> 7) % SLOTS
        new = np.flatnonzero(self.pair_slot[slot] != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            ok = self.v.side_by_side(asked // (self.v.unknown + 1), asked % (self.v.unknown + 1))
            out = self.pair_ok[slot]
            out[new] = ok[back]
            self.pair_slot[slot[new]], self.pair_ok[slot[new]] = key[new], ok[back]
            return out
        return self.pair_ok[slot]

    def learn(self, units: list[str]) -> None:
        """Pieces of units not met before."""
        v = self.v
        raw = [u.encode() for u in units]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        joined = bytes([END]).join(raw) + bytes([END]) * (v.width + 2)
        body = np.frombuffer(joined, np.uint8)
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        n = len(body) - v.width - 1
        order, head = suffix_order(body, v.width)
        low, high = np.searchsorted(head, v.low8), np.searchsorted(head, v.high8, "right")
        # longer pieces: binary search goes on by all their bytes, within the slots that share the first 8
        some = v.longer[high[v.longer] > low[v.longer]]
        if len(some):
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, low[some], 1)
            np.add.at(cover, high[some], -1)
            slots = np.flatnonzero(np.cumsum(cover)[:n])
            rows = np.lib.stride_tricks.as_strided(body, (n, v.width), (1, 1))[order[slots]].view(f"S{v.width}").ravel()
            first, stop = np.searchsorted(rows, v.low[some]), np.searchsorted(rows, v.high[some], "right")
            low[some] = slots[np.minimum(first, len(slots) - 1)]
            high[some] = low[some] + (stop - first)
        high[v.longer[~np.isin(v.longer, some)]] = 0
        many = np.maximum(high - low, 0)
        found = np.flatnonzero(many)
        many = many[found]
        at = np.repeat(low[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        # positions and pieces in 4 bytes: there are several edges to each byte
        edge_from = order[at].astype(np.int32)
        edge_piece = np.repeat(v.usable[found], many).astype(np.int32)
        del at, order, head
        edge_size = v.length[edge_piece].astype(np.int32)
        # characters that are no piece
        bare = ((body[:n] & 0xC0) != 0x80) & (body[:n] != END)
        width = np.where(body[:n] < 0x80, 1, np.where(body[:n] < 0xE0, 2, np.where(body[:n] < 0xF0, 3, 4)))
        one = edge_size == width[edge_from]
        bare[edge_from[one]] = False
        bare = np.flatnonzero(bare)
        edge_from = np.concatenate([edge_from, bare.astype(np.int32)])
        edge_piece = np.concatenate([edge_piece, np.full(len(bare), v.unknown, np.int32)])
        edge_size = np.concatenate([edge_size, width[bare].astype(np.int32)])
        edge_to = edge_from + edge_size

        # relax, all units at once by the offset at which an edge ends; long units one by one
        last = np.full(n + 1, NONE, np.int64)
        back = np.zeros(n + 1, np.int64)
        last[begin] = START
        base, long_at = np.repeat(begin.astype(np.int32), size + 1), np.repeat(size > LONG_UNIT, size + 1)
        offset = edge_to - base[edge_from]
        long_unit = long_at[edge_from]
        short = np.flatnonzero(~long_unit)
        by = short[np.argsort(offset[short].astype(np.uint16), kind="stable")]
        stops = np.cumsum(np.bincount(offset[by], minlength=1)) if len(by) else np.zeros(1, np.int64)
        for level in range(1, len(stops)):
            e = by[stops[level - 1]:stops[level]]
            before = last[edge_from[e]]
            e, before = e[before != NONE], before[before != NONE]
            inner = before != START
            ok = np.ones(len(e), bool)
            ok[inner] = self.may_follow(before[inner], edge_piece[e[inner]])
            e = e[ok]
            last[edge_to[e]], back[edge_to[e]] = edge_piece[e], edge_from[e]
        rest = np.flatnonzero(long_unit)
        rest = rest[np.argsort(edge_to[rest], kind="stable")]
        self.relax_long(rest, edge_from, edge_to, edge_piece, last, back)

        # walk back from the units' ends
        unit, here = np.arange(len(raw)), begin + size
        steps, owners, pieces = [], [], []
        step = 0
        while len(unit):
            inside = last[here] != START
            unit, here = unit[inside], here[inside]
            if not len(unit):
                break
            piece, source = last[here], back[here]
            known = piece < v.unknown
            owners.append(unit[known])
            pieces.append(v.id_of[piece[known]])
            steps.append(np.full(int(known.sum()), step))
            step += 1
            bare_at, bare_unit = np.flatnonzero(~known), unit[~known]
            if len(bare_at):  # bytes of a bare character, last one first
                for k in range(4):
                    p = here[bare_at] - 1 - k
                    inside_char = p >= source[bare_at]
                    owners.append(bare_unit[inside_char])
                    pieces.append(v.byte_id[body[p[inside_char]]])
                    steps.append(np.full(int(inside_char.sum()), step))
                    step += 1
            here = source
        if owners:
            owner_of, piece_of, step_of = np.concatenate(owners), np.concatenate(pieces), np.concatenate(steps)
            sorted_rows = np.lexsort((-step_of, owner_of))
            counts = np.bincount(owner_of, minlength=len(raw))
            new = piece_of[sorted_rows].astype(np.int32)
        else:
            counts, new = np.zeros(len(raw), np.int64), np.zeros(0, np.int32)
        self.start = np.concatenate([self.start, len(self.ids) + np.concatenate([[0], np.cumsum(counts)[:-1]])])
        self.size = np.concatenate([self.size, counts])
        self.ids = np.concatenate([self.ids, new])
        for u in units:
            self.unit[u] = len(self.unit)

    def relax_long(self, edges, edge_from, edge_to, edge_piece, last, back) -> None:
        for first in range(0, len(edges), 1 << 16):
            part = edges[first:first + (1 << 16)]
            for a, b, piece in zip(edge_from[part].tolist(), edge_to[part].tolist(), edge_piece[part].tolist()):
                before = int(last[a])
                if before == NONE:
                    continue
                if before != START and not self.may_follow(np.array([before]), np.array([piece]))[0]:
                    continue
                last[b], back[b] = piece, a

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each text's."""
        if len(self.unit) > MOST_UNITS:
            self.forget()
        # a blank before every text, as the model has it
        cut = [self.pattern.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        per_text = np.fromiter(map(len, cut), np.int64, len(cut))
        units = list(chain.from_iterable(cut))
        codes = np.fromiter(map(self.unit.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(codes < 0).tolist()
        if new:
            fresh, size = [], 0
            for unit in dict.fromkeys(units[i] for i in new):
                fresh.append(unit)
                size += len(unit) + 1
                if size > LEARN_BYTES:
                    self.learn(fresh)
                    fresh, size = [], 0
            if fresh:
                self.learn(fresh)
            codes[new] = [self.unit[units[i]] for i in new]
        size = self.size[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[codes] - ends[:-1], size) + np.arange(ends[-1])
        bounds = ends[np.concatenate([[0], np.cumsum(per_text)])]
        return self.ids[at], np.diff(bounds)


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of

    def decode(self, ids) -> str:
        """The text of ids; ids without a text (controls) are left out."""
        get = self.bytes_of.get
        text = b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """docs with ids (array of int), n_tokens and round_trip (whether the ids decode to the text)."""
    ids_type = T.ArrayType(T.IntegerType())

    def compute_with(state: dict, column: pa.Array) -> list:
        if not state:
            state["encoder"], state["decoder"] = Encoder(vocabulary), Decoder(vocabulary)
        texts = [t or "" for t in column.to_pylist()]
        ids, counts = state["encoder"].encode(texts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        plain, decode = ids.tolist(), state["decoder"].decode
        same = [decode(plain[a:b]) == t for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts)]
        return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(counts), pa.array(same)]

    state: dict = {}
    return with_columns(docs, text, {"ids": ids_type, "n_tokens": T.LongType(), "round_trip": T.BooleanType()},
                        lambda column: compute_with(state, column), ENCODE_BYTES)


def decoded(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows with the text of an id column; null ids give a null text."""
    decoder = Decoder(vocabulary)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(lambda x: None if x is None else decoder.decode(x.tolist()))

    return rows.withColumn(out, text_of(F.col(f"`{ids}`").cast("array<int>")))


def op8_pieces(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return encoded(docs, Vocabulary()).select("doc_id", "n_tokens", "ids", "round_trip")
