"""SentencePiece BPE with seeded merge-dropout.

Encoding processes an agenda of candidate merges (best score first, then leftmost).  A candidate is
skipped when a keyed hash of (seed, document, copy, number of the unit in its text, position, piece)
falls below the dropout rate, so every occurrence of a word is cut on its own, every rerun cuts it
the same, and every result is made of vocabulary merges.  Characters without a piece become UTF-8
byte pieces, and so does the space mark U+2581 itself, hence decoding returns the text exactly.

Units: no piece holds a character followed by the space mark, and no longer piece holds a newline,
so text is cut there first.  The agenda of a unit without dropout is cached (bounded number of
entries) with the merges it makes; an occurrence that skips none of these has that result, which the
keyed draws of all occurrences decide in arrays, and the others go through their own agenda.  The
vocabulary file is read on the driver and sent with the task (0.5 MB).

Copies: rows that follow each other with the same id in a task's input (as mixing leaves its copies)
are copies 0, 1, ... of a document and cut differently; a read split between two copies starts anew.

Defined results: a NULL text gives NULL ids; an empty text gives no ids; an empty table gives an
empty result; an input column named like an added one keeps its values under its name + ``_input``.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Batches, quoted

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 42
CACHE_WORDS = 300_000        # cached units (about 80 MB); the cache starts anew when full
CACHE_CHARS = 8_000_000      # and when it holds as many characters
SPACE = "▁"
MASK = (1 << 64) - 1
WIDTHS = (3, 4, 5, 6, 7, 8, 10, 12, 16, 24)  # column classes; longer units go through their agenda one by one
NONE = 1 << 62               # no candidate
CHUNK_UNITS = 5000           # units merged together
DRAW_UNITS = 100_000         # units whose draws are made together
C_PLACE, C_PIECE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
C_MIX, C_END = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
NEWLINE_UNIT, MARK_UNIT = "\n", "\n" + SPACE     # no unit of a text holds a newline
ALONE = 1 << 20
CLASS_OF = np.array([next(w for w in WIDTHS if n <= w) for n in range(WIDTHS[-1] + 1)] + [ALONE])
OPEN_AFTER, OPEN_WIDTH, OPEN_BITS = 3, 8, 28     # a unit of 8 characters has at most 28 candidates
UNIT = regex.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@lru_cache(maxsize=2)
def _vocabulary(model: bytes) -> tuple[dict[str, tuple[float, int]], list[int], list[str], dict[int, int]]:
    """piece -> (-score, id); ids of the 256 bytes; piece of every id; byte of the byte ids."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    ranks = {p: (-sp.get_score(i), i) for i, p in enumerate(pieces)
             if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    if any(SPACE in p.lstrip(SPACE) or (len(p) > 1 and "\n" in p) for p in ranks):
        raise ValueError("pieces across words: this vocabulary needs other units")
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return ranks, byte_ids, pieces, {i: b for b, i in enumerate(byte_ids)}


class Tables:
    """The vocabulary as arrays: symbol of a code point, merged symbol of a pair (open addressing)."""

    def __init__(self, ranks: dict[str, tuple[float, int]], size: int):
        self.pad = size                                  # code points without a piece: pad + 1 + point
        points = np.arange(0x110000, dtype=np.int64)
        self.symbol_of = points + size + 1
        self.symbol_of[0] = self.pad
        for piece, (_, i) in ranks.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        order = np.unique([r for r, _ in ranks.values()], return_inverse=True)[1]
        self.rank = np.full(size + 1, NONE, np.int64)
        for (_, i), k in zip(ranks.values(), order.tolist()):
            self.rank[i] = k
        pairs = {}
        for piece, (_, i) in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a and b:
                    pairs[(a[1] << 20) | b[1]] = i
        bits = (2 * len(pairs)).bit_length() + 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        key, value = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            first = np.zeros(len(key), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            key, value, slot = key[~put], value[~put], slot[~put]
            slot = np.where(self.keys[slot] >= 0, (slot + 1) & self.mask, slot)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs have a merged symbol, and that symbol."""
        todo = np.nonzero((left < self.pad) & (right < self.pad))[0]
        key = (left[todo] << 20) | right[todo]
        slot = self._slot(key)
        found, symbols = [], []
        while len(todo):
            there = self.keys[slot]
            hit = there == key
            found.append(todo[hit])
            symbols.append(self.values[slot[hit]])
            more = ~hit & (there >= 0)
            todo, key, slot = todo[more], key[more], (slot[more] + 1) & self.mask
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(symbols)


@lru_cache(maxsize=2)
def _tables(model: bytes) -> Tables:
    ranks, _, pieces, _ = _vocabulary(model)
    return Tables(ranks, len(pieces))


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def unpacked(data: bytes) -> list[int]:
    return np.frombuffer(data, "<i4").tolist()


def _classes(units: list[str]) -> np.ndarray:
    """The column class of every unit."""
    klass = CLASS_OF[np.minimum(np.fromiter(map(len, units), np.int64, len(units)), WIDTHS[-1] + 1)]
    klass[np.array([k for k, u in enumerate(units) if "\0" in u], np.int64)] = ALONE
    return klass


def _chunks(klass: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Positions that go through arrays, in chunks of one column class."""
    for width in WIDTHS:
        at = np.nonzero(klass == width)[0]
        for begin in range(0, len(at), CHUNK_UNITS):
            yield at[begin:begin + CHUNK_UNITS], width


def _salts(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return place.astype(np.uint64) * np.uint64(C_PLACE) + piece.astype(np.uint64) * np.uint64(C_PIECE)


class Encoder:
    """Encodes texts; one instance lives in a worker for its tasks.  Ids are kept packed, as
    little-endian int32: a cached unit is one short byte string and a text is their join."""

    def __init__(self, model: bytes, dropout: float = DROPOUT, seed: int = SEED):
        self.ranks, self.byte_ids, self.pieces, self.bytes_of = _vocabulary(model)
        self.limit, self.seed = int(dropout * (1 << 20)), seed
        self.tables = _tables(model)
        self.spoken = [bytes([self.bytes_of[i]]) if i in self.bytes_of else p.replace(SPACE, " ").encode("utf-8")
                       for i, p in enumerate(self.pieces)]
        self._forget()

    def _forget(self) -> None:
        """An empty cache: entry number of a unit, by the unit and, for units that begin with the
        space mark, by what follows it; per entry its ids without dropout and its merges' salts."""
        self.bare: dict[str, int] = {NEWLINE_UNIT: 0, MARK_UNIT: 1}
        self.marked: dict[str, int] = {}
        self.strings = [NEWLINE_UNIT, MARK_UNIT]
        self.base = [packed([self.byte_ids[10]]), packed([self.byte_ids[b] for b in SPACE.encode("utf-8")])]
        self.salts = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(2, np.int64), np.zeros(2, np.int64)
        self.klass = np.zeros(2, np.int64)      # column class; ALONE: through its agenda one by one
        self.seen = np.zeros(2, np.int64)       # times an occurrence had to go through its agenda
        self.all_salts = np.zeros(0, np.uint64)
        self.all_begin, self.all_count = np.zeros(2, np.int64), np.full(2, -1, np.int64)
        self.drawn: dict[int, bytes] = {}       # ids by entry and draws
        self.chars = 0

    def skipped(self, key: int, left: int, piece: int) -> bool:
        x = ((key ^ ((left * C_PLACE + piece * C_PIECE) & MASK)) * C_MIX) & MASK
        x = ((x ^ (x >> 29)) * C_END) & MASK
        return (x >> 44) < self.limit

    def _skips(self, keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """``skipped`` for arrays; a salt is a candidate's place and piece."""
        x = (keys ^ salts) * np.uint64(C_MIX)
        x ^= x >> np.uint64(29)
        x *= np.uint64(C_END)
        return (x >> np.uint64(44)) < np.uint64(self.limit)

    def unit_keys(self, doc, copy: int, n: int) -> np.ndarray:
        """The keys of the first ``n`` units (line ends count as units) of a copy of a document."""
        start = hashlib.blake2b(f"{self.seed}|{copy}|{doc}".encode("utf-8"), digest_size=8).digest()
        x = np.uint64(int.from_bytes(start, "little")) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(C_PLACE)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(C_MIX)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(C_END)
        return x ^ (x >> np.uint64(31))

    def unit(self, unit: str, key: int) -> list[int]:
        """Ids of one unit: the agenda over its characters."""
        ranks = self.ranks
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        agenda = []
        for i in range(n - 1):
            got = ranks.get(symbols[i] + symbols[i + 1])
            if got:
                agenda.append((got[0], i, i + 1, got[1], 2))
        if agenda:
            heapq.heapify(agenda)
            following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
            limit = self.limit
            while agenda:
                _, i, j, piece, size = heapq.heappop(agenda)
                a, b = symbols[i], symbols[j]
                if a is None or b is None or len(a) + len(b) != size or following[i] != j:
                    continue
                if limit and self.skipped(key, i, piece):
                    continue
                symbols[i], symbols[j] = a + b, None
                k = following[j]
                following[i] = k
                if k < n:
                    previous[k] = i
                    got = ranks.get(symbols[i] + symbols[k])
                    if got:
                        heapq.heappush(agenda, (got[0], i, k, got[1], size + len(symbols[k])))
                h = previous[i]
                if h >= 0:
                    got = ranks.get(symbols[h] + symbols[i])
                    if got:
                        heapq.heappush(agenda, (got[0], h, i, got[1], size + len(symbols[h])))
        out = []
        for s in symbols:
            if s is not None:
                got = ranks.get(s)
                if got:
                    out.append(got[1])
                else:
                    out.extend(self.byte_ids[b] for b in s.encode("utf-8"))
        return out

    def encode(self, text: str, doc, copy: int = 0) -> list[int]:
        return unpacked(self.encode_batch([text], [doc], [copy])[0])

    def encode_batch(self, values: list[str | None], docs: list, copies: list[int] | None = None) -> list[bytes | None]:
        """Packed ids of all texts of a batch, each with its document's id and the copy's number."""
        plans = [None if text is None else self._plan(text) for text in values]
        self._learn({w for plan in plans if plan for words, kind in plan if kind < 2 for w in words[kind:]},
                    {w for plan in plans if plan for words, kind in plan if kind for w in (words if kind == 2 else words[:1])})
        entries: list[int] = []
        ends = []
        for plan in plans:
            for line_no, (words, kind) in enumerate(plan or ()):
                if line_no:
                    entries.append(0)
                if kind:
                    entries.extend(map(self.bare.__getitem__, words if kind == 2 else words[:1]))
                if kind < 2:
                    entries.extend(map(self.marked.__getitem__, words[kind:] if kind else words))
            ends.append(len(entries))
        begins = [0, *ends[:-1]]
        parts = list(map(self.base.__getitem__, entries))
        at = np.array(entries, np.int64)
        keys = np.concatenate([np.zeros(0, np.uint64), *[self.unit_keys(doc, copy, end - begin) for doc, copy, begin, end
                                                         in zip(docs, copies or [0] * len(docs), begins, ends)]])
        for k in np.nonzero(self.klass[at] == ALONE)[0].tolist():
            parts[k] = packed(self.unit(self.strings[entries[k]], int(keys[k])))
        if self.limit:
            for begin in range(0, len(at), DRAW_UNITS):
                self._redraw(at, keys, begin, parts)
        return [None if plan is None else b"".join(parts[begin:end]) for plan, begin, end in zip(plans, begins, ends)]

    def _redraw(self, at: np.ndarray, keys: np.ndarray, begin: int, parts: list[bytes]) -> None:
        """Occurrences that skip a merge of their unit's plain agenda get an agenda of their own."""
        own, key = at[begin:begin + DRAW_UNITS], keys[begin:begin + DRAW_UNITS]
        row, hit, _ = self._draws(own, key, self.salts, self.begin, self.count)
        again = np.zeros(len(own), bool)
        again[row[hit]] = True
        which = np.nonzero(again)[0]
        own, key = own[which], key[which]
        which += begin
        self.seen += np.bincount(own, minlength=len(self.seen))
        self._open(np.unique(own[(self.seen[own] >= OPEN_AFTER) & (self.klass[own] <= OPEN_WIDTH) & (self.all_count[own] < 0)]))
        often = self.all_count[own] >= 0
        rest = np.nonzero(~often)[0]
        for k, ids in zip(which[rest].tolist(), self._again(own[rest], key[rest])):
            parts[k] = ids
        which, own, key = which[often], own[often], key[often]
        row, hit, bit = self._draws(own, key, self.all_salts, self.all_begin, self.all_count)
        mask = np.bincount(row[hit], weights=np.ldexp(1.0, bit[hit]), minlength=len(own)).astype(np.int64)
        codes, first, place = np.unique((own << OPEN_BITS) | mask, return_index=True, return_inverse=True)
        if len(self.drawn) > CACHE_WORDS:
            self.drawn.clear()
        codes = codes.tolist()
        new = [k for k, c in enumerate(codes) if c not in self.drawn]
        self.drawn.update(zip([codes[k] for k in new], self._again(own[first[new]], key[first[new]])))
        results = list(map(self.drawn.__getitem__, codes))
        for k, u in zip(which.tolist(), place.tolist()):
            parts[k] = results[u]

    def _draws(self, own: np.ndarray, key: np.ndarray, salts: np.ndarray, begin: np.ndarray,
               count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The draws of every salt of every occurrence: occurrence, skipped or not, number of the salt."""
        n = count[own]
        row = np.repeat(np.arange(len(own)), n)
        bit = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, self._skips(key[row], salts[np.repeat(begin[own], n) + bit]), bit

    def _open(self, entries: np.ndarray) -> None:
        """Short units met often: the salts of all candidates they can ever have.  Their agenda depends
        on the draws of these alone, so its result is cached by them."""
        salts = []
        for w in entries.tolist():
            u = self.strings[w]
            own = [(i * C_PLACE + self.ranks[u[i:j]][1] * C_PIECE) & MASK
                   for i in range(len(u) - 1) for j in range(i + 2, len(u) + 1) if u[i:j] in self.ranks]
            self.all_begin[w], self.all_count[w] = len(self.all_salts) + len(salts), len(own)
            salts += own
        self.all_salts = np.concatenate([self.all_salts, np.array(salts, np.uint64)])

    def _again(self, own: np.ndarray, key: np.ndarray) -> list[bytes]:
        """The agendas of entries under the keys of their occurrences."""
        out: list[bytes] = [b""] * len(own)
        for part, width in _chunks(self.klass[own]):
            units = [self.strings[w] for w in own[part].tolist()]
            for k, ids in zip(part.tolist(), self._rounds(units, width, key[part])[0]):
                out[k] = ids
        return out

    def _plan(self, text: str) -> list[tuple[list[str], int]]:
        """Lines as (words, kind).  Kind 0: every word has the space mark before it; 1: all but the
        first; 2: a line with runs of spaces or with the space mark itself (which goes as its three
        bytes), as whole units."""
        plan = []
        for line_no, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if SPACE not in line and "" not in words:
                plan.append((words, 1 if line_no else 0))
                continue
            units = []
            for k, part in enumerate(line.split(SPACE)):
                if k:
                    units.append(MARK_UNIT)
                part = (SPACE if line_no == 0 and k == 0 and text else "") + part.replace(" ", SPACE)
                units.extend(UNIT.findall(part))
            plan.append((units, 2))
        return plan

    def _learn(self, marked: set[str], bare: set[str]) -> None:
        """Bring the units into the cache, which starts anew when it would grow past its limits."""
        new_marked, new_bare = list(marked.difference(self.marked)), list(bare.difference(self.bare))
        if len(self.strings) + len(new_marked) + len(new_bare) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._forget()
            new_marked, new_bare = list(marked), list(bare.difference(self.bare))
        units = [SPACE + w for w in new_marked] + new_bare
        if not units:
            return
        first = len(self.strings)
        self.marked.update(zip(new_marked, range(first, first + len(new_marked))))
        self.bare.update(zip(new_bare, range(first + len(new_marked), first + len(units))))
        base: list[bytes] = [b""] * len(units)
        klass = _classes(units)
        rows, salts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for part, width in _chunks(klass):
            ids, row, salt = self._rounds([units[k] for k in part.tolist()], width, None)
            rows.append(part[row])
            salts.append(salt)
            for k, x in zip(part.tolist(), ids):
                base[k] = x
        row = np.concatenate(rows)
        count = np.bincount(row, minlength=len(units))
        self.begin = np.concatenate([self.begin, len(self.salts) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.salts = np.concatenate([self.salts, np.concatenate(salts)[np.argsort(row, kind="stable")]])
        self.klass = np.concatenate([self.klass, klass])
        self.seen, self.all_begin = (np.concatenate([x, np.zeros(len(units), np.int64)]) for x in (self.seen, self.all_begin))
        self.all_count = np.concatenate([self.all_count, np.full(len(units), -1, np.int64)])
        self.strings += units
        self.base += base
        self.chars += sum(map(len, units))

    def units(self, units: list[str], keys: np.ndarray) -> list[list[int]]:
        """Ids of units, each with its key."""
        out = [None] * len(units)
        for part, width in _chunks(_classes(units)):
            for k, ids in zip(part.tolist(), self._rounds([units[k] for k in part.tolist()], width, keys[part])[0]):
                out[k] = unpacked(ids)
        return [self.unit(u, int(key)) if x is None else x for x, u, key in zip(out, units, keys)]

    def _rounds(self, units: list[str], width: int, keys: np.ndarray | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The agendas of many units at once: in every round each takes its best candidate.  Column-wise arrays (width, units): ``symbols``, their first ``place``, and ``best`` with
        the candidate of every adjacent pair as rank, place and piece in one number.  Without keys no
        candidate is skipped, and the merges made are returned too, as unit numbers and salts."""
        t = self.tables
        points = np.array(units, dtype=f"<U{width}").view(np.uint32).reshape(len(units), width)
        symbols = np.ascontiguousarray(t.symbol_of[points].T)
        place = np.repeat(np.arange(width, dtype=np.int64)[:, None], len(units), axis=1)
        draw = keys is not None and self.limit > 0
        own_keys = keys if draw else np.zeros(len(units), np.uint64)

        def candidates(left: np.ndarray, right: np.ndarray, where: np.ndarray, own: np.ndarray) -> np.ndarray:
            out = np.full(len(left), NONE, np.int64)
            at, merged = t.merge(left, right)
            if draw and len(at):
                stay = ~self._skips(own[at], _salts(where[at], merged))
                at, merged = at[stay], merged[stay]
            out[at] = (t.rank[merged] << 32) | (where[at] << 24) | merged
            return out

        flat = candidates(symbols[:-1].ravel(), symbols[1:].ravel(), place[:-1].ravel(), np.tile(own_keys, width - 1))
        best = np.concatenate([flat.reshape(width - 1, len(units)), np.full((1, len(units)), NONE, np.int64)])
        done = np.empty((len(units), width), np.int64)
        live = np.arange(len(units))
        made_by, made = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        while True:
            at = best.argmin(axis=0)
            chosen = best[at, np.arange(len(live))]
            go = chosen < NONE
            if not go.all():
                done[live[~go]] = symbols[:, ~go].T
                if not go.any():
                    break
                live, at, chosen, own_keys = live[go], at[go], chosen[go], own_keys[go]
                symbols, place, best = symbols[:, go], place[:, go], best[:, go]
            if keys is None:
                made_by.append(live)
                made.append(_salts((chosen >> 24) & 0xFF, chosen & 0xFFFFFF))
            n = np.arange(len(live))
            symbols[at, n] = chosen & 0xFFFFFF
            # what stands right of the merge moves left with its candidates; the two that touch it are new
            for c in range(1, width - 1):
                right = at < c
                np.copyto(symbols[c], symbols[c + 1], where=right)
                np.copyto(place[c], place[c + 1], where=right)
                np.copyto(best[c], best[c + 1], where=right)
            symbols[width - 1] = t.pad
            best[width - 1] = NONE
            best[at, n] = candidates(symbols[at, n], symbols[np.minimum(at + 1, width - 1), n], place[at, n], own_keys)
            r = n[at > 0]
            c = at[r] - 1
            best[c, r] = candidates(symbols[c, r], symbols[c + 1, r], place[c, r], own_keys[r])
        plain = (done <= t.pad).all(axis=1)      # no character without a piece
        lengths = (done != t.pad).sum(axis=1)
        data = done.astype("<i4").tobytes()
        ends = np.arange(0, 4 * width * len(units), 4 * width) + 4 * lengths
        result = [data[begin:end] for begin, end in zip(range(0, len(data), 4 * width), ends.tolist())]
        for k in np.nonzero(~plain)[0].tolist():
            result[k] = packed([x for s in unpacked(result[k]) for x in (
                (s,) if s < t.pad else [self.byte_ids[b] for b in chr(s - t.pad - 1).encode("utf-8")])])
        return result, np.concatenate(made_by), np.concatenate(made)

    def decode(self, ids: list[int]) -> str:
        """The text, without the mark that was put before the first word."""
        return b"".join(map(self.spoken.__getitem__, ids)).decode("utf-8")[1:]


@lru_cache(maxsize=1)
def _encoder(model: bytes, dropout: float, seed: int, job: str) -> Encoder:
    """The worker's encoder of one call of ``encode_documents``: its later tasks find the words of
    its earlier ones, within the same bound; nothing is carried over to another call."""
    return Encoder(model, dropout, seed)


def read_model(docs: DataFrame, path: str = MODEL_PATH) -> bytes:
    """The vocabulary file, by a path on the driver (or one that Spark can read)."""
    if "://" in path:
        return bytes(docs.sparkSession.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH,
                     dropout: float = DROPOUT, seed: int = SEED, verify: bool = False) -> DataFrame:
    """``docs`` without the text column, plus ``piece_ids``; with ``verify`` also ``n_pieces``,
    ``pieces_sha256`` (of the ids as little-endian int32) and ``lossless`` instead of the ids."""
    model = read_model(docs, model_path)
    at, key_at = docs.columns.index(text_col), docs.columns.index(id_col)
    kept = [i for i in range(len(docs.columns)) if i != at]
    job = uuid.uuid4().hex
    added = ([T.StructField("n_pieces", T.LongType()), T.StructField("pieces_sha256", T.StringType()),
              T.StructField("lossless", T.BooleanType())] if verify
             else [T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])
    fields = [docs.schema.fields[i] for i in kept]
    taken = {f.name.lower() for f in added}
    names = [f.name + "_input" if f.name.lower() in taken else f.name for f in fields]
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, fields)], *added])

    def run(batches: Batches) -> Batches:
        last, copy = object(), 0
        gc.set_threshold(100_000, 50, 100)      # the caches hold no cycles worth looking for
        encoder = _encoder(model, dropout, seed, job)
        for batch in batches:
            values, keys = batch.column(at).to_pylist(), batch.column(key_at).to_pylist()
            copies = []
            for key in keys:
                copy = copy + 1 if key == last else 0
                last = key
                copies.append(copy)
            ids = encoder.encode_batch(values, keys, copies)
            if verify:
                extra = {"n_pieces": pa.array([None if x is None else len(x) // 4 for x in ids], pa.int64()),
                         "pieces_sha256": pa.array([None if x is None else hashlib.sha256(x).hexdigest()
                                                    for x in ids], pa.string()),
                         "lossless": pa.array([None if x is None else encoder.decode(unpacked(x)) == t
                                               for x, t in zip(ids, values)], pa.bool_())}
            else:
                sizes = np.array([0 if x is None else len(x) // 4 for x in ids], np.int64)
                flat = np.frombuffer(b"".join(x for x in ids if x), "<i4")
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32(),
                                   mask=np.array([x is None for x in ids] + [False]))
                extra = {"piece_ids": pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))}
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *extra.values()], names=[*names, *extra])
    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ids_col: str = "piece_ids", text_col: str = "text",
                     model_path: str = MODEL_PATH) -> DataFrame:
    """``encoded`` with the ids turned back into ``text``."""
    model = read_model(encoded, model_path)
    at = encoded.columns.index(ids_col)

    def run(batches: Batches) -> Batches:
        encoder = Encoder(model, 0.0)
        for batch in batches:
            decoded = [None if x is None else encoder.decode(x) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[text_col if i == at else n
                                                             for i, n in enumerate(batch.schema.names)])
    fields = [T.StructField(text_col, T.StringType()) if i == at else f for i, f in enumerate(encoded.schema.fields)]
    return encoded.mapInArrow(run, T.StructType(fields))


def encode_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, ``n_pieces``, ``pieces_sha256``, ``lossless``."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    return encode_documents(rows, "id", "text", verify=True, **options).withColumnRenamed("id", id_col)


