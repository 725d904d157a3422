"""BPE with word ends: speculate, verify, and merge exactly only where the guess fails.

Merging in rank order ends in one token sequence.  A sequence of tokens is that one exactly when every
token is the merge result of its own characters and every adjacent pair is *compatible*, that is, no merge
across the pair's border would have come before the merges that built the two tokens.  So a word is cut
greedily into longest matches (the guess), all adjacent pairs of a batch are checked in numpy arrays, and
only words with an incompatible pair run through the merge agenda.

Plain Latin texts are cut into words by a pattern here.  Others are cut at blanks, tabs and line ends, which belong
to no word and which no normal form joins to a neighbour, and the pieces go through the tokenizer file's own
normaliser and word splitter, so any Unicode text is cut as its library cuts it.  Words' results are cached (a
bounded number, per worker).  The tokenizer file is read on the driver and sent
with the task (a few MB).

Defined results: a NULL text counts as empty, an empty text has no ids; an empty table gives an empty result;
rows of equal text have equal ids; special tokens written in a text get their own ids; columns other than the
named ones may have any name.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import uuid
from collections import ChainMap
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Batches, append, quoted
from .pieces import read_model

TOKENIZER_PATH = "/opt/tokenizers/word_bpe_49k.json"
CACHE_WORDS = 400_000        # cached words of a worker (about 130 MB); the cache starts anew when full
CACHE_PIECES = 100_000       # cached cuts of odd pieces (about 30 MB), likewise
CACHE_CHARS = 64             # longer words and pieces are not cached
AGENDA_FROM = 64             # symbols from which exact merging keeps an agenda
NO_MERGE = (1 << 40, -1)
BYTES, SPECIAL = "\0", "\1"
NEVER = np.int64(1 << 40)    # later than any merge
# Plain texts hold only printable ASCII, tab, line ends, Latin letters of U+00C0..U+017F (but the two signs among them and
# the dotted capital I, whose small form is two characters) and dashes and quotes of U+2010..U+2027.
ODD = re.compile("[^ -~\t\n\r\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u2010-\u2027]")
# Their words, as in the tokenizer file's splitter (fixed values), after lower-casing.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^ \t\n\ra-z0-9\u00df-\u00f6\u00f8-\u017f]+")
# The letters that stand for bytes in such vocabularies: printable Latin-1 for itself, the others from U+0100 on.
_ITSELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) if b in _ITSELF else chr(256 + b - sum(x < b for x in _ITSELF)) for b in range(256)}


class Vocabulary:
    """Merges as arrays.  ``rank`` of a token is the rank of the merge that makes it, -1 for single characters."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("unk_token") \
                or model.get("byte_fallback") or model.get("continuing_subword_prefix") or spec["decoder"]:
            raise ValueError("a plain BPE model with word ends and no decoder is needed")
        self.data = data
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in [*self.ids.items(), *self.specials.items()]}
        size = max(self.names) + 1
        self.rank, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        self.merged: dict[int, tuple[int, int]] = {}         # pair -> rank, token
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, token = self.ids[a], self.ids[b], self.ids[a + b]
            if self.rank[token] >= 0 or max(self.rank[left], self.rank[right]) >= rank:
                raise ValueError("every merge must make a new token of tokens made before it")
            self.rank[token], self.left[token], self.right[token] = rank, left, right
            self.merged[left << 32 | right] = rank, token
        self.pair_keys = np.array(sorted(self.merged), np.int64)
        self.pair_ranks = np.array([self.merged[k][0] for k in self.pair_keys.tolist()], np.int64)
        # what a guess may propose: tokens that merging makes of their own characters
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for s, t in self.ids.items():
            if self.end and s.endswith(self.end) and len(s) > len(self.end):
                if self.merge_exactly([*self.symbols(s[:-len(self.end)], True)]) == [t]:
                    self.final[s[:-len(self.end)]] = t
            elif self.merge_exactly([*self.symbols(s, False)]) == [t]:
                self.inner[s] = t
        # by the first two letters, the length of the longest token inside a word
        self.reach: dict[str, int] = {}
        for token in self.inner:
            self.reach[token[:2]] = max(len(token), self.reach.get(token[:2], 0))

    def symbols(self, word: str, ends: bool = True) -> list[int]:
        """Single-character tokens of a word; the last one carries the word's end."""
        ids = self.ids
        out = [ids[c] for c in word if c in ids]
        if ends and self.end and out:
            out[-1] = ids[word[-1] + self.end]
        return out

    def merge_exactly(self, symbols: list[int]) -> list[int]:
        """Merges lowest rank first, then leftmost."""
        if len(symbols) > AGENDA_FROM:
            return self._merge_by_agenda(symbols)
        merged = self.merged
        pairs = [merged.get(a << 32 | b, NO_MERGE) for a, b in zip(symbols, symbols[1:])]
        while pairs:
            best = min(pairs)
            if best is NO_MERGE:
                break
            i = pairs.index(best)
            symbols[i] = best[1]
            del symbols[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = merged.get(best[1] << 32 | symbols[i + 1], NO_MERGE)
            if i:
                pairs[i - 1] = merged.get(symbols[i - 1] << 32 | best[1], NO_MERGE)
        return symbols

    def _merge_by_agenda(self, symbols: list[int]) -> list[int]:
        """The same for long words, over a linked list."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []       # rank, place, pair, token
        merged = self.merged

        def offer(i: int, j: int) -> None:
            pair = symbols[i] << 32 | symbols[j]
            if pair in merged:
                rank, token = merged[pair]
                heapq.heappush(agenda, (rank, i, pair, token))
        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, pair, token = heapq.heappop(agenda)
            j = after[i]
            if j >= n or symbols[i] << 32 | symbols[j] != pair:
                continue                              # one of the two has been merged since
            symbols[i], symbols[j] = token, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s >= 0]

    def guess(self, word: str) -> list[int] | None:
        """Longest match from the left; None if a place has no token."""
        whole = self.final.get(word)
        if whole is not None:
            return [whole]
        out, at, n, inner, final, reach = [], 0, len(word), self.inner, self.final, self.reach
        while at < n:
            if at and (t := final.get(word[at:])) is not None:
                out.append(t)
                break
            size = min(reach.get(word[at:at + 2], 1), n - at - 1 if self.end else n - at)
            while size > 0 and (t := inner.get(word[at:at + size])) is None:
                size -= 1
            if size <= 0:
                return None
            out.append(t)
            at += size
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Per pair of tokens: does merging leave their border alone?

        Both tokens are taken apart again, the later merge first (of equal ranks the right one, as merging
        goes from the left).  A merge of the two pieces at the border breaks the pair if it comes before
        the merge that takes the left piece away and not after the one that takes the right piece away."""
        ok = np.ones(len(left), bool)
        at, a, b = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
        until_a, until_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            key = a << 32 | b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[place] == key, self.pair_ranks[place], NEVER)
            broken = (rank < until_a) & (rank <= until_b)
            ok[at[broken]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            open_a = rank_a > rank_b
            live = ~broken & ((rank_a >= 0) | (rank_b >= 0))
            until_a, until_b = np.where(open_a, rank_a, until_a), np.where(open_a, until_b, rank_b)
            a, b = np.where(open_a, self.right[a], a), np.where(open_a, b, self.left[b])
            at, a, b, until_a, until_b = at[live], a[live], b[live], until_a[live], until_b[live]
        return ok

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Ids of every word, and how many words needed exact merging."""
        guesses = [self.guess(w) for w in words]
        sizes = np.array([len(g) if g else 0 for g in guesses], np.int64)
        flat = np.fromiter((t for g in guesses if g for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        failed = sizes == 0
        if len(flat) > 1:
            inside = np.nonzero(owner[1:] == owner[:-1])[0]
            pairs, which = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
            failed[owner[inside[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]]]] = True
        for k in np.nonzero(failed)[0].tolist():
            guesses[k] = self.merge_exactly(self.symbols(words[k]))
        return guesses, int(failed.sum())


class Encoder:
    """Encodes texts; ``render`` gives the forms of a word's ids that are cached."""

    def __init__(self, vocabulary: Vocabulary, render: Callable[[list[int]], tuple]):
        from tokenizers import Tokenizer
        self.v, self.render = vocabulary, render
        self.library = Tokenizer.from_str(vocabulary.data.decode("utf-8"))
        self.special = re.compile("(" + "|".join(sorted(map(re.escape, vocabulary.specials), key=len, reverse=True)) + ")") \
            if vocabulary.specials else None
        self.forms = len(render([]))
        self.cache: dict[str, tuple] = {}
        self.words_of: dict[str, list[str]] = {}

    def words(self, text: str) -> list[str]:
        """Words in order, as they are cached: a plain text's lower-cased, an odd text's in byte letters after
        ``BYTES``, and special tokens after ``SPECIAL`` (both marks are odd, so no plain word begins with one)."""
        if not ODD.search(text) and not (self.special and self.special.search(text)):
            return WORD.findall(text.lower())
        out = []
        for piece in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            known = self.words_of.get(piece)
            if known is None:
                known = self._split(piece)
                if len(piece) <= CACHE_CHARS:
                    self.words_of[piece] = known
            out += known
        return out

    def _split(self, piece: str) -> list[str]:
        """The words of a piece by the tokenizer file's normaliser and splitter."""
        out = []
        for part in self.special.split(piece) if self.special else [piece]:
            if part in self.v.specials:
                out.append(SPECIAL + part)
            else:
                normal = self.library.normalizer.normalize_str(part)
                out += [BYTES + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of words as ``words`` gives them."""
        spelled = {w: w if w.isascii() and w[0] > SPECIAL else w[1:] if w[0] == BYTES
                   else w.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS) for w in words if w[0] != SPECIAL}
        ids = dict(zip(spelled, self.v.encode_words(list(spelled.values()))[0]))
        return ids | {w: [self.v.specials[w[1:]]] for w in words if w[0] == SPECIAL}

    def rendered(self, texts: list[str | None]) -> list[tuple[tuple, ...]]:
        """Per text, for each form, its words' forms in order."""
        if len(self.words_of) > CACHE_PIECES:
            self.words_of = {}
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        split, cache = [self.words(t) if t else [] for t in texts], self.cache
        passing = {}
        for w, ids in self.encode(list(set().union(*split) - cache.keys())).items():
            (cache if len(w) <= CACHE_CHARS else passing)[w] = self.render(ids)
        table, nothing = ChainMap(passing, cache) if passing else cache, ((),) * self.forms
        return [tuple(zip(*map(table.__getitem__, words))) or nothing for words in split]


def _packed(ids: list[int]) -> tuple[bytes]:
    return (np.array(ids, "<i4").tobytes(),)


@lru_cache(maxsize=2)
def _worker_encoder(job: str, holder: tuple) -> Encoder:
    """The worker's encoder of one call; its later tasks find the pieces of its earlier ones."""
    return Encoder(*holder)


def _vocabulary(docs: DataFrame, path: str) -> Vocabulary:
    return Vocabulary(read_model(docs, path))


def encode_documents(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids",
                     tokenizer_path: str = TOKENIZER_PATH) -> DataFrame:
    """``docs`` plus ``ids_col`` (array of int).  A column of that name in ``docs`` is an error."""
    if ids_col in docs.columns:
        raise ValueError(f"the documents have a column {ids_col!r} already")
    vocabulary, job, at = _vocabulary(docs, tokenizer_path), uuid.uuid4().hex, docs.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        encoder = _worker_encoder(job, (vocabulary, _packed))
        for batch in batches:
            ids = [b"".join(r) for r, in encoder.rendered(batch.column(at).to_pylist())]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield append(batch, {ids_col: pa.ListArray.from_arrays(pa.array(offsets), flat)})
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode_documents(encoded: DataFrame, ids_col: str = "token_ids", text_col: str = "decoded",
                     tokenizer_path: str = TOKENIZER_PATH) -> DataFrame:
    """``encoded`` plus ``text_col``: the tokens joined by blanks, special ones included (the file has no
    decoder of its own).  Ids outside the vocabulary are left out; NULL ids give NULL."""
    if text_col in encoded.columns:
        raise ValueError(f"the rows have a column {text_col!r} already")
    names, at = _vocabulary(encoded, tokenizer_path).names, encoded.columns.index(ids_col)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield append(batch, {text_col: pa.array(
                [None if x is None else " ".join(names[i] for i in x if i in names)
                 for x in batch.column(at).to_pylist()], pa.string())})
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())]))


class _Texts:
    """Two forms of a word: ids as decimal text and its tokens, each followed by a blank."""

    def __init__(self, names: dict[int, str]):
        self.numbers, self.names = {i: f"{i} " for i in names}, {i: f"{s} " for i, s in names.items()}

    def __call__(self, ids: list[int]) -> tuple[str, str]:
        if len(ids) == 1:
            return self.numbers[ids[0]], self.names[ids[0]]
        return "".join([self.numbers[i] for i in ids]), "".join([self.names[i] for i in ids])


def encode_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  tokenizer_path: str = TOKENIZER_PATH) -> DataFrame:
    """Per document: id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by a blank), ``decoded_sha256``."""
    vocabulary, job = _vocabulary(docs, tokenizer_path), uuid.uuid4().hex
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))

    def run(batches: Batches) -> Batches:
        gc.set_threshold(100_000, 50, 100)      # the cache holds no cycles worth looking for
        encoder = _worker_encoder(job, (vocabulary, _Texts(vocabulary.names)))
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for ids, decoded in encoder.rendered(batch.column(1).to_pylist()):
                ids = "".join(ids)
                counts.append(ids.count(" "))
                ids_sha.append(hashlib.sha256(ids[:-1].encode()).hexdigest())
                decoded_sha.append(hashlib.sha256("".join(decoded)[:-1].encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    schema = T.StructType([rows.schema["id"], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
