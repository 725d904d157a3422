"""Search, word-end BPE and hard negatives against brute force and the tokenizer library."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac.llm import lexical, negatives, wordbpe
from tarmac.llm.catalog import QUERIES
from tarmac.llm.common import prepare_session

SF001 = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture()
def make(spark):
    prepare_session(spark)
    return lambda rows, schema: spark.createDataFrame(rows, schema)


# lexical search ----------------------------------------------------------------------------------

def split_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def search_by_hand(docs, items, top=10):
    bags = [(i, Counter(split_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 100 - 75 + (75 * sum(bag.values()) * n) // length
            score = 0
            for t in split_terms(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, k + 1, doc, score) for k, (_, _, doc, score) in enumerate(scored[:top])]
    return sorted(out, key=str)


def random_docs(count, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "é", "Ünder", "x-y", "a_b"]
    return [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 20, 20, 80])))) for i in range(count)]


@pytest.mark.parametrize("postings", [50, 1_000_000])
def test_search_equals_brute_force_with_ties_repeats_and_nulls(make, postings):
    docs = random_docs(300) + [(5, "the the w1"), (5, "the the w1"), (None, "w1 w2"), (900, None), (901, ""), (902, "-- !"),
                               (903, "w1 " * 30_000)]
    items = [(1, "The w1 w2 w1"), (2, "é x"), (3, None), (4, "nowhere"), (5, "w5 " * 40 + "under Ünder"), (5, "w1 w2")]
    index = lexical.build_index(make(docs, "doc_id long, text string"), segment_postings=postings)
    got = lexical.search(index, make(items, "item_id long, text string"), item_block=2)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == search_by_hand(docs, items)


def test_search_of_empty_tables_and_clashing_columns(make):
    schema = "doc_id long, text string, segment string, term int, score string"
    docs = make([(1, "some words", "a", 1, "b"), (2, "other words", "a", 1, "b")], schema)
    items = make([(1, "words other", "x")], "item_id long, text string, rank string")
    assert [(r.doc_id, r["rank"]) for r in lexical.rank_documents(docs, items).collect()] == [(2, 1), (1, 2)]
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical.rank_documents(docs.limit(0), items).count() == 0


def test_search_stops_at_the_bound():
    """Only the first strata are read when their documents beat the bounds of the others."""
    strata = 400
    rows = pd.DataFrame({"m": [np.arange(25, 25 + strata)], "tf": [np.ones(strata, int)], "size": [np.full(strata, 50)],
                         "doc": [np.arange(50 * strata)], "items": [[7]], "weights": [[1000]]})
    got, read = lexical.search_segment(rows, 10)
    assert list(got["ordinal"]) == list(range(10)) and read < 50 * strata / 10


# word-end BPE -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    with open(wordbpe.TOKENIZER_PATH, "rb") as f:
        return wordbpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(wordbpe.TOKENIZER_PATH)


def test_pairs_are_compatible_exactly_when_merging_keeps_them(vocabulary):
    v = vocabulary

    def symbols(t):
        return [t] if v.left[t] < 0 else symbols(int(v.left[t])) + symbols(int(v.right[t]))
    rng = np.random.default_rng(5)
    inner, final = np.array(list(v.inner.values())), np.array([*v.inner.values(), *v.final.values()])
    left, right = rng.choice(inner, 8000), rng.choice(final, 8000)
    merges = rng.integers(0, len(v.pair_keys), 4000)      # pairs that do merge, and pairs near them
    left = np.r_[left, v.pair_keys[merges] >> 32, rng.permutation(v.pair_keys[merges] >> 32)]
    right = np.r_[right, v.pair_keys[merges] & 0xFFFFFFFF, v.pair_keys[merges] & 0xFFFFFFFF]
    valid = np.isin(left, inner) & np.isin(right, final)
    got = v.compatible(left[valid], right[valid])
    want = [v.merge_exactly(symbols(a) + symbols(b)) == [a, b] for a, b in zip(left[valid].tolist(), right[valid].tolist())]
    assert got.tolist() == want and 0.05 < got.mean() < 0.95


def one_form(ids):
    return (list(ids),)


def odd_texts():
    rnd = random.Random(2)
    letters = "aaabcdeinstthe's019!?-<|>ÉéßΣσİ́\x1c\x85\xa0　\t\n\r漢한ñ\U0001F600  "
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in (rnd.randint(0, 0xD7FF) for _ in range(6))) for _ in range(2000)]
    plain = [chr(c) for c in range(0x20, 0x2100) if not wordbpe.ODD.search(chr(c))]
    texts += ["".join(rnd.choices(plain, k=rnd.randint(1, 30))) for _ in range(3000)] + [f"a{c}A {c} {c}{c}1{c}'s" for c in plain]
    return texts + ["", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|>́x", "ab" * 20_000, "x" * 3000,
                    "…" * 2000, "don't we'll THEY'RE 'S", "\0 a\0b"]


def test_encoder_equals_the_library(vocabulary, library):
    encoder = wordbpe.Encoder(vocabulary, one_form)
    texts = odd_texts()
    got = [[i for p in pieces for i in p] for pieces, in encoder.rendered(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_some_words_pass_and_some_need_exact_merging(vocabulary):
    words = ["the", "hello", "quickbrownfox", "zzyzx", "abababab", "internationalization", "thhe", "xqjk"]
    ids, failed = vocabulary.encode_words(words)
    assert 0 < failed < len(words)
    assert ids == [vocabulary.merge_exactly(vocabulary.symbols(w)) for w in words]
    for word in [*words, "a" * 50, "thethethe" * 6]:          # both ways of merging agree
        assert vocabulary.merge_exactly(vocabulary.symbols(word)) == vocabulary._merge_by_agenda(vocabulary.symbols(word))


def test_full_caches_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(wordbpe, "CACHE_PIECES", 50)
    monkeypatch.setattr(wordbpe, "CACHE_WORDS", 30)
    encoder = wordbpe.Encoder(vocabulary, one_form)
    texts = odd_texts()[:600]
    for k in range(0, len(texts), 40):
        got = [[i for p in pieces for i in p] for pieces, in encoder.rendered(texts[k:k + 40])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts[k:k + 40]]


def test_bpe_documents_and_report(make, library):
    rows = [(1, "Hello, World's 42!", "x"), (2, None, "x"), (2, "", "y"), (None, "naïve\tCAFÉ\n\ń", None), (5, "w " * 30_000, "z")]
    docs = make(rows, "doc_id long, text string, n_tokens string")
    want = {}
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.setdefault((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(decoded.encode()).hexdigest()))
    got = wordbpe.encode_report(docs).collect()
    assert len(got) == 5 and {tuple(r) for r in got} == set(want)
    encoded = wordbpe.encode_documents(docs)
    assert encoded.columns == ["doc_id", "text", "n_tokens", "token_ids"]
    for r in wordbpe.decode_documents(encoded).collect():
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.token_ids, skip_special_tokens=False)
    assert wordbpe.encode_report(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="token_ids"):
        wordbpe.encode_documents(encoded)


def test_bpe_query_on_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for r in QUERIES["op12_speculative_bpe"](spark, SF001).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


# hard negatives ------------------------------------------------------------------------------------

def mine_by_hand(rows, every=100, positives=5, negatives_=5):
    use = [(i, [math.floor(256 * x) for x in v], l, k) for k, (i, v, l) in enumerate(rows)
           if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, l, k in use:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, kk, m) for j, w, m, kk in use if kk != k)
        for ps, pid, _, _ in [s for s in scored if s[3] == l][:positives]:
            fit = [s for s in scored if s[3] != l and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:negatives_]
            out += [(i, pid, r + 1, s[1], -ps, -s[0]) for r, s in enumerate(fit)]
    return sorted(out)


def clustered(count, width=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(i, (centres[i % 6] * rng.uniform(0.5, 2) + 0.1 * rng.normal(size=width)).tolist(), int(rng.integers(0, 4)))
            for i in range(count)]


@pytest.mark.parametrize("shard_rows", [40, 2048])
def test_negatives_equal_brute_force(make, shard_rows):
    rows = clustered(500)
    same = rows[7][1]
    rows += [(1000 + i, same, i % 3) for i in range(200)]                      # one vector in a third of the rows
    rows += [(300, rows[3][1], 1), (1, None, 1), (2, [1.0] * 8, None), (3, [float("nan")] * 8, 1), (4, [None] + [1.0] * 7, 1),
             (5, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (2000, [0.0] * 8, 2), (2100, [], 2), (2001, [1.0, 2.0], 2)]
    got = negatives.hard_negatives(make(rows, "vec_id long, embedding array<double>, label int"), F.col("id") % 100 == 0,
                                   shard_rows=shard_rows).collect()
    assert sorted(map(tuple, got)) == mine_by_hand(rows)


def test_negatives_of_empty_and_extra_columns(make):
    schema = "vec_id long, embedding array<float>, label int, tag string, v int, shard string"
    rows = [(i, [float(i % 5), 1.0, -0.5], i % 2, "t", 1, "s") for i in range(30)]
    got = negatives.hard_negatives(make(rows, schema), F.col("id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == mine_by_hand([r[:3] for r in rows], every=10) and got
    for part in (make([], schema), make([(1, [1.0], 1, "t", 1, "s")], schema)):
        assert negatives.hard_negatives(part, F.col("id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(make([(100, [1e30, -1e30], 1, "t", 1, "s")], schema), F.col("id") % 100 == 0).count() == 0


def test_cover_tree_covers_and_skips():
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, (20, 16))
    points = centres[rng.integers(0, 20, 1500)] + rng.integers(-30, 30, (1500, 16))
    top = float((points.astype(float) ** 2).sum(axis=1).max())
    n = np.arange(1500)
    tree = negatives.CoverTree.unpack(negatives.CoverTree.build(points, n, n, n % 3, top).pack())
    lift = np.sqrt(top - (tree.points.astype(float) ** 2).sum(axis=1))
    full = np.c_[tree.points, lift]

    def below(k):
        return [tree.node[k]] if tree.leaf[k] else [x for c in range(tree.child[k], tree.child[k + 1]) for x in below(c)]
    assert sorted(below(0)) == list(range(len(tree.points)))          # every vector is one leaf
    for k in range(len(tree.node)):
        assert np.linalg.norm(full[below(k)] - full[tree.node[k]], axis=1).max() <= tree.radius[k] + 1e-9
    query = negatives.exact(points)[17]
    picked, member, score, work = tree.find(query, np.array([negatives.LOWEST]), np.array([negatives.HIGHEST]), 5, 17 % 3, True, 17)
    want = sorted(((-int(points[j] @ points[17]), j) for j in n if j % 3 == 17 % 3 and j != 17))[:5]
    assert [(-int(score[p]), int(tree.id[member[p]])) for p in picked[0]] == want
    assert work < len(tree.node) / 3                                 # other clusters are skipped
