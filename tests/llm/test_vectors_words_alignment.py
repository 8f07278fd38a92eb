"""Embedding near-duplicates, spelling variants and tokenizer alignment against brute force, with nulls, ties, repeated and empty rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from macrolith.llm import align, spelling, vecdup
from macrolith.llm import queries as q

SMALL = "/root/testdata/sf0.001"


# -- embeddings -------------------------------------------------------------------


def brute_vectors(rows, threshold=0.93):
    """vec_id, n_links, component_id, kept of (vec_id, label, vector) rows, all pairs compared."""
    ok = [r[1] is not None and r[2] is not None and all(v is not None and math.isfinite(v) for v in r[2]) and any(r[2]) for r in rows]
    unit = [np.array(r[2], float) / np.linalg.norm(np.array(r[2], float)) if o else None for r, o in zip(rows, ok, strict=True)]
    near = [{j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold} for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(rows))]
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return sorted(((r[0], len(near[i]), least.get(root[i]), r[0] == least.get(root[i])) for i, r in enumerate(rows)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def vector_rows(n, seed=1, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        v = rng.normal(size=dim)
        if out and k % 3:
            v = np.array(out[int(rng.integers(len(out)))][2]) + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.25, 0.4])
        out.append((k, int(rng.integers(3)) if k % 7 else 0, [float(np.float32(x)) for x in v]))
    return out


VECTORS = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize(("target", "block"), [(256, 1024), (8, 1024), (8, 5)])
def test_vectors_against_all_pairs(spark, target, block):
    rows = vector_rows(500)
    got = result(vecdup.near_duplicates(spark.createDataFrame(rows, VECTORS), target=target, block=block))
    assert got == brute_vectors(rows)


def test_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, 1, [1.0, 0.0]), (3, 1, [2.0, 0.0]), (3, 1, [2.0, 0.0]), (None, 1, [1.0, 0.01]), (7, None, [1.0, 0.0]), (8, 1, None), (9, 1, [0.0, 0.0]), (10, 1, [nan, 1.0]), (11, 1, [inf, 1.0]), (12, 1, [None, 1.0]), (13, 1, []), (14, 1, [1.0, 0.0, 0.0]), (15, 2, [1.0, 0.0]), (16, 1, [1e-30, 0.0]), (17, 2, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS + ", n_links int, cid string")
    assert result(vecdup.near_duplicates(df)) == brute_vectors(rows)
    assert vecdup.near_duplicates(df.limit(0)).count() == 0
    doubles = spark.createDataFrame([(1, "a", [1e200, 1e200]), (2, "a", [1e-200, 1e-200])], "vec_id long, label string, embedding array<double>")
    assert result(vecdup.near_duplicates(doubles)) == [(1, 1, 1, True), (2, 1, 1, False)]
    kept = vecdup.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.vec_id for r in kept.collect() if r.vec_id is not None) == [3, 3, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    o = rng.normal(size=64)
    o /= np.linalg.norm(o)
    q_ = o + 0.06 * rng.normal(size=64)
    q_ /= np.linalg.norm(q_)
    s, errors = float(o @ q_), []
    for r in range(400):
        turned = vecdup.rotate(np.stack([o, q_]), 0, seed=r)
        assert np.allclose(turned @ turned.T, [[1, s], [s, 1]])
        x = np.where(turned[0] > 0, 1, -1) / 8
        f = float(x @ turned[0])
        assert abs(float(x @ turned[1]) / f - s) <= math.sqrt(1 - f * f) / f * math.sqrt(1 - s * s) + 1e-12
        low, high = vecdup.bounds(np.array([f]), 64, s - 1e-9, 6.0)
        assert low[0] <= float(x @ turned[1]) / f <= high[0]
        errors.append(float(x @ turned[1]) / f - s)
    assert abs(np.mean(errors)) < 4 * np.std(errors) / 20


def test_most_pairs_are_dropped_by_their_estimate():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] + 0.05 * rng.normal(size=(200, 64))
    f, packed = vecdup.codes(vecdup.unit(x), 0, 1)
    b = vecdup.Bucket(x, f, packed, 0, 0, 1, 0.93, 6.0, vecdup.SEED)
    got = {(int(i), int(j)) for a, c in b.links(np.arange(400)) for i, j in zip(a, c, strict=True)}
    assert got == {(k, k + 200) for k in range(200)}
    assert b.seen[1] > 0.99 * b.seen[0] and b.seen[2] + b.seen[3] < 300


def test_recall_of_keys_at_the_threshold():
    rng = np.random.default_rng(5)
    bits, tables = vecdup.plan(100_000)
    a = vecdup.unit(rng.normal(size=(1000, 64)))
    side = rng.normal(size=(1000, 64))
    side = vecdup.unit(side - (side * a).sum(1)[:, None] * a)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * side
    ka, kb = (vecdup.keys_of(vecdup.codes(x, bits, tables)[1], bits, tables) for x in (a, b))
    assert bits > 6 and (ka == kb).any(1).mean() > 0.998


def test_query_of_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert result(q.op11_embedding_near_dedup(spark, SMALL)) == brute_vectors(rows)


# -- spelling ---------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_words(docs):
    c = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    n = {w: k for w, k in c.items() if len(w) >= 5 and k >= 3}
    by = {}
    for w in n:
        for k in range(len(w)):  # words one edit apart share a deletion, or one is the other's
            by.setdefault(w[:k] + w[k + 1 :], set()).add(w)
        by.setdefault(w, set()).add(w)
    form, count = {}, Counter()
    for w in n:
        found = {x for k in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))] for x in by[k] if near(w, x)}
        count[w] = len(found)
        best = min(found, key=lambda x: (-n[x], x)) if found else None
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


def words_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_automaton_numbers_and_errors():
    r = random.Random(0)
    for _ in range(200):
        words = sorted({"".join(r.choice("abé") for _ in range(r.randint(4, 8))) for _ in range(r.randint(1, 60))})
        a = spelling.Automaton(words)
        for w in words:
            half = len(w) // 2
            assert a.follow(a.start, 0, w, 0) == words.index(w)
            assert sorted(a.one_error(w, half)) == [k for k, x in enumerate(words) if near(w, x) and x[:half] == w[:half]]


def test_automaton_is_minimal():
    r = random.Random(4)
    stems = sorted(a + b for a in ("abcd", "efgh", "ijkl") for b in ("ing", "ings", "ed"))
    for words in [stems, *(sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(50)}) for _ in range(30))]:
        # As many states as prefixes differ in what may follow them.
        follow = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
        assert len(spelling.Automaton(words).next) == len(follow)


WORDS = "doc_id long, text string, word string, n int, root string"


@pytest.mark.parametrize(("prefix", "block"), [(4, 100_000), (2, 7), (3, 40)])
def test_spelling_against_brute_force(spark, prefix, block):
    r = random.Random(2)
    stems = ["".join(r.choice("abcdé") for _ in range(r.randint(4, 9))) for _ in range(40)]

    def vary(w):
        k = r.randrange(len(w))
        return r.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + r.choice("abcé") + w[k:], w[:k] + "x" + w[k + 1 :], w.upper()])

    docs = [(k, " ".join(vary(r.choice(stems)) for _ in range(60))) for k in range(60)]
    df = spark.createDataFrame([(*d, "w", 1, "r") for d in docs], WORDS)
    assert words_of(spelling.spelling_variants(df, prefix=prefix, block=block)) == brute_words(docs)


def test_spelling_edges(spark):
    long = "x" * 20_000
    docs = [(1, None), (2, ""), (3, "12 --"), (None, "colour colour colour color"), (4, "colour COLOUR colour color color"), (4, "colour COLOUR colour color color"), (5, f"{long} {long} {long}x {long}x {long}x {long}"), (6, "mapple×mapple÷mapple"), (7, "banana banane bananb banana banane bananb banana banane bananb"), (8, "a b cc dd")]
    df = spark.createDataFrame([(*d, "w", 1, "r") for d in docs], WORDS)
    assert words_of(spelling.spelling_variants(df)) == brute_words(docs)
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, letters=3)


def test_roots_of_long_chains(spark):
    chain = [(f"w{k:02d}", f"w{k + 1:02d}" if k < 40 else None) for k in range(41)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{k:02d}": "w40" for k in range(40)}


def test_query_of_spelling(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert words_of(q.op12_spelling_variants(spark, SMALL)) == brute_words(docs)


# -- alignment --------------------------------------------------------------------

A, B = q.tokenizer_path(q.BYTES), q.tokenizer_path(q.PIECES)


@pytest.fixture(scope="module")
def brute_align():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = align.byte_letters()

    def one(t):
        """n_a, n_b, groups, links of a text: all pairs of tokens compared by their bytes; None if the bytes don't come back."""
        if not t:
            return None
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        xa = [bytes(letters[c] for c in a.id_to_token(k)) for k in ia]
        xb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ib]
        if not b"".join(xa) == b"".join(xb) == (" " + t).encode():
            return None
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (xa, xb)]
        begin = [[0, *e[:-1]] for e in ends]
        links, at = [], 0
        for i in range(len(ia)):
            while at < len(ib) and ends[1][at] <= begin[0][i]:
                at += 1
            j = at
            while j < len(ib) and begin[1][j] < ends[0][i]:
                links.append((ia[i], ib[j]))
                j += 1
        groups, low = [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            to = [ends[0].index(e) + 1, ends[1].index(e) + 1]
            groups.append(",".join(map(str, ia[low[0] : to[0]])) + "|" + ",".join(map(str, ib[low[1] : to[1]])))
            low = to
        return len(ia), len(ib), groups, links

    def corpus(docs):
        found = [one(t) for _, t in docs]
        count = Counter(x for f in found if f for x in f[3])
        best = {}
        for (_, j), n in count.items():
            best[j] = max(best.get(j, 0), n)
        out = []
        for (i, _), f in zip(docs, found, strict=True):
            if f is None:
                out.append((i, 0, 0, 0, 0, 0, 0, ""))
                continue
            n_best = sum(count[x] == best[x[1]] for x in f[3])
            out.append((i, f[0], f[1], len(f[2]), len(f[3]), n_best, sum(count[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))
        return sorted(out, key=str)

    return one, corpus


def aligned(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


ODD = [None, "", " ", "  ", "a", "a  b", "\n\nfoo \n bar", "<|endoftext|> it's <s>", "▁x", "a▁b plain", "　x   y", "漢字 🎉 é", "x" * 5000, "word " * 3000, "\x00 a\x00 b", " private", "12 345 6,789.0", "tab\tend \r\n", "don't DON'T  we'll"]


def test_alignment_of_odd_texts(brute_align):
    r = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", " ", "　", "漢", "🎉", "'s", "the", " of", "\t", "<s>", "\x00", "ue", "12", "...", "\u0085", "​", "\r", " "]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    own = align.Aligner(A, B)
    assert own.cuts
    numbers, written, pairs, times = own.align(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        want = brute_align[0](t)
        if want is None:
            assert numbers[k].tolist() == [0, 0, 0, 0] and not written[k] and not pairs[k]
            continue
        assert numbers[k].tolist() == [want[0], want[1], len(want[2]), len(want[3])] and written[k].decode() == ";".join(want[2])
        got = Counter({(int(p) >> 16, int(p) & 0xFFFF): int(n) for p, n in zip(np.frombuffer(pairs[k], "<u4"), np.frombuffer(times[k], "<i4"), strict=True)})
        assert got == Counter(want[3])


def test_alignment_without_cuts_or_memo_is_the_same(monkeypatch):
    texts = pa.array(["one two  three\nfour", "it's fine", None, "again again"])
    plain, small = align.Aligner(A, B), align.Aligner(A, B)
    whole = align.Aligner(A, B)
    whole.cuts = False
    want = plain.align(texts)
    monkeypatch.setattr(align, "MEMO_BYTES", 1)
    for other in (small, whole):
        for _ in range(2):
            got = other.align(texts)
            assert (got[0] == want[0]).all() and list(got[1:]) == list(want[1:])


@pytest.mark.parametrize("block", [1 << 22, 50])
def test_corpus_alignment(spark, brute_align, block):
    docs = list(enumerate(ODD)) + [(5, "a  b"), (None, "a  b")]
    df = spark.createDataFrame([(*d, 1, b"z") for d in docs], "doc_id long, text string, n_a int, pairs binary")
    assert aligned(align.align_corpus(df, A, B, block=block)) == brute_align[1](docs)
    assert align.align_corpus(df.limit(0), A, B).count() == 0


def test_query_of_alignment(spark, brute_align):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert aligned(q.op13_tokenizer_alignment(spark, SMALL)) == brute_align[1](docs)


def test_group_products():
    assert align.group_products("1,2|3;4|5,6") == [(1, 3), (2, 3), (4, 5), (4, 6)] and align.group_products("") == []
    assert align.group_text("", A, B) == ""
