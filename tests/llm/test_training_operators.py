"""Each operator against brute force, a round trip or held-out labels, with nulls, empty and repeated rows, empty tables and clashing columns."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from macrolith.llm import bpe, chunks, decontaminate, html_main, langid, license, media, pll, simhash, tokenbin, toxicity
from macrolith.llm.components import components
from macrolith.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, n_words int, media string, spans int"


def docs_of(spark, texts, lang=None):
    rows = [(k, t, lang[k] if lang else "en", "s", len(t or ""), "x", 1, "y", 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


EDGE = [None, "", " \n\t ", "one", "One one ONE", "a b c d e f g", "a b c d e f g", "Ünï çödé 漢字 🎉", "x" * 5000, "word " * 3000, "<|endoftext|> it's"]


@pytest.fixture(scope="module")
def edge(spark):
    d = docs_of(spark, EDGE)
    return d.union(d.where("doc_id = 5"))


def brute_hits(words, items, window):
    hit, names = set(), set()
    for i, x in items:
        for k in range(max(1, len(x) - window + 1)) if x else ():
            q = x[k : k + window]
            for p in range(len(words) - len(q) + 1):
                if words[p : p + len(q)] == q:
                    names.add(i)
                    hit.update(range(p, p + len(q)))
    return hit, names


def test_automaton_against_brute_force():
    r = random.Random(3)
    for _ in range(300):
        alphabet = [b"a", b"b", b"c"][: r.randint(1, 3)]
        items = [(str(i), [r.choice(alphabet) for _ in range(r.randint(0, 9))]) for i in range(6)]
        window = r.randint(1, 5)
        a = decontaminate.Automaton(items, window)
        words = [r.choice([*alphabet, b"z"]) for _ in range(30)]
        spans, found = a.matches(words)
        hit, names = brute_hits(words, items, window)
        assert {a.ids[k] for k in found} == names
        assert [p for x, y in spans for p in range(x, y)] == sorted(hit)


def test_contamination_blocks_and_edges(spark, edge):
    items = spark.createDataFrame([(1, "a b c d"), (2, None), (3, ""), (4, "one"), (5, " ".join(f"w{k}" for k in range(40)))], "item_id long, text string")
    docs = edge.union(docs_of(spark, ["z " * 30 + " ".join(f"W{k}" for k in range(10, 30)) + " z" * 500]).withColumn("doc_id", F.lit(99).cast("long")))
    one = sorted(map(tuple, decontaminate.contamination(docs, items).drop("spans", "items").collect()), key=str)
    cut = sorted(map(tuple, decontaminate.contamination(docs, items, block_words=20).drop("spans", "items").collect()), key=str)
    assert one == cut and len(one) == 13
    by = {r[0]: r for r in one}
    assert by[0][1:3] == (0, 0) and by[3][1:4] == (1, 1, 1) and by[5][2] == 4 and by[99][2] == 20 and not by[99][5] and by[99][6] == 20
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    left = sorted(r.doc_id for r in kept.collect())
    assert left == sorted(r[0] for r in one if not r[5])
    assert left == sorted(r.doc_id for r in decontaminate.decontaminate(docs, items, block_words=20).collect())
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect())
    assert decontaminate.decontaminate(docs, items, longest=13).where("doc_id = 99 and text not like '%W15%'").count() == 1
    assert decontaminate.excise("Aa, bb! cc dd", [(1, 3)]) == "Aa,  dd"


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t, [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TRICKY = ["a,. b,, c'. 's, x\x1c, é, İ, Σας, ΟΔΟΣ. <|endoftext|>, <|EndOfText|>", "﷽,", "it's we'll 'rex!'s 1234 ½²", "\u0085 x y é ñ.", "'", "<|endoftext|>" * 3]


def test_token_files_round_trip(spark, edge):
    out = "file:///tmp/macrolith-test-tokens"
    docs = edge.union(docs_of(spark, TRICKY).withColumn("doc_id", F.col("doc_id") + 100))
    manifest = tokenbin.write_tokens(docs, tokenizer_path(), out, parts=3)
    got = sorted(tokenbin.read_tokens(manifest, out).collect(), key=lambda r: r.start)
    rows = sorted((r.doc_id, r.text) for r in docs.fillna("").collect())
    _, ids = library([t for _, t in rows])
    start = 0
    for r, (d, _), want in zip(got, rows, ids, strict=True):
        want = [*want, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (d, start, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert tokenbin.token_files(docs.limit(0), tokenizer_path()).count() == 0


def test_token_files_without_ids_hot_ids_and_small_files(spark):
    texts = ["a b c"] * 60 + ["d e", None, "f", "word " * 200]
    docs = docs_of(spark, texts).withColumn("doc_id", F.expr("CASE WHEN doc_id < 40 THEN 7 WHEN doc_id = 60 THEN NULL WHEN doc_id = 61 THEN NULL ELSE doc_id END"))
    out = "file:///tmp/macrolith-test-tokens"
    manifest = tokenbin.write_tokens(docs, tokenizer_path(), out, parts=6, file_bytes=40)
    got = sorted(tokenbin.read_tokens(manifest, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got if r.doc_id is not None) + [None, None]
    assert sorted(len(r.ids) for r in got if r.doc_id is None) == [1, 3] and sum(r.doc_id == 7 for r in got) == 40
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    files = manifest.collect()
    # The hot id lies in files of several ranges; a file ends soon after its limit.
    assert len(files) > 6 and sum(f.docs for f in files) == len(texts) and sum(f.tokens > 40 for f in files) <= 1
    with pytest.raises(ValueError):
        tokenbin.write_tokens(docs.withColumn("doc_id", F.lit("x")), tokenizer_path(), out)


def test_chunks_equal_the_library_with_a_tiny_memo():
    import pyarrow as pa

    r = random.Random(7)
    texts = [*EDGE, *TRICKY, *["".join(r.choice(s) for _ in range(r.randint(1, 80))) for _ in range(400) for s in ("ab.,'- ", "the (an).;[]\" ", "éß!? é.\n", "a'slr!. <|>", "İ.,Σσ Σ.", "1.2,½ ²")]]
    want = library(texts)[1]
    for size in (1 << 12, 1 << 24):
        e = tokenbin.LibraryEncoder(tokenizer_path(), 2, size)
        for at in range(0, len(texts), 500):
            ids, begin = e.ids(pa.array(texts[at : at + 500]))
            assert [x.tolist() for x in np.split(ids, begin[1:-1])] == want[at : at + 500]
        assert e.table.held <= size


def test_words_read_symbol_by_symbol_equal_merges():
    e, r = bpe.Encoder(tokenizer_path()), random.Random(8)
    words = "a hello thereof übermäßig 漢字 xyzzyxyzzy aaaaaaaaaaaaaaaaaaaaa".split()
    words += ["".join(r.choice(letters) for _ in range(r.randint(1, 400))) for letters in ("ab", "thean", "aeiouäöß", "!?.'", "漢é🎉a", "in", "abcdefghijklmnopqrstuvwxyz") for _ in range(60)]
    words += ["".join(r.choice(e.spec.merges[r.randrange(20_000)]).replace("</w>", "") for _ in range(60)) for _ in range(100)]
    early = 0
    for w in words:
        symbols = e.symbols(w, True)
        want = e.merge(list(symbols))
        t, got, most = bpe.Word(e), [], 0
        for at in range(0, len(symbols) - 1, 7):
            got += t.push(symbols[at : min(at + 7, len(symbols) - 1)], False)
            assert got == want[: len(got)]
            most = max(most, t.held)
        early += len(got) > 0
        assert got + t.push(symbols[-1:], True) == want
        # What is held is bounded by the merge list, not by the word.
        assert most <= e.spec.lookahead + e.longest
    assert early > 400 and e.fed == sum(len(e.symbols(w, True)) for w in words)


def test_every_chunk_goes_through_the_transducer(monkeypatch):
    """Fed in pieces, whatever their size; all ids come from what words emit, symbol by symbol."""
    import pyarrow as pa

    emitted = []
    push = bpe.Word.push
    monkeypatch.setattr(bpe.Word, "push", lambda self, symbols, ended: (lambda out: (emitted.append((len(out), ended)), out)[1])(push(self, symbols, ended)))

    texts = [*EDGE, *TRICKY, "a b " * 500 + "y" * 900 + " end", "\n" * 900]
    want = library(texts)[1]
    for piece in (64, 1000, bpe.PIECE):
        lanes = bpe.Lanes(tokenizer_path(), piece=piece)
        emitted.clear()
        got, fed_rows = [[] for _ in texts], 0
        for fed, ids, begin in lanes.rounds(pa.array(texts)):
            fed_rows += len(fed)
            for k, x in zip(fed, np.split(ids, begin[1:-1]), strict=True):
                got[k] += x.tolist()
        assert got == want and fed_rows > len(texts)
        # Each distinct chunk's symbols were fed, and the text without a blank gave ids before its end.
        assert lanes.e.fed > lanes.table.learned and sum(n for n, _ in emitted) > 0 and any(n and not ended for n, ended in emitted)
        decoded = [bpe._Digests() for _ in texts]
        for fed, ids, begin in lanes.rounds(pa.array(texts)):
            for k, n, *x in zip(fed, np.diff(begin).tolist(), *[bpe._pieces(t, ids, begin) for t in (lanes.numbers, lanes.tokens, lanes.bytes)], strict=True):
                decoded[k].feed(n, *x)
        t, plain = library([])[0], bpe.Decoder(lanes.e.spec)
        for d, ids in zip(decoded, want, strict=True):
            digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
            assert d.close() == (len(ids), digest(" ".join(map(str, ids))), digest(t.decode(ids, skip_special_tokens=False)), digest(plain.decode(ids)))


def test_words_of_a_batch():
    import pyarrow as pa

    texts = [*EDGE, "A-b c", "--", "x", " é'É 1a"]
    index, words, begin = chunks.words_of_batch(pa.array(texts))
    assert [[words[k] for k in x] for x in np.split(index, begin[1:-1])] == [decontaminate.words_of(t) for t in texts]
    assert chunks.words_of_batch(pa.array([], pa.string()))[2].tolist() == [0]


def test_frames_are_independent_and_checked():
    out = io.BytesIO()
    w = tokenbin.FrameWriter(out, 2, frame_bytes=64)
    want = {k: np.arange(k, dtype="<u2") for k in range(50)}
    for k, v in want.items():
        w.add(k, v.tobytes())
    w.close()
    raw = out.getvalue()
    r = tokenbin.FrameReader(io.BytesIO(raw), len(raw))
    assert len(r.frames) > 10 and all((r.find(k)[0] == v).all() for k, v in reversed(want.items()))
    bad = bytearray(raw)
    bad[r.offsets[3] + 8] ^= 0xFF
    broken = tokenbin.FrameReader(io.BytesIO(bytes(bad)), len(bad))
    assert (broken.find(3)[0] == want[3]).all()
    with pytest.raises(Exception):
        broken.frame(3)


def test_bpe_against_library(spark, edge):
    e = bpe.Encoder(tokenizer_path())
    r = random.Random(1)
    texts = [t or "" for t in EDGE] + TRICKY
    for _ in range(40):
        letters = r.choice(["ab", "thean", "aeiouäöß", "!?.'", "a'slr!", "漢é🎉a", "<|endoftext|>a", "in"])
        texts.append("".join(r.choice(letters) for _ in range(r.randint(1, 3000))))
    texts += ["".join(r.choice(e.spec.merges[r.randrange(3000)]).replace("</w>", "") for _ in range(600)) for _ in range(20)]
    t, want = library(texts)
    joined = bpe.Decoder(e.spec, joined=True)
    most = 0
    for x, ids in zip(texts, want, strict=True):
        assert e.encode(x) == ids, x[:60]
        assert joined.decode(ids) == t.decode(ids, skip_special_tokens=False)
        tr, out, at = bpe.Transducer(e), [], 0
        while at < len(x):
            n = r.randint(1, 300)
            out += tr.feed(x[at : at + n])
            at += n
            most = max(most, len(tr.raw) + len(tr.text) + (tr.open.held if tr.open else 0))
        assert out + tr.close() == ids, x[:60]
    assert most < 2 * (300 + e.spec.lookahead + e.longest)  # constant memory
    assert bpe.Decoder(e.spec).decode(e.encode("Grüße, 漢字 ok")) == "grüße , 漢字 ok "
    rows = {r.doc_id: r for r in bpe.encode_decode(edge, tokenizer_path()).collect()}
    ids = library([EDGE[7]])[1][0]
    assert rows[7].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and rows[0].n_tokens == 0
    assert bpe.encode_decode(edge.limit(0), tokenizer_path()).count() == 0


def test_fingerprint_against_plain_version():
    import xxhash

    for t in [*EDGE, "A b C d", "a b"]:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_keys_meet_all_near_segments():
    keys = [set(k.tolist()) for k in simhash.segment_keys()]
    r = random.Random(5)
    assert max(map(len, keys)) <= 6
    for x in r.sample(range(1 << 16), 3000):
        assert all(keys[x] & keys[x ^ 1 << b] for b in range(16))


def near_components(fps):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(k) for k in range(len(fps))]


@pytest.mark.parametrize("block", [2048, 8])
def test_links_connect_what_brute_force_connects(spark, block):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(20)] + [0]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(30)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block))
    of = {r.vertex: r.root for r in found.collect()}
    want = near_components(fps)
    groups: dict[int, set] = {}
    for x, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(of.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_near_duplicates_and_survivors(spark, edge):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == "0" * 16 and by[2].component_id == 0 and by[6].component_id == 5
    kept = simhash.one_of_each(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows})
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


def test_survivors_without_ids_and_with_repeated_ids(spark):
    docs = docs_of(spark, ["a b c d", "a b c d", "a b c d", "x y z", "x y z", "p q"]).withColumn("doc_id", F.expr("CASE doc_id WHEN 0 THEN NULL WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE doc_id END"))
    assert sorted((r.doc_id or 0, r.text) for r in simhash.one_of_each(docs).collect()) == [(0, "x y z"), (5, "p q"), (7, "a b c d")]
    other = docs_of(spark, ["a b c d", "e f g h"]).withColumn("doc_id", F.lit(3).cast("long"))
    assert simhash.one_of_each(other).count() == 2


def test_ordinal_regression_orders_grades(spark, edge):
    r = random.Random(2)
    texts, grades = [], []
    for _ in range(600):
        g = r.randrange(4)
        texts.append(" ".join([r.choice(["fine", "plain", "day", "sun"]) for _ in range(20)] + ["vile"] * (g >= 1) + ["foul"] * (g >= 2) + ["awful"] * (g >= 3)))
        grades.append(g)
    m = toxicity.Ordinal.fit([toxicity.features(t) for t in texts], grades)
    assert (np.diff(m.thresholds) > 0).all()
    expect = [m.probabilities(toxicity.features(t)) @ m.grades for t in ("fine day", "vile day", "vile foul day", "vile foul awful day")]
    assert expect == sorted(expect) and expect[0] < 0.5 and expect[3] > 2.5
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, g if k % 2 else None, 1) for k, g in enumerate(grades)], "doc_id long, toxic int, text int")
    found = toxicity.severity(docs, labels).collect()
    assert np.mean([x.grade == g for x, g in zip(sorted(found), grades, strict=True)]) > 0.95
    none = toxicity.severity(edge, labels.limit(0)).collect()
    assert len(none) == 12 and all(x.severity == 0 and not x.toxic for x in none)
    assert toxicity.without_toxic(edge, labels).columns == edge.columns
    assert toxicity.severity(edge.limit(0), labels).count() == 0


def test_toxicity_on_held_out_labels(spark):
    d, y = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SMALL}/../sf0.01/labels.parquet")
    rows = toxicity.severity(d, y.where("doc_id % 3 <> 0")).withColumnRenamed("toxic", "pred").join(y.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r.pred == bool(r.toxic) for r in rows]) > 0.93
    assert sum(r.pred and not r.toxic for r in rows) == 0


def test_language_on_held_out_documents(spark, edge):
    from macrolith.llm.queries import op7_language

    rows = op7_language(spark, f"{SMALL}/../sf0.01").join(spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.96
    m = langid.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = {r.doc_id: r for r in langid.identify(edge, m).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (0, 1, 2))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.train(edge.limit(0)).predict("hello") == ("und", 0.0)
    assert langid.train(edge).predict("hello") == ("en", 1.0)
    assert langid.with_language(edge, m).columns == edge.columns
    assert m.predict("½ ² 12 ③ Ⅷ _") == ("und", 0.0) and m.predict("x")[0] != "und"


def test_short_clean_texts_keep_their_language(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    m = langid.train(docs)
    texts = [" ".join(r.text.split()[:3]) for r in docs.where("lang is not null").orderBy("doc_id").limit(300).collect()]
    found = [m.predict(t) for t in texts]
    # Whole bytes tie for many of them.
    tied = sum(len({*sorted(m.sizes(t.lower().encode()))[:2]}) == 1 for t in texts)
    assert tied > 10 and sum(k != "und" and x < langid.MARGIN for k, x in found) <= 2
    assert langid.with_language(docs_of(spark, texts), m).count() >= len(texts) - 4
    # Probabilities of all bytes in a place add up to one.
    c = langid.Contexts(b"the cat and the hat\n" * 3)
    assert abs(sum(2 ** (c.bits(b"the") - c.bits(b"the" + bytes([k]))) for k in range(256)) - 1) < 1e-9


def test_samples_are_bounded_when_ids_repeat(spark):
    docs = docs_of(spark, ["der die das"] * 300 + ["the and of"] * 300, ["de"] * 300 + ["en"] * 300)
    one = langid.train(docs.withColumn("doc_id", F.lit(None).cast("long")), salts=4)
    assert one.samples == {"de": b"der die das\n", "en": b"the and of\n"}
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int")
    m = toxicity.train(docs.withColumn("doc_id", F.lit(3).cast("long")).union(docs), labels)
    assert m.grades.tolist() == [0, 1]
    # The size of a text does not switch the method: rotations make up about as many bytes.
    assert len({langid.Model({"en": b"the and of " * 50, "de": b"der die das " * 50}).predict("the and " * n)[0] for n in (1, 10, 100, 128, 129, 2000)}) == 1


def test_media_round_trip(spark, edge):
    rows = media.media_features(edge).collect()
    assert len(rows) == 12
    for r in rows:
        raw = (EDGE[r.doc_id] or "").encode()
        n, pay = media.payload(EDGE[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(raw), max(64, -(-len(raw) // 64) * 64)) and pay.rstrip(b"\0") == raw.rstrip(b"\0")
        assert r.payload_sha256 == hashlib.sha256(pay).hexdigest() and r.tail_crc32 == zlib.crc32(pay[-64:])
        stored = media.write_wav(pay)
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest() and media.read_wav(stored) == pay and r.media_bytes == len(stored)
    tone = bytes(int(128 + 100 * np.sin(2 * np.pi * 20 * k / 256)) for k in range(4096))
    bins, _ = media.peaks(tone)
    assert (bins[:, 0] == 20).all()
    t, c = media.pairs(bins)
    assert ((c >> 6 & 0x1FF) == 20).all() and (np.diff(t) >= 0).all()
    assert media.media_features(edge.limit(0)).count() == 0


def test_last_samples_are_in_a_frame():
    one, other = bytes(range(256)) + b"a" * 64, bytes(range(256)) + bytes(range(40, 168, 2))
    assert len(media.peaks(one)[0]) == 2 and (media.peaks(one)[0] != media.peaks(other)[0]).any()
    assert [len(media.peaks(bytes(n))[0]) for n in (64, 256, 320, 384, 448)] == [1, 1, 2, 2, 3]


def test_network_gradient_and_scores(spark, edge):
    net = pll.Network(hidden=4, classes=3)
    net.flat = net.flat.astype(np.float64)
    rng = np.random.default_rng(0)
    ids = np.concatenate(([9, 9], rng.integers(0, 9, 200), [9, 9]))
    rows, target = net.rows(ids), ids[2:-2]
    w = net.parts(net.flat)
    # Probabilities of all tokens at one place add up to one.
    total = sum(np.exp(net.forward(w, rows[:1], np.array([t]))[0][0]) for t in range(9))
    assert abs(total - 1) < 1e-9
    loss = lambda flat: -net.forward(net.parts(flat), rows, target)[0].mean()
    flat = net.flat.copy()
    net.step(flat, rows, target, 1e-3)
    move = (net.flat - flat) / 1e-3
    at = 0
    for name, shape in net.shapes.items():
        size = int(np.prod(shape))
        for k in rng.integers(at, at + size, 5):
            up, down = net.flat.copy(), net.flat.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 * (8 if name == "table" else 1) - move[k]) < 1e-4, name
        at += size
    docs = docs_of(spark, ["the cat sat on the mat"] * 400 + ["mat the on sat cat the"] + [None, ""])
    m = pll.train(docs, rounds=4)
    got = {r.doc_id: r for r in pll.score(docs, m).collect()}
    assert got[0].pll > got[400].pll + 1 and got[401].pll == 0 and got[402].perplexity is None and got[0].n_tokens == 6
    assert pll.score(edge.limit(0)).count() == 0 and pll.score(edge).count() == 12


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(120)
    got = []
    for n in (1, 8):
        d = docs.repartition(n, F.xxhash64("text"))
        got.append(sorted(map(tuple, pll.score(d, pll.train(d, shard=9000)).collect())))
    assert got[0] == got[1]


def test_vocabulary_counts_everything(spark):
    docs = docs_of(spark, ["b a a", "A c b", None])
    assert pll.vocabulary(docs, 2) == [b"a", b"b"]


def test_rare_words_score_by_their_own_counts(spark):
    # qaaz and qbbz share a hashed entry, as their length, first and last byte are equal.
    docs = docs_of(spark, [" ".join(f"f{k}x" for k in range(1000))] * 6 + ["qaaz"] * 4 + ["qbbz", None])
    m = pll.train(docs)
    first = list(m.ids)
    got = {r.doc_id: r for r in pll.score(docs, m).collect()}
    # Counts that are joined give what counts that workers hold give.
    assert len(m.known) == 1002
    joined = pll.Scorer(first, m.net, m.counts, known=0)
    assert len(joined.known) == 960
    for r in pll.score(docs, joined).collect():
        assert abs(r.pll - got[r.doc_id].pll) < 0.002 and r.n_tokens == got[r.doc_id].n_tokens
    assert abs(got[6].pll - got[10].pll - np.log(4)) < 0.002 and got[11].pll == 0
    unseen = {r.doc_id: r for r in pll.score(docs_of(spark, ["qccz", "qbbz"]), m).collect()}
    assert unseen[1].pll == got[10].pll and abs(unseen[0].pll - unseen[1].pll - 4 * pll.SPELL) < 0.002
    # The shares of an entry's words and of those never seen add up to one.
    slot = pll.bucket(b"qaaz")
    n = {bytes(r.word): r.n for r in m.counts.collect()}
    rare = sum(v for w, v in n.items() if w not in first and pll.bucket(w) == slot)
    assert len(n) == 1002 and abs(np.exp(m.held[slot]) - rare - 1) < 1e-6


def test_edits_against_plain_dynamic_program():
    r = random.Random(4)
    for _ in range(100):
        t, b = [[r.choice("abc") for _ in range(r.randint(1, n))] for n in (6, 12)]
        d = [[0] * (len(b) + 1)] + [[k] + [0] * len(b) for k in range(1, len(t) + 1)]
        for i in range(1, len(t) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j - 1] + (t[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
        assert license.edits(t, b) == min(d[-1])


_ART = "<p>The committee met on Tuesday to discuss the new budget for the town, and agreed on most points.</p><p>Another paragraph follows with more words about the matter at hand and its history.</p>"
_HEAD = "<html><body><nav><a href=/>Home</a></nav>"


@pytest.fixture(scope="module")
def chain():
    return html_main.train()


@pytest.mark.parametrize(
    ("page", "title"),
    [
        (f"{_HEAD}<article><h1>Title of it</h1>{_ART}</article><div class='zzq-disc'><div>Bob wrote: nice article!</div><div>Ann: I disagree with this</div></div>", True),
        (f"{_HEAD}<article><h1>Title of it</h1>{_ART}</article><div class='cmts'><p>Bob: nice article!</p><p>Ann: I disagree with this.</p></div>", True),
        (f'{_HEAD}<main><h1>Title of it</h1>{_ART}<div class="promo-box">Buy now and save 20%</div></main>', True),
        (f"<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td><h1>Title of it</h1>{_ART}</td></tr></table>", True),
        (f"<body><div class='x1'>{_ART}</div>", False),
        (f"{_HEAD}<article><h1>Title of it</h1>{_ART}<div class='cmts'><p>Bob: nice article!</p></div></article>", True),
    ],
)
def test_layouts_whose_names_say_little(chain, page, title):
    want = ["Title of it"] * title + ["The committee met on Tuesday to discuss the new budget for the town, and agreed on most points.", "Another paragraph follows with more words about the matter at hand and its history."]
    assert html_main.main_text(page, chain) == "\n".join(want)


def test_extraction_of_long_pages_and_clashing_columns(spark, chain):
    long = _HEAD + "<article>" + _ART * 4000 + "</article>"
    rows = [(1, "u", long, "t", 5), (1, "u", long, "t", 5), (2, None, None, "t", 5), (None, "v", "", None, None), (3, "w", "<p", "t", 1), (4, "x", "plain words without a tag", "t", 1)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r.page_id), r.url, r.n_chars, r.text.count("\n")) for r in html_main.extract(d, chain).collect())
    assert got[0][0] == "1" and got[0] == got[1] and got[0][3] == 7999 and [g[2] for g in got if g[0] in ("2", "3", "None")] == [0, 0, 0]
    assert html_main.extract(d.limit(0), chain).count() == 0
    assert [f.name for f in html_main.extract(d, chain).schema] == ["page_id", "url", "text", "n_chars"]


#: Usual ways to say under which license something is, and which one.
PHRASINGS = """MIT: This project uses the MIT License|Released under the terms of the MIT license|Licensed under the MIT License|distributed under the MIT license|available under the MIT License|The code is released under the MIT license, see LICENSE|license: MIT License|covered by the MIT License
Apache-2.0: licensed under Apache 2.0|Licensed under the Apache License 2.0|released under the Apache 2.0 license|Distributed under the Apache License, Version 2.0|available under the Apache Software License 2.0|under the terms of the Apache License, Version 2.0|provided under the Apache 2.0 license
GPL-2.0: This software is released under the GNU GPL v2 or later|licensed under the GPLv2|under the terms of the GNU General Public License v2|distributed under the GNU General Public License version 2
GPL-3.0: licensed under GPLv3|released under the GNU GPL version 3|under the terms of the GNU General Public License version 3
LGPL-2.1: licensed under the GNU LGPL v2.1|under the terms of the GNU Lesser General Public License v2.1
AGPL-3.0: licensed under the GNU AGPL v3|released under the AGPLv3
BSD-3-Clause: Available under the BSD 3-clause license|licensed under the 3-Clause BSD License|distributed under the BSD 3-Clause License
BSD-2-Clause: released under the BSD 2-Clause License
ISC: licensed under the ISC license|distributed under the ISC License
MPL-2.0: licensed under MPL 2.0|available under the Mozilla Public License 2.0|under the terms of the Mozilla Public License v2.0
CC-BY-4.0: licensed under CC BY 4.0|published under the Creative Commons Attribution 4.0 License
CC-BY-NC-ND-4.0: Creative Commons Attribution-NonCommercial-NoDerivatives 4.0|Published under CC BY-NC-ND 4.0
EPL-2.0: licensed under the Eclipse Public License 2.0
BSL-1.0: distributed under the Boost Software License 1.0
Unlicense: released under the Unlicense""".splitlines()


@pytest.mark.parametrize(("want", "text"), [(k, t) for line in PHRASINGS for k, _, ts in [line.partition(": ")] for t in ts.split("|")])
def test_usual_phrasings_of_licenses(want, text):
    found = {f[0] for f in license.Scanner().scan(f"Some words of no use.\n{text}.\nAnd more of them.")[1]}
    assert any(re.fullmatch(rf"{re.escape(want)}(-named|-name|-short|-long)?", f) for f in found) and len(found) == 1


@pytest.mark.parametrize("text", ["Der Hund ging mit der Katze unter der Lizenz", "an apache helicopter under the bridge", "license to chill", "BSD was released in 1977", "the eclipse of 2024 was public", "a boost for software", "under the GNU license", "general public opinion version 3", "Licensed under the Apache License, Version 1.1"])
def test_plain_words_are_no_license(text):
    assert license.Scanner().scan(text)[1] == []


def test_license_scan(spark, edge):
    texts = [f"some words\nx {t} and more words\n" for t in license.TEMPLATES.values()]
    rows = sorted(license.scan(docs_of(spark, [*texts, "a license to chill", "Licensed under CC BY-SA 4.0.", None])).collect())
    for r, name in zip(rows, license.TEMPLATES, strict=False):
        assert name in r.licenses.split(",") and r.n_confirmed >= 1
    assert rows[-3].licenses == "" and rows[-3].n_blocks == 1 and rows[-1].n_blocks == 0
    assert len(license.scan(edge).collect()) == 12 and license.scan(edge.limit(0)).count() == 0
    # Notices where blocks are cut and overlap count once each.
    for gap in (3, 20, 40, 41, 47, 90):
        text = ("Released under the MIT License. " + "word " * gap) * 120
        assert [f[0] for f in license.Scanner().scan(text)[1]] == ["MIT"] * 120, gap


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0-short"]),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0-short"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0-short"]),
        ("Licensed under CC BY-NC 2.5.", []),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 1.", []),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0-long"]),
        ("Licensed under the Mozilla License, Version 2.0.", ["MPL-2.0-short"]),
        ("Licensed under the Foo License, Version 2.0.", []),
        ("This work is licensed under the GNU General Public Licence, version 3.0.", ["GPL-3.0"]),
        ("SPDX-License-Identifier: MIT-0", ["MIT-0-spdx"]),
        ("SPDX-License-Identifier: (GPL-2.0-only OR Apache-2.0)", ["Apache-2.0-spdx", "GPL-2.0-only-spdx"]),
        ("Released under the MIT License. " * 2, ["MIT", "MIT"]),
    ],
)
def test_licenses_differ_by_their_deciding_words(text, want):
    assert sorted(f[0] for f in license.Scanner().scan(f"some words\nx {text} and more words\n")[1]) == want


def test_leaf_blocks():
    text = lambda p: [b.text for b in html_main.leaf_blocks(p)]
    assert text("<body><p>a <b>b</b><br>c<p>d &amp; &lt;e&gt;</p>f<!-- x <p> --><script>var t='</p>';</script>g") == ["a b c", "d & <e>", "fg"]
    assert text('<div title="a>b">x</div><ul><li>1<li>2</ul>y < z') == ["x", "1", "2", "y < z"]
    assert text("<head><title>t</title></head><body>a<style>p{}</style> b</body>") == ["a b"]
    assert text(None) == [] and text("") == [] and text("<p") == []


def test_marks_of_long_blocks():
    text = "We use cookies. " * 200
    block = html_main.leaf_blocks(f"<p>{text}</p>")[0]
    assert len(block.text) > 2000 and {"mark cookie", "mark sentence"} <= set(html_main.text_features(block, 0, 1))


def test_chain_on_pages_it_was_not_trained_on(spark):
    c = html_main.train()
    wrong = total = 0
    for page, labels in html_main.labelled_pages(150, 77):
        got = c.label(html_main.leaf_blocks(page))
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong < 0.015 * total
    pages = spark.createDataFrame([(1, "u", None, "z"), (2, None, "", "z"), (3, "u", "<nav><a href=x>Home</a></nav><article><h1>T</h1><p>One two three.</p></article><footer>&copy; me</footer>", "z")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in sorted(html_main.extract(pages, c).collect(), key=lambda r: r.page_id)] == [(1, "", 0), (2, "", 0), (3, "T\nOne two three.", 16)]


def test_viterbi_is_the_best_path():
    c = html_main.Chain(["bias"], np.array([0.3]), np.array([[0.5, -0.2], [-0.7, 0.1]]), np.array([0.2, -0.1]))
    blocks = html_main.leaf_blocks("<p>a<p>b. <a href=x>x</a><p>c<p>d" * 2)
    got = c.label(blocks)
    import itertools

    e = 0.3

    def value(y):
        return c.start[y[0]] + sum(e * k for k in y) + sum(c.moves[a][b] for a, b in zip(y, y[1:], strict=False))

    assert value(got) == max(value(y) for y in itertools.product((0, 1), repeat=len(blocks)))
