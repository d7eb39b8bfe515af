"""Operators against brute force, the libraries, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import fuzzy_lexicon, html_extract, line_dedup, packing, quality, secret_scan, sentence_pieces, shared, simhash, simhash_bits, telephony, token_counts, toxicity

pub = pytest.importorskip("public_tokenizers")
BPE, PIECES = pub.path("byte_bpe_50k.json"), pub.path("piece_bpe_32k.model")
PARTS = ["'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "the", "th", "é", "ñ", "1", "²", "中", "🙂", "!", "'", "<|endoftext|>", "　", "\x1c", "\x85", "'S", "don't", "́", "=" * 30, "ing", "▁", "\x00", "<s>", "<0x0A>", "www", "hello world"]


def mixed(n, seed=0, most=25):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_token_counts(library):
    texts = mixed(4000)
    got = token_counts.TokenCounter(BPE).counts([t.encode() for t in texts])
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    small = token_counts.TokenCounter(BPE, max_states=50)
    assert all((small.counts([t.encode() for t in texts[k : k + 100]]) == got[k : k + 100]).all() for k in range(0, 1000, 100))


def test_state_maps_compose():
    r = np.random.default_rng(0)
    maps = r.integers(0, 8, (37, 8)).astype(np.uint8)
    want, state = [], np.arange(8)
    for m in maps:
        state = m[state]
        want.append(state)
    assert (token_counts.scan_maps(maps) == np.array(want)).all()
    data = np.frombuffer("It's  a test, isn't it?\n\n 'tis ''s x".encode() + b"\xff", np.uint8)
    sym = token_counts.symbols(data)
    assert all((token_counts.starts(sym, chunk) == token_counts.starts(sym, 1000)).all() for chunk in (1, 2, 3, 7, 64))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = lib
    ids = lib.encode(text, add_special_tokens=False).ids
    assert token_counts.counter(BPE).counts([text.encode("utf-8", "surrogatepass")]).tolist() == [len(ids)]
    assert np.frombuffer(packing.word_ids(BPE).encode(text), "<u4").tolist() == ids


def test_pieces():
    import sentencepiece

    lib, model = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentence_pieces.PieceModel(PIECES, 50)
    for t in [*mixed(3000, 1), "a" * 5000, "▁" * 40 + "x"]:
        ids = np.frombuffer(model.encode(t), "<u4").tolist()
        assert ids == lib.encode(t)
        both = [model.begin, *ids, model.end]
        assert model.decode(both) == lib.decode(both).encode()


def test_piece_query(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(mixed(50, 2))], "doc_id long, text string")
    for r in sentence_pieces.encode_documents(df, PIECES, with_ids=True).join(df, "doc_id").collect():
        ids = lib.encode(r.text, add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_packing(spark, library):
    r = random.Random(5)
    texts = [" ".join(r.choice(["alpha", "beta", "x", "the", "é"]) for _ in range(r.choice([0, 1, 5, 50, 400, 3000]))) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for limits in ({}, {"max_segments": 3}, {"max_loss": 300, "loss_start": lambda i, n: 0 if i % 2 == 0 else n}):
        rows = packing.pack_documents(df, BPE, window=16, **limits).collect()
        ids = [np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
        by_doc, by_seq = {}, {}
        for x in rows:
            assert x.ids_crc32 == zlib.crc32(ids[x.doc_id][x.start : x.start + x.length].tobytes()) and x.length > 0
            assert x.doc_tokens == len(ids[x.doc_id])
            by_doc.setdefault(x.doc_id, []).append((x.start, x.length))
            by_seq.setdefault(x.sequence_id, []).append((x.offset, x.length, x.doc_id))
        for k, pieces in by_doc.items():
            at = 0
            for start, n in sorted(pieces):
                assert start == at
                at += n
            assert at == len(ids[k])
        assert len(by_doc) == len(texts)
        for pieces in by_seq.values():
            at = 0
            for offset, n, _ in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 1024 and len(pieces) <= limits.get("max_segments", 64)
            assert sum(n for _, n, k in pieces if k % 2 == 0) <= limits.get("max_loss", 1024) or "max_loss" not in limits
        if "max_loss" not in limits:
            waste = sum(0 if n & (n - 1) == 0 else 1024 - n for n in (sum(p[1] for p in s) for s in by_seq.values()))
            assert waste == 0


@pytest.mark.parametrize("sizes", [[1], [3], [12], range(1, 17), [1, 900]])
def test_short_examples_need_no_padding(sizes):
    r = random.Random(1)
    lengths = [r.choice([*sizes]) for _ in range(3000)]
    packer = packing.Packer(1024, 64, 1024)
    packed = [s for k, n in enumerate(lengths) for s in packer.add([(k, 0, n, n)])] + list(packer.finish())
    totals = [sum(p[2] for p in s) for s in packed]
    assert sum(totals) == sum(lengths) and all(n & (n - 1) == 0 and len(s) <= 64 for n, s in zip(totals, packed, strict=True))
    pieces = sorted((p[0], p[1], p[2]) for s in packed for p in s)
    at: dict = {}
    for k, start, n in pieces:
        assert start == at.get(k, 0) and n > 0
        at[k] = start + n
    assert at == dict(enumerate(lengths))


def test_loss_limit_of_answers():
    """Prompts bear no loss: many fit beside few answers, and no sequence has more than its share."""
    r = random.Random(2)
    packer, lengths = packing.Packer(256, 16, 64), [(r.randint(1, 200), r.randint(0, 100)) for _ in range(400)]
    packed = [s for k, (p, a) in enumerate(lengths) for s in packer.add([(k, 0, p + a, a)])] + list(packer.finish())
    for s in packed:
        loss = sum(max(0, start + n - max(start, lengths[k][0])) for k, start, n, _ in s)
        assert loss <= 64 and loss == sum(p[3] for p in s) and sum(p[2] for p in s) <= 256 and len(s) <= 16
    assert sum(p[2] for s in packed for p in s) == sum(p + a for p, a in lengths)


def test_telephony():
    for law in (telephony.MU_LAW, telephony.A_LAW):
        table = telephony.EXPAND[law]
        codes = telephony.compress(table.astype(np.int32), law)
        assert (table[codes] == table).all()
    assert telephony.mu_law_table()[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.a_law_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    wave = (8000 * np.sin(np.arange(4000) / 9)).astype(np.int16)
    blocks = telephony.encode_adpcm(wave)
    back = telephony.decode_adpcm(blocks).ravel()[: len(wave)]
    assert np.abs(back.astype(int) - wave)[100:].mean() < 200
    for k in range(len(blocks)):  # block by block, the plain way
        sample, index = int(np.frombuffer(blocks[k, :2].tobytes(), "<i2")[0]), int(blocks[k, 2])
        want = [sample]
        for byte in blocks[k, 4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                d = (step >> 3) + (step if code & 4 else 0) + ((step >> 1) if code & 2 else 0) + ((step >> 2) if code & 1 else 0)
                sample = max(-32768, min(32767, sample - d if code & 8 else sample + d))
                index = max(0, min(88, index + int(telephony.INDEX_CHANGE[code])))
                want.append(sample)
        assert telephony.decode_adpcm(blocks[k : k + 1])[0].tolist() == want
    media = telephony.wav(telephony.IMA_ADPCM, blocks.tobytes(), block=256, bits=4, samples=len(wave))
    assert len(telephony.to_pcm(media)) == 2 * blocks.shape[0] * 505
    with pytest.raises(ValueError):
        telephony.read_wav(b"no")


def test_media_query(spark):
    texts = ["", "x" * 64, "é" * 100, None, *(f"text {k} " * k for k in range(1, 40))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows, kinds = telephony.store_payloads(df, with_media=True, group=500).collect(), set()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media, pcm = bytes(r.media), bytes(r.pcm)
        assert (r.media_bytes, r.media_sha256, r.pcm_bytes, r.pcm_sha256) == (len(media), hashlib.sha256(media).hexdigest(), len(pcm), hashlib.sha256(pcm).hexdigest())
        x = telephony.read_wav(media)
        kinds.add(x["tag"])
        # from the file alone, code by code
        if x["tag"] == telephony.IMA_ADPCM:
            blocks = np.frombuffer(x["data"], np.uint8).reshape(-1, 68)
            assert blocks[:, 4:].tobytes() == payload
            want = np.concatenate([telephony.decode_adpcm(b[None])[0] for b in blocks])
        else:
            assert x["data"] == payload
            want = telephony.EXPAND[x["tag"]][np.frombuffer(payload, np.uint8)]
        stored = telephony.read_wav(pcm)
        got = np.frombuffer(stored["data"], "<i2")
        assert stored["rate"] == 16000 and (got[::2] == want).all()
        n = [int(f.split("=")[1]) for f in r.feature.split(";") if f.startswith(("n=", "peak=", "zc="))]
        assert n == [len(got), int(np.abs(got.astype(int)).max()), sum((a >= 0) != (b >= 0) for a, b in zip(got, got[1:], strict=False))]
    assert kinds == {telephony.MU_LAW, telephony.A_LAW, telephony.IMA_ADPCM}


def test_transcode_gives_null_for_what_it_cant_read(spark):
    good, stereo = telephony.wav(telephony.A_LAW, b"abc"), bytearray(telephony.wav(telephony.MU_LAW, b"abcd"))
    stereo[22] = 2
    media = [good, b"bad", None, stereo, telephony.wav(telephony.IMA_ADPCM, b"abcd" * 4, block=5)[:40], telephony.wav(telephony.MU_LAW, b"abc", rate=0)]
    for block in (0, 2):
        x = bytearray(telephony.wav(telephony.IMA_ADPCM, b"abcd" * 4, block=8))
        x[32:34] = block.to_bytes(2, "little")
        media.append(x)
    df = spark.createDataFrame([(k, None if m is None else bytearray(m)) for k, m in enumerate(media)], "media_id long, media binary")
    got = {r.media_id: r for r in telephony.transcode(df).collect()}
    assert telephony.read_wav(bytes(got[0].pcm))["rate"] == 16000
    assert all(got[k].pcm is None and got[k].feature is None for k in range(1, len(media)))
    assert telephony.transcode(df.limit(0)).collect() == []


def test_resampling_down_takes_out_what_does_not_fit():
    t = np.arange(16000) / 16000
    low, high = (8000 * np.sin(2 * np.pi * f * t) for f in (300, 7000))
    got = telephony.resample((low + high).astype(np.int16), 16000, 8000)
    assert len(got) == 8000 and np.abs(got - low[::2])[200:-200].max() < 400


def slow_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def test_simhash(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    base = [[r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 30, 200]))] for _ in range(60)]
    texts = []
    for k in range(400):
        t = [*r.choice(base)]
        for _ in range(r.choice([0, 0, 1, 2])):
            if t:
                t[r.randrange(len(t))] = r.choice(words).upper()
        texts.append(" ".join(t))
    fps = [slow_fingerprint(t) for t in texts]
    assert fps == [simhash_bits.fingerprint(t.encode()) for t in texts]
    root = [*range(len(fps))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect()}
    assert got == {k: (f"{f:016x}", find(k)) for k, f in enumerate(fps)}


def test_close_pairs_at_every_distance(spark):
    r = random.Random(8)
    base = r.getrandbits(64)
    near = [base] + [base ^ sum(1 << b for b in r.sample(range(64), n)) for n in (1, 2, 3, 4) for _ in range(60)]
    near = [*dict.fromkeys(near)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in near], "fp long")
    got = {frozenset((p.a, p.b)) for p in simhash.close_pairs(df).collect()}
    assert got == {frozenset((signed(a), signed(b))) for k, a in enumerate(near) for b in near[:k] if (a ^ b).bit_count() <= 3}


def test_components(spark):
    r = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    got = {x.node: x.root for x in shared.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    assert got == {x: find(x) for x in list(root) if find(x) != x}


def all_windows(line, n=8):
    return frozenset(line[k : k + n] for k in range(max(1, len(line) - n + 1)))


def test_line_dedup(spark):
    r = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("th", "er", "on", "st") for b in ("in", "at", "es") for c in ("", "ly", "ed", "ou")]
    pool = [" ".join(r.choice(words) for _ in range(r.choice([1, 2, 4, 12, 40]))) for _ in range(120)]
    docs = []
    for k in range(150):
        lines = []
        for _ in range(r.randint(0, 6)):
            line = r.choice(pool).split()
            if len(line) > 10 and r.random() < 0.5:
                line[r.randrange(len(line))] = r.choice(words)
            lines.append(" ".join(line) if r.random() < 0.9 else "")
        docs.append((k, "\n".join(lines)))
    first = {}
    for k, t in docs:
        for n, line in enumerate(t.split("\n")):
            if line.strip(" "):
                first.setdefault(line.strip(" ").lower(), (k, n))
    norms = [*first]
    sets = [all_windows(x) for x in norms]
    root = [*range(len(norms))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for a in range(len(norms)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
                links += 1
    heads = {}
    for k, x in enumerate(norms):
        heads[find(k)] = min(heads.get(find(k), (1 << 60, 0)), first[x])
    want = {x: heads[find(k)] for k, x in enumerate(norms)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = line_dedup.line_classes(df).collect()
    assert len(rows) == sum(len(t.split("\n")) for _, t in docs)
    texts = dict(docs)
    wrong = 0
    for x in rows:
        norm = texts[x.doc_id].split("\n")[x.line_no].strip(" ").lower()
        if not norm:
            assert x.kept and x.class_doc is None
            continue
        wrong += (x.class_doc, x.class_line) != want[norm]
        assert x.kept == ((x.doc_id, x.line_no) == (x.class_doc, x.class_line))
    assert links > 50 and wrong <= 0.03 * len(rows)  # what banding misses at the threshold


def test_prefix_filtering_is_exact(spark):
    """All lines in one band, none joined yet: exactly the similar pairs are left after verification."""
    r = random.Random(6)
    base = [f"word{k}" for k in range(30)]
    norms = []
    for _ in range(60):
        line = [*base]
        for _ in range(r.choice([1, 2, 3, 5, 8])):
            line[r.randrange(30)] = f"new{r.randrange(50)}"
        norms.append(" ".join(line))
    norms = [*dict.fromkeys(norms)]
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(norms)], "key long, norm string")
    lines = line_dedup.shingle_sets(lines, 8)
    open_ = spark.createDataFrame([(k, k) for k in range(len(norms))], "key long, root long")
    pairs = line_dedup._by_prefix(open_, lines, 0.8)
    got = {(p.a, p.b) for p in line_dedup._verified(pairs, lines, 0.8).collect()}
    sets = [all_windows(x) for x in norms]
    assert got == {(b, a) for a in range(len(norms)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def slow_distance(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_fuzzy_lexicon():
    terms = [("idiot", False), ("moron", False), ("scum", False), ("lowei", True), ("worthless", False)]
    lex = fuzzy_lexicon.FuzzyLexicon(terms)
    r = random.Random(2)
    words = [t for t, _ in terms]
    for t in [*words]:
        for _ in range(60):
            w = [*t]
            for _ in range(r.choice([0, 1, 1, 2])):
                k = r.randrange(len(w))
                w[k : k + r.choice([0, 1])] = r.choice(["", "x", "e", r.choice(t)])
            words.append("".join(w) + r.choice(["", "", "", "ung"]))
    text = ". ".join(w.title() for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    got, at, want = {p: (lex.terms[t][0], e) for p, t, e in lex.find(points)}, 0, {}
    for w in words:
        best = []
        for t, stem in terms:
            heads = [w[:n] for n in range(len(w) + 1)] if stem else [w]
            e = min(slow_distance(h, t) for h in heads)
            if e == 0 or (e == 1 and len(t) >= 5):
                best.append(e)
        if w and best:
            want[at] = min(best)
        at += len(w) + 2
    assert {p: e for p, (_, e) in got.items()} == want


def test_toxicity(spark):
    r = random.Random(7)
    filler = [f"{a}{b}" for a in ("ther", "on", "est", "ing", "al") for b in ("e", "an", "or", "is")]
    prose = lambda n: [r.choice(filler) for _ in range(n)]
    bad = ["zibbler", "grumpod", "snarfle"]

    def text(y):
        w = prose(r.randint(20, 60))
        if y:
            w.insert(r.randrange(len(w)), r.choice(bad))
        return " ".join(w)

    model = toxicity.fit([(text(k % 4 == 0), int(k % 4 == 0)) for k in range(800)])
    assert sorted(t for t, _ in model.lexicon.terms) == sorted(bad)
    tests = [(text(k % 2), k % 2) for k in range(200)]
    assert all((model.score(model.hits(t)) >= 0.3) == bool(y) for t, y in tests)
    score = lambda t: model.score(model.hits(t))
    assert score("you grumpdo there") >= 0.3 and score("you gr1mpod there") >= 0.3
    assert score('she said "grumpod" and that the word was wrong') < 0.3 <= score("what a grumpod you are")
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(tests)], "doc_id long, text string")
    got = {x.doc_id: x.predicted for x in toxicity.score_documents(docs, model).collect()}
    assert got == {k: y for k, (_, y) in enumerate(tests)}
    assert {x.doc_id for x in toxicity.without_toxic(docs, model).collect()} == {k for k, (_, y) in enumerate(tests) if not y}


def test_quality_statistics():
    r = random.Random(9)
    for _ in range(200):
        text = "".join(r.choice(["a ", "b ", "é ", "\n", "a b c ", "#", "x\ty ", "\x0b", " "]) for _ in range(r.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = text.split("\n")
        dup = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = Counter(grams)
        covered = {k + d for k, g in enumerate(grams) if times[g] > 1 for d in range(3)}
        data = text.encode()
        got = quality.base_statistics(data, data.split())
        assert data.split() == [w.encode() for w in words]
        assert got == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_quality_model():
    r = random.Random(10)
    good = lambda: " ".join(r.choice(["river", "stone", "walks", "under", "the", "bright", "moon"]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["BUY!!", "NOW!!", "$$$", "CLICK!!", "FREE!!"]) for _ in range(60))
    sample = [((good if k % 2 else bad)(), k % 2) for k in range(400)]
    model = quality.fit(sample)
    tests = [((good if k % 2 else bad)(), k % 2) for k in range(100)]
    p = 1 / (1 + np.exp(-(model.slope * quality.margins([t.encode() for t, _ in tests], model) + model.offset)))
    assert all((x >= 0.5) == bool(y) for x, (_, y) in zip(p, tests, strict=True))
    whole = quality.margins([t.encode() for t, _ in tests], model)
    assert np.allclose(whole, quality.margins([t.encode() for t, _ in tests], model, block=500), atol=1e-4)


def test_secrets(spark):
    model = secret_scan.train(spark)
    held = secret_scan.generated_findings(400, seed=99)
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(held)], "doc_id long, text string")
    rows = secret_scan.scan(df, model).collect()
    said = {x.doc_id for x in rows if x.is_secret}
    truth = {k for k, (_, y) in enumerate(held) if y}
    assert len(said & truth) >= 0.93 * len(truth) and len(said - truth) <= 0.05 * len(held)
    for x in rows:
        assert held[x.doc_id][0][x.start : x.start + x.length] == x.token
    texts = {x.doc_id: x.text for x in secret_scan.redact(df, model).collect()}
    for k, (t, _) in enumerate(held):
        spans = sorted(((x.start, x.length) for x in rows if x.doc_id == k and x.is_secret), reverse=True)
        for start, n in spans:
            t = t[:start] + "[SECRET]" + t[start + n :]
        assert texts[k] == t


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav></header><div class="cookie-banner">We use cookies, and more, to track.</div>
<div class="layout"><div class="sidebar"><p>Other stories, many of them, are long enough to look like text, are they not?</p></div>
%s
<div id="comments"><p>I like this article, really, I do, so much that I write on and on and on about it.</p></div>
<form><label>Name</label><input name=q><p>Send us your thoughts, please, whenever you like.</p></form></div><footer>&copy; nobody</footer></body></html>"""


@pytest.mark.parametrize("wrap", ['<article>%s</article>', '<div class="content">%s</div>', '<main><div>%s</div></main>', '<div class="post-body">%s</div>', "<section>%s</section>"])
def test_pages(wrap):
    body = "<h2>Head &amp; shoulders</h2><p>First,   with <b>bold</b>\n and <a href=x>a link</a>, goes on for quite a while, as paragraphs do.<p>Second one, unclosed, &eacute;&#233;&#xe9; also with words enough.<ul><li>point one<li>point two</ul><div class=ad>Buy!</div><blockquote>Quoted, at last.</blockquote>"
    want = "Head & shoulders\nFirst, with bold and a link, goes on for quite a while, as paragraphs do.\nSecond one, unclosed, ééé also with words enough.\npoint one\npoint two\nQuoted, at last."
    assert html_extract.main_text(PAGE % (wrap % body)) == want


def test_quality_margin_is_that_of_its_definition():
    """Margins of scoring against features and weights, one text at a time, in many scripts."""
    r = np.random.default_rng(3)
    model = quality.QualityModel(r.standard_normal(2 * quality.SIZE).astype(np.float32), 0.25, 1.0, 0.0)
    texts = [t.encode() for t in [*mixed(200, 4), "Straße élan 中文 текст 🙂"] if "\x00" not in t]
    got = quality.margins(texts, model)
    for t, m in zip(texts, got, strict=True):
        points = [ord(c) for c in t.decode()]
        assert quality.points_of(t).tolist() == points
        where, share = quality._features(t) if t else (np.zeros(0, int), np.zeros(0))
        assert abs(m - 0.25 - float((model.weights[where] * share).sum())) < 1e-4
