"""What a review found missing."""

import random

import numpy as np

from tessera.llm import fuzzy_lexicon, line_dedup, secret_scan, simhash


def line_heads(spark, lines, **options):
    """The line that each line is classed with, one document a line."""
    df = spark.createDataFrame([*enumerate(lines)], "doc_id long, text string")
    return {r.doc_id: r.class_doc for r in line_dedup.line_classes(df, **options).collect()}


def all_windows(line, n=8):
    return {line[k : k + n] for k in range(max(1, len(line) - n + 1))}


def test_line_shingles_cover_the_line(spark):
    policy = ["read more about our privacy policy here.", "read more about our privacy policy here"]
    apart = ["bundesverfassungsgericht", "bundesverwaltungsamt", "acgtacgtttgacaggatcca", "acgtacgtcccatgattacag"]
    assert line_heads(spark, policy + apart) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}


def test_line_classes_by_all_shingles(spark):
    r = random.Random(12)
    lines = []
    for _ in range(60):
        line = "".join(r.choice("abcdefghij .") for _ in range(r.choice([6, 9, 30, 80, 200]))).strip() + "x"
        lines.append(line)
        for _ in range(2):
            k = r.randrange(len(line))
            lines.append((line[:k] + r.choice(["", "q", "zz"]) + line[k + r.choice([0, 1]) :]).strip())
    sets = [all_windows(x) for x in lines]
    root = [*range(len(lines))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    got = line_heads(spark, lines)
    wrong = sum(got[k] != find(k) for k in range(len(lines)))
    assert sum(find(k) != k for k in range(len(lines))) > 50 and wrong <= 0.03 * len(lines)


def test_lines_of_four_and_five_shingles(spark):
    """A set of four within one of five has similarity 0.8."""
    r = random.Random(5)
    longer = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(100)]
    got = line_heads(spark, [x for line in longer for x in (line, line[:11])])
    assert sum(got[2 * k + 1] == 2 * k for k in range(100)) >= 88  # bands find 0.96 of them


def test_terms_beside_typographic_signs_and_in_other_scripts():
    terms = ["grumpod", "scum", "дурак", "λόγος", "混蛋"]
    lex = fuzzy_lexicon.FuzzyLexicon([(t, False) for t in terms])
    found = lambda text: [(lex.terms[t][0], e) for _, t, e in lex.find(np.frombuffer(text.encode("utf-32-le"), "<u4"))]
    for t in terms:
        for text in (t, t.upper(), f"“{t}”", f"‘{t}’", f"so—{t}—it", f"a {t}… b", f"–{t}", f"、{t}。"):
            assert found(text) == [(t, 0)], text
    assert found("дурок") == [("дурак", 1)] and found("xдуракy") == [] and found("U0001f642grumpod".replace("U0001f642", chr(0x1F642))) == [("grumpod", 0)]


def test_near_duplicate_stage_takes_five_words_and_similarity(spark):
    """Pairs of five-word Jaccard 0.8 and more lose one document, pairs below keep both."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    texts, want = [], set()
    for k in range(80):
        words = [word() for _ in range(r.choice([60, 150, 400]))]
        other = [*words]
        for _ in range(r.choice([1, 2, 4, 8])):
            other[r.randrange(len(other))] = word()
        texts += [" ".join(words), " ".join(other)]
        a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words, other))
        want |= {2 * k} if len(a & b) >= 0.8 * len(a | b) else {2 * k, 2 * k + 1}
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert 90 < len(want) < 150
    assert {x.doc_id for x in simhash.keep_one(df).collect()} == want


def test_headings_that_begin_alike_stay(spark):
    lines = ["Internationalization", "Internationally", "Government", "Governmental", "Donaudampfschifffahrt", "Donaudampflokomotive", "chapter one: internationalization", "chapter one: internationally"]
    df = spark.createDataFrame([*enumerate(lines)], "doc_id long, text string")
    assert line_dedup.without_repeats(df).count() == len(lines)


def test_white_space_at_ends_of_lines(spark):
    df = spark.createDataFrame([(1, "one line that is here\r\nsecond"), (2, "\tone line that is here  \n \t\r")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.class_doc, r.kept) for r in line_dedup.line_classes(df).collect()}
    assert got == {(1, 0): (1, True), (1, 1): (1, True), (2, 0): (1, False), (2, 1): (None, True)}


def test_recall_of_lines_by_similarity(spark):
    """Share of similar pairs that get linked: found / all, by similarity, in sets of many sizes."""
    r = random.Random(21)
    pairs = []
    for _ in range(900):
        n = r.choice([14, 30, 60, 150, 400])
        line = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        # a cut at an end takes one window a character
        pairs.append((line, line[: n - r.randint(1, max(1, (n - 7) // 5))]))
    heads = line_heads(spark, [x for p in pairs for x in p])
    found = {"0.80": [], "0.85": [], "0.90": []}
    for k, (a, b) in enumerate(pairs):
        x, y = all_windows(a), all_windows(b)
        j = len(x & y) / len(x | y)
        if j >= 0.8:
            found["0.90" if j >= 0.9 else "0.85" if j >= 0.85 else "0.80"].append(heads[2 * k + 1] == 2 * k)
    assert all(len(f) > 50 for f in found.values())
    shares = {j: sum(f) / len(f) for j, f in found.items()}
    assert shares["0.80"] >= 0.93 and shares["0.85"] >= 0.97 and shares["0.90"] >= 0.99, shares


def test_hot_bands_are_salted(spark):
    """Near copies that share all bands, in more rows than a slot may hold: still one class, by few candidate pairs."""
    words = " ".join(f"word{k}" for k in range(150))
    lines = [f"{words} {k}" for k in range(1500)]
    assert set(line_heads(spark, lines).values()) == {0}
    member = spark.createDataFrame([(k, 7) for k in range(5000)], "key long, band long")
    sizes = [x["count"] for x in line_dedup._salted(member, 5000).groupBy("salt").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 650


def test_repeated_ids_in_the_near_duplicate_stage(spark):
    unique, copy = " ".join(f"u{k}" for k in range(60)), " ".join(f"c{k}" for k in range(60))
    df = spark.createDataFrame([(5, unique), (5, copy), (3, copy)], "doc_id long, text string")
    assert {tuple(x) for x in simhash.keep_one(df).collect()} == {(5, unique), (3, copy)}


def test_wildcards_that_many_share(spark):
    """Thousands of fingerprints with one half: candidates stay few, and pairs are those of brute force."""
    r = random.Random(4)
    half = r.getrandbits(32)
    fps = [half << 32 | r.getrandbits(32) for _ in range(3000)] + [(half ^ 1 << 5) << 32 | r.getrandbits(32) for _ in range(3000)]
    fps += [f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for f in fps[:40]]
    fps = [*dict.fromkeys(fps)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {frozenset((p.a, p.b)) for p in simhash.close_pairs(df).collect()}
    points = np.array(fps, np.uint64)
    want = set()
    for k in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(points[:k] ^ points[k]) <= 3):
            want.add(frozenset((signed(fps[k]), signed(fps[j]))))
    assert got == want and len(got) >= 40
    wild = spark.createDataFrame([(k, 0, 9, k % 2) for k in range(6000)], "fp long, half int, key long, side long")
    assert simhash._dealt(wild, 6000).where("part >= 0").count() == 18000


def test_secrets_with_any_characters_are_whole(spark):
    model = secret_scan.train(spark)
    values = ["p@ssw0rd!2024", "Tr0ub4dor&3xK!q", "$ecret#99!", "kTqWnzLpRmBv93x"]
    texts = [f"login password={values[0]} then", f"password: '{values[1]}' here", f'the db_password = "{values[2]}" in it', f"name: web\npassword:        {values[3]}\nport: 80"]
    texts += ["password: required for the next step", "the token = None", "author: somebody wrote it", "a passage: reading aloud"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {}
    for x in secret_scan.scan(df, model).where("is_secret").collect():
        assert texts[x.doc_id][x.start : x.start + x.length] == x.token
        got.setdefault(x.doc_id, []).append(x.token)
    assert got == {k: [v] for k, v in enumerate(values)}


def test_secrets_in_very_long_texts(spark):
    """100,000 candidates without a space, and megabytes of text: every place is right, in time."""
    secret = "ghp_" + "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0zA1bC3"
    texts = ["a1234567," * 100_000, ("é" * 40 + " plain words here \n") * 60_000 + secret + " end", "x" * 3_000_000, "a1" * 50_000 + " ok " + secret]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows = secret_scan.candidates(df).select("doc_id", "start", "token").collect()
    by = {}
    for x in rows:
        assert texts[x.doc_id][x.start : x.start + len(x.token)] == x.token
        by.setdefault(x.doc_id, []).append((x.start, x.token))
    assert sorted(by[0]) == [(9 * k, "a1234567") for k in range(100_000)]
    assert [t for _, t in by[1]] == [secret] and 2 not in by and [t for _, t in by[3]] == [secret]
