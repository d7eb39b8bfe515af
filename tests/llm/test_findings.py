"""What a review of the operators found."""

import random

import numpy as np
import xxhash

from tessera.llm import line_dedup, near_copies, shared, simhash, simhash_bits


def test_exploded_fingerprints_are_never_broadcast(spark):
    """Tables of fingerprints that are small on disk: 64 variants of each would go through the driver."""
    r = random.Random(5)
    fps = [r.getrandbits(63) for _ in range(300)]
    fps += [f ^ (1 << r.randrange(62)) for f in fps[:50]]
    table, path = shared.shared_table(spark.createDataFrame([(f,) for f in fps], "fp long"), "fps")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        pairs = simhash.close_pairs(table)
        assert pairs.distinct().count() >= 50
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold") if before is None else spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        shared.drop_shared(spark, path)


def test_near_duplicate_stage_links_fingerprints(spark, monkeypatch):
    """Without a band in common: fingerprints within three bits propose, five-word Jaccard decides."""
    monkeypatch.setattr(near_copies, "bands", lambda h: [int(h.view(np.int64).sum())])
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    texts, want = [], set()
    for k in range(40):
        words = [word() for _ in range(r.choice([60, 400, 1500]))]
        other = [*words]
        other[r.randrange(len(other))] = word()
        pair = [" ".join(words), " ".join(other)]
        texts += pair
        a, b = (simhash_bits.fingerprint(t.encode(), 5) for t in pair)
        x, y = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words, other))
        want |= {2 * k} if (a ^ b).bit_count() <= 3 and len(x & y) >= 0.8 * len(x | y) else {2 * k, 2 * k + 1}
    # Nothing in common.
    texts += ["few", "words"]
    want |= {80, 81}
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert 42 < len(want) < 75
    assert {x.doc_id for x in simhash.keep_one(df).collect()} == want


def test_line_signatures_are_least_hashes_of_bins(spark):
    """One hash a window: by hand, with empty bins filled; repeats of windows change nothing."""
    lines = ["abcdefghij" * 30, "short", "x" * 8, "x" * 500, "".join(chr(97 + k * k % 26) for k in range(90)) + "é🙂 end"]
    df = spark.createDataFrame([*enumerate(lines)], "key long, norm string")
    got = {r.key: [r[f"b{k}"] for k in range(24)] for r in line_dedup.signatures(df, 8, 24).collect()}
    for key, line in enumerate(lines):
        want = [None] * 24
        for k in range(max(1, len(line) - 7)):
            h = xxhash.xxh64_intdigest(line[k : k + 8].encode("utf-32-be"), 42)
            signed, bin_ = h - (1 << 64) if h >> 63 else h, (h >> 32) * 24 >> 32
            want[bin_] = signed if want[bin_] is None else min(want[bin_], signed)
        assert got[key] == want
    bands = {r.key: r.bands for r in line_dedup.banded_signatures(df, 8, 24, 14, 5, 7).collect()}
    assert all(len(b) == 14 and None not in b for b in bands.values()) and bands[2] == bands[3] and len({tuple(b) for b in bands.values()}) == 4


def test_numbers_agree_as_sets_do(spark):
    """The share of equal bands of sets of similarity 0.8 is what five numbers that agree independently give, small sets too."""
    r = random.Random(31)
    for n in (12, 40, 200):
        wide = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n + 7)) for _ in range(300)]
        pairs = [x for w in wide for x in (w, w[: 7 + -(-8 * n // 10)])]
        got = {x.key: x.bands for x in line_dedup.banded_signatures(spark.createDataFrame([*enumerate(pairs)], "key long, norm string"), 8, 24, 14, 5, 7).collect()}
        equal = [a == b for k in range(300) for a, b in zip(got[2 * k], got[2 * k + 1])]
        found = sum(any(a == b for a, b in zip(got[2 * k], got[2 * k + 1])) for k in range(300))
        assert 0.27 < sum(equal) / len(equal) < 0.42 and found >= 0.94 * 300


def test_line_sets_take_one_pass_and_heads_are_made_once(spark, capsys):
    """Sets are made where the line lies: no row a window and no group; prefixes read a table, not the sets again."""
    lines = spark.createDataFrame([(k, f"line {k % 7} of text that is long enough {k}") for k in range(40)], "key long, norm string")
    sets = line_dedup.shingle_sets(lines, 8)
    sets.explain()
    plan = capsys.readouterr().out
    assert "Aggregate" not in plan and "Generate" not in plan
    with shared.Scratch(spark) as scratch:
        line_dedup._by_prefix(spark.createDataFrame([(k, k) for k in range(40)], "key long, root long"), sets, 0.8, scratch).explain()
        plan = capsys.readouterr().out
    assert "open_sets" not in plan and "heads" in plan


def test_texts_are_split_and_encoded_once(spark, capsys):
    """No filter that an explode adds splits a text, or cuts a line, a second time; null texts have no lines."""
    df = spark.createDataFrame([(1, "one\ntwo"), (2, None), (3, "")], "doc_id long, text string")
    rows = line_dedup.split_lines(df)
    assert sorted((x.doc_id, x.line_no, x.line) for x in rows.collect()) == [(1, 0, "one"), (1, 1, "two"), (3, 0, "")]
    rows.explain()
    assert capsys.readouterr().out.count("split(") == 1
    line_dedup.shingles(rows.where("norm <> ''").select("key", "norm"), 8).explain()
    assert capsys.readouterr().out.count("sequence(") == 1
