"""The operators of the training-data package against brute force, on small and awkward tables."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import bpe, chat_format, edit_fingerprint, gated_lm, licenses, packing, quality_classifier, quality_rules, simhash, token_counts
from scriptorium.llm.common import checkpointed, prepare
from scriptorium.llm.components import component_roots

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = r"[^\x20\x09-\x0D]+"
PROSE = "the cat sat on the mat and looked at a bird that flew over green fields near the old mill. "
#: Null, empty, blank, very long, repeated and odd texts; a repeated row, and columns named as the operators name theirs.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, PROSE * 4000), (6, PROSE), (6, PROSE), (7, PROSE), (8, "x" * 50_000),
    (9, "ΣΊΣΥΦΟΣ İstanbul <|endoftext|> naïve 中文 \x1c don't  two"), (10, "a <|text|> b <\\| c"), (11, "a, b. C"),
]
CLASHES = ("key", "row", "ids", "n", "token", "label", "stats", "fp", "length", "start", "_pattern", "pattern", "component_id", "fingerprint", "license", "c", "_group")


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    rows = spark.createDataFrame(ODD, "doc_id bigint, text string")
    return rows.select("*", *[F.lit("clash").alias(name) for name in CLASHES])


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.limit(0)


def texts():
    return [(k, t or "") for k, t in ODD]


def rows_of(df, *names):
    return sorted(tuple(row[n] for n in names) for row in df.collect())


def test_bpe_is_the_library(odd, none):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made = bpe.encode(odd, "doc_id", decoded=True)
    want = sorted((k, library.encode_ordinary(t), t.encode()) for k, t in texts())
    assert [(k, i, bytes(d)) for k, i, d in rows_of(made, "doc_id", "ids", "decoded")] == want
    apart = bpe.decode(bpe.encode(odd, "doc_id"), "doc_id")
    assert [(k, bytes(d)) for k, d in rows_of(apart, "doc_id", "decoded")] == [(k, t) for k, _, t in want]
    assert bpe.encode(none, "doc_id").count() == 0
    encoder, r = bpe.TextEncoder(ranks, public_tokenizers.PATTERN), random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", " \n", "é", "中", "²", "1", "'s", "!", "\0", "\x1c", " ", "́", "the", "aaaaaaaaaaaaa", "=-"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(encoder.ids(text), "<i4").tolist() == library.encode_ordinary(text)
    for text in ("ab" * 3000, "".join(r.choice("abcdefgh") for _ in range(5000))):
        assert np.frombuffer(encoder.ids(text), "<i4").tolist() == library.encode_ordinary(text)


def test_joins_of_a_tree_are_associative():
    tree, r = bpe.TreeEncoder(bpe.read_ranks(public_tokenizers.path(bpe.RANKS))), random.Random(4)
    for _ in range(300):
        data = bytes(r.choice(b"thein grao") for _ in range(r.randint(2, 40)))
        i = r.randint(1, len(data) - 1)
        assert tree.join(tree.greedy(data[:i]), tree.greedy(data[i:])) == tree.greedy(data)


def test_token_counts_are_the_librarys(odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path(token_counts.VOCABULARY)
    library = tokenizers.Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert rows_of(token_counts.count_tokens(odd, "doc_id"), "doc_id", "n_bytes", "n_tokens") == sorted((k, len(t.encode()), count(t)) for k, t in texts())
    assert token_counts.count_tokens(none, "doc_id").count() == 0
    counter, r = token_counts.TextCounter(path), random.Random(5)
    parts = ["a", "b", " ", "\n", "é", "中", "²", "1", "'s", "!", "\x1c", "́", "the", "aaaaaaaa", "=-", "<|endoftext|>", "Σ", "İ", "</w>", "\x85", "K"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert counter.count(text) == count(text)
        assert counter.prefix_counts(text, 3)[-1] == count(text)


def test_a_long_word_takes_memory_in_proportion():
    counter, peaks = token_counts.TextCounter(public_tokenizers.path(token_counts.VOCABULARY)), []
    counter.count("warm up")
    for n in (500_000, 2_000_000):
        text = "abcdefghij" * (n // 10)
        tracemalloc.start()
        assert counter.count(text) == counter.count(text, chunk=n)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0] and peaks[1] < 12 * 2_000_000


def test_prefix_scan():
    assert token_counts.prefix_scan(list("abcdefg"), lambda a, b: a + b) == ["a", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg"]


@pytest.mark.parametrize("group_rows", [packing.GROUP_ROWS, 1])
def test_packing(odd, none, group_rows, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", group_rows)
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    made = packing.packed_documents(odd, "doc_id").toPandas()
    ids = {k: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in texts()}
    assert made.length.sum() == sum(len(ids[k]) for k, _ in texts()) and set(made.doc_id) == set(ids)
    for row in made.itertuples():
        assert zlib.crc32(ids[row.doc_id][row.start : row.start + row.length].tobytes()) == row.ids_crc32
        assert row.length == 2048 or row.piece == 0
    for _, group in made.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == [0, *np.cumsum(group.length)[:-1]] and group.length.sum() <= 2048
    assert made.sequence_id.nunique() <= -(-made.length.sum() // 2048) + 1
    assert packing.packed_documents(none, "doc_id").count() == 0


def test_packing_plan_uses_every_piece():
    r = random.Random(6)
    for n in (1, 5, 200, 5000):
        counts = collections.Counter(min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(n))
        plan = packing.plan(counts)
        used = collections.Counter()
        for lengths, times in plan:
            assert sum(lengths) <= 2048
            for size in lengths:
                used[size] += times
        assert used == counts
        assert sum(t for _, t in plan) <= 1.02 * sum(s * c for s, c in counts.items()) / 2048 + 1
    assert packing.plan({1000: 3, 600: 3, 448: 3}) == [((1000, 600, 448), 3)]
    assert packing.plan({1048: 1, 400: 1, 300: 2}) == [((1048, 400, 300, 300), 1)]


def brute_statistics(text):
    words = re.findall(WORD, text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, none):
    extra = [(20, "a b c d e f g h a b c d e i\n\nsame\nsame\n \nsame"), (21, "one two three four five six seven one two three four five six"), (22, "a a a a a a a a a a a a")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_rules.judge(docs)
    assert rows_of(judged, *names) == sorted((k, *brute_statistics(t)) for k, t in [*texts(), *extra])
    kept = dict(rows_of(judged, "doc_id", "kept"))
    assert kept[6] and kept[7] and not kept[1] and not kept[2] and not kept[5] and not kept[22]
    assert quality_rules.judge(none).count() == 0
    clash = quality_rules.judge(odd)
    assert clash.columns.count("kept") == 1 and set(CLASHES) - {"_pattern"} <= set(clash.columns)


def test_distinct_words_of_whole_texts(spark, odd):
    """A varied head does not hide a poor text, nor a poor head a varied one; texts of up to 500 words count as they are."""
    r = random.Random(12)
    fresh = lambda n: [f"word{r.randrange(10**6)}" for _ in range(n)]
    poor = lambda n: [r.choice(["stone", "river", "cloud", "tree", "grass"]) for _ in range(n)]
    cases = [fresh(500) + poor(4000), poor(500) + fresh(4000), fresh(500), fresh(501), poor(499), poor(1250), []]
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(cases)], "doc_id bigint, text string")
    got = dict(rows_of(quality_rules.measure(docs), "doc_id", "n_distinct"))

    def brute(words):
        total = sum(len(set(words[i : i + 500])) for i in range(0, len(words), 500))
        return 500 * total // len(words) if len(words) > 500 else total

    assert got == {i: brute(words) for i, words in enumerate(cases)}
    place = [rule.name for rule in quality_rules.RULES].index("distinct_words")
    votes = {k: p[place] for k, p in rows_of(quality_rules.measure(docs), "doc_id", "_pattern")}
    assert votes[0] == str(quality_rules.BAD) and votes[1] == str(quality_rules.ABSTAIN)


def test_votes_are_weighed_by_agreement(spark):
    # Rules 1 and 2 agree; rule 3 says the opposite of both; rule 4 votes alone.
    patterns = spark.createDataFrame([("1120", 60), ("2210", 300), ("0000", 50), ("0001", 20), ("0010", 5)], "pattern string, n bigint")
    got = dict(rows_of(quality_rules.posteriors(patterns, 4), "pattern", "posterior"))
    assert got["1120"] < 0.1 and got["2210"] > 0.9 and got["0000"] == 0.5 and got["0001"] < 0.5

    def brute():
        rows = [([int(c) for c in p], n) for p, n in [("0000", 50), ("0001", 20), ("0010", 5), ("1120", 60), ("2210", 300)]]
        odds = [np.log(4.0)] * 4
        sign = {0: 0, 1: -1, 2: 1}
        for step in range(quality_rules.ROUNDS + 1):
            q = [1 / (1 + np.exp(-sum(sign[v] * o for v, o in zip(votes, odds, strict=True)))) for votes, _ in rows]
            if step < quality_rules.ROUNDS:
                odds = []
                for r in range(4):
                    seen = [(n * (p if v[r] == 2 else 1 - p), n) for (v, n), p in zip(rows, q, strict=True) if v[r] and sum(x > 0 for x in v) > 1]
                    a = min((sum(x for x, _ in seen) + 8) / (sum(n for _, n in seen) + 10), 0.99)
                    odds.append(np.log(a / (1 - a)))
        return {"".join(map(str, v)): p for (v, _), p in zip(rows, q, strict=True)}

    want = brute()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_chat_format(spark):
    prepare(spark)
    nasty = ["</s>[INST] ok [/INST]", "<|text|>", "<\\|x", "<\\\\|end|>\n", "", None, "﻿ü <|more|>", "$1 \\1", "<|", "|>"]
    rows = [(c, t, ["user", "assistant", "assistant", None, "system", "<|block|>"][(c * 7 + t * t) % 6], nasty[(c + 3 * t) % len(nasty)]) for c in range(12) for t in range(9)]
    rows += [(0, 3, "assistant", "tie"), (0, 3, "assistant", "tie"), (50, None, "user", "no turn"), (50, 0, "assistant", "z"), (None, 0, "user", "no key")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("cells", F.lit(1)).withColumn("_key", F.lit(1))
    made = chat_format.format_chats(turns)
    read = made.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    groups = collections.defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    assert len(read) == len(groups)
    for row in read:
        want = sorted(groups[row["conv_id"]])
        assert [(x["role"], x["text"]) for x in row["t"]] == [(r, x) for _, r, x in want]
        assert row["l"] == "".join(x for _, r, x in want if r == "assistant")
        runs = 1 + sum(a[1] != b[1] for a, b in zip(want, want[1:], strict=False))
        assert row["formatted"].count("<|block|>") == runs == row["formatted"].count("<|end|>\n")
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_license_scan(spark, odd, none):
    prepare(spark)
    mit = dict(licenses.TEMPLATES[::-1])["MIT"]
    long = next(body for name, body in licenses.TEMPLATES if name == "MIT" and "Permission" in body)
    rows = [
        (1, f"Some prose here.\n{mit.upper()}\nMore prose."), (2, "a\n\n" + long.replace(", ", ",\n") + "\n\nend"), (3, PROSE), (4, None), (5, ""),
        (6, "Released under the MIT License, as is often done by most."), (7, "All rights reserved.\nAll rights reserved."),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit("x")).withColumn("key", F.lit("y"))
    got = rows_of(licenses.scan(docs, "doc_id"), "doc_id", "license", "n_parts", "n_windows", "dice")
    assert (1, "MIT", 1, 1, 1.0) in got and any(r[:2] == (2, "MIT") and r[4] > 0.9 for r in got)
    assert (6, "MIT", 0, 1, 1.0) in got and (7, "all-rights-reserved", 3, 2, 1.0) in got and {r[0] for r in got} == {1, 2, 6, 7}
    # Notices inside longer lines and a word changed; of like licences the one that is meant.
    bodies = [(name, body) for name, body in licenses.TEMPLATES]
    inside = [(100 + i, f"{PROSE}{body} {PROSE}") for i, (_, body) in enumerate(bodies)]
    inside += [(1, "Copyright (c) 2024 Acme Inc. All rights reserved."), (2, "Licensed under the MIT License"), (3, "see Mozilla Public License Version 2.0 there")]
    found = collections.defaultdict(set)
    for key, name in rows_of(licenses.scan(spark.createDataFrame(inside, "doc_id bigint, text string"), "doc_id"), "doc_id", "license"):
        found[key].add(name)
    assert all(name in found[100 + i] for i, (name, _) in enumerate(bodies))
    assert found[1] == {"all-rights-reserved"} and found[2] == {"MIT"} and found[3] == {"MPL-2.0"}
    assert all(found[100 + i] == {name} for i, (name, _) in enumerate(bodies) if name in ("GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "CC-BY-NC-4.0", "CC-BY-SA-4.0"))
    assert licenses.scan(none, "doc_id").count() == 0 and licenses.scan(odd, "doc_id").count() == 0


def brute_fingerprint(text, width=3):
    import xxhash

    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (int(values[i]) ^ int(values[j])).bit_count() <= radius and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_simhash(spark, odd, none):
    got = rows_of(simhash.near_duplicates(odd, "doc_id"), "doc_id", "fp", "component_id")
    keys, values = [k for k, _ in texts()], [brute_fingerprint(t) for _, t in texts()]
    labels = brute_components(values, 2)
    smallest = {label: min(k for k, x in zip(keys, labels, strict=True) if x == label) for label in labels}
    assert [(k, fp % 2**64, c) for k, fp, c in got] == sorted((k, v, smallest[x]) for k, v, x in zip(keys, values, labels, strict=True))
    assert simhash.near_duplicates(none, "doc_id").count() == 0
    assert rows_of(simhash.survivors(odd, "doc_id"), "doc_id") == sorted({(s,) for s in smallest.values()})
    assert set(CLASHES) <= set(simhash.survivors(odd, "doc_id").columns)
    # Unlike rows that share a key are both kept; of like ones the smallest key stays, and a missing key goes last.
    a, b, c = "alpha beta gamma delta", "one two three four", "red green blue black"
    rows = spark.createDataFrame([(1, a), (1, b), (2, c), (3, b), (None, c), (None, "no key at all here"), (2, c)], "doc_id bigint, text string")
    stays = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.survivors(rows, "doc_id").collect())
    assert stays == [(0, "no key at all here"), (1, a), (1, b), (2, c)]


@pytest.mark.parametrize("shard", [8192, 20])
def test_links_of_clustered_fingerprints(spark, monkeypatch, shard):
    """Shards that are dealt again find the same components."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "FRONTIER", 2000)
    r, values = np.random.default_rng(7), set()
    for base in r.integers(0, 2**63, 12):
        for _ in range(30):
            v = int(base)
            for bit in r.integers(0, 64, r.integers(0, 6)):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    distinct = checkpointed(spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp bigint"))
    roots = {row["node"]: row["root"] for row in component_roots(simhash.fingerprint_links(distinct, 2)).collect()}
    got = collections.defaultdict(set)
    for v in values:
        signed = v - 2**64 if v >= 2**63 else v
        got[roots.get(signed, signed)].add(v)
    want = collections.defaultdict(set)
    for v, label in zip(values, brute_components(values, 2), strict=True):
        want[label].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_trees_hold_real_shards(spark):
    """Thousands of fingerprints in a tree of some depth, of which a search meets a share; the links are those of all pairs."""
    r = np.random.default_rng(8)
    value = r.integers(0, 2**63, 3000, dtype="u8") * np.uint64(2) + r.integers(0, 2, 3000, dtype="u8")
    for i in range(0, 3000, 10):
        value[i + 1] = value[i] ^ np.uint64(1 << int(r.integers(0, 64))) ^ np.uint64(1 << int(r.integers(0, 64)))
    value = np.unique(value)
    shard = np.zeros(len(value), "i8")
    root, parent, edge = simhash.build_trees(shard, value)
    depth = np.zeros(len(value), int)
    for _ in range(60):
        depth = np.where(parent >= 0, depth[parent] + 1, 0)
    visits = collections.Counter()
    found = {(int(a), int(b)) for q, n in simhash.search_trees(root, parent, edge, value, 2, visits) for a, b in zip(q, n, strict=True)}
    near = np.bitwise_count(value[:, None] ^ value[None, :]) <= 2
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a != b} and len(found) >= 500
    assert depth.max() > 3 and visits["nodes"] < 0.7 * len(value) ** 2
    distinct = checkpointed(spark.createDataFrame([(int(v),) for v in value.view("<i8")], "fp bigint"))
    dealt, _ = simhash._by_prefix(distinct, 2)
    sizes = [row["count"] for row in dealt.groupBy("key").count().collect()]
    assert sum(sizes) == 3 * len(value) and max(sizes) > 1000


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    roots = dict(rows_of(component_roots(links), "node", "root"))
    assert roots == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert component_roots(links.limit(0)).count() == 0


def test_edit_fingerprints(spark, odd, none):
    got = edit_fingerprint.edited_by_next(odd, "doc_id").toPandas().sort_values(["doc_id"], kind="stable")
    docs = sorted(texts())
    want = [a[: len(a) - len(a) // 4] + b[: len(a) // 4] for (_, a), (_, b) in zip(docs, docs[1:] + docs[:1], strict=True)]
    assert sorted(got.edited_sha256) == sorted(hashlib.sha256(e.encode()).hexdigest() for e in want)
    assert got.n_chars.tolist() == [len(t) for _, t in docs]
    prints = dict(rows_of(edit_fingerprint.fingerprint(odd, "doc_id"), "doc_id", "fingerprint"))
    assert got.fingerprint.tolist() == [prints[k] for k, _ in docs] and prints[6] == prints[7] and prints[1] == prints[2] != prints[4]
    assert edit_fingerprint.edited_by_next(none, "doc_id").count() == 0
    one = edit_fingerprint.edited_by_next(spark.createDataFrame([(1, "abcdefgh")], "doc_id bigint, text string"), "doc_id").first()
    named = [(None, "nothing here"), (None, "nothing"), ("b", "bbbbbbbb"), ("a", "aaaaaaaa"), ("ñ", "nnnnnnnn"), ("b", "bbbbbbbb")]
    got = edit_fingerprint.edited_by_next(spark.createDataFrame(named, "doc_id string, text string").repartition(5), "doc_id").collect()
    order = sorted(named, key=lambda row: (row[0] is not None, row[0] or "", hashlib.sha256(row[1].encode()).hexdigest()))
    want = [(k, hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest()) for (k, t), (_, u) in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(want, key=str) == sorted(((row["doc_id"], row["edited_sha256"]) for row in got), key=str)
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_edit_likeness_follows_the_edit_distance(spark):
    r = random.Random(8)
    base = ["".join(r.choice("etaoinshrdlu ") for _ in range(3000)) for _ in range(30)]

    def edited(text, p):
        return "".join(c if r.random() > p else r.choice(["", c + "x", "z"]) for c in text)

    prints = edit_fingerprint.fingerprints_of(base)
    mean = lambda p: np.mean([edit_fingerprint.likeness_of(a, b) for a, b in zip(prints, edit_fingerprint.fingerprints_of([edited(t, p) for t in base]), strict=True)])
    assert mean(0) == 1 and mean(0.002) > 0.8 > mean(0.05) > 0.15
    assert np.mean([edit_fingerprint.likeness_of(a, b) for a, b in zip(prints, prints[1:], strict=False)]) < 0.15
    near = edit_fingerprint.fingerprints_of([edited(t, 0.001) for t in base])
    rows = spark.createDataFrame([*enumerate(prints), *enumerate(near, 100)], "doc_id bigint, fingerprint string")
    found = dict(rows_of(edit_fingerprint.similar_to(rows, "doc_id"), "doc_id", "similar_to"))
    assert sum(found.get(100 + i) == i for i in range(30)) >= 27 and all(found[k] == k - 100 for k in found)
    assert edit_fingerprint.similar_to(rows.limit(0), "doc_id").count() == 0


def junk(r, i):
    words = [r.choice(PROSE.split()) for _ in range(80)]
    return " ".join(w + "###" if i % 2 else w.upper() + "!!" for w in words)


def test_quality_classifier(spark, odd, none):
    r = random.Random(9)
    rows = [(i, junk(r, i) if i % 4 == 0 else " ".join(r.choice(PROSE.split()) for _ in range(80))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit(7)).withColumn("stats", F.lit(7))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(5, 1), (6, None), (None, 0)], "doc_id bigint, quality int")
    got = quality_classifier.classify(docs, labels, "doc_id").toPandas()
    assert len(got) == 400 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == (held.doc_id % 4 > 0)).mean() > 0.97
    again = quality_classifier.classify(docs.repartition(7), labels, "doc_id").toPandas()
    assert np.allclose(again.sort_values("doc_id").score.values, got.sort_values("doc_id").score.values, atol=1e-12)
    assert rows_of(quality_classifier.good_documents(docs, labels, "doc_id"), "doc_id") == sorted((int(k),) for k in got[got.predicted == 1].doc_id)
    strange = quality_classifier.classify(odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))), labels, "doc_id").toPandas()
    assert len(strange) == len(ODD) + 1 and strange.score.notna().all()
    assert quality_classifier.classify(none, labels, "doc_id").count() == 0
    assert set(quality_classifier.classify(odd, labels.limit(0), "doc_id").toPandas().score) == {0.5}


def test_isotonic():
    x, y = quality_classifier.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 2, 1, 3]), np.array([2.0, 2, 2, 3]))
    assert y.tolist() == [0.0, 0.75, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def test_language_model(spark, odd, none):
    r = random.Random(10)
    tongues = [["lirum", "larum", "lorem", "ipsum"] * 3 + [f"al{i}o" for i in range(30)], ["vax", "vux", "vox", "vex"] * 3 + [f"ze{i}k" for i in range(30)]]
    rows = [(i, " ".join(r.choice(tongues[i % 2]) for _ in range(r.randint(5, 120)))) for i in range(600)] + [(1000 + k, t) for k, t in texts()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("token", F.lit("x")).withColumn("row", F.lit(1))
    got = gated_lm.score(docs, "doc_id").toPandas()
    assert len(got) == len(rows)
    words = lambda t: [*re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    counts = collections.Counter(w for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((k, len(words(t)), sum(counts[w] > 0 for w in words(t)), sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for k, t in rows)
    have = sorted(zip(got.doc_id, got.n_tokens, got.n_known, got.base_score, strict=True))
    assert [w[:3] for w in want] == [h[:3] for h in have] and np.allclose([w[3] for w in want], [h[3] for h in have])
    assert set(got.train_tokens) == {n}
    tongue = got[(got.doc_id < 600) & got.held_out]
    assert tongue.score.sum() > tongue.base_score.sum()
    assert gated_lm.score(none, "doc_id").count() == 0


def test_language_model_reads_every_training_text_once(spark, odd):
    rows = [*((i, PROSE) for i in range(300)), *((300 + i, f"text {i}") for i in range(300)), *((None, f"no key {i}") for i in range(30)), *texts()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    vocabulary = gated_lm.vocabulary_of(checkpointed(gated_lm.word_counts(docs)))
    dealt = gated_lm.training_texts(docs, "doc_id", "text", vocabulary, 5, 4)
    parts = dealt.withColumn("part", F.spark_partition_id()).collect()
    want = collections.Counter(vocabulary.symbols(gated_lm.words_of(t or ""))[1].astype("<u2").tobytes() for _, t in rows)
    assert collections.Counter(bytes(row["symbols"]) for row in parts) == want
    assert len({row["shard"] for row in parts}) == 5 == len({(row["shard"], row["part"]) for row in parts}) and {row["round"] for row in parts} == {0, 1, 2, 3}
    # Each text moves the weights, also alone.
    start = gated_lm.Network(vocabulary).flat
    for text in ("text 1", "text 2", "text 3", "text 4"):
        assert not np.array_equal(gated_lm.train(docs.filter(F.col("text") == text), "doc_id", "text", vocabulary), start)


def test_language_model_does_not_depend_on_the_layout(spark, odd, monkeypatch):
    monkeypatch.setattr(gated_lm, "SHARD_TOKENS", 400)
    monkeypatch.setattr(gated_lm, "AVERAGED", 3)
    rows = [*((i, f"{PROSE} text {i % 40}") for i in range(200)), *texts()[:4]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [sorted(map(tuple, gated_lm.score(docs.repartition(parts), "doc_id").collect())) for parts in (1, 4, 32)]
    assert found[0] and all(a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9) for other in found[1:] for a, b in zip(found[0], other, strict=True))


def test_many_shards_keep_most_of_the_gain(spark):
    r = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    follow = {w: r.sample(words, 3) for w in words}

    def text():
        out = [r.choice(words)]
        for _ in range(150):
            out.append(r.choice(follow[out[-1]]))
        return " ".join(out)

    docs = checkpointed(spark.createDataFrame([(i, text()) for i in range(1200)], "doc_id bigint, text string"))
    gains = []
    for shards in (1, 8):
        tokens = gated_lm.SHARD_TOKENS
        gated_lm.SHARD_TOKENS = -(-150_000 // shards)
        try:
            got = gated_lm.score(docs, "doc_id").toPandas()
        finally:
            gated_lm.SHARD_TOKENS = tokens
        held = got[got.held_out]
        gains.append((held.score.sum() - held.base_score.sum()) / held.n_tokens.sum())
    assert gains[0] > 0.2 and gains[1] > 0.5 * gains[0]


def test_language_model_gradients():
    """Backpropagation against differences, and scores that do not depend on windows or neighbours."""
    words, counts = ["\n", *[f"w{i}" for i in range(60)]], np.arange(61, 0, -1)
    network = gated_lm.Network(gated_lm.Vocabulary(words, counts, int(counts.sum()), 61, np.zeros((gated_lm.BUCKETS, 2), "i8")), None)
    network = gated_lm.Network(network.vocabulary, network.flat.astype("f8"))
    r = np.random.default_rng(11)
    x, y, fresh = r.integers(0, 61, (5, 3)), r.integers(0, 61, (5, 3)), r.random((5, 3)) < 0.2
    start = np.zeros((3, gated_lm.HIDDEN))

    def loss():
        h, total = start, 0.0
        for t in range(5):
            h = np.where(fresh[t][:, None], 0, h)
            h = network.step(x[t], h)[4]
            total -= network.log_probabilities(h, y[t]).sum()
        return total

    grads, _, (inputs, out) = network.gradients(x, y, fresh, start)
    e = np.zeros(network.e.shape)
    e[inputs[0]] = inputs[1]
    ww = np.zeros(network.ww.shape)
    for members, g, _ in out:
        ww[members] += g
    for weights, gradient in ((network.u, grads["u"]), (network.wc, grads["wc"]), (network.e, e), (network.ww, ww)):
        for _ in range(6):
            i = np.unravel_index(np.abs(gradient).argsort(axis=None)[-1 - r.integers(0, 40)], gradient.shape)
            before = weights[i]
            weights[i] = before + 1e-4
            up = loss()
            weights[i] = before - 1e-4
            down = loss()
            weights[i] = before
            assert abs((up - down) / 2e-4 - gradient[i]) < 2e-3 * max(1, abs(gradient[i]))
    lengths = (1, 300, 64, 65, 7)
    some = [r.integers(0, 61, n) for n in lengths]
    together = gated_lm.text_scores(network, some)
    assert np.allclose(together, [gated_lm.text_scores(network, [s])[0] for s in some], rtol=1e-4)


def test_scores_of_texts_do_not_depend_on_their_neighbours():
    r = np.random.default_rng(1)
    words, counts = ["\n", *[f"w{i}" for i in range(3000)]], np.arange(3001, 0, -1)
    network = gated_lm.Network(gated_lm.Vocabulary(words, counts, int(counts.sum()), 3001, np.ones((gated_lm.BUCKETS, 2), "i8")))
    some = [r.integers(0, 1600, n) for n in r.integers(1, 200, 60)]
    together, alone = gated_lm.text_scores(network, some), [gated_lm.text_scores(network, [one])[0] for one in some]
    assert np.allclose(together, alone, rtol=1e-11, atol=0)


def test_words_in_a_column_are_the_words_of_each_text():
    some = ["", None, " a  b\t", "A\x0b\x0c\r\nb\x1cc\u0085d É", "  ", "x", *(t for _, t in ODD)]
    words, counts = gated_lm.words_in(pa.array(some, pa.string()))
    want = [gated_lm.words_of(t or "") for t in some]
    assert counts.tolist() == [len(w) for w in want] and words.to_pylist() == [x.decode() for w in want for x in w]
    names, rows = np.array([3, 1, 3, 3, 9, 3, 3, 1, 70_000]), np.arange(18.0).reshape(9, 2)
    for few in (names, names[:8]):
        found, sums = gated_lm._sums_by(few, rows[: len(few)])
        assert found.tolist() == sorted(set(few.tolist())) and np.allclose(sums, [rows[: len(few)][few == name].sum(axis=0) for name in found])


def test_new_words_go_through_the_library_together(monkeypatch):
    tokenizer = packing.TextTokenizer(public_tokenizers.path(packing.VOCABULARY))
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeionrst中éß") for _ in range(r.randint(1, 12)))
    some = [" ".join(word() + r.choice(["", "", ",", ".", "<|endoftext|>", "\0"]) for _ in range(r.randint(0, 300))) for _ in range(20)]
    some += [t for _, t in texts()]
    library, want = tokenizer._library, []
    for t in some:
        want.append(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
    assert tokenizer.ids(some) == want
    # As many calls as there are bounded lots, not one text a word.
    words = list({" " + word() for _ in range(3000)})
    assert b"".join(tokenizer._together(words)) == np.array(library.encode("".join(words), add_special_tokens=False).ids, "<u4").tobytes()
    # Where a token went over the end of a piece, pieces go one by one.
    tokenizer._sizes = tokenizer._sizes * 0 + 1
    assert tokenizer._together(words) is None
    fresh = packing.TextTokenizer(public_tokenizers.path(packing.VOCABULARY))
    monkeypatch.setattr(fresh, "_together", lambda pieces: None)
    assert fresh.ids(some) == want


def test_decoding_takes_tokens_as_a_column():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    vocabulary, r = bpe._vocabulary(public_tokenizers.path(bpe.RANKS)), random.Random(4)
    assert isinstance(vocabulary, pa.Array)
    by_id = {i: token for token, i in ranks.items()}
    for n in (0, 1, 5, bpe.DECODE_LEAF, bpe.DECODE_LEAF + 1, 3 * bpe.DECODE_LEAF + 7):
        ids = [r.choice([*range(300), len(ranks) - 1]) for _ in range(n)]
        ids = [i for i in ids if i in by_id]
        assert bpe.decode_tree(np.array(ids, "i4"), vocabulary) == b"".join(by_id[i] for i in ids)
