"""The manifest, the lexical search and the exact dedup against brute force, on small and awkward tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import exact_dedup, lexical_search, merkle
from scriptorium.llm.common import prepare

PROSE = "The cat sat on the mat and looked at a bird that flew over green fields near the old mill. "
#: Null keys, sources and texts, empty, blank and very long texts, capitals beyond ASCII, copies, repeated rows.
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "word", "b"), (5, PROSE * 3000, "a"), (6, PROSE, "a"), (6, PROSE, "a"), (7, PROSE.upper(), "é"),
    (None, PROSE, "a"), (None, None, None), (8, "ÀÉ x", "z"), (9, "àé X", "Z"), (10, "ÀÉ X", "a"), (11, "word", None), (6, "other", "b"), (None, "other", "b"),
    *[(100 + i, f"copy {i % 3}", "hot") for i in range(700)],
]
CLASHES = ("id", "sha", "row", "_row", "_key", "block", "bit", "n", "_maybe", "tree", "page", "index", "digest", "altered", "term", "terms", "tfs", "item", "rank", "score", "question", "keep_id")


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").repartition(5)
    return rows.select("*", *[F.lit("clash").alias(name) for name in CLASHES])


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def first(key):
    return (key is not None, key or 0)


# Exact dedup


@pytest.mark.parametrize("blocks", [exact_dedup.FILTER_BLOCKS, 1])
def test_exact_duplicates(odd, blocks, monkeypatch):
    if blocks == 1:
        # Several slices, as for a table beyond one filter.
        monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 200)
    groups = collections.defaultdict(list)
    for key, text, _ in ROWS:
        groups[lowered(text)].append(key)
    want = collections.Counter()
    for text, keys in groups.items():
        keep = max(keys, key=first)
        for i, key in enumerate(sorted(keys, key=first)):
            want[(key, keep, len(keys), i == len(keys) - 1, sha(text))] += 1
    made = exact_dedup.duplicate_groups(odd, "doc_id", filter_blocks=blocks)
    assert made.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert collections.Counter(map(tuple, made.collect())) == want
    stays = exact_dedup.deduplicated(odd, "doc_id", filter_blocks=blocks)
    assert stays.columns == odd.columns
    assert sorted((lowered(r["text"]), r["doc_id"]) for r in stays.collect()) == sorted((t, max(k, key=first)) for t, k in groups.items())
    assert exact_dedup.duplicate_groups(odd.limit(0), "doc_id").count() == 0 and exact_dedup.deduplicated(odd.limit(0), "doc_id").count() == 0


def test_filter_finds_every_repeated_digest_and_few_others(spark):
    digests = spark.range(20_000).select(F.sha2(F.when(F.col("id") < 500, F.col("id") % 100).otherwise(F.col("id")).cast("string"), 256).alias("sha"), "id")
    blocks = exact_dedup._filter_sizes(20_000, exact_dedup.FILTER_BLOCKS)[1]
    marked = exact_dedup.flagged(digests, blocks)
    assert marked.filter("id < 500").filter("NOT _maybe").count() == 0
    assert marked.filter("id >= 500 AND _maybe").count() < 0.1 * 20_000


def test_exact_dedup_is_native(odd):
    plan = exact_dedup.duplicate_groups(odd, "doc_id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


# Merkle manifest


def brute_levels(leaves, fan=merkle.FAN):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


def brute_proof(levels, index):
    out = []
    for level in levels[:-1]:
        start = index - index % merkle.FAN
        out += [d for i, d in enumerate(level[start : start + merkle.FAN], start) if i != index]
        index //= merkle.FAN
    return out


def test_addresses_are_those_of_a_sequential_builder():
    for fan in (2, 3, 16):
        for n in [*range(70), 255, 256, 257, 300]:
            leaves = [sha(str(i)).encode() for i in range(n)]
            log = merkle.append_log(leaves, fan)
            levels = brute_levels([d.decode() for d in leaves], fan) if n else []
            at = {merkle.address(level, i, n, fan): d for level, nodes in enumerate(levels) for i, d in enumerate(nodes)}
            assert [at[i] for i in range(len(at))] == [d.decode() for d in log]


def brute_manifest(rows):
    """Rows (tree, key, digest, altered) to their sorted (key, leaf, subroot, root, siblings, verified), and the levels of the trees."""
    trees = collections.defaultdict(list)
    for tree, key, digest, altered in rows:
        trees[tree].append((first(key), digest, altered, key))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    levels = {t: brute_levels([leaf[1] for leaf in sorted(trees[t], key=lambda x: x[:2])]) for t in names}
    top = brute_levels([levels[t][-1][0] for t in names])
    out = []
    for rank, t in enumerate(names):
        for i, (_, digest, altered, key) in enumerate(sorted(trees[t], key=lambda x: x[:2])):
            siblings = "".join(brute_proof(levels[t], i) + brute_proof(top, rank))
            out.append((key, digest, levels[t][-1][0], top[-1][0], siblings, altered is None or altered == digest))
    return out, levels


def by_key(rows):
    return sorted(map(tuple, rows), key=lambda r: (first(r[0]), r[1:]))


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17, None: 1, "é": 16, "Z": 256}, {"hot": 5000, "b": 257, **{f"s{i}": 1 for i in range(300)}}])
def test_manifest(spark, sizes):
    prepare(spark)
    r = random.Random(7)
    rows = [(t, r.choice([i, i, i // 2]) if r.random() > 0.01 else None, sha(f"{t} {i // 3}"), r.choice([None, None, sha(f"{t} {i // 3}"), sha("x")])) for t, n in sizes.items() for i in range(n)]
    leaves = spark.createDataFrame(r.sample(rows, len(rows)), "tree string, key bigint, digest string, altered string").repartition(7)
    made = merkle.manifest(leaves)
    want, levels = brute_manifest(rows)
    proofs = made.proofs("doc_id")
    found = [r for r in proofs.collect()]
    assert by_key(r[:5] for r in found) == by_key(w[:5] for w in want)
    assert by_key((r["doc_id"], r["leaf"], r["verified"]) for r in found) == by_key((w[0], w[1], w[5]) for w in want)
    assert all((r["folded_root"] == r["root"]) == r["verified"] for r in found)
    digests = made.proof_digests("doc_id").collect()
    assert by_key((r["doc_id"], r["leaf"], r["proof_sha256"]) for r in digests) == by_key((w[0], w[1], sha(w[4])) for w in want)
    log = collections.defaultdict(dict)
    for row in made.log().collect():
        assert row["position"] not in log[row["tree"]] and levels[row["tree"]][row["level"]][row["index"]] == row["digest"]
        log[row["tree"]][row["position"]] = row["digest"]
    for tree, nodes in log.items():
        sequential = merkle.append_log([d.encode() for d in levels[tree][0]])
        assert [nodes[i] for i in range(len(nodes))] == [d.decode() for d in sequential]


def test_manifest_of_odd_rows(odd):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    columns = [F.col("doc_id"), F.col("source"), F.col("text")]
    leaves = odd.select(F.col("source").alias("tree"), F.col("doc_id").alias("key"), merkle.leaf_digest(*columns).alias("digest"), F.lit(None).cast("string").alias("altered"))
    want, _ = brute_manifest([(s, k, sha(field(k) + field(s) + field(t)), None) for k, t, s in ROWS])
    assert by_key(r[:5] for r in merkle.manifest(leaves).proofs("doc_id").collect()) == by_key(w[:5] for w in want)
    none = merkle.manifest(leaves.limit(0))
    assert none.root is None and none.proofs("doc_id").count() == 0 and none.log().count() == 0


# Lexical search


def brute_search(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    bags = [(key, collections.Counter(words(t))) for key, t in docs]
    bags = [(key, bag, sum(bag.values())) for key, bag in bags if bag]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = collections.Counter(t for _, bag, _ in bags for t in bag)
    questions = collections.defaultdict(collections.Counter)
    for item, text in set(items):
        questions[item].update(words(text))
    out = []
    for item, asked in questions.items():
        scored = []
        for key, bag, n in bags:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, c in asked.items() if t in bag)
            if score > 0:
                scored.append((-score, first(key), key))
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return out


def found_rows(made):
    return sorted(map(tuple, made.collect()), key=lambda r: (first(r[0]), r[1]))


ITEMS = [(1, PROSE), (1, PROSE), (2, "word WORD copy"), (2, "1"), (None, "àé x zzz"), (3, None), (4, "!!"), (5, "nowhere"), (6, "copy 1 2 mill")]


@pytest.mark.parametrize("vocabulary", [lexical_search.VOCABULARY, 7])
def test_lexical_search(spark, odd, vocabulary, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD", 100)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("term", F.lit("clash"))
    made = lexical_search.search(odd, items, "doc_id", "item_id", k=20, vocabulary=vocabulary)
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    assert found_rows(made) == sorted(brute_search([(k, t) for k, t, _ in ROWS], ITEMS, 20), key=lambda r: (first(r[0]), r[1]))
    assert lexical_search.search(odd.limit(0), items, "doc_id", "item_id").count() == 0
    assert lexical_search.search(odd, items.limit(0), "doc_id", "item_id").count() == 0


def random_vectors(r, docs, terms, topics):
    """Sparse rows around some topics, with copies."""
    rows = []
    for _ in range(docs):
        topic = r.randrange(topics)
        chosen = {topic * 40 + r.randrange(40) for _ in range(r.randint(5, 25))} | {terms - 1 - int(r.expovariate(0.2)) % 40 for _ in range(15)}
        rows.append(sorted((t, r.randint(1, 10**6)) for t in chosen))
        if r.random() < 0.2:
            rows.append(rows[-1])
    ptr = np.r_[0, np.cumsum([len(row) for row in rows])]
    return ptr, np.array([t for row in rows for t, _ in row], "i8"), np.array([v for row in rows for _, v in row], "i8")


def test_blocks_bound_their_documents_and_are_skipped(monkeypatch):
    r = random.Random(11)
    topics, terms = 30, 1300
    ptr, term, impact = random_vectors(r, 1500, terms, topics)
    weights = np.array([r.randint(1, 9000) for _ in range(terms)], "i8")
    monkeypatch.setattr(lexical_search, "ENTRIES", 5000)
    monkeypatch.setattr(lexical_search, "LONG", 28)
    shard = lexical_search.Shard(ptr, term, impact, weights)
    matrix = np.zeros((len(ptr) - 1, terms), "i8")
    matrix[np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), term] = impact
    assert len(shard.long) and sorted(zip(shard.posting, np.repeat(shard.terms, np.diff(shard.list_ptr)), strict=True)) == [
        (d, t) for d in range(len(matrix)) if (matrix[d] > 0).sum() <= 28 for t in np.flatnonzero(matrix[d])
    ]
    read = blocks = 0
    import pyarrow as pa

    keys = pa.array(range(len(matrix)))
    for _ in range(40):
        topic = r.randrange(topics)
        asked = np.array(sorted({topic * 40 + r.randrange(40) for _ in range(12)} | {terms - 1 - r.randrange(5)}), "i8")
        times = weights[asked] * r.randint(1, 3)
        coords = np.searchsorted(shard.terms, asked)
        bound = shard.bounds(coords, times)
        exact = matrix[:, asked] @ times
        for b, (a, z) in enumerate(zip(shard.block_start, shard.block_end, strict=True)):
            assert bound[b] == matrix[shard.posting[a:z]][:, asked].max(axis=0) @ times
        best = lexical_search.Best(20).at(keys, np.arange(len(matrix)))
        read += shard.search(asked, times, best)
        blocks += sum(shard.first_block[c + 1] - shard.first_block[c] for c in coords)
        order = np.lexsort((np.arange(len(exact)), -exact))[:20]
        assert [(-s, k) for s, _, k in best.rows] == [(exact[i], i) for i in order if exact[i] > 0]
    assert read < 0.7 * blocks
