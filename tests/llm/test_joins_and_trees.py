"""Operators 11 to 13 against their plain versions: hard inputs, rare paths, whole tables."""

import random

import numpy as np
import pytest

from quarry.llm import fill_in_middle, io, jaccard_join, prefix_trie
from quarry.llm.components import components
from tests.llm import brute
from tests.llm.test_operators import MORE, docs, empty, named, prose, same, texted, variant  # noqa: F401  (empty needs docs)

TRIE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"
JACCARD = "doc_id n_shingles component_id"
MIDDLE = "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256"


# --- 11


def conversations(spark, rows):
    data = [(*r, "c", k, "x") for k, r in enumerate(rows)]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, bucket string, n long, path string").repartition(3)


def talk(seed, n, convs):
    """Conversations that share turns, with ties, nulls, repeats and copies."""
    r = random.Random(seed)
    some = [("user", f"turn {k} é" * (k % 3)) for k in range(4)] + [("assistant", None), (None, ""), (None, "x"), ("system", "🦀 a\nb")]
    rows = []
    for c in convs:
        for t in range(r.randint(1, n)):
            rows.append((c, r.choice([t, t, t, None, 0]), *r.choice(some)))
    return rows


CONVS = [*range(0, 40), *range(100, 130), 205, 206, 311, -3, -250, -200, 10**15 + 7, 10**15]
TALK = talk(1, 7, CONVS) + [(None, 1, "user", "lost")] + [(c, k, "user", "same") for c in range(400, 460) for k in range(9)]


@pytest.mark.parametrize("local", [prefix_trie.LOCAL, 20, 2, 1])
def test_trie(spark, monkeypatch, local):
    monkeypatch.setattr(prefix_trie, "LOCAL", local)
    same(prefix_trie.trie(conversations(spark, TALK)), TRIE, brute.trie(TALK))


def test_trie_of_long_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LOCAL", 3)
    rows = [(c, k, "user", f"t{k}" if k < 60 else f"own {c % 5}") for c in range(1, 40) for k in range(62)]
    same(prefix_trie.trie(conversations(spark, rows)), TRIE, brute.trie(rows))


def test_trie_of_hard_inputs(spark):
    none = conversations(spark, TALK[:1]).limit(0)
    assert prefix_trie.trie(none).count() == 0
    only = [(7, None, None, None)]
    same(prefix_trie.trie(conversations(spark, only)), TRIE, brute.trie(only))
    lost = [(None, 1, "user", "x")]
    assert prefix_trie.trie(conversations(spark, lost)).count() == 0
    turnless = [(101, 0, "user", "a"), (102, 0, "user", "b"), (103, 0, "user", "c")]
    same(prefix_trie.trie(conversations(spark, turnless)), TRIE, brute.trie(turnless))


def test_trie_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LOCAL", 10)
    df = io.table(spark, "/root/testdata/sf0.01", "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    same(prefix_trie.op11_prefix_trie(spark, "/root/testdata/sf0.01"), TRIE, brute.trie(rows))


def test_multikey_quicksort_by_all_prefixes():
    r = np.random.default_rng(4)
    for _ in range(40):
        turns = [np.array(x, np.int64) for x in {tuple(r.integers(0, 3, r.integers(0, 6)).tolist()) for _ in range(r.integers(1, 30))}]
        chars = [x * 2 + 1 for x in turns]
        n, least = r.integers(1, 4, len(turns)), r.permutation(100)[: len(turns)]
        ends = [f"e{k}" for k in range(len(turns))]
        got = prefix_trie.quicksorted(turns, chars, least, n, ends, 0, None)
        expected = {}
        for k, x in enumerate(turns):
            for d in range(len(x) + 1):
                expected.setdefault(tuple(x[:d].tolist()), []).append(k)
        assert len(got) == len(expected)
        by = {(x[0], x[1]): x for x in got}
        for p, who in expected.items():
            x = by[int(least[who].min()), len(p)]
            assert x[3] == n[who].sum() and x[4] == len({q for q in expected if len(q) == len(p) + 1 and q[: len(p)] == p})
            below = [q for q in expected if q[: len(p)] == p]
            assert x[5] == sum(not any(o != q and o[: len(q)] == q for o in expected) for q in below)
            assert x[6] == sum((int(n[expected[q]].sum()) - 1) * (2 * q[-1] + 1) for q in below if q)


# --- 12


def near_family(seed, n, words):
    """Texts some edits apart, around the least similarity."""
    r = random.Random(seed)
    base = prose(seed, words)
    return [variant(base, *r.sample(range(words), r.randint(0, max(1, words // 28)))) for _ in range(n)]


FAMILIES = [*MORE, *enumerate(near_family(300, 25, 120) + near_family(301, 20, 45) + near_family(302, 10, 300) + near_family(303, 6, 10), 500)]
FAMILIES += [(600 + k, f"{prose(310, 40)} {prose(320 + k, 6)}") for k in range(15)] + [(700 + k, f"{prose(330 + k, 60)} {prose(311, 50)}") for k in range(10)]
FAMILIES += [(800, "One two"), (801, "one TWO"), (802, "one two three"), (803, "one"), (804, " ONE\t")]


@pytest.mark.parametrize("path", ["as it is", "all frequent", "none frequent", "runs of three", "chunks", "joined", "all runs", "some runs"])
def test_jaccard_join(spark, monkeypatch, path):
    whole = jaccard_join.levels_of
    if path in ("all frequent", "runs of three"):
        monkeypatch.setattr(jaccard_join, "levels_of", lambda counts: (whole(counts)[0], 0))
    if path == "none frequent":
        monkeypatch.setattr(jaccard_join, "levels_of", lambda counts: (whole(counts)[0], 256))
    if path == "runs of three":
        monkeypatch.setattr(jaccard_join, "COMBINATION", 3)
    if path == "chunks":
        monkeypatch.setattr(jaccard_join, "BUCKET", 4)
        monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    if path.endswith("runs"):
        monkeypatch.setattr(jaccard_join, "LARGE", 1 if path == "all runs" else 110)
    if path == "joined":
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in FAMILIES], "doc_id long, text string, node string, keys string").repartition(3)
    expected = brute.jaccard(FAMILIES)
    assert len({x[2] for x in expected}) < len({t for _, t in FAMILIES})
    same(jaccard_join.classes(df), JACCARD, expected)


def test_links_of_near_texts_are_kept_as_one_for_each(spark, monkeypatch):
    base, given, n = prose(340, 120), [], 40
    rows = [(k, variant(base, k + 20)) for k in range(n)]

    def counted(links):
        given.append(links.count())
        return components(links)

    monkeypatch.setattr(jaccard_join, "components", counted)
    same(jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), JACCARD, brute.jaccard(rows))
    assert given[0] > n and all(x < n for x in given[1:])


def test_jaccard_join_of_hard_inputs(spark, empty):  # noqa: F811
    assert jaccard_join.classes(empty).count() == 0
    same(jaccard_join.classes(named(spark, MORE)), JACCARD, brute.jaccard(texted(MORE)))


def test_sketches_never_exceed_the_differing_tokens():
    r = np.random.default_rng(8)
    for _ in range(100):
        sets = [np.unique(r.integers(0, 1 << 20, int(r.integers(1, 3000))).astype(np.uint64) << np.uint64(8)) for _ in range(2)]
        n = np.array([len(x) for x in sets])
        width = jaccard_join.wide_enough(n)
        raw = jaccard_join.parities(np.concatenate(sets), np.repeat([0, 1], n), width).tobytes()
        x, y = raw[: width[0] // 8], raw[width[0] // 8 :]
        size = min(len(x), len(y))
        assert np.bitwise_count(jaccard_join.folded(x, size) ^ jaccard_join.folded(y, size)).sum() <= len(np.setxor1d(*sets))
        assert (jaccard_join.folded(x, 32) == np.frombuffer(jaccard_join.parities(sets[0], np.zeros(n[0], int), np.array([256])).tobytes(), np.uint8)).all()


def test_every_similar_pair_shares_a_key(monkeypatch):
    """The prefixes by themselves, on random sets around the least similarity and any classes of tokens."""
    r = np.random.default_rng(6)
    for large in (jaccard_join.LARGE, 60, 1) * 100:
        monkeypatch.setattr(jaccard_join, "LARGE", large)
        size = int(r.integers(2, 120))
        x = r.choice(10_000, size, replace=False)
        more = r.integers(0, size // 9 + 1)
        lost = r.integers(0, size // 10 + 1)
        y = np.concatenate((x[lost:], 10_000 + r.choice(10_000, more, replace=False)))
        level = np.zeros(jaccard_join.CLASSES, np.uint8)
        spread = np.arange(20_000, dtype=np.uint64) << np.uint64(40)
        level[:20_000] = r.integers(0, 6, 20_000)
        sets = [np.unique(spread[v]) for v in (x, y)]
        both = len(np.intersect1d(*sets))
        if 10 * both < 9 * (len(sets[0]) + len(sets[1]) - both) or np.array_equal(*sets):
            continue
        n = np.array([len(v) for v in sets])
        row, keys = jaccard_join.index_keys(np.concatenate(sets), np.repeat([0, 1], n), n, level, int(r.integers(0, 7)))
        assert np.intersect1d(keys[row == 0], keys[row == 1]).size


def bucket_rows(monkeypatch):
    """The rows of every table of buckets that is written from now on."""
    counts, whole = [], io.written

    def counted(df):
        out = whole(df)
        if out.columns == ["key", "node", "center"]:
            counts.append(out.count())
        return out

    monkeypatch.setattr(io, "written", counted)
    return counts


def test_keys_of_the_same_nodes_are_one_bucket(spark, monkeypatch):
    rows, pairs = [], 20
    for k in range(pairs):
        base = prose(350 + k, 100)
        rows += [(2 * k, base), (2 * k + 1, variant(base, 50))]
    counts = bucket_rows(monkeypatch)
    same(jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), JACCARD, brute.jaccard(rows))
    assert len(counts) == 1 and 2 * pairs <= counts[0] <= 4 * pairs


@pytest.mark.parametrize("whole", [False, True])
def test_small_buckets_are_compared_together(monkeypatch, whole):
    import pyarrow as pa

    r = np.random.default_rng(9)
    n_buckets, names = 500, ["key", "chunk", "node", "root", "n", *jaccard_join.SKETCH]
    size = r.integers(1, 14, n_buckets)
    key = np.repeat(np.arange(n_buckets), size)
    node = np.concatenate([r.choice(300, k, replace=False) for k in size])
    n = r.integers(80, 120, 300)
    # near and far sketches, the first bit of a word among them
    sketch = r.integers(-(1 << 63), 1 << 63, (4, 4))[r.integers(0, 4, 300)] ^ np.where(r.random((300, 4)) < 0.5, np.int64(-(1 << 63)), 0)
    columns = [key, np.zeros(len(key), np.int64), node, node % 40, n[node], *sketch[node].T]
    rows = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)
    alone, one = [], jaccard_join.bucket_pairs
    monkeypatch.setattr(jaccard_join, "bucket_pairs", lambda rows, *more: alone.append(len(rows)) or one(rows, *more))
    batches = [rows.slice(k, 100) for k in range(0, len(key), 100)]
    got = {(int(a), int(b)) for x in jaccard_join.across(iter(batches), whole) for a, b in zip(*x.columns, strict=True) for a, b in [(a.as_py(), b.as_py())]}
    expected = set()
    for k in range(n_buckets):
        own = node[key == k]
        for a in own:
            for b in own:
                differing = sum(int(x).bit_count() for x in (sketch[a] ^ sketch[b]).view(np.uint64))
                fits = 10 * min(n[a], n[b]) >= 9 * max(n[a], n[b]) and 19 * differing <= n[a] + n[b]
                if a < b and a % 40 != b % 40 and fits and (whole or len(own) <= 12):
                    expected.add((int(a), int(b)))
    assert len(expected) > 100 and (got == expected if whole else got >= expected)
    assert len(alone) == (size == 13).sum()


def test_a_pair_of_large_buckets_is_returned_by_the_first():
    import pyarrow as pa

    n, n_keys = 20, 30
    node = np.arange(n)
    batches = []
    for key in range(n_keys):
        columns = [np.full(n, key), np.zeros(n, np.int64), node, node, np.full(n, 100), *np.zeros((4, n), np.int64)]
        earlier = pa.array([[k for k in range(key) if (k + x) % 7] for x in node.tolist()], pa.list_(pa.int64()))
        # a node isn't in every bucket
        own = np.flatnonzero((key + node) % 7)
        batches.append(pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], earlier], ["key", "chunk", "node", "root", "n", *jaccard_join.SKETCH, "earlier"]).take(pa.array(own)))
    got = [tuple(p) for x in jaccard_join.across(iter(batches), True) for p in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)]
    assert sorted(got) == [(a, b) for a in range(n) for b in range(a + 1, n)]


# --- 13


LINES = [
    *MORE, (50, "a\nb\n"), (51, "\n\n\n"), (52, "no newline"), (53, "é\n🦀🦀\nß end"), (54, "has <P> in\nit"), (55, "<M>"), (56, "< P>\n<S\n>"), (57, "x\r\ny\rz"),
    *[(60 + k, "same\ntext\nof many\n") for k in range(40)], (None, "same\ntext\nof many\n"), (60, "same\ntext\nof many\n"), (200, "\n".join(prose(k, 5) for k in range(3000))),
    (201, "é" * 5000 + "\n" + "x" * 70_000 + "\n" + "🦀\n" * 600),
]


def test_fill_in_middle(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in LINES], "doc_id long, text string, form string, n int").repartition(3)
    same(fill_in_middle.report(df), MIDDLE, brute.fill_in_middle(LINES))
    monkeypatch.setattr(io, "HEAVY", 4)  # a text of a fourth of all rows is dealt over several keys
    monkeypatch.setattr(fill_in_middle, "HELD", 64)
    same(fill_in_middle.report(df), MIDDLE, brute.fill_in_middle(LINES))


def test_fill_in_middle_of_hard_inputs(spark, empty):  # noqa: F811
    assert fill_in_middle.report(empty).count() == 0
    same(fill_in_middle.report(named(spark, MORE)), MIDDLE, brute.fill_in_middle(texted(MORE)))
    half = fill_in_middle.fill_in_middle(spark.createDataFrame(LINES, "doc_id long, text string"), seed=3, rate=40, spm_share=10)
    same(half, "doc_id n form prefix_chars middle_chars", [x[:5] for x in brute.fill_in_middle(LINES, 3, 40, 10)])


def test_texts_with_equal_hashes_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(k, f"text {k % 3}\nof {k % 3}") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(F, "xxhash64", lambda *x: F.lit(5).cast("long"))
    same(fill_in_middle.report(df), MIDDLE, brute.fill_in_middle(rows))


def test_elias_fano_lists():
    r = np.random.default_rng(1)
    for n, most in ((1, 1), (1, 10**6), (5, 5), (1000, 1000), (3000, 10**7), (700, 701), (2, 10**9)):
        values = np.sort(r.choice(most, n, replace=False) + 1 if most < 10**7 else r.integers(1, most + 1, n))
        packed = fill_in_middle.EliasFano(values.astype(np.int64), most)
        assert [packed[i] for i in range(n)] == values.tolist()
        assert (packed.low.nbytes + packed.high.nbytes) * 8 <= n * (2 + max(0, np.ceil(np.log2(most / n)))) + 64


# --- near copies of the pipeline


def test_no_similar_candidate_is_left_out(spark, monkeypatch):
    """Classes by all pairs of texts that are near by their fingerprints and similar, in families around the least
    similarity: a bucket's forest alone would join texts over others that aren't similar."""
    import pyarrow as pa

    from quarry.llm import simhash

    r = random.Random(77)
    rows = []
    for family in range(6):
        base = prose(900 + family, 60)
        for _ in range(30):
            rows.append((len(rows), variant(base, *r.sample(range(60), r.randint(0, 5)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps = simhash.fingerprints_of(pa.array([t for _, t in rows]), simhash.SIMILAR)
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            close = np.bitwise_count(fps[a] ^ fps[b]).sum() <= simhash.SIMILAR.bits
            if close and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    expected = sorted({find(x) for x in range(len(rows))})
    assert 6 < len(expected) < len(rows) - 10
    assert sorted(x["doc_id"] for x in simhash.keep(df).collect()) == expected
    monkeypatch.setattr(simhash, "BUCKET", 3)
    assert sorted(x["doc_id"] for x in simhash.keep(df).collect()) == expected


def test_every_pair_of_near_copies_shares_a_key():
    """As for operator 12, at the least similarity of near copies, and with single rare tokens whatever the size."""
    from quarry.llm import simhash

    r, seen = np.random.default_rng(13), 0
    for _ in range(300):
        size = int(r.integers(2, 120))
        x = r.choice(10_000, size, replace=False)
        y = np.concatenate((x[r.integers(0, size // 5 + 1) :], 10_000 + r.choice(10_000, r.integers(0, size // 4 + 1), replace=False)))
        level = np.zeros(jaccard_join.CLASSES, np.uint8)
        spread = np.arange(20_000, dtype=np.uint64) << np.uint64(40)
        level[:20_000] = r.integers(0, 6, 20_000)
        sets = [np.unique(spread[v]) for v in (x, y)]
        both = len(np.intersect1d(*sets))
        if 5 * both < 4 * (len(sets[0]) + len(sets[1]) - both) or np.array_equal(*sets):
            continue
        seen += 1
        n = np.array([len(v) for v in sets])
        row, keys = jaccard_join.index_keys(np.concatenate(sets), np.repeat([0, 1], n), n, level, int(r.integers(0, 7)), simhash.SHARE, np.inf)
        assert np.intersect1d(keys[row == 0], keys[row == 1]).size
    assert seen > 50


@pytest.mark.parametrize("n", [50, 300])
def test_texts_that_share_nothing_never_meet(spark, monkeypatch, n):
    """However many there are: segments of fingerprints brought ever more of them together."""
    from quarry.llm import simhash

    base = prose(999, 60)
    rows = [(k, " ".join(f"{k}w{j}" for j in range(40))) for k in range(n)] + [(n, base), (n + 1, variant(base, 5))]
    counts = bucket_rows(monkeypatch)
    kept = simhash.keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(n + 1))
    assert len(counts) == 1 and 2 <= counts[0] < 20


def test_the_first_variant_is_the_first_that_both_have():
    from quarry.llm import simhash

    r = np.random.default_rng(12)
    for scheme in (simhash.SIMILAR, simhash.CONTRACT):
        x = r.integers(0, 1 << 63, (200, scheme.width), dtype=np.uint64)
        y = x.copy()
        for k in range(len(y)):
            for bit in r.choice(64 * scheme.width, r.integers(1, scheme.bits + 1), replace=False):
                y[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        mine = simhash.first_variant(x, y, scheme)
        one, other = (simhash.variants(v, scheme).reshape(-1, len(x)) for v in (x, y))
        for k in range(len(x)):
            shared = [int(v >> np.uint64(22)) for v in np.intersect1d(one[:, k], other[:, k])]
            assert mine[k] == min(shared)
