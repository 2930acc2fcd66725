"""The numbered operators against their plain versions, over a fixture of hard cases and the smallest tables."""

import itertools
import random

import numpy as np
import pytest

from quarry.llm import (
    classifier, decontamination, html_extraction, io, piece_encoding, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, url_filters,
)
from quarry.llm.components import components, contracted, stars
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdeéß", k=r.randint(1, 7))) for _ in range(n))


ROWS = [
    (1, prose(1, 120)), (2, prose(1, 120)), (3, "start " + prose(2, 70) + " " + prose(1, 120)), (4, prose(2, 70) + " other end"),
    (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "A b\nA b\n\nA b"), (10, prose(3, 60) + " " + prose(3, 60)), (11, "x" * 900),
    (12, prose(4, 60) + prose(2, 70)), (13, "y " * 300), (13, "y " * 300), (14, prose(5, 4000) + prose(1, 120)), (15, "  a   b ▁ c 🦀 " + prose(6, 30)),
    (16, prose(7, 55)), (17, prose(7, 55).replace("a", "a", 1) + " tail"), (18, "\x1c\x85 é\u00a0z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", k) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, phrase string, fp long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def same(df, columns, expected):
    assert sorted((tuple(r[c] for c in columns.split()) for r in df.collect()), key=repr) == sorted(expected, key=repr)


def test_suffix_dedup(docs, empty):
    same(suffix_dedup.report(docs), "doc_id n_bytes n_removed n_spans kept_sha256", brute.suffix_dedup(ROWS))
    assert suffix_dedup.report(empty).count() == 0
    assert suffix_dedup.dedup(docs).columns == docs.columns


def test_substring_dedup(docs, empty):
    same(substring_dedup.dedup(docs), "doc_id n_words n_removed kept_sha256", brute.substring_dedup(ROWS))
    assert substring_dedup.dedup(empty).count() == 0


def test_simhash(docs, empty):
    same(simhash.report(docs), "doc_id fingerprint component_id", brute.simhash(ROWS))
    assert simhash.report(empty).count() == 0


def variant(text, *places):
    """The text with other words at some places."""
    w = text.split(" ")
    for k in places:
        w[k] = f"other{k}"
    return " ".join(w)


def kept_rows(df, expected):
    """As `same`, where any text of an id stands for those that are equally good."""
    got = [(r["doc_id"], r["text"]) for r in df.collect()]
    unsure = [i for i, t in expected if t == "any"]
    assert sorted(((i, "any" if i in unsure else t) for i, t in got), key=repr) == sorted(expected, key=repr)


def test_near_copies(spark, docs, empty):
    assert simhash.keep(docs).columns == docs.columns
    kept_rows(simhash.keep(docs), brute.near_copies(ROWS))
    assert simhash.keep(empty).count() == 0


def test_near_copies_beyond_four_bits(spark):
    base = prose(20, 100)
    rows = [(k, variant(base, *range(k * 7, k * 7 + 2))) for k in range(12)] + [(20, variant(base, 0, 20, 40, 60, 80)), (21, prose(21, 100))]
    assert len({x for _, _, x in brute.simhash(rows)}) > len(brute.near_copies(rows)) > 1
    kept_rows(simhash.keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), brute.near_copies(rows))


@pytest.mark.parametrize("n", [30, 60])
def test_links_of_near_copies_grow_with_the_group(spark, monkeypatch, n):
    """What is known of classes goes on as one link for each node, not as all links found."""
    base, given = prose(27, 120), []
    rows = [(k, variant(base, k + 20)) for k in range(n)]

    def counted(links):
        given.append(links.count())
        return components(links)

    monkeypatch.setattr(simhash, "components", counted)
    kept_rows(simhash.keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), brute.near_copies(rows))
    assert given[0] > 2 * n and all(x < n for x in given[1:])


@pytest.mark.parametrize("few", [True, False])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr("quarry.llm.components.LEAST_TASKS", 1 if few else 1000)
    chains = [(k, k + 1) for k in range(40) if k % 8] + [(k, 1000 - k) for k in range(0, 40, 8)]
    links = chains + [(100, k) for k in range(101, 160)] + [(7, 7), (9, 10)]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    root = {x: x for link in links for x in link if link != (7, 7)}
    for _ in root:
        for x, y in links:
            root[x] = root[y] = min(root.get(x, x), root.get(y, y))
    got = components(df)
    assert {r["node"]: r["root"] for r in got.collect()} == root and got.count() == len(root)
    assert {(r["a"], r["b"]) for r in stars(got).collect()} == {(x, y) for x, y in root.items() if x != y}
    more = spark.createDataFrame([(5, 39), (3, 4), (500, 150), (39, 5), (600, 601)], "a long, b long")
    assert {(r["a"], r["b"]) for r in contracted(more, got).collect()} == {(root[5], root[39]), (500, 100), (root[39], root[5]), (600, 601)}


def test_near_copies_by_row(spark):
    base = prose(22, 100)
    rows = [
        (5, prose(23, 90)), (3, base), (5, variant(base, 50)), (5, variant(base, 50)), (7, base), (7, base), (None, base), (None, variant(base, 1)),
        (None, prose(24, 80)), (None, prose(24, 80)), (None, variant(prose(24, 80), 3)), (8, prose(25, 70)), (8, prose(25, 70)), (8, prose(26, 70)),
        (None, None), (None, ""), (9, " "),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute.near_copies(rows)
    assert len(expected) == 6
    kept_rows(simhash.keep(df), expected)


def test_quality_rules(docs, empty):
    same(quality_rules.quality(docs), "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed", brute.quality(ROWS))
    assert quality_rules.quality(empty).count() == 0
    assert not [r for r in quality_rules.quality(docs).collect() if r["base_failed"] and r["kept"]]


def test_longest_repeats():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(30):
        tokens = r.integers(0, 3, r.integers(0, 40)).astype(np.uint64)
        got = quality_rules.longest_repeats(tokens, np.array([0, len(tokens)]), 1)
        assert got.tolist() == brute.longest_repeat(tokens.tolist())[1]


def test_decontamination(spark, docs, empty):
    items = [(1, prose(2, 30)), (2, "one"), (3, None), (4, prose(9, 30)), (5, "a b A"), (6, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontamination.report(docs, bench), "doc_id n_words n_hit n_items items_sha256 contaminated", brute.decontaminate(ROWS, items))
    assert decontamination.report(empty, bench).count() == 0
    assert not [r for r in decontamination.report(docs, bench.limit(0)).collect() if r["contaminated"]]


def test_piece_encoding(docs, empty):
    path = piece_encoding.model_path()
    same(piece_encoding.encode(docs), "doc_id n_pieces pieces_sha256", brute.pieces(ROWS, path))
    assert [r["doc_id"] for r in piece_encoding.encode(docs).filter("not lossless").collect()] == [15]
    assert piece_encoding.encode(empty).count() == 0


def test_piece_encoding_of_long_units(spark):
    r = random.Random(40)
    texts = [
        "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(100_000)), "a" * 100_001, "".join(r.choices("etaoinshr", k=100_000)),
        "start  " + "".join(r.choices("abcXYZé-_/", k=3000)) + "   " + "e" * 700 + " end", " " + "中" * 300, "  " + "=" * 5000, "\u0301" * 1000, "🦀" * 400,
        "".join(r.choices("日本語のテキスト。、", k=5000)) + " " * 300 + "x" * 257, "x" * 256, "th" * 128 + "e",
    ]
    rows = list(enumerate(texts))
    got = piece_encoding.encode(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got, "doc_id n_pieces pieces_sha256", brute.pieces(rows, piece_encoding.model_path()))


def test_sharding(docs, empty):
    got = sharding.shard(docs).collect()
    assert len(got) == len(ROWS) and {r["law"] for r in got} == {"rows"}
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min([len(by.get(s, [])) for s in range(16)]) <= 1
    assert sharding.shard(empty).count() == 0


def test_url_filters(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/en/1", "http://example.com/en/", "http://a.example.com/en", "http://x.net/es/?q",
        "http://x.net/fr", "http://best-casino.org/x", "http://com/", "http://xcom/", "http://example.com", "a://b://c.com/", "http://ads.x.com/en/",
        "http://mail.spam.org/", "http://pokers.org/", "http://x.poker", "http://a-POKER-b.org/x", "http://org/casino./", "http://torrents.example.org:80/", "http://.ads./",
    ]
    pages = spark.createDataFrame([(k, u, "c") for k, u in enumerate([*urls, *urls])], "page_id long, url string, host string")
    expected = [(k, *brute.verdict(u, url_filters.WORDS)) for k, u in enumerate([*urls, *urls])]
    same(url_filters.judge(pages), "page_id host path rule verdict", expected)
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_html_extraction(spark):
    page = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
        "<div class='ad'>Buy now.</div><article><h1>Head &amp; line</h1><p>First  long\n sentence of the text, which goes on. And another one.</p>"
        "<p>Second sentence, also long enough to count.</p></article><footer>&copy; Site</footer></body></html>"
    )
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, "")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extraction.extract(pages).collect()}
    text = "Head & line\nFirst long sentence of the text, which goes on. And another one.\nSecond sentence, also long enough to count."
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0)}


def test_classifier_on_held_out_rows(spark):
    docs, labels = (io.table(spark, DATA, t) for t in ("documents", "labels"))
    scored = classifier.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in scored)
    assert scored and right >= 0.9 * len(scored)
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    assert out.columns[0] == "doc_id" and 100 < out.count() <= 200


#: With repeated rows, one id for two texts, and copies without an id.
MORE = [*ROWS, (None, prose(1, 120)), (None, prose(30, 90)), (None, prose(30, 90)), (None, variant(prose(30, 90), 4)), (40, prose(31, 80)), (40, prose(31, 80)),
    (40, prose(32, 80)), (41, prose(33, 40) + " " + prose(34, 20)), (42, prose(33, 40) + " end of it " + prose(35, 60)),
]


def test_stages_on_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame(MORE, "doc_id long, text string").repartition(3)
    items = [(1, prose(34, 20)), (2, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept_rows(simhash.keep(df), brute.near_copies(MORE))
    same(suffix_dedup.dedup(df), "doc_id text", brute.suffix_cut(MORE))
    marked = brute.decontaminate(MORE, items)
    same(decontamination.clean(df, bench), "doc_id text", [r for r, m in zip(MORE, marked, strict=True) if not m[-1]])


def test_pipeline_on_repeated_rows_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    items = [(1, prose(34, 20)), (2, None)]
    spark.createDataFrame(MORE, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # the rules have a test of their own
    rows = [tuple(r) for r in quality_rules.keep(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()]
    rows = brute.near_copies(rows)
    assert (None, prose(30, 90)) in rows or (None, variant(prose(30, 90), 4)) in rows or (None, "any") in rows
    whole = {t for i, t in MORE if i is None}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # of copies without an id either may stay
    choices = [[(i, t) for t in sorted(whole, key=repr) if t and t != prose(1, 120)] if t == "any" else [(i, t)] for i, t in rows]
    fits = []
    for some in itertools.product(*choices):
        cut = brute.suffix_cut(list(some))
        cut = [r for r, m in zip(cut, brute.decontaminate(cut, items), strict=True) if not m[-1]]
        fits.append(sorted(brute.pieces(cut, piece_encoding.model_path()), key=repr))
    assert sorted(((r["doc_id"], r["n_pieces"], r["pieces_sha256"]) for r in out), key=repr) in fits


# --- parameters set so that rare paths are taken, ids of other types, names that clash, hard inputs


def named(spark, rows):
    """The rows with text ids, and columns whose names the operators use themselves."""
    names = "row cut kept h1 h2 node k1 k2 key fp0 kept_id cut_1 cut_2 new_text bad_key least chosen_id part".split()
    data = [(None if i is None else f"{i:03d}", t, len(t or ""), *["x"] * len(names)) for i, t in rows]
    return spark.createDataFrame(data, "doc_id string, text string, n_chars int, " + ", ".join(f"{c} string" for c in names)).repartition(3)


def texted(rows):
    return [(None if i is None else f"{i:03d}", *rest) for i, *rest in rows]


def test_text_ids_and_clashing_names(spark):
    df = named(spark, MORE)
    rows = texted(MORE)
    items = [(1, prose(34, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(suffix_dedup.dedup(df), "doc_id text n_chars", [(i, t, len(t or "")) for i, t in brute.suffix_cut(rows)])
    kept_rows(simhash.keep(df), brute.near_copies(rows))
    marked = brute.decontaminate(rows, items)
    same(decontamination.clean(df, bench), "doc_id text", [r for r, m in zip(rows, marked, strict=True) if not m[-1]])
    for out in (suffix_dedup.dedup(df), simhash.keep(df), decontamination.clean(df, bench), quality_rules.keep(df)):
        assert out.columns == df.columns and out.schema["cut"] == df.schema["cut"]
    same(quality_rules.quality(df), "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed", brute.quality(rows))
    same(substring_dedup.dedup(df), "doc_id n_words n_removed kept_sha256", brute.substring_dedup(rows))
    labels = spark.createDataFrame([(f"{k:03d}", k % 2) for k in range(1, 15)], "doc_id string, quality int")
    assert classifier.classify(df, labels).count() == len(rows)
    assert sharding.shard(df).count() == len(rows)


def test_suffix_dedup_by_single_strings(docs, monkeypatch):
    """Groups above CROWD have their strings counted one by one, wherever they lie."""
    rows = [*ROWS, *[(50 + k, prose(60 + k, 20) + prose(2, 60) + prose(80 + k, 20)) for k in range(6)]]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for crowd in (suffix_dedup.CROWD, 1):
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        same(suffix_dedup.report(df), "doc_id n_bytes n_removed n_spans kept_sha256", brute.suffix_dedup(rows))


def test_substring_dedup_with_a_line_in_all_documents(spark):
    line = prose(70, 55)
    rows = [(k, f"{prose(100 + k, 30)} {line} {prose(200 + k, 30)}" + (" " + prose(100 + k // 2, 60)) * (k % 2)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(substring_dedup.dedup(df), "doc_id n_words n_removed kept_sha256", brute.substring_dedup(rows))


def test_substring_dedup_in_small_pieces(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 3)
    same(substring_dedup.dedup(docs), "doc_id n_words n_removed kept_sha256", brute.substring_dedup(ROWS))


def test_simhash_in_chunks(docs, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 1)
    same(simhash.report(docs), "doc_id fingerprint component_id", brute.simhash(ROWS))


def test_simhash_links_all_near_fingerprints(spark):
    """Many fingerprints in few buckets: classes by links equal those by all pairs."""
    import numpy as np

    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 40, (60, 3), dtype=np.uint64), axis=1) for b in base]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp0 long").repartition(3)
    from quarry.llm.components import components

    got = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    root = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(fps):
        for y in fps[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ x) <= 4]:
            root[find(int(y.view(np.int64)))] = find(int(x.view(np.int64)))
    members = {}
    for x in root:
        members.setdefault(find(x), set()).add(x)
    mine = {}
    for x in root:
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, members.values())) == sorted(map(sorted, mine.values()))


@pytest.mark.parametrize("bits", [8, 64, 1 << 16])
def test_decontamination_by_full_bit_tables(spark, docs, monkeypatch, bits):
    """A table in which most or all bits are set lets others through, which changes no result."""
    monkeypatch.setattr(decontamination, "BITS", bits)
    items = [(1, prose(2, 30)), (2, "one"), (3, None), (4, prose(9, 30)), (5, "a b A"), (6, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontamination.report(docs, bench), "doc_id n_words n_hit n_items items_sha256 contaminated", brute.decontaminate(ROWS, items))


def test_decontamination_of_a_text_repeated_very_often(spark):
    rows = [(k, prose(2, 70)) for k in range(3000)] + [(5000, prose(9, 30))]
    items = [(k, prose(2, 30)) for k in range(3)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert {r["n"] for r in decontamination.occurrences(df.selectExpr("md5(text) AS key", "text"), np.full(8, 255, np.uint8), [3], 10).groupBy("key").count().selectExpr("count AS n").collect()} <= {1, 2, 3}
    same(decontamination.report(df, bench), "doc_id n_words n_hit n_items items_sha256 contaminated", brute.decontaminate(rows, items))


def test_hypergeometric_by_inversion(monkeypatch):
    """The draw for large populations has the law of numpy's, and of a huge population its moments."""
    import numpy as np

    r = np.random.default_rng(11)
    monkeypatch.setattr(sharding, "SAMPLER_LIMIT", 0)
    for good, bad, draws in ((5, 7, 6), (40, 3, 41), (1, 1, 1), (300, 900, 100)):
        mine = [sharding.hypergeometric(r, good, bad, draws) for _ in range(4000)]
        theirs = r.hypergeometric(good, bad, draws, 4000)
        width = np.arange(min(good, draws) + 2)
        gap = np.abs(np.searchsorted(np.sort(mine), width) - np.searchsorted(np.sort(theirs), width)).max() / 4000
        assert gap < 0.05, (good, bad, draws, gap)
    good, bad, draws = 10**11, 15 * 10**11, 10**7
    some = np.array([sharding.hypergeometric(r, good, bad, draws) for _ in range(400)], float)
    mean, var = draws / 16, draws * (1 / 16) * (15 / 16)
    assert abs(some.mean() - mean) < 5 * (var / 400) ** 0.5 and 0.75 < some.var() / var < 1.3


def test_sharding_of_equal_rows_and_null_ids(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "COPIES", 50)
    monkeypatch.setattr(sharding, "PARTITION_ROWS", 10)
    rows = [(None, "same")] * 900 + [(None, f"t{k}") for k in range(400)] + [(k, "x") for k in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert sum(sizes) == 1600 and max(sizes) - min(sizes) <= 1
    slots = got.groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("most")).collect()
    assert all(r["n"] == r["most"] + 1 for r in slots)
    # each shard takes its share of the equal rows: 56 in the mean, deviation below 7
    copies = [r["count"] for r in got.filter("size = 5 AND doc_id IS NULL").groupBy("shard").count().collect()]
    assert len(copies) == 16 and 20 < min(copies) and max(copies) < 95


def test_url_rules_of_all_kinds(spark, tmp_path):
    """Some hundred rules from a file, upper-case and without a token, against every rule's expression tried on every URL."""
    import re

    r = random.Random(50)
    words_ = ["Docs", "casino", "a", "x1", "news", "ads", "été", "B"]
    hosts = [".".join(r.choices(["shop", "Mail", "www", "cdn", "b2"], k=r.randint(1, 2))) + r.choice([".com", ".Net", ".org"]) for _ in range(40)]
    lines = [f"{r.choice(['allow', 'block'])} {h}/{'/'.join(r.choices(words_, k=r.randint(0, 2)))}" for h in hosts for _ in range(5)]
    lines = list({x.split()[1]: x for x in lines}.values()) + ["# note", "", "pattern Casino (?i)casino[.-]", "pattern - /é+t", "block é/"]
    (tmp_path / "rules.txt").write_text("\n".join(lines))
    rules, patterns = url_filters.read_rules(spark, str(tmp_path / "rules.txt"))
    assert len(rules) > 100 and len(patterns) == 2
    urls = [f"http://{r.choice(['', 'a.', 'casino-'])}{r.choice(hosts)}/{'/'.join(r.choices(words_, k=r.randint(0, 3)))}{r.choice(['', '?q=1', '/'])}" for _ in range(300)] + ["http://é/x", "http://q.org/éét"]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    expected = []
    for k, u in enumerate(urls):
        host, path, _, _ = brute.verdict(u)
        fitting = []
        for rule, v in rules:
            own, _, start = rule.partition("/")
            own = own.translate(fold)
            if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
                fitting.append((len(rule), rule, v))
        best = max(fitting) if fitting else None
        hit = any(re.search(p, host + path) for p, _ in patterns)
        expected.append((k, best[1] if best else None, best[2] if best else "block" if hit else "allow"))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    same(url_filters.judge(pages, rules, patterns), "page_id rule verdict", expected)


def test_marginals_against_all_states():
    """Sum-product on small trees equals the sum over all labellings."""
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(20):
        n = int(r.integers(1, 8))
        parent = [-1, *[int(r.integers(0, k)) for k in range(1, n)]]
        unary, pair = r.normal(0, 2, n), r.normal(0, 1, (2, 2))
        total, ones = 0.0, np.zeros(n)
        for state in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(unary[i] * s for i, s in enumerate(state)) + sum(pair[state[parent[i]], state[i]] for i in range(1, n)))
            total, ones = total + weight, ones + weight * np.array(state)
        assert np.allclose(html_extraction.marginals(parent, unary, pair), ones / total)


def test_html_extraction_on_pages_not_trained_on():
    """Share of the characters of other templated pages that get the right label."""
    import numpy as np

    weight, pair = html_extraction.fit()
    right = whole = 0
    for page, label in html_extraction.labelled_pages(seed=99):
        unary = np.array([sum(weight.get(f, 0.0) for f in row) for row in page.features()])
        found = html_extraction.marginals(page.parent, unary, pair) >= 0.5
        for piece in filter(None, page.pieces):
            size = len(piece[1].strip())
            right, whole = right + size * (found[piece[0]] == label[piece[0]]), whole + size
    assert right >= 0.97 * whole, right / whole


def test_html_extraction_of_layouts_not_trained_on():
    """Share of the characters that get the right label where a fourth of all templates, with every word that only they
    use, was left out in training."""
    import numpy as np

    right = whole = 0
    for fold in range(4):
        kinds = (html_extraction.CONTENT, html_extraction.BEFORE, html_extraction.AFTER)
        rest, out = ([tuple(t for k, t in enumerate(kind) if (k % 4 == fold) == own) for kind in kinds] for own in (False, True))
        weight, pair = html_extraction.fit(list(html_extraction.labelled_pages(7, *rest)))
        for page, label in html_extraction.labelled_pages(99, *out):
            unary = np.array([sum(weight.get(f, 0.0) for f in row) for row in page.features()])
            found = html_extraction.marginals(page.parent, unary, pair) >= 0.5
            for piece in filter(None, page.pieces):
                size = len(piece[1].strip())
                right, whole = right + size * (found[piece[0]] == label[piece[0]]), whole + size
    assert right >= 0.78 * whole, right / whole


def test_html_extraction_of_hard_pages(spark):
    import time

    deep = "<div>" * 20_000 + "<p>" + "Text of it. " * 30 + "</p>"
    rows = [(1, "u", deep, "c"), (2, "u", "<p>a<p>b</div></p></span>" * 2000, "c"), (2, "u", "<table><tr><td>" + "<div>" * 3000 + "<tr>" * 3000, "c"), (3, None, None, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    began = time.time()
    got = html_extraction.extract(pages).collect()
    assert len(got) == 4 and time.time() - began < 60
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_classifier_scores_by_hand(spark):
    """Scores are the softmax of the mean of the features' weights; training reads whole texts."""
    import numpy as np

    r = np.random.default_rng(3)
    fitted = r.normal(0, 1, classifier.BUCKETS + 1)
    rows = [(1, "a b"), (2, None), (3, prose(5, 30)), (3, prose(5, 30)), (None, "x x x")]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, score string")
    expected = []
    for i, t in rows:
        buckets, counts = classifier.bag(t)
        mean = float((fitted[buckets] * counts).sum() / max(1, counts.sum()))
        expected.append((i, round(1 / (1 + np.exp(-(mean + fitted[-1]))), 9)))
    got = [(x["doc_id"], round(x["score"], 9)) for x in classifier.score(df, fitted).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert classifier.score(df.limit(0), fitted).count() == 0
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0)], "doc_id long, quality int")
    bags, values = classifier.sample(df, labels)
    assert len(bags) == len(values) <= 2
    long = "good " * 30_000 + "bad"
    assert classifier.bag(long)[1].sum() > 150_000
    none = classifier.classify(df, labels.limit(0)).collect()
    assert {x["score"] for x in none} == {0.5}


def test_quality_verdict_by_all_spans():
    """Covered share and longest repeat against every pair of places compared."""
    rows = [(k, t) for k, (_, t) in enumerate([*ROWS, (0, prose(3, 20) + " " + prose(3, 20) + " " + prose(8, 100)), (0, (prose(9, 70) + " ") * 2 + prose(10, 900))]) if len(t or "") < 9000]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] or "" for r in rows])], ["doc_id", "text"])
    for got in quality_rules.measure(iter([batch]), 6, 0.3, 60):
        for x in got.to_pylist():
            w = brute.words(dict(rows)[x["doc_id"]])
            top, each = brute.longest_repeat(w)
            gone = [False] * len(w)
            for at, size in enumerate(each):
                if size >= 6:
                    gone[at : at + size] = [True] * size
            share = sum(gone) / max(1, len(w))
            assert abs(x["repeated_share"] - share) < 1e-12 and x["longest_repeat"] == (top if top >= 6 else 0)
            assert x["kept"] == (not x["base_failed"] and share <= 0.3 and x["longest_repeat"] <= 60)


def test_piece_encoding_of_words_that_share_units(spark, monkeypatch):
    """A word enters the lattice once, whatever stands beside it that no piece joins to it; blanks in a row and U+2581 too."""
    seen, whole = [], piece_encoding.lattices
    monkeypatch.setattr(piece_encoding, "lattices", lambda units, pieces: seen.append(units) or whole(units, pieces))
    marks = ["", "é", "中", "§", ",é", "\u0301", "%&", "\n"]
    rows = [(k, f"house{m} {m}house{m}{m}  house{m}▁house{m} ") for k, m in enumerate(marks)] + [(20, "  "), (21, "▁"), (22, " é "), (23, None)]
    path = piece_encoding.model_path()
    got = piece_encoding.encode(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got, "doc_id n_pieces pieces_sha256", brute.pieces(rows, path))
    pairs = piece_encoding.Pieces(path).pairs
    units = [r["unit"] for df in seen for r in df.collect()]
    assert len(set(units)) == len(units) and {"▁house", "house"} <= set(units)
    assert all(u[k : k + 2] in pairs for u in units for k in range(len(u) - 1)), units


@pytest.mark.parametrize("folded", [piece_encoding.FOLDED, 1])
def test_paths_of_many_units_at_once(monkeypatch, folded):
    """The fold gives what merging gives, for all units of a batch."""
    import pyarrow as pa

    monkeypatch.setattr(piece_encoding, "FOLDED", folded)
    pieces = piece_encoding.Pieces(piece_encoding.model_path())
    number = {row[0]: row[1] for row in pieces.rows()}
    r = random.Random(71)
    units = ["".join(r.choices("etaoinshrdl", k=r.randint(2, 64))) for _ in range(150)] + ["▁" + "".join(r.choices("étinge", k=r.randint(1, 20))) for _ in range(150)]
    units += [c * n for c in ("=", "th", "a", "ing") for n in (2, 7, 16)]
    edges = [
        sorted((s + n << 40) + (s << 32) + number[u[s : s + n]] for s in range(len(u)) for n in range(2, len(u) - s + 1) if u[s : s + n] in number)
        for u in units
    ]
    some = [k for k, x in enumerate(edges) if x]
    got = piece_encoding.paths(pieces, pa.array([units[k] for k in some]), pa.array([edges[k] for k in some], pa.list_(pa.int64())))
    assert got.to_pylist() == [pieces.merged(units[k]) for k in some] and len(some) > 250


def test_piece_encoding_recovers_from_other_blocks(spark, monkeypatch):
    """Units that a block doesn't find are merged where they stand: the same ids."""
    monkeypatch.setattr(piece_encoding, "LONG", 1)
    rows = [(k, prose(k, 40)) for k in range(5)]
    got = piece_encoding.encode(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got, "doc_id n_pieces pieces_sha256", brute.pieces(rows, piece_encoding.model_path()))


def unigram_model(path, scores):
    """A unigram piece file with byte fallback: its messages written out field by field."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, value):
        if isinstance(value, bytes):
            return varint(number << 3 | 2) + varint(len(value)) + value
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        return varint(number << 3) + varint(value)

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], *[(t, s, 1) for t, s in scores.items()]]
    pieces = b"".join(field(1, field(1, t.encode()) + field(2, float(s)) + field(3, kind)) for t, s, kind in rows)
    # unigram with byte fallback; blanks before the text and in a row stay, and stand as U+2581
    path.write_bytes(pieces + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)))


@pytest.mark.parametrize("long", [piece_encoding.LONG, 3])
def test_unigram_encoding_by_the_best_sum(spark, tmp_path, monkeypatch, long):
    r = random.Random(17)
    scores = {c: -r.uniform(3, 9) for c in "abcdeé▁🦀"}
    while len(scores) < 120:
        scores["▁" * r.randint(0, 1) + "".join(r.choices("abcdeé", k=r.randint(1, 6)))] = -round(r.uniform(2, 12), 1)
    unigram_model(tmp_path / "u.model", {t: s for t, s in scores.items() if t})
    rows = [(k, prose(700 + k, 40)) for k in range(12)] + [(20, ""), (21, None), (22, "  a   b 🦀x zz"), (23, "abcdeé" * 60), (24, "a"), (25, " "), (26, "é z\nb\tc")]
    path = str(tmp_path / "u.model")
    expected = brute.pieces(rows, path)
    assert sum(n for _, n, _ in expected) < sum(len(t or "") for _, t in rows)
    monkeypatch.setattr(piece_encoding, "LONG", long)
    got = piece_encoding.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, unigram=True)
    same(got, "doc_id n_pieces pieces_sha256", expected)
    assert got.filter("not lossless").count() == 0
    with pytest.raises(ValueError):
        unigram_model(tmp_path / "v.model", {"▁": -1.0, "ab": -2.0})
        piece_encoding.Pieces(str(tmp_path / "v.model"), True)


def test_decoding_of_lists_of_ids():
    """All texts of a batch at once: empty ones, blanks, bytes that are no text."""
    import pyarrow as pa

    decoded = [b" ", b"ab", "é".encode(), b"\xff", b"\xc3", b"\xa9", b""]
    lists = [[0, 1, 2], [], [0], [0, 3, 1], [0, 4, 5], [0, 4], [6], [0, 0, 1]]
    expected = [b"".join(decoded[i] for i in x)[1:].decode(errors="replace") for x in lists]
    flat, sizes = np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists])
    assert piece_encoding.decoded_texts(flat, sizes, pa.array(decoded, pa.binary())) == expected
    assert piece_encoding.decoded_texts(flat[:0], np.zeros(2, int), pa.array(decoded, pa.binary())) == ["", ""]


def test_piece_encoding_of_a_table(spark):
    df = io.table(spark, DATA, "documents")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = piece_encoding.encode(df)
    same(out, "doc_id n_pieces pieces_sha256", brute.pieces(rows, piece_encoding.model_path()))
    same(out, "doc_id decoded", rows)
