"""Workers are kept from task to task, and give their memory back in between."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quarry.llm import io, piece_encoding, quality_rules, suffix_dedup


def test_memory_goes_back_at_the_end_of_a_task(monkeypatch):
    seen = []
    monkeypatch.setattr(io, "release", lambda: seen.append("released"))

    def run(batches):
        for x in batches:
            yield x + 1
        seen.append("done")

    assert list(io.releasing(run)(iter([1, 2]))) == [2, 3] and seen == ["done", "released"]
    seen.clear()
    # a task that is left early gives it back too
    some = io.releasing(run)(iter([1, 2]))
    assert next(some) == 2
    some.close()
    assert seen == ["released"]


def test_suffix_ranks_hold_few_bytes_for_each_of_text():
    data = np.random.default_rng(5).integers(97, 99, 300_000, dtype=np.uint8)
    at = np.arange(len(data) - 200)
    tracemalloc.start()
    ranks = suffix_dedup.suffix_ranks(data, at, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * len(data)
    raw = data.tobytes()
    some = at[::1000].tolist()
    by_bytes = sorted({raw[a : a + 200] for a in some})
    assert len(set(ranks[some].tolist())) == len(by_bytes)
    assert [raw[a : a + 200] for a in sorted(some, key=lambda a: ranks[a])] == sorted(raw[a : a + 200] for a in some)


def test_groups_are_compared_in_bounded_slices():
    group = np.repeat([1, 2, 3, 4, 5], [3, 40, 2, 2, 1])
    batch = pa.RecordBatch.from_arrays([pa.array(group), pa.array([b"x" * 100] * len(group))], ["group", "bytes"])
    for size in (1, 4, 7, 48):
        # a group may stand in several batches, empty ones among them
        parts = [batch.slice(k, size) for k in range(0, len(group), size)]
        slices = [x.column("group").to_pylist() for x in suffix_dedup.whole_groups(iter([batch.slice(0, 0), *parts]), 500)]
        assert sum(slices, []) == group.tolist()
        kinds = [sorted(set(x)) for x in slices]
        assert sum(kinds, []) == [1, 2, 3, 4, 5] and kinds[-1] == [3, 4, 5]
        assert all(100 * sum(g != x[-1] for g in x) <= 500 for x in slices)
    assert not list(suffix_dedup.whole_groups(iter([batch.slice(0, 0)]), 500))


def test_texts_are_sliced(spark):
    text = " ".join(f"word{k}" for k in range(10_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array([text] * 12)], ["doc_id", "text"])
    out = list(quality_rules.measure(iter([batch]), 3, 0.2, 100))
    assert sum((x.column("doc_id").to_pylist() for x in out), []) == list(range(12))
    assert max(x.num_rows for x in out) * len(text) <= 1 << 18
    # both sides of an exchange with Python hold a batch
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for step in (quality_rules.keep, suffix_dedup.report):
        before = spark.conf.get(name)
        try:
            spark.conf.unset(name)
            step(docs)
            assert spark.conf.get(name) == str(io.ARROW_BYTES)
        finally:
            spark.conf.set(name, before)


def test_a_small_corpus_has_small_partitions_of_units():
    # sorting the edges of a sixteenth of 0.1 GB's units filled an executor's heap
    assert piece_encoding.unit_partitions(130_000_000, 6) == 96
    assert piece_encoding.unit_partitions(5_000_000, 6) == 6
    assert piece_encoding.unit_partitions(40_000_000_000, 6) == 5000
