"""A Python worker that goes on to the next task does not keep the memory of the last one."""

import pyarrow as pa

from barline.llm.common import released

SIZE, COUNT = 2_000, 100_000  # 200 MB in small pieces, with one held at the end that keeps the heap from shrinking by itself


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def burdened(batches):
    before, held = resident(), []
    for batch in batches:
        held = [bytes(bytearray(SIZE)) for _ in range(COUNT)]
        most = resident()
        burdened.kept = held[-1]
        del held
        yield pa.RecordBatch.from_arrays([pa.array([before]), pa.array([most])], ["before", "most"])


def test_memory_goes_back(spark):
    def run(batches):
        make = released(burdened)
        first = list(make(batches))[0].to_pylist()[0]
        after = resident()
        yield pa.RecordBatch.from_arrays([pa.array([first["before"]]), pa.array([first["most"]]), pa.array([after])], ["before", "most", "after"])

    row = spark.range(1).repartition(1).mapInArrow(run, "before long, most long, after long").first()
    assert row["most"] - row["before"] > 150 << 20
    assert row["after"] - row["before"] < 60 << 20
