import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelwright.llm.hilbert import curve_index, hilbert_shards
from tests.llm.common import AWKWARD, awkward, empty, small_documents


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3)])
def test_the_curve_visits_every_cell_in_unit_steps(spark, dimensions, bits):
    cells = spark.range(1 << (dimensions * bits))
    axes = [F.expr(f"cast(shiftright(id, {k * bits}) & {(1 << bits) - 1} as int)") for k in range(dimensions)]
    rows = cells.select(*axes, curve_index(axes, bits).alias("index")).collect()
    rows.sort(key=lambda r: r["index"])
    assert [r["index"] for r in rows] == list(range(len(rows)))
    for a, b in zip(rows, rows[1:], strict=False):
        assert sum(abs(x - y) for x, y in zip(a[:-1], b[:-1], strict=True)) == 1


def check_laws(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(shards))
    assert max(counts[k] for k in range(shards)) - min(counts[k] for k in range(shards)) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)


@pytest.mark.parametrize("shards", [1, 7, 8])
def test_shards_are_equal_runs_of_the_curve(spark, shards):
    table = small_documents()
    rows = hilbert_shards(spark.createDataFrame(table), shards=shards).collect()
    check_laws(rows, shards)
    texts = dict(zip(table.doc_id, table.text, strict=True))
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def test_one_cell_with_most_rows_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(k, "same text", "en", "hot", 9) for k in range(300)]
    rows += [(7, "same text", "en", "hot", 9)] * 3
    rows += [(k, "x" * rng.randrange(400), "de", f"s{k % 3}", 0) for k in range(300, 400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check_laws(hilbert_shards(frame.repartition(5)).collect(), 8)


def test_awkward_rows(spark):
    rows = hilbert_shards(awkward(spark), shards=3).collect()
    assert len(rows) == len(AWKWARD)
    check_laws(rows, 3)
    assert sorted(r["size"] for r in rows)[:2] == [1, 1]
    assert hilbert_shards(empty(spark)).isEmpty()
