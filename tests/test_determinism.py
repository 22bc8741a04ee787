"""Results don't depend on how rows are partitioned."""

from __future__ import annotations

import pytest

from readlake.plans import registry
from tests.oracle import rows

NAMES = ("top_keywords", "summary", "characters", "build_chapters", "read_throttle", "cloze_quiz", "backlog_order", "catalog_rank")


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_with_one_and_seven_partitions(spark, sf, name):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(rows(registry.queries()[name](spark, sf).toPandas()))
        assert found[0] == found[1] and found[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_batch_and_stream_agree(spark, sf):
    q = registry.queries()
    for batch, stream in (("read_throttle", "stream_read_throttle"), ("session_last", "stream_session_last")):
        assert rows(q[batch](spark, sf).toPandas()) == rows(q[stream](spark, sf).toPandas())
