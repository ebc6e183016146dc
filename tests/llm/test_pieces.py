"""Pieces are cut by Spark: encoding and cutting share no task, so an executor keeps one Python worker for each core."""

import zlib

import numpy as np

from fathomline.llm import packing


def test_pieces_take_no_python_worker(spark):
    rng = np.random.default_rng(3)
    coded = [(i, rng.integers(0, 1 << 32, n, dtype=np.uint32).astype("<u4").tobytes()) for i, n in enumerate([0, 1, 6, 7, 8, 15, 16, 50])]
    df = packing.pieces(spark.createDataFrame(coded, "doc_id long, ids binary").repartition(3), 8)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("MapInArrow", "InPandas", "PythonUDF", "ArrowEvalPython"))
    want = []
    for i, ids in coded:
        whole = ids + b"\0\0\0\0"
        want += [(i, p, 8 * p, len(whole[32 * p:32 * p + 32]) // 4, zlib.crc32(whole[32 * p:32 * p + 32])) for p in range((len(whole) + 31) // 32)]
    assert sorted(map(tuple, df.collect())) == want
    assert df.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]
