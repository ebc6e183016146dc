"""The pipeline, stage by stage, against brute force on what each stage got."""

import corpus_pipeline
from fathomline.llm import queries, registry
from fathomline.llm.arrow import written
from tests.conftest import SF
from tests.llm.test_pairs import plain_classes
from tests.llm.test_texts import check_packing, plain_removed, reference


def test_stages(spark):
    import zlib

    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], SF), name))
        assert kept[-1].columns == columns and kept[-1].dtypes == docs.dtypes
    raw, good, single, cut = ({r.doc_id: r for r in d.collect()} for d in kept)
    assert set(good) < set(raw) and all(good[i] == raw[i] for i in good)
    assert set(single) == {c for _, _, c in plain_classes([(i, r.text) for i, r in good.items()])}
    want = {i: (n, text) for i, _, n, text in plain_removed([(i, r.text) for i, r in single.items()], 13)}
    assert set(cut) == set(single)
    for i, (n, text) in want.items():
        assert cut[i].text == (text if n else single[i].text) and cut[i].n_chars == len(cut[i].text)
    assert any(n for n, _ in want.values())
    pieces = []
    for i, r in cut.items():
        ids = np.array(reference(r.text) + [0], "<u4")
        pieces += [(i, p // 2048, p, len(ids[p:p + 2048]), zlib.crc32(ids[p:p + 2048].tobytes())) for p in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, SF).collect()
    assert check_packing(got, pieces, 2048) <= sum(p[3] for p in pieces) / 2048 * 1.1 + 1


def test_ten_operators_are_registered():
    assert queries and [n.split("_")[0] for n in sorted(registry.QUERIES, key=lambda n: int(n.split("_")[0][2:]))] == [f"op{i}" for i in range(1, 14)]


def test_further_columns_keep_their_values(spark):
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, text + f" end{i}" if i < 2 else None if i == 4 else f"other{i} " * 3, "mine", "kept", "k_", 7) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, whole string, kept string, __kept string, n_words int")
    one = corpus_pipeline.one_of_each(spark, docs, "")
    assert sorted(r.doc_id for r in one.collect()) == [0, 2, 3, 4] and one.columns == docs.columns
    left = corpus_pipeline.without_repeats(spark, docs, "")
    got = {r.doc_id: r for r in left.collect()}
    assert left.columns == docs.columns and {(r.whole, r.kept, r["__kept"], r.n_words) for r in got.values()} == {("mine", "kept", "k_", 7)}
    assert got[1].text == "end1" and [got[i].text for i in (0, 2, 3, 4)] == [rows[i][1] for i in (0, 2, 3, 4)]
