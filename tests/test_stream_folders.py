"""Tables that are folders of files, and tables without rows, as streams."""

from fathomline.plans import streams
from fathomline.session import shared_folder
from tests.conftest import SF

OUT = ["path", "chunk_id", "chunk_type", "section", "token_count", "dims"]


def folder_copy(spark, name, where="true", files=3):
    root = shared_folder(spark, "tables")
    spark.read.parquet(f"{SF}/{name}.parquet").where(where).repartition(files).write.parquet(f"{root}/{name}.parquet")
    return root


def test_a_folder_of_files_streams_all_its_rows(spark):
    few = "page_id < 24"
    many, one = folder_copy(spark, "pages", few), folder_copy(spark, "pages", few, 1)
    got, want = (sorted(tuple(r[c] for c in OUT) for r in streams.stream_chunk_ingest(spark, root).collect()) for root in (many, one))
    assert got == want and len({r[0] for r in got}) > 10
    events = streams.stream_audit_ingest(spark, folder_copy(spark, "events"))
    assert events.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_no_pages_give_no_chunks(spark):
    out = streams.stream_chunk_ingest(spark, folder_copy(spark, "pages", "false"))
    assert sorted(out.columns) == sorted(OUT) and out.count() == 0
