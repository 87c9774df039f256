from pathlib import Path
from urllib.parse import unquote

from lexspark.sources.documents import read_documents, write_documents


def test_documents_as_files_of_their_own(spark, tmp_path):
    given = {"a/b": "10 €\n", "ä %2F": "", "none": None, **{str(i): f"{i} €\nja\n" for i in range(60)}}
    frame = spark.createDataFrame(list(given.items()), "doc_id string, text string")
    for _ in range(2):  # what runs again writes the same files
        write_documents(frame, f"file://{tmp_path}/texts", "doc=", 7)
    files = list((tmp_path / "texts").glob("*/*"))
    assert len(files) == len(given) and {p.parent.name for p in files} == {str(n) for n in range(7)}
    assert {unquote(p.stem.removeprefix("doc=")): p.read_text() for p in files} == {k: v or "" for k, v in given.items()}
    read = read_documents(spark, f"file://{tmp_path}/texts/*", "text").collect()
    assert {Path(unquote(unquote(r["doc_id"]))).name for r in read} >= {f"doc={i}.txt" for i in range(60)}
    assert sorted(r["text"] for r in read) == sorted(v for v in given.values() if v)  # Spark's reader gives no row for an empty file
