"""Files that are not UTF-8 keep a row and do not end the job."""

from threadloom.operators.code_index import READ_ERROR, file_structure


def test_unreadable_file_keeps_its_row(spark):
    rows = [(1, "a.py", 1, b"x = '\xe9'\n"), (1, "b.py", 2, '"""Né."""\n\ndef f(): pass\n'.encode()), (1, "c.ts", 1, b"export const \xff = 1")]
    files = spark.createDataFrame([(r, p, n, bytearray(c)) for r, p, n, c in rows], "repo_id int, path string, line_count int, content binary")
    got = {r["path"]: r for r in file_structure(files).collect()}
    assert got["a.py"]["purpose"] == got["c.ts"]["purpose"] == READ_ERROR
    assert got["a.py"]["symbols"] == [] and got["a.py"]["line_count"] == 1
    assert got["b.py"]["purpose"] == "Né." and [s["name"] for s in got["b.py"]["symbols"]] == ["f"]
