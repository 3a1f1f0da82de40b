"""Archives read by ranges, and the functions and views that are called from SQL text."""

import io
import struct
import zipfile

import pytest

from strandline.sources import archives, sql, zips

CODE = "namespace N\n{\n    public class A\n    {\n        void M() { }\n        int P { get; set; }\n    }\n}\n"


class Counted:
    """A file that says how much was read of it."""

    def __init__(self, file):
        self.file, self.taken, self.most = file, 0, 0

    def read(self, n):
        data = self.file.read(n)
        self.taken, self.most = self.taken + len(data), max(self.most, len(data))
        return data

    def seek(self, *a):
        return self.file.seek(*a)

    def tell(self):
        return self.file.tell()


def made(*entries, comment=b""):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
        z.comment = comment
    return sink.getvalue()


def plain(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(i, e.filename, e.file_size, e.compress_size) for i, e in enumerate(z.infolist()) if not e.is_dir()]


@pytest.mark.parametrize("data", [
    made(),
    made(("a.cs", "x" * 1000), ("d/", ""), ("d/é漢.py", "y"), ("d/empty", "")),
    b"prefix " * 50 + made(("a", "b")),
    made(("a", "b"), comment=b"a comment" * 20),
    made(*((f"folder/file-{i:05}.txt", "z") for i in range(30_000))),
])
def test_listing_is_that_of_the_library(data):
    assert [e[:4] for e in zips.listing(io.BytesIO(data))] == plain(data)
    assert all(e.error is None for e in zips.listing(io.BytesIO(data)))


def test_broken_archives_say_why():
    good = made(("a", "b" * 100), ("c", "d"))
    errors = lambda data: [e.error for e in zips.listing(io.BytesIO(data))]
    assert errors(b"") == errors(b"text") == errors(good[:-30]) == ["not_an_archive"]
    k = good.rfind(zips.END)
    split = bytearray(good)
    split[k + 4] = 1
    assert errors(bytes(split)) == ["split_archive"]
    broken = bytearray(good)
    at = good.rfind(zips.ENTRY)
    broken[at] = 0
    assert errors(bytes(broken)) == [None, "broken_directory"]
    many = bytearray(good)
    struct.pack_into("<HH", many, k + 8, 9, 9)
    assert errors(bytes(many)) == [None, None, "broken_directory"]
    size = bytearray(good)
    struct.pack_into("<I", size, k + 12, 1 << 20)
    assert errors(bytes(size)) == ["broken_directory"]


def test_a_large_archive_in_bounded_memory(tmp_path, spark):
    """An archive of more than 4 GB, most of it a hole of the file, with sizes beyond 32 bits."""
    path, hole = tmp_path / "large.zip", 5 << 30
    name = b"huge.bin"
    extra = struct.pack("<HHQQ", 1, 16, hole, hole)
    entry = zips.ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0) + name + extra
    with open(path, "wb") as f:
        f.truncate(hole)
        f.seek(hole)
        f.write(entry)
        f.write(zips.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), hole))
        f.write(zips.LOCATOR64 + struct.pack("<IQI", 0, hole + len(entry), 1))
        f.write(zips.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    with open(path, "rb") as f:
        source = Counted(f)
        assert [tuple(e) for e in zips.listing(source)] == [(0, "huge.bin", hole, hole, None)]
        assert source.taken < 70_000
    assert plain_rows(archives.archive_entries(spark, str(tmp_path))) == [("large.zip", 0, "huge.bin", hole, None)]


def plain_rows(df):
    return sorted((r.path.rpartition("/")[2], r.idx, r.entry, r.size, r.error) for r in df.collect())


def test_no_setting_is_changed(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    (tmp_path / "a.zip").write_bytes(made(("a", "b")))
    (tmp_path / "b.zip").write_bytes(b"no")
    assert plain_rows(archives.archive_entries(spark, str(tmp_path))) == [("a.zip", 0, "a", 1, None), ("b.zip", -1, None, None, "not_an_archive")]
    assert spark.conf.get(name) == before


@pytest.fixture(scope="module")
def registered(spark, tmp_path_factory):
    sql.register(spark)
    folder = tmp_path_factory.mktemp("zips")
    (folder / "a.zip").write_bytes(made(("src/a.cs", CODE), ("b.txt", "x")))
    spark.createDataFrame([(str(folder / "a.zip"),), (None,)], "path string").createOrReplaceTempView("archives")
    rows = [(1, "p", "src/a.cs", ".cs", CODE), (2, "p", "b.py", ".py", "def f():\n  pass\n"), (3, "q", "c.md", ".md", "words " * 400), (4, "q", "d.cs", ".cs", None)]
    spark.createDataFrame(rows, "doc_id long, project_id string, file_path string, ext string, content string").createOrReplaceTempView("files")
    return spark


def test_table_functions_in_sql(registered):
    run = lambda text: sorted((tuple(r) for r in registered.sql(text).collect()), key=str)
    assert run("select entry, size, error from zip_entries(table(select path from archives))") == [("b.txt", 1, None), ("src/a.cs", len(CODE), None)]
    assert run("select * from code_units(table(select doc_id, ext, content from files))") == [(1, "A", "class", 3, 7, "N"), (2, "f", "method", 1, 3, None)]
    assert run("select name, type from code_units(table(select doc_id, ext, content from files where doc_id = 1), 10)") == [("M", "method"), ("P", "property")]
    assert run("select doc_id, count(*) from sliding_chunks(table(select doc_id, content from files), 100, 10, 5) group by doc_id") == [(1, 1), (2, 1), (3, 1)]
    got = run("select doc_id, name, type, chunk_index from semantic_chunks(table(select doc_id, project_id, file_path, ext, content from files) partition by (project_id), 1600, 200, 1)")
    assert got == [(1, "A", "class", 0), (2, "f", "method", 0), (3, "c.md", "file", 0)]
    assert registered.sql("select * from semantic_chunks(table(select doc_id, project_id, file_path, ext, content from files where doc_id > 9))").count() == 0


def test_wrong_arguments_are_refused(registered):
    with pytest.raises(Exception, match="lacks the column content"):
        registered.sql("select * from sliding_chunks(table(select doc_id from files))").collect()
    with pytest.raises(Exception):  # no table
        registered.sql("select * from zip_entries('a.zip')").collect()


def test_views(registered, sf_dir):
    sql.create_views(registered, sf_dir)
    n = registered.sql("select count(*) from source_files").first()[0]
    assert n == registered.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert registered.sql("select project_id, count(*) from semantic_chunks(table(select doc_id, project_id, file_path, ext, content from code_files)) group by 1").count() > 1
