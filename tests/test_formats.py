"""Round trips of the formats, and the consolidation of files."""

import os

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import rows

from pyspark.sql import functions as F

from tidemark.operators.consolidate import BrokenData, concatenate_files, consolidate_records, joinable, read_consolidated, stored_frames, superfluous, verify_parts, without_superfluous
from tidemark.sources import formats as Fm
from tidemark.sources.frames import frame_ends, pack_record, unpack_records


def put(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_libsvm_fixture(spark, tmp_path):
    p = put(tmp_path / "a.libsvm", "1 1:0.5 4:2\n3 2:1\n\n2\n1 3:7\n")
    got = Fm.read_libsvm(spark, p, True, True).collect()
    assert sorted((r.label, r.ids, r.vals) for r in got) == sorted([(0, [0, 3], [0.5, 2.0]), (2, [1], [1.0]), (1, [], []), (0, [2], [7.0])])
    dense = Fm.read_libsvm_dense(spark, p, 4, feature_one_based=True, label_one_based=True).collect()
    assert [0.5, 0.0, 0.0, 2.0] in [r.x for r in dense]
    Fm.write_libsvm(Fm.read_libsvm(spark, p), str(tmp_path / "out"))
    assert rows(Fm.read_libsvm(spark, str(tmp_path / "out"))) == rows(Fm.read_libsvm(spark, p))


def test_shards(spark, tmp_path):
    for i in range(4):
        put(tmp_path / f"x.{i}", f"{i} 1:1\n{i}\n")
    got = Fm.read_shards(spark, str(tmp_path / "x"), 1, 2)
    assert sorted(r.label for r in got.collect()) == [2, 3]
    assert Fm.read_shards(spark, str(tmp_path / "x"), 9, 2).count() == 0


@pytest.mark.parametrize("snappy", [False, True])
def test_binary_records(spark, tmp_path, snappy):
    pack = (lambda b: pa.compress(b, codec="snappy", asbytes=True)) if snappy else (lambda b: b)
    d = put(tmp_path / "dense.bin", pack(b"".join(Fm.dense_record(i, [i, 0.5, -1]) for i in range(5))))
    got = Fm.read_dense_binary(spark, d, 3, snappy).collect()
    assert [(r.label, r.x) for r in got] == [(i, [float(i), 0.5, -1.0]) for i in range(5)]
    s = put(tmp_path / "sparse.bin", pack(Fm.sparse_record(4, [1, 9], [0.5, 2]) + Fm.sparse_record(-1, [], [])))
    assert [(r.label, r.ids, r.vals) for r in Fm.read_sparse_binary(spark, s, snappy).collect()] == [(4, [1, 9], [0.5, 2.0]), (-1, [], [])]


def test_cut_off_records_raise(spark, tmp_path):
    p = put(tmp_path / "bad.bin", Fm.sparse_record(4, [1, 9], [0.5, 2])[:-1])
    with pytest.raises(Exception, match="cut off"):
        Fm.read_sparse_binary(spark, p).collect()


def test_meta(spark, tmp_path):
    m = Fm.read_meta(spark, put(tmp_path / "m", "num_labels: 7\nfeature_one_based: 1\nurl: a:b\n\nnoise\n"))
    assert m["num_labels"] == "7" and Fm.meta_flag(m, "feature_one_based") and not Fm.meta_flag(m, "x") and m["url"] == "a:b"


def test_matrices(spark, tmp_path):
    cells = [(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.0)]
    assert rows(Fm.read_coo_text(spark, put(tmp_path / "c", "0 0 1\n0 2  2\n\n2 1 3\n"))) == rows(spark.createDataFrame(cells, "i int, j int, x float"))
    m, dims = Fm.read_matrix_market(spark, put(tmp_path / "mm", "%%MatrixMarket\n% c\n3 3 3\n0 0 1\n0 2 2\n2 1 3\n"))
    assert dims == (3, 3, 3) and m.count() == 3
    r, dims = Fm.read_rows_libsvm(spark, put(tmp_path / "r", "3 3\n2 0:1 2:2\n0\n1 1:3\n"))
    assert dims == (3, 3) and [tuple(x) for x in r.orderBy("i", "j").collect()] == cells
    bad, _ = Fm.read_rows_libsvm(spark, put(tmp_path / "r2", "1 3\n2 0:1\n"))
    with pytest.raises(Exception, match="wrong count"):
        bad.collect()
    b = put(tmp_path / "b", Fm.coo_block(*zip(*cells), 3, 3))
    assert [tuple(x) for x in Fm.read_coo_binary(spark, b).collect()] == cells
    t = Fm.read_matrix_text(spark, put(tmp_path / "t", "1 2\n3 4\n"), 2)
    assert {(x.i, x.j, x.client): x.x for x in t.collect()} == {(0, 0, 0): 1.0, (0, 1, 1): 2.0, (1, 0, 0): 3.0, (1, 1, 1): 4.0}


def test_weights_and_passes(spark, tmp_path):
    w = spark.createDataFrame([(k, f, k + f / 4) for k in range(2) for f in range(3)], "k int, fid int, w double")
    Fm.write_weights(w, str(tmp_path / "w"), 2, 3)
    got, labels, dim = Fm.read_weights(spark, str(tmp_path / "w"))
    assert (labels, dim) == (2, 3) and rows(got) == rows(w)
    folder = tmp_path / "s"
    folder.mkdir()
    for n, lines in (("b", 3), ("a", 2), (".hidden", 9)):
        put(folder / n, "x\n" * lines)
    files = Fm.stream_files(spark, str(folder))
    assert [os.path.basename(f) for f in files] == ["a", "b"]
    assert Fm.read_passes(spark, files, 10).count() == 50
    assert Fm.stream_files(spark, put(tmp_path / "list", "\n".join(files)), "list") == files
    assert Fm.stream_files(spark, "p.", "sequence", 2) == ["p.0", "p.1"]


def test_word_counts_and_synthetic(spark, tmp_path):
    p = put(tmp_path / "w", "0 38:2 160024:1\n5 1:3\n")
    assert sorted((r.word, r.n) for r in Fm.read_word_counts(spark, p).collect()) == [(1, 3), (38, 2)]
    s = Fm.synthetic_sparse(spark, 500, 40, 6, 4, seed=3)
    n = [r.n for r in s.groupBy("label").count().withColumnRenamed("count", "n").collect()]
    assert len(n) == 4 and sum(n) == 500 and min(n) > 100


@given(st.lists(st.tuples(st.integers(-(2**40), 2**40), st.integers(0, 2**31 - 1), st.none() | st.integers(-(2**31), 2**31 - 1), st.none() | st.text(max_size=9), st.none() | st.binary(max_size=20)), max_size=20))
@settings(max_examples=60, deadline=None)
def test_records_round_trip(records):
    assert unpack_records(b"".join(pack_record(*r) for r in records)) == records


@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5), st.booleans())
@settings(max_examples=60, deadline=None)
def test_frame_boundaries(bodies, checksum):
    frames = [zstandard.ZstdCompressor(write_checksum=checksum).compress(b) for b in bodies]
    joint = b"".join(frames)
    assert frame_ends(joint) == list(np.cumsum([len(f) for f in frames]))
    with pytest.raises(BrokenData):
        frame_ends(joint[:-1])


def test_joinable_lines():
    assert joinable(b"\xef\xbb\xbfa,b\n1,2", "lines", b"a,b") == b"1,2\n"
    assert joinable(b"", "lines", None) == b"" and joinable(b"x\n", "lines", b"h") == b"x\n"
    assert joinable(b"a,b", "lines", b"a,b") == b""
    assert joinable(b"\xef\xbb\xbfa,b\r\n1,2\r\n", "lines", b"a,b") == b"1,2\r\n"
    assert joinable(b"a,bc\n1,2", "lines", b"a,b") == b"a,bc\n1,2\n"
    assert joinable(b"\xef\xbb\xbf", "lines", None) == b""


@pytest.mark.parametrize("kind", ["lines", "zstd"])
def test_concatenated_files(spark, tmp_path, kind):
    folder = tmp_path / "in"
    folder.mkdir()
    want = []
    for i in range(60):
        body = b"h\n" + b"".join(b"row %d %d\n" % (i, j) for j in range(i % 4))
        want += body.split(b"\n")[1:-1]
        put(folder / f"f{i:03d}", body[: -1 if i % 3 else None] if kind == "lines" else zstandard.ZstdCompressor().compress(body[2:]) if i % 4 else b"")
    out = str(tmp_path / "out")
    m = concatenate_files(spark, str(folder), out, kind, "h" if kind == "lines" else None, target=400)
    parts = sorted(p for p in os.listdir(out) if not p.startswith("."))
    assert 1 < len(parts) < 30 and {r.part for r in m.select("part").collect()} == set(parts)
    got = []
    for p in parts:
        data = open(f"{out}/{p}", "rb").read()
        if kind == "zstd":
            data = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        got += [x for x in data.split(b"\n") if x and x != b"h"]
    assert sorted(got) == sorted(want)
    with open(f"{out}/{parts[0]}", "r+b") as f:
        f.seek(5)
        f.write(b"\x00\x01")
    with pytest.raises(Exception, match="differ from the manifest"):
        verify_parts(m, out, 2 if kind == "lines" else 0)


RECORD = "file_id bigint, rec_no int, datum_key string, label int, data binary, part string"
FILE = "file_id bigint, db_name string, file_path string, n_bytes bigint, n_records bigint, listed_at timestamp, before string"


def test_consolidated_records(spark, tmp_path):
    from datetime import datetime

    at = datetime(2024, 1, 1)
    files = spark.createDataFrame([(f, "a" if f < 3 else None if f == 4 else "b", "p", 1, None, at, "x") for f in (1, 2, 3, 4)] + [(1, "a", "p", 1, 1, at, "x")], FILE)
    hot = [(2, i, f"k{i % 50}", i, bytearray(b"same" * 50), "p") for i in range(600)]
    data = [(1, 0, "k", 1, bytearray(b"x"), "p"), (2, 900, "k", 2, bytearray(b"x"), "p"), (3, 0, "k", 1, bytearray(b"x"), "p"), (1, 1, "k", None, bytearray(b""), "p"), (1, 2, "k", None, None, "p"), (1, 3, None, 5, None, "p"), (1, 4, None, 6, None, "p"), (4, 0, "k", 1, bytearray(b"x"), "p"), (9, 0, "k", 1, bytearray(b"x"), "p"), *hot]
    records = spark.createDataFrame(data, RECORD)
    manifest, out = consolidate_records(records, files, str(tmp_path / "out"), target=600, frame_bytes=300)
    got = read_consolidated(manifest, out).collect()
    first: dict = {}
    db = {1: "a", 2: "a", 3: "b", 4: None, 9: None}
    for f, n, k, _, d, _ in sorted(data, key=lambda r: r[:2]):
        first.setdefault((db[f], k, None if d is None else bytes(d)), (f, n))
    assert sorted((r.file_id, r.rec_no) for r in got) == sorted(first.values())
    assert {(r.datum_key, r.label, None if r.data is None else bytes(r.data)) for r in got if r.file_id == 1} == {("k", 1, b"x"), ("k", None, b""), ("k", None, None), (None, 5, None)}
    assert manifest.select("part").distinct().count() > 3
    some = manifest.first().part
    with open(f"{out}/{some}", "r+b") as f:
        f.write(b"\x00")
    with pytest.raises(Exception, match="differ from the manifest"):
        read_consolidated(manifest, out).collect()


def test_only_files_with_superfluous_records_are_decoded(spark, tmp_path):
    files = spark.createDataFrame([(f, "a", "p", 1, 1, None, "x") for f in range(30)], FILE)
    data = [(f, i, f"k{f}-{i}", None, bytearray(b"body %d %d" % (f, i)), "p") for f in range(30) for i in range(20)]
    data += [(7, 100, "k3-4", 1, bytearray(b"body 3 4"), "p"), (9, 5, "k9-5", 0, bytearray(b"body 9 5"), "p"), (11, 6, "other", 0, bytearray(b"at the same place"), "p")]
    records = spark.createDataFrame(data, RECORD)
    frames = stored_frames(records, 200).persist()
    clean = without_superfluous(frames, superfluous(records, files), files).collect()
    decoded = {r.source: 0 for r in clean}
    for r in clean:
        decoded[r.source] += r.decoded
    assert {k for k, v in decoded.items() if v} == {"7", "9"} and sum(decoded.values()) == 41  # and one in a frame of which nothing is left
    before = {(str(r.file_id), r.piece): bytes(r.body) for r in frames.collect()}
    assert all(bytes(r.body) == before[r.source, r.piece] for r in clean if r.source not in ("7", "9"))
    again = records.where("file_id = 4").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(9)))).drop("copy")
    manifest, out = consolidate_records(records.unionByName(again), files, str(tmp_path / "out"), target=2000, frame_bytes=200)
    got = sorted((r.file_id, r.rec_no, bytes(r.data)) for r in read_consolidated(manifest, out).collect())
    assert got == sorted({(f, i, bytes(d)) for f, i, _, _, d, _ in data if (f, i) != (7, 100)})
    assert {r.label for r in read_consolidated(manifest, out).where("file_id = 9 and rec_no = 5").collect()} == {None}


def test_nothing_to_consolidate(spark, tmp_path):
    manifest, out = consolidate_records(spark.createDataFrame([], RECORD), spark.createDataFrame([], FILE), str(tmp_path / "o"))
    assert manifest.count() == 0 and read_consolidated(manifest, out).count() == 0
    assert superfluous(spark.createDataFrame([], RECORD), spark.createDataFrame([], FILE)).count() == 0
