"""Files: signatures, charsets, quarantine, sinks."""

import pytest

from authorship_spark.jobs import ingest as job
from authorship_spark.jobs import verify
from authorship_spark.sources import ingest

from .test_metrics import write

CASES = {
    "a.txt": (b"\xef\xbb\xbfa", "a", "UTF-8", None),
    "b.txt": (b"\xff\xfea\x00", "a", "UTF-16LE", None),
    "c.txt": (b"\xfe\xff\x00a", "a", "UTF-16BE", None),
    "d.txt": (b"\xcf\xf0\xe8", "При", "windows-1251", None),
    "e.txt": (b"a\xa9b", "a©b", "ISO-8859-1", None),
    "f.txt": (b"\x89PNG\r\n\x1a\n", None, None, "PNG"),
    "g.txt": (b"PK\x03\x04abcd", None, None, "ZIP"),
    "h.txt": (b"a" * 98 + b"\x00\x00", None, None, "NUL bytes"),
    "i.txt": (b"a" * 95 + b"\x01" * 5, None, None, "control bytes"),
    "j.txt": (b"", "", "UTF-8", None),
    "k.txt": ("žluť".encode(), "žluť", "UTF-8", None),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    for name, (data, *_) in CASES.items():
        (at / name).write_bytes(data)
    (at / "x.bin").write_bytes(b"no text file")
    return at


def test_decode(spark, folder):
    rows = ingest.detect_and_decode(ingest.read_text_files(spark, str(folder))).collect()
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["charset"], r["reject_reason"]) for r in rows}
    assert got == {name: tuple(case[1:]) for name, case in CASES.items()}
    rows = spark.createDataFrame([(name, bytearray(case[0])) for name, case in CASES.items()] + [("null", None)], "path string, content binary")
    got = {r["path"]: (r["text"], r["charset"], r["reject_reason"]) for r in ingest.detect_and_decode(rows).collect()}
    assert got["j.txt"] == ("", "UTF-8", None) and got["null"][0] is None


def test_files_without_bytes(spark, tmp_path):
    """They are found whatever their names, in subfolders too, and only those with an extension that is asked for."""
    (tmp_path / "in ner").mkdir()
    names = ["a b.txt", "50%25.txt", "é+x.txt", "in ner/none.md", "some.txt", "none.bin"]
    for name in names:
        (tmp_path / name).write_bytes(b"x" if name == "some.txt" else b"")
    rows = ingest.read_text_files(spark, str(tmp_path)).collect()
    got = {r["path"].split(tmp_path.name + "/", 1)[1]: (r["length"], bytes(r["content"])) for r in rows}
    assert got == {n: (1, b"x") if n == "some.txt" else (0, b"") for n in names[:-1]} and len(rows) == 5
    assert {r["charset"] for r in ingest.detect_and_decode(ingest.read_text_files(spark, str(tmp_path))).collect()} == {"UTF-8"}
    assert ingest.read_text_files(spark, str(tmp_path), extensions=()).count() == 6


def test_scopes(spark, tmp_path):
    """What one job stores goes at its end; another's tables, and those of no job, stay."""
    from authorship_spark import storage

    plain = storage.stored(spark.range(3), "plain")
    with storage.job(spark) as outer:
        mine = storage.stored(spark.range(4), "mine")
        with storage.job(spark) as inner:
            its = storage.stored(spark.range(5), "its")
            assert its.count() == 5 and inner.startswith(outer)
        assert mine.count() == 4 and plain.count() == 3
        with pytest.raises(Exception):
            spark.read.parquet(its.inputFiles()[0]).count()
    assert plain.count() == 3
    spark.catalog.clearCache()
    with pytest.raises(Exception):
        spark.read.parquet(outer).count()
    # a job that runs to its end leaves a lazy result of another readable
    docs = spark.createDataFrame([(i, write("AB"[i % 2], i, 120)) for i in range(4)], "doc_id long, text string")
    scored, _ = verify.verify(verify.prepare(docs, force=True), spark.createDataFrame([(0, 1)], "doc_a long, doc_b long"), self_baseline=False)
    listed = spark.createDataFrame([(0, 1), (0, 1), (2, 3)], "doc_a long, doc_b long")
    verify.run_pairs(spark, docs, listed, str(tmp_path / "out"), force=True, self_baseline=False)
    assert scored.count() == 1
    written = spark.read.parquet(f"{tmp_path}/out/scores")
    assert written.count() == 3 and written.select("pair_id").distinct().count() == 3
    assert spark.read.parquet(f"{tmp_path}/out/metrics").count() == 3 * 17


def test_job(spark, folder, tmp_path):
    job.ingest(spark, str(folder), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/corpus").count() == 7
    assert spark.read.parquet(f"{tmp_path}/refused").count() == 4
    assert not spark.read.parquet(f"{tmp_path}/summary").isEmpty()


def test_from_files_to_scores_and_reports(spark, tmp_path_factory):
    """Ingest, verify and the sinks, with the hashed 64-bit ids that ingest makes."""
    at = tmp_path_factory.mktemp("whole")
    (at / "files").mkdir()
    for name, author, seed in (("one", "A", 1), ("two", "A", 2), ("three", "B", 3), ("four", "C", 4)):
        (at / "files" / f"{name}.txt").write_bytes(write(author, seed, 130).encode())
    job.ingest(spark, str(at / "files"), str(at / "in"))
    corpus = spark.read.parquet(f"{at}/in/corpus")
    assert corpus.where("abs(doc_id) > 1L << 61").count() > 0
    verify.run(spark, corpus, str(at / "out"), block=("charset",), window=3, force=True)
    scores = spark.read.parquet(f"{at}/out/scores")
    assert scores.count() == 6 and scores.where("self_distance IS NOT NULL").count() > 0
    assert spark.read.parquet(f"{at}/out/metrics").count() == 6 * 17
    lines = [r["value"] for r in spark.read.text(f"{at}/out/reports").collect()]
    assert sum(" P = " in x for x in lines) == 6
    assert sum(x.startswith("text ") and ".txt (id " in x and "script Latin, charset UTF-8" in x for x in lines) == 12


def test_signatures_and_sniffing_of_bytes(spark):
    heads = {name: bytes.fromhex(h) for name, h in zip("PNG RIFF text".split(), ("89504E470D0A1A0A", "5249464600000000", "20"), strict=True)}
    rows = spark.createDataFrame([(k, bytearray(v + b"x" * 80)) for k, v in heads.items()], "k string, content binary")
    got = {r["k"]: r["s"] for r in rows.select("k", ingest.binary_signature(rows["content"]).alias("s")).collect()}
    assert got == {"PNG": "PNG", "RIFF": None, "text": None}
