"""Page words from files of text operators, in batches, as a stream, by the data source, and through ingest."""

from ledgerloom.sources import fixtures as fx
from ledgerloom.sources import pages
from ledgerloom.streaming import ingest

HIGH = 600.0


def printed(statement) -> bytes:
    """A statement's words as one page stream for each page, letters three wide at size six."""
    out = [b"%%PDF-1.4\n/MediaBox [0 0 780 600]\n"]
    for page in sorted({w[1] for w in statement}):
        lines = [f"BT /F1 6 Tf 1 0 0 1 {w[3]} {HIGH - w[4] - 6} Tm ({w[7].replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj ET" for w in statement if w[1] == page]
        out.append(b"1 0 obj <<>>\nstream\n" + "\n".join(lines).encode("latin-1") + b"\nendstream\nendobj\n")
    return b"".join(out)


def test_text_operators():
    data = rb"""/MediaBox [10 0 210 100]
stream
BT /F1 10 Tf 12 TL 20 80 Td (one  two) Tj T* (three) Tj [(fo) -20 (ur) -900 (five)] TJ (s\(i\)x) ' ET
endstream
stream
BT 1 0 0 1 30 50 Tm (next) Tj 5 -10 TD (down) Tj ET
endstream"""
    got = list(pages.DEFAULT.words(data, 0, 9))
    assert [(w[0], w[6]) for w in got] == [(0, "one"), (0, "two"), (0, "threefo"[:5]), (0, "four"), (0, "five"), (0, "s(i)x"), (1, "next"), (1, "down")]
    assert got[0][1:6] == (200.0, 10.0, 10.0, 25.0, 20.0) and got[1][2] == 35.0 and got[6][2:6] == (20.0, 40.0, 40.0, 50.0) and got[7][2] == 25.0
    assert pages.DEFAULT.count(data) == 2 and list(pages.DEFAULT.words(b"", 0, 1)) == []


def test_sources_agree(spark, tmp_path):
    """One row a word from both ways to read; a file that can't be read says why; large files are split by pages."""
    for name, data in (("a.pdf", "one two\n  é\fthree\f\f\ffour".encode()), ("b.pdf", b"\xff\xfe"), ("c.pdf", b""), ("d.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    one = pages.words(spark, str(tmp_path), pages.REPORTS).collect()
    assert [(r.page, r.x0, r.y0, r.text) for r in one if r.page is not None] == [(0, 0.0, 0.0, "one"), (0, 20.0, 0.0, "two"), (0, 10.0, 10.0, "é"), (1, 0.0, 0.0, "three"), (4, 0.0, 0.0, "four")]
    assert ["UnicodeDecodeError" in r.text for r in one if r.page is None] == [True] and len({r.statement_id for r in one}) == 2 and all(0 <= r.statement_id < 2**43 for r in one)
    pages.register(spark)
    options = {"path": str(tmp_path), "extractor": "ledgerloom.sources.pages:REPORTS", "split": "3", "pages": "2"}
    two = spark.read.format("pages").options(**options).load()
    assert sorted(((r.page, r.text) for r in two.collect()), key=repr) == sorted(((r.page, r.text) for r in one), key=repr)
    assert two.rdd.getNumPartitions() == 5  # five pages, two by two, and the files that are too short to split
    assert not spark.read.format("pages").options(**options | {"pattern": "*.none"}).load().collect()
    stream = spark.readStream.format("pages").options(**options).load()
    for n in (6, 7):
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == n
        (tmp_path / "e.pdf").write_bytes(b"later")


def test_pages_to_statements(spark, tmp_path):
    """Files arrive, are extracted, parsed and stored; one that can't be read is named; a second run adds what came later."""
    source, root = tmp_path / "in", f"{tmp_path}/store"
    source.mkdir()
    (source / "a.pdf").write_bytes(printed(fx.statement(1)))
    (source / "bad.pdf").write_bytes(b"%PDF /MediaBox [0 0 x 1]\nstream\nBT /F1 1.2.3 Tf 1 Tf Tm Tj ET\nendstream")
    run = lambda: ingest.run_stream(pages.stream(spark, str(source), pages.DEFAULT), root, f"{tmp_path}/check")
    run()
    (source / "b.pdf").write_bytes(printed(fx.statement(2, 50.0)))
    run()
    rows = {r.source_path.rsplit("/", 1)[1]: r for r in ingest.statements(spark, root).collect()}
    assert {n: r.status for n, r in rows.items()} == {"a.pdf": "CUADRA", "b.pdf": "DIFERENCIAS"}
    assert rows["a.pdf"].holder == "ROMERO CARLA" and rows["a.pdf"].transaction_count == 4 and rows["b.pdf"].total_cargo == 410
    left = ingest.retry(spark, root, read=lambda paths: pages.words(spark, paths, pages.DEFAULT))
    assert left.count() == 0
