from tracemill.sources import tail


def test_spans_cover_each_line_once(tmp_path):
    path = tmp_path / "a.jsonl"
    lines = [f'{{"n": {i}, "x": "{"é" * (i % 9)}"}}' for i in range(50)]
    path.write_bytes("".join(x + "\n" for x in lines).encode() + b'{"open')
    size = path.stat().st_size
    end = tail.last_line_end(str(path), 0, size, step=7)
    assert end == size - len(b'{"open')
    for span in (1, 13, 40, 10_000):
        found = [r for low in range(0, end, span) for r in tail.read_span(str(path), low, min(low + span, end))]
        assert [r[2] for r in found] == lines
        assert all(path.read_bytes()[at:].startswith(text.encode()) for _, at, text in found)


def test_goes_on_where_it_was(spark, tmp_path):
    spark.dataSource.register(tail.TailSource)
    log, out, check = tmp_path / "a.jsonl", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = spark.readStream.format("tail_lines").load(str(tmp_path / "*.jsonl"))
        stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r["raw_json"] for r in spark.read.parquet(out).collect())

    log.write_text("one\ntwo\nthr")
    assert run() == ["one", "two"]
    with log.open("a") as file:
        file.write("ee\nfour\n")
    assert run() == ["four", "one", "three", "two"]
