"""Long texts cut from many lines: a group of slices after another, with what is done deleted."""

import random
import zlib
from pathlib import Path

from strandline.functions import pieces, scan
from strandline.session import shared_folder

LINES = "doc string, pos int, text string"


def test_many_lines_give_the_same_pieces_and_leave_no_lines(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(f"d{draw.randint(0, 6)}", i, draw.choice(["", "é", "ab", "a line", "x" * 37, None])) for i in range(400)]
    # A text that begins with an empty line, and one without any characters.
    rows += [("e", 0, ""), *[("e", i, "0123456789") for i in range(1, 30)], ("n", 0, None), ("n", 1, "")]
    df = spark.createDataFrame(rows, LINES)
    for between in ("", "\n", ", "):
        texts = {}
        for doc, _, text in sorted(rows, key=lambda r: r[:2]):
            texts.setdefault(doc, []).append(text or "")
        want = []
        for doc, lines in texts.items():
            whole = between.join(lines)
            parts = [whole[k : k + 10] for k in range(0, max(1, len(whole)), 10)]
            want += [(doc, k, 10 * k, p, zlib.crc32(p.encode())) for k, p in enumerate(parts)]
        for at_once in (pieces.SLICE_ROWS, 100):
            monkeypatch.setattr(pieces, "SLICE_ROWS", at_once)
            before = {f for f in Path(shared_folder(spark)).glob("lines-*/**/*.parquet")}
            got = sorted(map(tuple, pieces.text_pieces(df, ["doc"], ["pos"], "text", between, 10).collect()))
            assert got == sorted(want)
            left = {f for f in Path(shared_folder(spark)).glob("lines-*/**/*.parquet")} - before
            assert bool(left) == (at_once > 100)
        monkeypatch.undo()


def test_the_plan_of_scanned_rows_runs_once(spark):
    """Bounds are drawn from the table that the rows become, not from their plan again."""
    from pyspark.sql import functions as F

    runs = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(i):
        runs.add(1)
        return i

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), seen(F.col("id")).alias("i"))
    out = scan.numbered(scan.range_chunks(df, ["k"], ["i"]), ["k"], "i", "n")
    assert out.count() == 1000 and runs.value == 1000
