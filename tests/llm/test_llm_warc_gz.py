"""Archives named ``.warc.gz`` are split and read like any other."""

from __future__ import annotations

import glob
import gzip
import os
import shutil

import pytest
from pyspark.sql import functions as F

from cohortlab.llm import warc


@pytest.mark.parametrize("size", ["128m", "4k"])
def test_names_make_no_difference(spark, tmp_path, size):
    # payloads that hold the magic, stored without compression: chance magics all over
    rows = [(i, f"http://h/{i}", "x" * (i * 37 % 3000) + "\x1f" + "\u008b\x08" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "u", "same"), (102, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    plain = str(tmp_path / "plain")
    warc.write_archives(pages, plain)
    files = sorted(glob.glob(plain + "/*.txt"))
    for name in ("gz", "mixed"):
        os.makedirs(tmp_path / name)
        for i, f in enumerate(files):
            shutil.copy(f, tmp_path / name / (f"part {i}.warc" + (".gz" if name == "gz" or i % 2 else "")))
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        of = lambda path: sorted(map(str, warc.read_archives(spark, path).drop("file").collect()))
        want = of(plain)
        assert len(want) == len(rows) + len(files)
        for name in ("gz", "mixed"):
            assert of(str(tmp_path / name)) == want
        if size == "4k":
            ranges, _ = warc.byte_ranges(spark, str(tmp_path / "gz"))
            assert ranges.select(F.spark_partition_id()).distinct().count() > len(files)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    seen = {os.path.basename(r.file) for r in warc.read_archives(spark, str(tmp_path / "gz")).select("file").distinct().collect()}
    assert seen == {f"part%20{i}.warc.gz" for i in range(len(files))}
    with gzip.open(tmp_path / "gz" / "part 0.warc.gz") as f:
        assert f.read().startswith(b"WARC/")  # an ordinary archive


def test_few_rows_go_to_python_at_once(spark, tmp_path):
    """Rows are whole pages and whole members: a batch of them is bounded in the writer and the reader."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    pages = spark.createDataFrame([(i, "u", "x" * i) for i in range(700)], "page_id long, url string, html string")
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
        assert int(spark.conf.get(key)) <= 256
        spark.conf.set(key, "10000")
        assert warc.read_archives(spark, str(tmp_path / "w")).where("warc_type != 'warcinfo'").count() == 700
        assert int(spark.conf.get(key)) <= 256
    finally:
        spark.conf.set(key, before)
