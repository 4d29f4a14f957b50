"""An OCR content file holds a bounded run of pages, however many pages a book has."""

import glob
import json

from scholia import plans
from scholia.sources import tables


def test_files_are_bounded(spark, tmp_path, monkeypatch):
    pages = [(50 * n + b, "u", f"<html><h1>title {n}</h1><p>one</p><p>two</p></html>") for b in (0, 1) for n in range(250)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/in/pages.parquet")
    monkeypatch.setattr(tables, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    r = {x.book: (x["items"], x.chars) for x in plans.QUERIES["io1_read_ocr_content"](spark, f"{tmp_path}/in").collect()}
    chars = sum(len(f"title {n}") + 6 for n in range(250))
    assert r == {0: (750, chars), 1: (750, chars)}
    sizes = [len(json.load(open(f))) for f in glob.glob(f"{tmp_path}/ocr-content/**/part-*", recursive=True)]
    assert sum(sizes) == 1500 and max(sizes) <= 300
