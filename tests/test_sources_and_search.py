"""A paged service that fails, and search from postings."""

from __future__ import annotations

import random
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from phenospark.operators import name_index, store
from phenospark.sources import paged


@pytest.fixture
def service():
    """A table of ``rows`` rows; the first answers of some pages fail, are cut or are short of rows."""
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        rows, faults = 0, {}

        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            limit, offset = int(q["limit"][0]), int(q["offset"][0])
            asked[offset] += 1
            fault = self.faults.get(offset) if asked[offset] <= 2 else None
            if fault == "error":
                self.send_error(503)
                return
            have = range(offset, min(offset + limit, self.rows))
            if fault == "short":
                have = have[:1]
            body = "genome_id,note\n" + "".join(f'562.{i},"a, {i}\nb"\n' for i in have)
            data = body.encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data[: len(data) // 2] if fault == "cut" else data)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Handler, asked, f"http://127.0.0.1:{server.server_address[1]}/?limit={{limit}}&offset={{offset}}"
    server.shutdown()


def test_pages_are_fetched_once_whatever_fails(spark, service, tmp_path):
    handler, asked, url = service
    handler.rows, handler.faults = 57, {0: "error", 20: "cut", 30: "short", 50: "cut"}
    pages = paged.Pages(url, f"file://{tmp_path}/pages", page=10, wait=0.01)
    want = sorted((f"562.{i}", f"a, {i}\nb") for i in range(57))
    got = lambda **k: sorted(map(tuple, paged.paged_table(spark, pages, ["genome_id", "note"], **k).collect()))
    assert got(rows=57) == want
    assert asked == {0: 3, 10: 1, 20: 3, 30: 3, 40: 1, 50: 3}
    handler.rows = 0  # nothing is asked again
    assert got(rows=57) == want and asked.total() == 14
    page = tmp_path / "pages" / "page-10-000000000010.csv"
    page.write_bytes(page.read_bytes()[:-9])
    handler.rows = 57
    assert got(rows=57) == want and asked[10] == 2
    assert not list(tmp_path.glob("pages/*.partial"))


@pytest.mark.parametrize("rows", [0, 3, 10, 40, 41, 77])
def test_rows_are_counted(spark, service, tmp_path, rows):
    handler, asked, url = service
    handler.rows = rows
    pages = paged.Pages(url, f"file://{tmp_path}/pages", page=10, wait=0.01)
    assert pages.count() == rows
    before = asked.total()
    assert paged.paged_table(spark, pages, ["genome_id"]).count() == rows
    assert max(asked.values()) == 1 and before <= 12


def test_a_service_that_stays_down_is_an_error(spark, service, tmp_path):
    handler, asked, url = service
    handler.rows = 15
    pages = paged.Pages(url, f"file://{tmp_path}/pages", page=10, retries=1, wait=0.01)
    with pytest.raises(Exception, match="could not be fetched"):
        paged.paged_table(spark, pages, ["genome_id"], rows=30).collect()
    with pytest.raises(Exception, match="no column"):
        paged.paged_table(spark, pages, ["genome_id", "other"], rows=15).collect()


NAMES = ["Ada Lovelace", "ada king-noel", "Élodie Ünal", "Adam  Ant", "B. Ada", None, "", "x", "Patient 12", "李 小龍", "adaAda"]


def test_search_from_postings_equals_the_scan(spark, tmp_path):
    rng = random.Random(2)
    rows = {f"P-{i}": rng.choice(NAMES) for i in range(80)}
    index = name_index.NameIndex(f"{tmp_path}/index", "ident", "name", buckets=8)
    table = lambda d: spark.createDataFrame(list(d.items()), "ident string, name string")
    index.add(table(rows), 0)

    def check():
        now = table(rows)
        for text in ["ada", "ADA lov", "a", "king", "noel ada", "él", "P-1", "-7", "79", "p", "小", "nobody", "ada ada", "  ", "12", "lovelaces", "P-12 ", "king-noel", "a%"]:
            want = sorted(map(tuple, store.search(now, text, "name", "ident", most=7).select("ident", "name").collect()), key=str)
            assert sorted(map(tuple, index.search(spark, text, most=7).collect()), key=str) == want, text

    check()
    for version in (1, 2):
        changed = {k: rng.choice(NAMES) for k in rng.sample(sorted(rows), 25)} | {f"Q{version}{k}": "Ada New" for k in range(3)}
        before = {k: rows[k] for k in changed if k in rows}
        for _ in range(version):  # the second is written twice
            index.add(table(changed), version, table(before))
        rows |= changed
    check()


def test_search_reads_only_the_buckets_of_its_grams(spark, tmp_path):
    index = name_index.NameIndex(f"{tmp_path}/index", "ident", "name")
    index.add(spark.range(300).select(F.col("id").cast("string").alias("ident"), F.concat(F.lit("name"), F.col("id")).alias("name")), 0)
    plan = index.search(spark, "name7")._jdf.queryExecution()
    scans = [x for x in plan.executedPlan().toString().split("\n") if "FileScan" in x]
    assert scans and all("PartitionFilters: []" not in x and "bucket" in x for x in scans)
    files = index._of(spark, ["wname"]).inputFiles()
    every = spark.read.parquet(index.path).inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in every}) > 30
    assert files
