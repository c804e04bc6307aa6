import base64
import hashlib
import random

from lamina.llm import warc as W
from lamina.llm.queries import warc_round_trip
from lamina.llm.warc import ranges, read_warc, write_warc


def brute(rows):
    out = []
    for i, _, p in rows:
        data = (p or "").encode()
        same = [x for x, _, q in rows if (q or "") == (p or "") and x is not None]
        best = max(same) if same else None
        again = best is not None and i != best
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


def rows():
    rng = random.Random(1)
    out = [(i, f"http://x/{i}?a b\r\n", rng.choice(["<p>same</p>", "", None, "é日本", f"own {i}", "long " * 30_000])) for i in range(80)]
    return out + [(79, "u", "<p>same</p>"), (79, "u", "<p>same</p>"), (None, None, "own 3"), (None, "v", "nobody"), (None, "v", "nobody"), (801, None, "no address"), (802, "", "p"), (803, "http://x/a b?q=é%20%zz\x85", "q")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "page_id long, url string, html string, size int")
    got = sorted((tuple(r) for r in warc_round_trip(df).collect()), key=str)
    assert got == brute(rows())
    assert warc_round_trip(df.limit(0)).count() == 0


def test_payloads_and_selection(spark, tmp_path):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string")
    index = write_warc(df, str(tmp_path / "archives"))
    back = read_warc(index).collect()
    want = {i: (p or "").encode() for i, _, p in rows()}
    urls = {(i, u) for i, u, _ in rows()}
    assert {(r.page_id, r.url) for r in back} == urls and (None, "v") in urls
    assert all(r.intact for r in back) and all(bytes(r.payload) == want[r.page_id] for r in back if r.record_type == "response" and r.page_id not in (None, 79))
    some = index.where("page_id % 7 = 0")
    assert sorted(r.page_id for r in read_warc(some).collect()) == sorted(i for i, _, _ in rows() if i is not None and i % 7 == 0)


def test_tasks_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "TASK_BYTES", 2000)
    rng = random.Random(2)
    df = spark.createDataFrame([(i, "u", "".join(rng.choice("abcdef") for _ in range(3000))) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    back = read_warc(write_warc(df, str(tmp_path / "archives")))
    assert back.rdd.getNumPartitions() > 20 and sorted(r.page_id for r in back.select("page_id").collect()) == list(range(60))


def test_ranges():
    assert ranges([(0, 10), (10, 5), (200_000, 3), (200_100, 1)]) == [(0, 15, [(0, 10), (10, 5)]), (200_000, 200_101, [(200_000, 3), (200_100, 1)])]
    assert ranges([]) == [] and len(ranges([(0, 5 << 20), (5 << 20, 10)])) == 2
