import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lamina.cli import main
from lamina.functions import layout as fn
from lamina.operators import profile as P
from lamina.operators import rules as R
from lamina.operators.benchmark import benchmark, report_text
from lamina.operators.lint import at_least, conflicts, directives, has_issue, last_wins, lint, prescription, shown
from lamina.operators.rewrite import rewrite, same_schema
from lamina.plans.dsl import Codec, Prescription
from lamina.plans.writer import ColumnSettings, Settings, apply_prescription, infer, plan
from lamina.sources.datasource import register
from lamina.sources.footer import CHUNKS, files, footers, pages
from lamina.sources.locations import data_files, resolve
from lamina.sources.texts import fetch_if_missing, read_manifest, read_prescriptions

MIB = 1 << 20


def chunk(**x):
    base = {
        "file": "f", "row_group": 0, "col_idx": 0, "path": "c", "physical_type": "BYTE_ARRAY", "logical_type": "STRING", "root_fields": 1, "leaves": 1, "max_rep_level": 0, "max_def_level": 0, "codec": "SNAPPY", "encodings": ["PLAIN", "RLE", "RLE_DICTIONARY"],
        "num_values": 1000, "rg_rows": 1000, "rg_compressed": 1000, "compressed": 500, "uncompressed": 1000, "null_count": 0, "has_stats": False, "column_index_offset": 1,
    }
    row = base | x
    return tuple(row.get(f.name) for f in CHUNKS)


def inputs(spark, rows, distinct=(100, 1000)):
    d = spark.createDataFrame([("f", 0, *distinct)], "file string, col_idx int, distinct_count long, non_null_count long")
    return R.Inputs(spark.createDataFrame(rows, CHUNKS), distinct=d)


def found(spark, name, rows, distinct=(100, 1000)):
    return [(r.severity, [(d.scope, d.property, d.value) for d in r.directives]) for r in R.RULES[name](inputs(spark, rows, distinct)).collect()]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_functions(spark):
    n = lambda x: F.lit(x).cast("bigint")
    r = one(
        spark, fn.dictionary_payload(n(100), n(1000), n(10_000_000)), *(fn.dictionary_limit(n(x)) for x in (None, 2 * MIB, 2 * MIB + 1, 5 * MIB)), fn.dictionary_rows(n(1_000_000), n(128 * MIB)), fn.dictionary_rows(n(1_000_000), n(8 * MIB)),
        fn.null_ratio(n(0), n(0)), P.cardinality_ratio(n(0), n(0)), P.cardinality_ratio(n(100), n(1000)), fn.scale_distinct(n(5), n(0), n(9)), fn.div_ceil(n(7), n(2)).cast("long"), fn.percent_change(F.lit(0.0), F.lit(4.0)),
    )
    assert tuple(r) == (1_250_000, 2 * MIB, 2 * MIB, 4 * MIB, 8 * MIB, 125_000, 1_000_000, 0.0, 0.0, 0.1, 9, 4, 0.0)
    t = one(spark, fn.int_type(F.lit("INTEGER"), F.lit("INT32"), F.lit(16), F.lit(False)).alias("a"), fn.int_type(F.lit(None), F.lit("INT64"), F.lit(None).cast("int"), F.lit(None).cast("boolean")).alias("b"))
    assert tuple(t.a) == (16, False) and tuple(t.b) == (64, True)


@pytest.mark.parametrize("groups,want", [
    ([(10_000, 64 * MIB), (20_000, 128 * MIB)], None), ([(70_000, 128 * MIB)], "65536"), ([(100_000, 512 * MIB)], "50000"), ([(65_536, 256 * MIB)], None),
])
def test_row_groups(spark, groups, want):
    rows = [chunk(row_group=i, rg_rows=r, rg_compressed=s) for i, (r, s) in enumerate(groups)]
    got = found(spark, "page-row-group-size", rows)
    assert got == ([] if want is None else [("warning", [("file", "max_row_group_size", want), ("file", "data_page_size_limit", str(MIB))])])


def test_row_group_message(spark):
    rows = [chunk(row_group=i, rg_rows=70_000) for i in range(226)]
    (m,) = [r.message for r in R.RULES["page-row-group-size"](inputs(spark, rows)).collect()]
    assert "226 of 226" in m and "256 MiB" not in m and "data_page_size_limit=1MB" in m


@pytest.mark.parametrize("rows,want", [
    ([chunk(codec="GZIP", uncompressed=40 * MIB, compressed=20 * MIB)], "zstd(3)"), ([chunk(codec="GZIP", uncompressed=31 * MIB, compressed=MIB)], None), ([chunk(codec="UNCOMPRESSED", uncompressed=40 * MIB, compressed=40 * MIB)], None),
    ([chunk(physical_type="DOUBLE", logical_type=None, uncompressed=4 * MIB + 1, compressed=3 * MIB)], "lz4_raw"), ([chunk(physical_type="DOUBLE", logical_type=None, uncompressed=4 * MIB, compressed=3 * MIB)], None),
    ([chunk(uncompressed=5 * MIB, compressed=3 * MIB)], None), ([chunk(row_group=i, uncompressed=99_480_415 // 240, compressed=int(414_501 * 0.636)) for i in range(240)], "lz4_raw"),
    ([chunk(row_group=i, uncompressed=414_501, compressed=int(414_501 * 0.30)) for i in range(240)], "zstd(3)"),
])
def test_codecs(spark, rows, want):
    got = found(spark, "compression-codec-upgrade", rows)
    assert [d[0][2] for _, d in got] == ([] if want is None else [want])


@pytest.mark.parametrize("total,compressed,n,fires", [(163_000_000, 72_000_000, 5, True), (520_000_000, 110_000_000, 1, False), (99_000_000, 63_000_000, 240, True)])
def test_text_encoding(spark, total, compressed, n, fires):
    rows = [chunk(row_group=i, uncompressed=total // n, compressed=compressed // n) for i in range(n)]
    got = found(spark, "string-byte-array-encoding", rows)
    assert got == ([("suggestion", [("column", "dictionary", "false"), ("column", "encoding", "delta_length_byte_array")])] if fires else [])


def stats(*pairs):
    return [{"page_type": p, "encoding": e, "count": 1} for p, e in pairs]


FALL = stats(("DICTIONARY_PAGE", "PLAIN"), ("DATA_PAGE", "RLE_DICTIONARY"), ("DATA_PAGE", "PLAIN"))


@pytest.mark.parametrize("rows,distinct,want", [
    ([chunk(encoding_stats=FALL)], (600, 1000), [("warning", [("column", "dictionary", "false")])]),
    ([chunk(encoding_stats=FALL, uncompressed=10_000_000)], (100, 1000), [("warning", [("column", "dictionary_page_size_limit", str(2 * MIB))])]),
    ([chunk(encoding_stats=FALL, uncompressed=400_000_000, rg_rows=1_000_000)], (100, 1000), [("warning", [("column", "dictionary_page_size_limit", str(16 * MIB)), ("file", "max_row_group_size", "250000")])]),
    ([chunk(encodings=["PLAIN", "RLE"])], (50, 1000), [("suggestion", [("column", "dictionary", "true")])]), ([chunk(encodings=["PLAIN", "RLE"])], (100, 1000), []),
    ([chunk(encoding_stats=stats(("DATA_PAGE", "RLE_DICTIONARY")))], (900, 1000), []),
])
def test_dictionaries(spark, rows, distinct, want):
    assert found(spark, "dictionary-encoding-cardinality", rows, distinct) == want


def test_float_vector_time_and_statistics_rules(spark):
    f = dict(physical_type="DOUBLE", logical_type=None)
    assert found(spark, "float-byte-stream-split", [chunk(**f)]) == [("suggestion", [("column", "encoding", "byte_stream_split")])]
    assert found(spark, "float-byte-stream-split", [chunk(**f)], (99, 1000)) == [] == found(spark, "float-byte-stream-split", [chunk(**f, max_rep_level=1)])
    assert found(spark, "vector-embedding-page-size", [chunk(**f, max_rep_level=1, num_values=64_000)]) == [("warning", [("file", "data_page_size_limit", "262144")])]
    assert found(spark, "vector-embedding-page-size", [chunk(**f, max_rep_level=1, num_values=63_999)]) == []
    t = dict(physical_type="INT64", logical_type="TIMESTAMP")
    assert len(found(spark, "timestamp-delta-encoding", [chunk(**t)])) == 1 and found(spark, "timestamp-delta-encoding", [chunk(**t | {"logical_type": "TIME"})]) == []
    assert len(found(spark, "oversized-string-statistics", [chunk(min=b"x" * 65, max=b"y", min_exact=True)])) == 1 and found(spark, "oversized-string-statistics", [chunk(min=b"x" * 65, min_exact=False)]) == []
    assert len(found(spark, "low-compression-ratio", [chunk(compressed=951)])) == 1 and found(spark, "low-compression-ratio", [chunk(compressed=950)]) == []
    assert found(spark, "missing-page-statistics", [chunk()]) == [] and len(found(spark, "missing-page-statistics", [chunk(), chunk(row_group=1, column_index_offset=None)])) == 1


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    table = pa.table({
        "a": pa.array([1, 2, 3, 4] * 500, pa.int32()), "u": pa.array([None if i % 3 else (1 << 63) + i for i in range(2000)], pa.uint64()), "f": [float("nan") if i % 7 == 0 else -i / 3 for i in range(2000)], "s": [f"text {i % 100} é" for i in range(2000)],
        "l": [[i, i + 1] if i % 5 else None for i in range(2000)], "t": pa.array([i * 10**6 for i in range(2000)], pa.timestamp("us")), "n": pa.nulls(2000, pa.string()),
    })
    pq.write_table(table, f"{folder}/one.parquet", row_group_size=900, compression={"a": "zstd", "s": "gzip"}, use_dictionary=["a", "l.list.element"], column_encoding={"t": "DELTA_BINARY_PACKED"}, write_page_index=True)
    return f"{folder}/one.parquet", table


def test_footers_as_pyarrow(spark, sample):
    path, _ = sample
    meta = pq.ParquetFile(path).metadata
    rows = footers(spark, path).orderBy("row_group", "col_idx").collect()
    assert len(rows) == meta.num_row_groups * meta.num_columns
    for r in rows:
        m = meta.row_group(r.row_group).column(r.col_idx)
        assert (r.path, r.physical_type, r.codec, r.num_values, r.compressed, r.uncompressed, r.null_count) == (m.path_in_schema, m.physical_type, m.compression, m.num_values, m.total_compressed_size, m.total_uncompressed_size, m.statistics.null_count)
        assert sorted(r.encodings) == sorted(m.encodings) and (r.column_index_offset is not None) == m.has_column_index
    f = files(spark, path).first()
    assert (f.num_rows, f.num_row_groups, f.num_leaf_columns, f.size_bytes) == (2000, 3, 7, os.path.getsize(path))
    p = pages(footers(spark, path)).groupBy("row_group", "col_idx").agg(F.sum(F.when(F.col("page_type") != "DICTIONARY_PAGE", F.col("num_values"))).alias("n")).collect()
    assert {(x.row_group, x.col_idx): x.n for x in p} == {(r.row_group, r.col_idx): r.num_values for r in rows}


def test_profile(spark, sample):
    path, table = sample
    got = {r.path: r for r in P.columns(footers(spark, path)).collect()}
    assert tuple(got["a"].int_stats) == (1, 4, 32, True) and got["a"].distinct_count == 8 and got["a"].arrow_type == "int32"
    assert got["u"].int_stats.bit_width == 64 and not got["u"].int_stats.is_signed and got["u"].null_count == 1333
    assert got["s"].string_stats.min == "text 0 é" and tuple(got["s"].string_stats.lengths)[:2] == (9, 10) and got["s"].distinct_count == 222
    assert got["n"].distinct_count == 0 and got["n"].cardinality_ratio == 0.0 and got["n"].null_ratio == 1.0
    assert got["l.list.element"].max_rep_level == 1 and got["t"].arrow_type == "timestamp(us,none)" and got["t"].int_stats.max == 1999 * 10**6


def test_data_sources(spark, sample):
    path, table = sample
    register(spark)
    assert spark.read.format("parquet_footer").option("path", path).load().count() == 21
    assert spark.read.format("parquet_pages").option("path", path).load().count() >= 21
    rows = spark.read.format("parquet_sample").option("path", path).option("rows", 10).load().select("a", "s").collect()
    assert [r.s for r in rows] == table.column("s").to_pylist()[:10]


def test_lint_order_and_text(spark, sample):
    path, _ = sample
    findings = lint(spark, path).cache()
    rows = findings.collect()
    assert [(r.severity_ord, r.rule_ord) for r in rows] == sorted((r.severity_ord, r.rule_ord) for r in rows) and [r.ordinal for r in rows] == list(range(len(rows)))
    assert has_issue(findings) == any(r.severity == "warning" for r in rows) and at_least(findings, "warning").count() == sum(r.severity == "warning" for r in rows)
    assert lint(spark, path, rules=["no-such-rule"]).count() == 0 and len(shown(findings).collect()) == len(rows)
    d = directives(findings)
    assert len(prescription(findings)) == d.count() and last_wins(d).count() <= d.count() and conflicts(d).columns[:2] == ["file", "scope"]


def test_no_row_groups(spark, tmp_path):
    pq.ParquetWriter(tmp_path / "empty.parquet", pa.schema([("a", pa.int64())])).close()
    assert lint(spark, str(tmp_path / "empty.parquet")).count() == 0 and files(spark, str(tmp_path)).first().num_rows == 0


def test_two_columns_one_rewritten(spark, tmp_path):
    table = pa.table({"a": pa.array([1, 2, 3, 4], pa.int32()), "b": pa.array([10, 20, 30, 40], pa.int32())})
    source, target = str(tmp_path / "x.parquet"), str(tmp_path / "y")
    pq.write_table(table, source, compression={"a": "zstd", "b": "snappy"})
    done = rewrite(spark, source, target, Prescription.parse("set column a compression gzip(6)"), single=True)
    assert done[0][0].sink == "arrow" and {r.path: r.codec for r in footers(spark, target).collect()} == {"a": "GZIP", "b": "SNAPPY"}
    assert same_schema(spark, source, target) and [tuple(r) for r in spark.read.parquet(target).collect()] == [(1, 10), (2, 20), (3, 30), (4, 40)]


def test_rewrite_removes_findings(spark, tmp_path):
    source, target = str(tmp_path / "x.parquet"), str(tmp_path / "y")
    pq.write_table(pa.table({"a": list(range(70_000)), "t": pa.array(range(70_000), pa.timestamp("us"))}), source)
    assert {"page-row-group-size", "timestamp-delta-encoding"} <= {r.rule for r in lint(spark, source).collect()}
    done = rewrite(spark, source, target, single=True)
    assert not {"page-row-group-size", "timestamp-delta-encoding", "missing-page-statistics"} & {r.rule for r in lint(spark, target).collect()} and done[0][0].unapplied == []
    assert spark.read.parquet(target).exceptAll(spark.read.parquet(source)).count() == 0 and spark.read.parquet(target).count() == 70_000


def test_native_sink_and_inference(spark, tmp_path):
    source, target = str(tmp_path / "x.parquet"), str(tmp_path / "y")
    pq.write_table(pa.table({"a": list(range(5000)), "b": ["x"] * 5000}), source, compression="gzip", row_group_size=2500)
    s = infer(footers(spark, source))
    assert s.max_row_group_size == 2500 and s.columns["a"].codec == Codec("gzip", 6) and s.columns["a"].dictionary and s.columns["a"].statistics == "chunk"
    done = rewrite(spark, source, target, Prescription.parse("set column a bloom_filter true\nset column a dictionary false"), single=True)
    rows = footers(spark, target).collect()
    assert done[0][0].sink == "native" and {r.codec for r in rows} == {"GZIP"} and len({r.row_group for r in rows}) == 2 and all(r.bloom_offset for r in rows if r.path == "a")
    apply_prescription(spark.read.parquet(source).write.mode("overwrite"), "set file compression zstd(3)").parquet(target)
    assert {r.codec for r in footers(spark, target).collect()} == {"ZSTD"}
    with pytest.raises(ValueError):
        apply_prescription(spark.range(1).write, "set file compression snappy\nset file compression zstd(3)")


def test_rewrite_onto_its_source(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    pq.write_table(pa.table({"a": list(range(70_000))}), folder / "x.parquet")
    for source, target in ((folder, folder), (folder / "x.parquet", folder), (folder, folder / "new"), (folder, f"file://{folder}/"), (folder, folder / ".." / "f")):
        with pytest.raises(ValueError, match="lie in each other"):
            rewrite(spark, str(source), str(target))
        assert spark.read.parquet(str(folder)).count() == 70_000
    old = tmp_path / "old"
    old.mkdir()
    (old / "stale.parquet").write_bytes(b"stale")
    rewrite(spark, str(folder), str(old))
    assert spark.read.parquet(str(old)).count() == 70_000 and sorted(os.listdir(tmp_path)) == ["f", "old"]


def test_rewrite_keeps_how_files_were_written(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    n = 3000
    table = pa.table({"a": list(range(n)), "b": ["x", "y", "z"] * (n // 3), "c": [float(i % 7) for i in range(n)]})
    table = table.replace_schema_metadata({"owner": "someone"})
    pq.write_table(table, folder / "1.parquet", use_dictionary=["b"], write_statistics=["a", "b"], version="1.0", row_group_size=1000, compression="gzip", sorting_columns=[pq.SortingColumn(0)])
    pq.write_table(table, folder / "2.parquet", compression="zstd")
    # The native sink: a plan for each file, as they were written in different ways.
    done = rewrite(spark, str(folder), str(tmp_path / "native"), Prescription.parse("set column a bloom_filter true"))
    assert [p.sink for p, _ in done] == ["native"] * 2 and [len(f) for _, f in done] == [1, 1] and any(x.startswith("key owner") for x in done[0][0].lost) and any(x.startswith("sorting") for x in done[0][0].lost)
    rows = footers(spark, str(tmp_path / "native")).collect()
    gzip = [r for r in rows if r.codec == "GZIP"]
    assert {r.codec for r in rows} == {"GZIP", "ZSTD"} and len({r.row_group for r in gzip}) == 3 and all(r.bloom_offset for r in rows if r.path == "a")
    assert {r.path for r in gzip if "RLE_DICTIONARY" in r.encodings or "PLAIN_DICTIONARY" in r.encodings} == {"b"} and {r.path for r in gzip if r.has_stats} == {"a", "b"}
    # The Arrow sink.
    done = rewrite(spark, str(folder), str(tmp_path / "arrow"), Prescription.parse("set column b compression snappy"))
    rows = footers(spark, str(tmp_path / "arrow")).collect()
    gzip = [r for r in rows if r.codec == "GZIP"]
    assert [p.sink for p, _ in done] == ["arrow"] * 2 and {(r.path, r.codec) for r in rows} == {("a", "GZIP"), ("c", "GZIP"), ("a", "ZSTD"), ("c", "ZSTD"), ("b", "SNAPPY")}
    assert all(r.key_values.get("owner") == "someone" and r.writer_version == 1 and r.sorting == "0:0:0" and not r.has_stats or r.path != "c" for r in gzip) and len({r.row_group for r in gzip}) == 3
    for where in ("native", "arrow"):
        back = spark.read.parquet(str(tmp_path / where))
        assert back.count() == 2 * n and back.exceptAll(spark.read.parquet(str(folder))).count() == 0
    assert rewrite(spark, str(folder), str(tmp_path / "none"), Prescription.parse("# nothing")) == [] and not (tmp_path / "none").exists()


def test_rewrite_without_rows(spark, tmp_path):
    pq.write_table(pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.string())}), tmp_path / "x.parquet")
    rewrite(spark, str(tmp_path / "x.parquet"), str(tmp_path / "y"), Prescription.parse("set column a compression zstd(3)"))
    assert spark.read.parquet(str(tmp_path / "y")).count() == 0


def test_small_dictionaries_stay(spark, tmp_path):
    pq.write_table(pa.table({"t": pa.array([i % 50 for i in range(70_000)], pa.timestamp("us")), "u": pa.array(range(70_000), pa.timestamp("us"))}), tmp_path / "x.parquet")
    (planned, _), = rewrite(spark, str(tmp_path / "x.parquet"), str(tmp_path / "y"))
    assert {(d.path, d.property) for d, _ in planned.unapplied} == {("t", "encoding")}
    assert {r.path for r in footers(spark, str(tmp_path / "y")).collect() if "RLE_DICTIONARY" in r.encodings} == {"t"}


def test_plan_lists_what_it_cannot_apply():
    p = plan(Prescription.parse("set column a encoding byte_stream_split\nset file compression brotli(3)"))
    assert len(p.unapplied) == 2 and p.sink == "native"
    p = plan(Prescription.parse("set column a encoding byte_stream_split\nset column a bloom_filter true"), Settings(columns={"a": ColumnSettings()}), unsafe=True)
    assert p.sink == "arrow" and [d.property for d, _ in p.unapplied] == ["bloom_filter"] and p.options["column_encoding"] == {"a": "BYTE_STREAM_SPLIT"}
    assert Settings(columns={"a": ColumnSettings(Codec("snappy"))}).apply(Prescription.parse("set column a compression gzip(1)\nset file compression zstd(3)")).columns["a"].codec == Codec("gzip", 1)


def test_inputs(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# files\nhttp://x/a.parquet # first\n\n  b.parquet  \n")
    assert [(r.idx, r.location) for r in read_manifest(spark, str(tmp_path / "m.txt")).orderBy("idx").collect()] == [(0, "http://x/a.parquet"), (1, "b.parquet")]
    (tmp_path / "1.prescription").write_text("set file compression snappy\n")
    (tmp_path / "x.prescription").write_text("bad")
    assert [i for i, _ in read_prescriptions(str(tmp_path), 2)] == [1]
    with pytest.raises(ValueError):
        read_prescriptions(str(tmp_path), 1)
    assert fetch_if_missing(str(tmp_path / "m.txt"), str(tmp_path / "c" / "m")) and not fetch_if_missing("gone", str(tmp_path / "c" / "m"))
    assert resolve("s3a://b/k") == "s3a://b/k" and resolve(str(tmp_path)).startswith("file:///")
    with pytest.raises(FileNotFoundError):
        resolve("no/such/file")
    (tmp_path / "bad.parquet").write_text("nothing")
    assert [x.rsplit("/", 1)[1] for x in data_files(spark, str(tmp_path / "bad.parquet"))] == ["bad.parquet"]
    with pytest.raises(Exception, match="not a Parquet file"):
        footers(spark, str(tmp_path / "bad.parquet")).collect()


def test_files_of_the_web(spark, sample):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    path, _ = sample
    with open(path.removeprefix("file://"), "rb") as f:
        data = f.read()

    class Ranges(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/whole.parquet":
                self.send_response(200)
                self.end_headers()
                self.wfile.write(data)
                return
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{b}/{len(data)}")
            self.end_headers()
            self.wfile.write(data[a : b + 1])

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        address = f"http://127.0.0.1:{server.server_port}/one.parquet"
        keep = lambda df: sorted((r.rule, r.message) for r in df.collect())
        assert keep(lint(spark, address)) == keep(lint(spark, path))
        with pytest.raises(Exception, match="range requests"):
            footers(spark, address.replace("one", "whole")).collect()
    finally:
        server.shutdown()


def test_command_line(spark, sample, tmp_path, capsys):
    path, _ = sample
    out = str(tmp_path / "p.txt")
    assert main(["check", path, "--rules", "timestamp-delta-encoding,missing-page-statistics", "--export-prescription", out], spark) in (0, 1)
    assert main(["rewrite", path, "--dry-run"], spark) == 0 and main(["rewrite", path, "--rules", "a", "--from-prescription", out], spark) == 2
    (tmp_path / "q.txt").write_text("set column s compression zstd(3)\n")
    assert main(["rewrite", path, "-o", str(tmp_path / "o"), "--from-prescription", str(tmp_path / "q.txt")], spark) == 0
    assert "arrow writer" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "o")).count() == 2000


def test_benchmark(spark, sample, tmp_path):
    path, _ = sample
    (tmp_path / "m.txt").write_text(f"{path}\n")
    rows = benchmark(spark, str(tmp_path / "m.txt"), str(tmp_path / "d"), str(tmp_path / "o"), {0: Prescription.parse("set column s compression zstd(9)")}, iterations=1)
    assert [r.name for r in rows.collect()] == ["one.parquet", "total"] and "total" in report_text(rows)


def test_stream(spark, sample, tmp_path):
    from lamina.streaming.lint_stream import lint_stream

    path, _ = sample
    q = lint_stream(spark, os.path.dirname(path), str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == lint(spark, path).count()


def test_page_headers_read_all_tables(spark):
    from lamina.queries import TABLES, page_headers

    assert {r.tbl for r in page_headers(spark, "/root/testdata/sf0.001").select("tbl").distinct().collect()} == set(TABLES)
