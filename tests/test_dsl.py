import pytest
from hypothesis import given
from hypothesis import strategies as st

from lamina.plans.dsl import COLUMN_PROPERTIES, ENCODINGS, STATISTICS, Codec, Directive, Prescription, PrescriptionError

codecs = st.one_of(st.sampled_from(["uncompressed", "snappy", "lz4_raw"]).map(Codec), st.integers(1, 22).map(lambda n: Codec("zstd", n)), st.integers(0, 9).map(lambda n: Codec("gzip", n)), st.integers(0, 11).map(lambda n: Codec("brotli", n)))
numbers = st.integers(0, (1 << 64) - 1)
values = {
    "compression": codecs, "encoding": st.sampled_from(ENCODINGS), "dictionary": st.booleans(), "dictionary_page_size_limit": numbers, "statistics": st.sampled_from(STATISTICS), "bloom_filter": st.booleans(),
    "bloom_filter_ndv": numbers, "bloom_filter_fpp": st.floats(0, 1),
}
paths = st.lists(st.text("abcXYZ_019", min_size=1, max_size=5), min_size=1, max_size=3).map(".".join)
columns = st.one_of(*(st.builds(Directive, st.just(p), values[p], paths) for p in COLUMN_PROPERTIES))
file_ = st.one_of(
    st.builds(Directive, st.just("compression"), codecs), st.builds(Directive, st.sampled_from(["max_row_group_size", "data_page_size_limit"]), numbers), st.builds(Directive, st.just("statistics_truncate_length"), st.one_of(st.none(), numbers))
)


@given(st.lists(st.one_of(columns, file_), max_size=8).map(Prescription))
def test_print_then_parse(p):
    assert Prescription.parse(str(p)) == p


def test_texts():
    text = "# all\nset file compression zstd(3)  # level\n\n  set column a.list.element encoding byte_stream_split\nset file statistics_truncate_length none\nset column a bloom_filter_fpp 0.01"
    p = Prescription.parse(text)
    assert [str(d) for d in p] == ["set file compression zstd(3)", "set column a.list.element encoding byte_stream_split", "set file statistics_truncate_length none", "set column a bloom_filter_fpp 0.01"]


@pytest.mark.parametrize("bad", [
    "garbage", "set file compression zstd", "set file compression zstd(23)", "set file compression gzip(10)", "set file nothing 1", "set column a..b dictionary true", "set column a dictionary yes", "set column a encoding rle", "set file compression",
    "set file max_row_group_size -1", "set column a statistics all", "SET file compression snappy", "set file max_row_group_size 1 2",
])
def test_errors_name_their_line(bad):
    with pytest.raises(PrescriptionError, match="^line 2: "):
        Prescription.parse(f"set file compression snappy\n{bad}")


def test_conflicts():
    p = Prescription.parse("set file compression snappy\nset column a dictionary true\nset file compression snappy\nset file compression zstd(1)")
    assert p.conflict().key == "file compression" and p.conflict().second.shown == "zstd(1)"
    with pytest.raises(PrescriptionError):
        p.validate()
    assert Prescription.parse("set file compression snappy\nset file compression snappy").conflict() is None
    assert p.settled()[None, "compression"].shown == "zstd(1)" and len(p + p) == 8
