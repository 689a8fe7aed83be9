import pytest

from gleanery.operators import codec, index


@pytest.mark.parametrize("n", [1, 2, 7, 32, 63, 127, 128])
def test_sorted_round_trip(n):
    numbers = [i * 10 for i in range(n)]
    data = codec.encode_sorted(numbers)
    assert codec.decode_sorted(data + b"rest", n) == (numbers, b"rest")
    assert len(data) == 5 + (codec.bit_width(10 if n > 1 else 0) * (n - 1) + 7) // 8


@pytest.mark.parametrize("numbers", [[2**32 - 1], [0, 2**32 - 1], [5, 5, 5], [0]])
def test_sorted_edges(numbers):
    assert codec.decode_sorted(codec.encode_sorted(numbers), len(numbers)) == (numbers, b"")


@pytest.mark.parametrize("numbers", [[(17 * i + 5) % 100 for i in range(n)] for n in (1, 2, 7, 63, 128)] + [[0] * 9, [1, 0, 1], [2**32 - 1]])
def test_unsorted_round_trip(numbers):
    data = codec.encode_unsorted(numbers)
    assert codec.decode_unsorted(data, len(numbers)) == (numbers, b"")
    assert len(data) == 1 + (codec.bit_width(max(numbers)) * len(numbers) + 7) // 8


def test_bits_are_packed_lowest_first():
    assert codec.pack([1, 2, 3], 2) == bytes([0b111001])
    assert codec.unpack(bytes([0b111001]), 2, 3) == [1, 2, 3]


def test_errors():
    for call in (
        lambda: codec.encode_sorted([10, 5]), lambda: codec.decode_sorted(b"\0\0\0", 1), lambda: codec.decode_sorted(codec.encode_sorted([0, 300])[:-1], 2),
        lambda: codec.decode_unsorted(b"", 1), lambda: codec.decode_unsorted(b"\0\0", 1), lambda: codec.decode_unsorted(b"\x21" + b"\0" * 9, 1), lambda: codec.pack([4], 2),
    ):
        with pytest.raises(codec.CodecError):
            call()


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 500, 999])
def test_postings_round_trip(n):
    postings = [(2 * i, 3 * i) for i in range(n)]
    assert codec.decode_postings(codec.encode_postings(postings), n) == postings


def test_tables(spark):
    docs = spark.createDataFrame([(i, "a " * (i % 5) + f"b{'x' * (i % 3)}") for i in range(400)], "doc_id long, text string")
    postings = index.build_index(docs, 250).postings
    encoded = codec.encode_lists(postings)
    assert sorted(codec.decode_lists(encoded).collect()) == sorted(postings.drop("doc_len").collect())
    sizes = {(r.segment_id, r.term): len(r.data) for r in encoded.collect()}
    assert sizes == {(r.segment_id, r.term): r.bytes for r in codec.posting_block_stats(postings).collect()}
