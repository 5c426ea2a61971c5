import itertools
import zlib

import numpy as np
import pytest

from jsonloom.llm import packing


def check(docs, pieces, length=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    ids = [(r.doc_id, (*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2)) for r in docs.collect()]
    total = sum(len(x) for _, x in ids)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    padding = 0
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0 and sum(p.length for p in pieces) == total
    # each id is in one piece: pieces in order along the sequences give each document back
    rebuilt, whole = [], []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        if p.start == 0:
            whole.append((p.doc_id, p.doc_tokens, []))
        assert whole[-1][0] == p.doc_id and len(whole[-1][2]) == p.start
        whole[-1][2].extend(np.frombuffer(p.ids, "<u4").tolist())
    rebuilt = [(k, tuple(x)) for k, n, x in whole]
    assert sorted(map(repr, rebuilt)) == sorted(map(repr, ids))


def test_documents(documents):
    check(documents, packing.pack(documents).collect())


def test_odd(odd):
    check(odd, packing.pack(odd).collect())


def test_added_tokens(spark):
    texts = ["hello <|endoftext|> world <|startoftext|>", "a<|endoftext|>b<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "word.<|startoftext|>Word!! x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.pack(docs).collect()
    check(docs, pieces)
    assert np.frombuffer(b"".join(p.ids for p in sorted((p for p in pieces if p.doc_id == 0), key=lambda p: p.start)), "<u4").tolist() == [3306, 49407, 1002, 49406, 2]


def test_none(none):
    assert packing.pack(none).collect() == []


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2)])
def test_hilbert_steps_to_neighbours(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    order = points[np.argsort(packing.hilbert(points, bits))]
    assert sorted(packing.hilbert(points, bits)) == list(range(len(points)))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_cuts():
    for total in (0, 1, 5, 4096, 4097, 10_000):
        out = packing.cuts(total, 4096)
        assert out[0] == total // 4096 * 4096 and out[-1] == total
        assert all((b - a) & (b - a - 1) == 0 for a, b in zip(out, out[1:]))


def test_chunks_with_nul_bytes_have_ids_of_their_own():
    body = [b"a b\x00 a", b"c a b\x00"]
    joined = b" ".join(body) + b"        "
    start = np.array([0, 2, 5, 7, 9, 11])
    stop = start + [1, 2, 1, 1, 1, 2]
    assert [joined[x:y] for x, y in zip(start, stop)] == [b"a", b"b\x00", b"a", b"c", b"a", b"b\x00"]
    assert len(set(packing.span_hashes(joined, start, stop).tolist())) == 3
    assert packing.spans_equal(joined, start, stop, np.array([0, 1, 0, 3, 0, 1]))
    assert not packing.spans_equal(joined, start, stop, np.array([0, 0, 0, 3, 0, 0]))
