"""Byte-level BPE and token files against the libraries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from stratanet.llm import bpe, token_files

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = bpe.load_ranks(f.read())
    own = bpe.Vocabulary(ranks)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n: int):
    rng = random.Random(3)
    for _ in range(n):
        yield "".join(rng.choice("aeiou thnsr0123.,\n  éÉß你😀\x00<|>AB") for _ in range(rng.randint(0, 60)))


def test_pieces_equal_the_library(library):
    own, other = library
    pieces = bpe.PieceEncoder(own, public_tokenizers.PATTERN)
    cuts = bpe.CutEncoder(lambda ts: [pieces.encode(t) for t in ts])
    for t in [*texts(3000), "a" * 3000, " " * 3000]:
        assert np.frombuffer(cuts.encode(t), "<u4").tolist() == other.encode_ordinary(t)


def test_table_follows_appends_and_edits(library):
    own, _ = library
    rng = random.Random(1)
    for t in texts(150):
        data = t.encode()
        table = bpe.PrefixTable(own, data)
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        table.replace(a, b, b"zq hello")
        table.append(b" and more")
        fresh = bpe.PrefixTable(own, data[:a] + b"zq hello" + data[b:] + b" and more")
        assert table.last == fresh.last and table.data == fresh.data


def test_edit_far_from_the_end_is_local(library):
    own, _ = library
    table = bpe.PrefixTable(own, b"some words in a row " * 200)
    assert table.replace(100, 104, b"text") < 400


def test_encode_and_decode_odd_rows(odd, none, library):
    back = bpe.decode(bpe.encode(odd, PATH, public_tokenizers.PATTERN), PATH).collect()
    want = sorted((r.doc_id or 0, (r.text or "").encode()) for r in odd.collect())
    assert sorted((r.doc_id or 0, bytes(r.bytes)) for r in back) == want
    assert bpe.decode(bpe.encode(none, PATH, public_tokenizers.PATTERN), PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 3000])
def test_elias_fano_round_trip(n):
    values = np.cumsum(np.random.default_rng(n).integers(0, 500, n))
    held, _ = token_files.EliasFano.from_bytes(memoryview(token_files.EliasFano.of(values).to_bytes()))
    assert held.all().tolist() == values.tolist()
    assert [held.select(i) for i in range(n)] == values.tolist()


def test_single_documents_of_a_file():
    ids = [[1, 2], [], [70000, 5, 6], [9]]
    file = token_files.TokenFile(token_files.pack_file([4, None, 6, 7], [np.array(x, "<u4").tobytes() for x in ids]))
    assert [file.document(i).tolist() for i in range(4)] == ids
    assert file.known.tolist() == [True, False, True, True]


def test_files_equal_the_library(odd, none, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    other.encode_special_tokens = True
    got = token_files.read_files(token_files.write_files(odd, path)).collect()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = [*other.encode(r.text or "", add_special_tokens=False).ids, token_files.END]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert token_files.read_files(token_files.write_files(none, path)).count() == 0


def test_texts_of_a_batch_are_encoded_together():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    calls = []

    def whole(ts):
        calls.extend(ts)
        return [np.array(c.ids, "<u4").tobytes() for c in tokenizer.encode_batch_fast(ts, add_special_tokens=False)]

    opens = np.zeros(tokenizer.get_vocab_size(), bool)
    opens[[i for t, i in tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
    odd = ["", " ", "x ", " x", "x\n", "a\nb x\n", "x  y", "x  ", "<|endoftext|> a", "Ġ Ġa", "it's 'll  two", "a\x85 b\x1c", "x "]
    every = [*odd, *texts(2000), *odd]
    batch = token_files.BatchEncoder(whole, opens, remembered=500)
    for _ in range(2):
        got = batch.encode(every)
        assert got == whole(every)
    assert batch.encode([]) == []
    # Unknown words of many texts go to the library as one text, not as one each.
    calls.clear()
    many = [f"w v{i} u{i}" for i in range(1000)]
    assert batch.encode(many) == whole(many)
    assert len(calls) < 1000 + 5
