"""Token counts and token output against the tokenizers library, whole round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logweave.llm import textarrays as ta
from logweave.llm import token_counts as tc
from logweave.llm import token_output as to
from logweave.llm.elias_fano import EliasFano
from tests.llm.conftest import rows_of

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [*"abstmdrevlAIΣ'''  \n\t 12!?,.é\u0301ßς中🙂½²\u00a0\x1c\x85_ＡⅣİ", "<|endoftext|>", "<|", "'ll", "'re"]


def random_texts(n):
    rng = random.Random(9)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 70))) for _ in range(n)] + ["", "x" * 3000, None]


@pytest.mark.parametrize("n", [0, 1, 2, 300, 1000])
@pytest.mark.parametrize("top", [0, 3, 257, 10**7, 2**40])
def test_elias_fano_round_trip_and_select(n, top):
    rng = random.Random(n + top)
    values = sorted(rng.randint(0, top) for _ in range(n))
    code = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert code.values().tolist() == values
    assert [code.select(i) for i in range(n)] == values
    with pytest.raises(IndexError):
        code.select(n)


def test_elias_fano_is_small_and_refuses_decreasing():
    values = np.cumsum(np.full(20_000, 700))
    assert len(EliasFano.encode(values).to_bytes()) < 20_000 * 12 / 8 + 1_000  # 2 + log2(700) bits each, and samples
    with pytest.raises(ValueError):
        EliasFano.encode([3, 2])


def test_counts_equal_the_library():
    texts = random_texts(2_000)
    own = tc.Counter(WORD, ta.packed_classes())
    library = Tokenizer.from_file(WORD)
    assert own.texts(texts) == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_ids_equal_the_library():
    texts = random_texts(2_000)
    own = to.Encoder(BYTE, ta.packed_classes())
    library = Tokenizer.from_file(BYTE)
    assert [x.tolist() for x in own.texts(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_emptied_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(to, "REMEMBERED", 50)
    monkeypatch.setattr(tc, "REMEMBERED", 50)
    monkeypatch.setattr(ta, "PIECE_CHARS", 500)
    test_ids_equal_the_library()
    test_counts_equal_the_library()


def test_long_texts_are_cut_where_no_token_crosses():
    text = "word  next here\n " * 4_000 + "y" * 3_000 + " end"
    pieces = list(ta.safe_pieces(text, 1_000))
    assert "".join(pieces) == text and len(pieces) > 10
    library = Tokenizer.from_file(BYTE)
    whole = library.encode(text, add_special_tokens=False).ids
    assert [i for p in pieces for i in library.encode(p, add_special_tokens=False).ids] == whole


def test_count_tokens_keeps_rows_and_columns(clashing, none):
    out = tc.count_tokens(clashing, WORD)
    assert sorted(out.columns) == sorted(clashing.columns)
    library = Tokenizer.from_file(WORD)
    for r in out.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 2048)
    assert out.count() == clashing.count() and tc.count_tokens(none, WORD).count() == 0


def check_output(spark, docs, segment_ids):
    library = Tokenizer.from_file(BYTE)
    segments = to.write_token_ids(docs, BYTE, segment_ids=segment_ids)
    got = sorted(rows_of(to.read_boundaries(segments)), key=lambda r: r[1])
    expected = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.select("doc_id", "text").collect()]
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    packed = sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in expected)
    assert sorted((str(i), n, c) for i, _, n, c in got) == packed
    return segments, dict(expected)


def test_written_ids_round_trip(spark, clashing, none):
    check_output(spark, clashing, 500)
    assert to.read_boundaries(to.write_token_ids(none, BYTE)).count() == 0


def test_select_reads_single_documents(spark, small):
    segments, expected = check_output(spark, small, 5_000)
    assert segments.count() > 4
    wanted = spark.createDataFrame([(i,) for i in (0, 7, 100, 199, 10**9)], "doc_id long")
    found = {r.doc_id: r.ids for r in to.token_ids_of(segments, wanted).collect()}
    assert found == {i: expected[i] for i in (0, 7, 100, 199)}
