"""Token counts, token files and byte-level BPE against the libraries themselves."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from quillmere.llm import byte_bpe, token_counts, token_files  # noqa: E402
from quillmere.sources.scratch import scratch_path  # noqa: E402

ODD = ["", " ", "\n", "a  b", " a\n\n b ", "x\t y\r\n", "▁▁ a▁b", "\x00 a", "  \n  ", "é①  ﬁ", "<s> <unk>", "\n a", "<|endoftext|> a <|startoftext|>x", "é ́x", "a̸ ≠", "\x1c\x85 a", "İ Σς ΑΣ.", "it's I'LL 'tis 12 a1b"]
SCHEMA = "doc_id long, text string, n_bytes string, ids int"


def table(spark, rows):
    """With extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    made = ["".join(r.choice(["the ", "an ", "ereth ", "\n", " ", "é", "'s", "12", "ﬁ", ".", "x" * 9]) for _ in range(r.randint(0, 200))) for _ in range(60)]
    return [*enumerate(ODD + made), (None, "no id"), (9, None), (9, "twice"), (9, "twice")]


def test_sentencepiece_counts(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = sorted((tuple(r) for r in token_counts.token_counts(table(spark, rows), P.path("piece_bpe_32k.model"), limit=50).collect()), key=repr)
    n = [(i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows]
    assert got == sorted(((*x, x[2] > 50) for x in n), key=repr)
    assert token_counts.token_counts(table(spark, []), P.path("piece_bpe_32k.model")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n▁ab<>é\r\t{}();中😀s'"), max_size=60))
def test_sentencepiece_pretokens_add_up(text):
    m = token_counts.model(P.path("piece_bpe_32k.model"))
    assert token_counts.count_text(text, token_counts.Counts(m, {})) == len(m.encode(text))


def test_token_files(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = scratch_path(spark, "file")
    token_files.write_token_file(table(spark, rows), path, P.path("word_bpe_49k.json"), 2, block_ids=300)
    read = token_files.read_token_file(spark, path)
    got = sorted(((r.start, r.doc_id, bytes(r.ids)) for r in read.collect()), key=lambda x: x[0])
    assert [i for _, i, _ in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for s, _, ids in got:
        assert s == start
        start += len(ids) // 4
    want = sorted((i is not None, i or 0, np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows)
    assert sorted((i is not None, i or 0, ids) for _, i, ids in got) == want
    assert {(r.start, r.ids_crc32) for r in token_files.digest(read).collect()} == {(s, zlib.crc32(ids)) for s, _, ids in got}
    empty = scratch_path(spark, "file")
    token_files.write_token_file(table(spark, []), empty, P.path("word_bpe_49k.json"), 2)
    assert token_files.read_token_file(spark, empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 600), min_size=1, max_size=3000), st.integers(10, 16))
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=700), limit)
    used = lengths[lengths > 0].astype(int)
    assert used.max() <= limit and sum(2.0**-n for n in used) <= 1
    stream, marks = token_files.pack(ids, lengths, token_files.canonical(lengths))
    assert token_files.Decoder(lengths, token_files.LIMIT).ids_in(stream, len(ids), marks).tolist() == ids.tolist()


def test_huffman_is_optimal_and_limited():
    fibonacci = [1, 1]
    while len(fibonacci) < 25:
        fibonacci.append(sum(fibonacci[-2:]))
    counts = np.array(fibonacci)
    free, tight = token_files.code_lengths(counts, 24), token_files.code_lengths(counts, 6)
    assert sorted(free.tolist()) == sorted([24, 24, *range(1, 24)])
    assert tight.max() == 6 and (counts * tight).sum() >= (counts * free).sum()
    assert token_files.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9, int), 3)


@pytest.fixture(scope="module")
def tiktoken_own():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, rows, tiktoken_own):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = sorted((tuple(r) for r in byte_bpe.decode_digest(byte_bpe.encode(table(spark, rows), path, P.PATTERN), path, P.PATTERN).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = tiktoken_own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (30, 8), (200, 3)])
def test_chunks_are_stitched(spark, tiktoken_own, chunk, overlap):
    r = random.Random(chunk)
    texts = ["".join(r.choice([" ", "a", "the ", "\n", " " * 9, "x" * 30, "'s", "1", "é"]) for _ in range(r.randint(0, 300))) for _ in range(80)]
    rows = [*enumerate(texts), (500, "a" * 3000), (501, " " * 2000 + "b"), (502, None), (None, "hello world " * 40), (503, texts[0]), (503, texts[0])]
    got = byte_bpe.encode(table(spark, rows), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, chunk=chunk, overlap=overlap)
    have = sorted(((x.doc_id, np.frombuffer(bytes(x.ids), "<u4").tolist()) for x in got.collect()), key=repr)
    assert have == sorted(((i, tiktoken_own.encode_ordinary(t or "")) for i, t in rows), key=repr)
