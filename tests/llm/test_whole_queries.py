"""The queries themselves on a small folder of tables with a very long text, nulls, repeats and clashing columns, against plain definitions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("xxhash")
from quillmere.llm import registry  # noqa: E402

SPACED, WORDS = "[^\x20\x09-\x0d]+", "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def made(r, n):
    return [("".join(r.choice("abcdefghijk") for _ in range(r.randint(3, 9)))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """The long text has 200,000 words; what is to be found stands behind them all, and again in a short one."""
    r = random.Random(21)
    passage = " ".join(made(r, 60))
    item = " ".join(made(r, 12))
    tail = f"{passage} {item}. All rights reserved, x@mail.example.org +1 555 010 9999, 4111111111111111, 10.2.3.4"
    long = " ".join(w if k % 11 else w + "é.\n" for k, w in enumerate(made(r, 200_000)))
    return passage, item, [(1, f"{long} {tail}"), (2, None), (3, ""), (4, f"Another start. {passage}"), (5, "short text"), (5, "short text"), (None, "no id here"), (7, " \n\t ")]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    _, item, rows = texts
    columns = "doc_id long, text string, lang string, source string, n_chars long, fp int, n_words string, kept int, ids int, spans int, label string, part int, item_id int"
    full = [(i, t, "e", "s", None if t is None else len(t), 1, "x", 2, 3, 4, "y", 5, 6) for i, t in rows]
    spark.createDataFrame(full, columns).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, " ".join(made(random.Random(5), 12)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def run(spark, folder, name):
    got = registry.QUERIES[name](spark, folder).collect()
    return sorted(((r.doc_id, r) for r in got), key=lambda p: (p[0] is not None, p[0] or 0))


def by_id(texts):
    return sorted(texts[2], key=lambda p: (p[0] is not None, p[0] or 0))


def test_op1(spark, folder, texts):
    passage = texts[0].split(" ")
    for (i, t), (j, r) in zip(by_id(texts), run(spark, folder, "op1_substring_dedup"), strict=True):
        words = re.findall(SPACED, t or "")
        kept = " ".join(words).replace(" ".join(passage), "").split() if i in (1, 4) else words
        assert (i, len(words), len(words) - len(kept), sha(" ".join(kept))) == (j, r.n_words, r.n_removed, r.kept_sha256)


def test_op2(spark, folder, texts):
    spm, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    own = spm.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    for (i, t), (j, r) in zip(by_id(texts), run(spark, folder, "op2_token_counts"), strict=True):
        n = len(own.encode(t or ""))
        assert (i, len((t or "").encode()), n, n > 4096) == (j, r.n_bytes, r.n_tokens, r.over_limit)


def test_op3(spark, folder, texts):
    lib, tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    own = lib.Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    own.no_truncation()
    own.no_padding()
    start, want = 0, []
    for i, t in by_id(texts):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert [(j, r.start, r.n_tokens, r.ids_crc32) for j, r in run(spark, folder, "op3_token_files")] == want


def test_op4(spark, folder, texts):
    first, copy = texts[2][0][1].encode(), texts[2][3][1].encode()
    lead = copy.index(texts[0].encode())
    while first[first.rindex(texts[0].encode()) - 1 :].startswith(copy[lead - 1 :]):  # what stands before may agree too
        lead -= 1
    for (i, t), (j, r) in zip(by_id(texts), run(spark, folder, "op4_suffix_dedup"), strict=True):
        own = (t or "").encode()
        kept = own[:lead] if i == 4 else own
        assert (i, len(own), len(own) - len(kept), int(i == 4), sha(kept)) == (j, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)


def test_op6_base(spark, folder, texts):
    for (i, t), (j, r) in zip(by_id(texts), run(spark, folder, "op6_quality_rules"), strict=True):
        w = re.findall(SPACED, t or "")
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(three)
        repeats = len({p for k, x in enumerate(three) if n[x] > 1 for p in (k, k + 1, k + 2)})
        failed = len(w) < 50 or 100 * repeats > 50 * len(w)
        assert (i, len(w), sum(map(len, w)), repeats, failed) == (j, r.n_words, r.word_chars, r.n_repeat_words, r.base_failed)
        assert not (failed and r.kept)


def test_op7_base(spark, folder, texts):
    for (i, t), (j, r) in zip(by_id(texts), run(spark, folder, "op7_license_scan"), strict=True):
        w = re.findall(WORDS, (t or "").translate(LOWER))
        at = [k for k in range(len(w) - 2) if w[k : k + 3] == ["all", "rights", "reserved"]]
        assert (i, len(w), len(at), at[0] if at else None, at[-1] if at else None) == (j, r.n_words, r.n_base, r.first_word, r.last_word)
        assert r.base_labels == ("reserved" if at else "") and 0 <= r.score <= 1


def test_op8(spark, folder, texts):
    item = texts[1].split(" ")
    for (i, t), (j, r) in zip(by_id(texts), run(spark, folder, "op8_decontaminate"), strict=True):
        w = re.findall(WORDS, (t or "").translate(LOWER))
        windows = {tuple(item[k : k + 8]) for k in range(5)}
        hit = {p for k in range(len(w) - 7) if tuple(w[k : k + 8]) in windows for p in range(k, k + 8)}
        assert (i, len(w), len(hit), int(bool(hit)), sha("1" if hit else ""), False) == (j, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)


def test_op9(spark, folder, texts):
    import numpy as np
    import xxhash

    def fingerprint(t):
        w = re.findall(SPACED, (t or "").translate(LOWER))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        if not s:
            return 0
        h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in s], np.uint64)
        return sum(1 << k for k in range(64) if 2 * int((h >> np.uint64(k) & np.uint64(1)).sum()) > len(h))

    got = run(spark, folder, "op9_simhash")
    for (i, t), (j, r) in zip(by_id(texts), got, strict=True):
        assert (i, f"{fingerprint(t):016x}") == (j, r.fingerprint)
    low = {r.doc_id: r.component_id for _, r in got}
    assert low[2] == low[3] == low[7] == 2 and low[5] == 5 and low[1] == 1


def test_op10_base(spark, folder, texts):
    for (i, t), (j, r) in zip(by_id(texts), run(spark, folder, "op10_pii"), strict=True):
        assert i == j and (r.n_email, r.n_ip, r.n_card, r.n_phone) == ((1, 1, 1, 1) if i == 1 else (0, 0, 0, 0))
        at = lambda kind, s: f"{kind}:{t.rindex(s)}:{t.rindex(s) + len(s)}"  # noqa: B023, E731
        base = [at("email", "x@mail.example.org"), at("ip", "10.2.3.4"), at("card", "4111111111111111"), at("phone", "+1 555 010 9999")] if i == 1 else []
        assert r.base_sha256 == sha(",".join(base))


def test_op5(spark, folder, texts):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from tiktoken.load import load_tiktoken_bpe

    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for (i, t), (j, r) in zip(by_id(texts), run(spark, folder, "op5_byte_bpe"), strict=True):
        ids = own.encode_ordinary(t or "")
        assert (i, len(ids), sha(",".join(map(str, ids))), sha(t or "")) == (j, r.n_tokens, r.ids_sha256, r.decoded_sha256)
