import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from kbspark.llm import bpe

ODD = [None, "", " ", "a", "  two  spaces \n\n\t end ", "don't I'LL we've", "é" * 3000, "ab" * 20_000, "1234567" * 900, "\U0001F600ß€\u0301 x\u00a0y", "<|endoftext|> </s>",
       "".join(random.Random(5).choice("abcdeé \n'sZ9!-") for _ in range(20_000))]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(spark, make_docs, clash):
    enc = reference()
    rows = list(enumerate(ODD)) + [(None, "null id"), (3, "again"), (3, "again")]
    got = bpe.encode_texts(make_docs(rows, **clash), keep=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), enc.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((str(r.id), list(r.ids)) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bytes(r.decoded)).hexdigest()
    assert sorted(bytes(r.decoded).decode() for r in got) == sorted(t or "" for _, t in rows)
    assert bpe.encode_texts(make_docs([])).collect() == []


def test_whole_documents(spark):
    from kbspark.llm.common import table

    enc = reference()
    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    got = bpe.encode_texts(table(spark, "/root/testdata/sf0.001", "documents"), keep=("ids_sha256",)).collect()
    assert {r.id: r.ids_sha256 for r in got} == {i: hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t or ""))).encode()).hexdigest() for i, t in docs.items()}


def test_merges_pick_the_least_rank_leftmost_also_when_new_pairs_rank_lower():
    # "abc" ranks below "bc": after bc merges, a+bc comes before any other bc
    words = {bytes([c]): 300 + c for c in range(256)} | {b"bc": 20, b"abc": 10, b"bca": 15, b"aa": 5}
    coder = bpe.Codec(words, r"\S+|\s+")

    def plain(piece):
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            pairs = [(words[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in words]
            if not pairs:
                return [words[p] for p in parts]
            _, i = min(pairs)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(1)
    for _ in range(3000):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(2, 14)))
        if piece not in words:
            assert coder.merge(piece) == plain(piece), piece


def test_recent_parts_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "RECENT", 10)
    coder = bpe.Codec({bytes([c]): c for c in range(256)}, r"\S+|\s+")
    for n in range(200):
        assert coder.encode(f"w{n}") == " ".join(str(b) for b in f"w{n}".encode())
        assert len(coder.recent) <= 10 and len(coder.recent.older) <= 10
