import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from kbspark.llm import packing

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Word, WORD! wörd 'll don't <|endoftext|> ÀÉ ǅ İx ΣΑΣ %%% a|b || 12,3"), (5, "one " * 5000), (6, "x" * 30_000),
       (7, "a b c"), (7, "a b c"), (None, "no id"), (10, "end <|endoftext|> x"), (11, "a<|startoftext|>b\n<|ENDOFTEXT|> <|endoftext|>  "), (8, "e\u0301 \u00a0nbsp\x85next\x1cfs"), (9, "Straße, STRASSE. ﬁ Å Å")]


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array([*e.ids, 0], dtype="<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, docs):
    want = defaultdict(int)
    for (i, _), raw in zip(docs, ids_of([t for _, t in docs])):
        for k in range(0, len(raw), 8192):
            want[i, k // 8192, k // 4, len(raw[k:k + 8192]) // 4, zlib.crc32(raw[k:k + 8192])] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in rows:
        got[r.id, r.piece, r.start, r.length, r.crc] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places)


def test_pieces_places_and_odd_texts(make_docs, clash):
    check(packing.pack_documents(make_docs(ODD, **clash)).collect(), ODD)
    assert packing.pack_documents(make_docs([])).collect() == []


def test_names_of_added_tokens_are_those_tokens(make_docs):
    ids = packing.word_ids(None).ids("end <|endoftext|> x")
    assert np.frombuffer(ids, dtype="<u4").tolist() == [806, 49407, 343]


def test_recent_parts_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "RECENT_BYTES", 20_000)
    coder = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"w{i}x{j}" * (1 + j % 3) for j in range(60)) for i in range(30)] + ["long" * 30_000, "w1x1 w2x2"]
    for text, raw in zip(texts, ids_of(texts)):
        assert coder.ids(text) == raw[:-4]
        assert sum(packing.ENTRY_BYTES + len(k) + len(v) for k, v in coder.items()) <= max(10_000, packing.ENTRY_BYTES + 4 * 120_000 * 4)


def test_whole_documents_take_few_sequences(spark):
    from kbspark.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = packing.pack_documents(docs).collect()
    n = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_best_fit_and_closing():
    bins = packing.BestFit(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.BestFit(10, 2, 0)
    for n in (6, 7):
        bins.place(n)
    assert bins.place(8) == (2, 0)  # opens a third bin: the fullest (7 of 10) closes
    assert bins.open == 2 and bins.place(3) == (0, 6)
    assert packing.BestFit(10, 1, 5).place(10) == (5, 0)


def test_open_bins_never_exceed_the_bound():
    bins, rng = packing.BestFit(100, 7, 0), random.Random(3)
    used = defaultdict(int)
    for _ in range(5000):
        n = rng.randrange(1, 101)
        bin_id, offset = bins.place(n)
        assert offset == used[bin_id]
        used[bin_id] += n
        assert bins.open <= 7 and used[bin_id] <= 100
