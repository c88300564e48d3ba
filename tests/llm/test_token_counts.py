import random

import public_tokenizers
import sentencepiece

from kbspark.llm import token_counts

ODD = [(1, None), (2, ""), (3, " "), (4, "  a  b \n\t c "), (5, "<s> x </s> <unk> <0x0A> ▁▁ a"), (6, "one two " * 20_000), (7, "x" * 90_000),
       (8, "漢字仮名" * 20_000), (9, "é ﬁ\x00\r\n😀 İ" * 9000), (10, "\n" * 40_000), (11, " " * 40_000), (12, "12345 " * 9000 + " "),
       (13, "same"), (13, "same"), (None, "no id")]


def library(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.VOCABULARY))
    return [len(model.encode(t or "")) for t in texts]


def test_odd_texts(make_docs, clash):
    got = token_counts.count_tokens(make_docs(ODD, **clash)).collect()
    want = [(i, len((t or "").encode()), n, n > 4096) for (i, t), n in zip(ODD, library([t for _, t in ODD]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(make_docs([])).collect() == []


def test_segments_count_as_the_whole():
    rng, count = random.Random(4), token_counts.counter()
    parts = ["the", " ", "  ", "▁", "\n", "<", "0x0A", ">", "tion", "é", "漢", "字", "12", ".", "…", "\x00", "😀", "Ab", "\t"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 120))) for _ in range(400)]
    for size in (1, 3, 17):
        assert count.counts(iter(texts), size=size, batch_bytes=50) == library(texts)
    for text in texts:
        assert "".join(count.segments(text, 5)) == text


def test_whole_documents(spark):
    from kbspark.llm.common import table

    rows = table(spark, "/root/testdata/sf0.001", "documents").collect()
    got = {r.id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(rows)).collect()}
    assert got == {r.doc_id: n for r, n in zip(rows, library([r.text for r in rows]))}
