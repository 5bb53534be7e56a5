import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from neumes.llm.bpe import Words, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [None, "", " \t\n", "Hello  World's 123 café\n x<|endoftext|>Y <|startoftext|> <|ENDoftext|>", "İstanbul ΟΔΟΣ é́ ẞß ﬁ", "a b　c d\x1ce\x85f\x0bg\x00h",
        "I'll we've 'S ''s !'s don't’s", "²½Ⅷ٣ \U0001f600\U0001f468‍\U0001f469 你好", "x" * 5000, "word " * 300, "Å Å 가 नि"]


T = Tokenizer.from_file(PATH)
T.no_truncation()
T.no_padding()


def exact(text):
    ids = T.encode(text or "", add_special_tokens=False).ids
    return ids, T.decode(ids, skip_special_tokens=False)


def test_equals_the_library_on_hard_texts(spark):
    rng = random.Random(7)
    marks = list("aBéΣ \t\n'stred0.,!<|>̇ß  一\x1f") + ["<|endoftext|>", "\U0001f600"]
    texts = HARD + ["".join(rng.choices(marks, k=60)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    for hot in (0, 50, 300_000):  # none broadcast, some, all
        got = {r.doc_id: r for r in bpe_encode(docs, PATH, hot_words=hot).collect()}
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            ids, back = exact(text)
            assert bytes(got[i].ids) == b"".join(x.to_bytes(4, "little") for x in ids), (i, text)
            assert got[i].decoded == back and got[i].n_tokens == len(ids)


def test_empty_table_and_repeated_rows(spark):
    assert bpe_encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    twice = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two")], "doc_id long, text string")
    assert [r.n_tokens for r in bpe_encode(twice, PATH).collect()] == [2, 2, 2]


def test_a_word_stays_whole_when_split_again():
    words = Words(open(PATH, encoding="utf-8").read())
    assert words.split("Don't") == ["don", "'t"] and words.split("x<|endoftext|>") == ["x", "<|endoftext|>"]


def test_whole_table_against_the_library(spark):
    from neumes.llm.queries import op4_bpe

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op4_bpe(spark, sf).collect()}
    t = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(got)
    for r in docs:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_tokenizers_are_refused(spark):
    import pytest

    with pytest.raises(ValueError, match="normalizer, pre_tokenizer, decoder"):
        bpe_encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))
