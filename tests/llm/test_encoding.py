import random

import pytest

from spanloom.llm import encoding


@pytest.fixture(scope="module")
def encoder():
    with open(encoding.VOCABULARY, "rb") as f:
        return encoding.build_encoder(f.read())


def tree(encoder, parts):
    while len(parts) > 1:
        parts = [encoding.join_parts(encoder, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def test_joins_agree_with_direct_encoding(encoder):
    rng = random.Random(7)
    alphabet = ["a", "e", "the", "'", "'s", "'ll", " ", "  ", "\n", "1", "23", "א", "בּ", "é", "😀", ".", "-", "ing", "xxxxxxxxx"]
    for _ in range(1500):
        letters = rng.sample(alphabet, rng.choice([2, 3, len(alphabet)]))
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 80)))
        width = rng.randint(1, 30)
        got = tree(encoder, [encoding.encode_part(encoder, text[i : i + width]) for i in range(0, len(text), width)])
        assert got.ids == encoder.encode_ordinary(text) and got.text == text


@pytest.mark.parametrize("text", ["a" * 20000, "אבגדה" * 3000, " " * 9000 + "x", "ab1" * 4000, "antidisestablishment" * 500])
def test_long_unsplit_text(encoder, text):
    got = tree(encoder, [encoding.encode_part(encoder, text[i : i + 2048]) for i in range(0, len(text), 2048)])
    assert got.ids == encoder.encode_ordinary(text)


def test_table(spark, encoder):
    texts = [None, "", " ", "Hello <|endoftext|> there", "x" * 5000, "שלום עולם. " * 900, "same", "same"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(7, "same", "n")], "doc_id bigint, text string, row_key string")
    for packed in (False, True):
        out = encoding.encode(df, "text", ["doc_id", "row_key"] if not packed else ["doc_id"], packed=packed).collect()
        assert len(out) == len(texts) + 1
        for r in out:
            want = encoder.encode_ordinary(texts[r["doc_id"]] or "")
            ids = r["ids"] if not packed else [int.from_bytes(r["ids"][i : i + 3], "little") for i in range(0, len(r["ids"]), 3)]
            assert ids == want


def test_empty_table(spark):
    assert encoding.encode(spark.createDataFrame([], "doc_id bigint, text string"), "text", ["doc_id"]).count() == 0
