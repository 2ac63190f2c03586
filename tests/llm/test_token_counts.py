from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topicweir.llm.token_counts import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(docs, limit):
    tokenizer = Tokenizer.from_file(PATH)
    out = Counter()
    for r in docs.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        out[(r.doc_id, len((r.text or "").encode()), n, n > limit)] += 1
    return out


@pytest.mark.parametrize("head", [0, 40, 100_000])
def test_counts_are_the_tokenizers_own(odd_docs, head):
    got = count_tokens(odd_docs, PATH, limit=20, head=head)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, got.collect())) == expected(odd_docs, 20)


def test_counts_of_the_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert Counter(map(tuple, count_tokens(docs, PATH, head=500).collect())) == expected(docs, 1024)


def test_empty_table(no_docs):
    assert count_tokens(no_docs, PATH).count() == 0


def test_every_code_point_beside_words_digits_and_blanks(spark):
    """Letters newer than the JVM's tables among them."""
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = []
    for i in range(0, len(points), 2000):
        chars = map(chr, points[i : i + 2000])
        texts.append("".join(f"{c}'s a{c} {c}1{c}t'll {c}{c}!" for c in chars))
    texts += ["\U0001e4d0's \U00031350't \U0002ebf0'm", "\u0870's"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert Counter(map(tuple, count_tokens(docs, PATH).collect())) == expected(docs, 1024)


def test_other_files_are_refused(spark, no_docs):
    with pytest.raises(ValueError):
        count_tokens(no_docs, public_tokenizers.path("word_bpe_49k.json"))
