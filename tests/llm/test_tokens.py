import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.llm.tokens import PieceCounter, count_tokens, counter
from tests.llm.helpers import ODD, documents

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" a▁\n<s>é", max_size=80))
def test_count_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode("utf-8")
    assert counter(PATH).count(text) == len(LIBRARY.encode(text))


def test_odd_rows(spark):
    got = count_tokens(documents(spark, ODD), PATH, limit=5).collect()
    want = []
    for doc_id, text in ODD:
        n = len(LIBRARY.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 5))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert count_tokens(documents(spark, []), PATH).count() == 0


def test_a_piece_with_an_inner_mark_is_refused():
    with pytest.raises(ValueError, match="inside"):
        PieceCounter({"a▁b": 1.0})
