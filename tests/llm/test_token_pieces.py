"""Ids put together from pieces equal the library's ids of whole texts, whatever stands in the texts."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from lureline.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
OF, OF_PLAIN = tokens.Encoder(PATH), tokens.Encoder(PATH, plain_specials=True)
SIGNS = ["a", "B", "é", "ß", "×", "÷", "ÿ", "Ā", "ł", "1", "²", ".", ",", "'", "'s", "'re", "_", "|", "<|endoftext|>", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "\u0085", " ", "　", "​", "́", "日", "ह", "\U0001f600", "\x00", "\x1c", "\x7f"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SIGNS) | st.text(max_size=4), max_size=14).map("".join), max_size=5))
def test_any_texts(texts):
    want = [e.ids for e in PLAIN.encode_batch(texts, add_special_tokens=False)]
    ids, ends = OF.flat(texts)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == want
    assert [np.frombuffer(r, "<u4").tolist() for r in OF.encode(texts)] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=10).map("".join), min_size=1, max_size=3))
def test_strings_of_special_tokens_may_be_plain_text(texts):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    assert [np.frombuffer(r, "<u4").tolist() for r in OF_PLAIN.encode(texts)] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_pieces_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 300)
    of = tokens.Encoder(PATH)
    for k in range(30):
        of.encode([" ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}{'x' * (i % 7)}" for i in range(200)) + " " + "y" * 100])
    assert len(of.young) <= 300 + 210 and len(of.old) <= 300 + 210
    assert max(map(len, of.young)) <= tokens.LONGEST


def test_words_go_to_the_library_as_signs_of_their_bytes():
    assert sorted(tokens._SIGNS.values()) == sorted(ByteLevel.alphabet())
    assert ByteLevel(add_prefix_space=False).pre_tokenize_str(" é")[0][0] == " é".encode().decode("latin-1").translate(tokens._SIGNS)
    # No second pass over bytes in the library, which took about a quarter of the time of such words.
    assert "ByteLevel" not in str(OF.single.pre_tokenizer)
    words = [" élan", " Straße", " ÿ", " plainword", " Àé"]
    assert [np.frombuffer(OF._pieces(words)[w], "<u4").tolist() for w in words] == [PLAIN.encode(w, add_special_tokens=False).ids for w in words]
