"""Words of the BPE encoder: longest matches first, and what is kept of them."""

import random
import struct

from torrentia.llm import bpe_codec


def test_longest_matches_give_the_ids_of_the_search():
    c, pick = bpe_codec.Codec(bpe_codec.default_vocabulary()), random.Random(5)
    parts = ["tion", "the", "ing", "er", "é", "ß", "th", "qu", "zzz", "a", "ouat", "&&&", "語", "x"]
    for _ in range(3000):
        text = "".join(c.bytes[b] for b in "".join(pick.choices(parts, k=pick.randint(1, 9))).encode()) + c.END
        ids = c._descent(text)
        assert ids is not None and struct.pack(f"<{len(ids)}I", *ids) == c._searched(text)


def test_words_met_again_are_not_encoded_again(monkeypatch):
    c, made = bpe_codec.Codec(bpe_codec.default_vocabulary()), []
    word = c.words.make
    monkeypatch.setattr(c.words, "make", lambda w: made.append(w) or word(w), raising=False)
    text = " ".join("".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(60_000))
    first = c.encode_bytes(text)
    assert len(made) == 60_000
    assert c.encode_bytes(text) == first and len(made) == 60_000
