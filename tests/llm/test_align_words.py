"""Words of the token alignment: merges on bytes, and windows that are kept by parts of words."""

import random

from torrentia.llm import token_alignment as A

PARTS = ["tion", "the", "ing", "é", "ß", "ñ", "th", "qu", "zzz", "a", "ǅ", "Ñuß", "ouat", "The", "ɏ", "ă"]


def test_latin_pieces_are_those_of_the_codec():
    c, pick = A.Aligner(*A.default_vocabularies()), random.Random(2)
    for _ in range(4000):
        word = "".join(pick.choices(PARTS, k=pick.randint(1, 8)))
        got = c.latin.encode(" " + word)
        assert got is None or got == c.b.encode_each(word), word
        got = c.latin.encode(word)
        assert got is None or got == c.b.encode_chunks(word), word


def test_a_word_before_other_signs_is_aligned_once(monkeypatch):
    c, made = A.Aligner(*A.default_vocabularies()), []
    window = c._window
    monkeypatch.setattr(c, "_window", lambda key: made.append(key) or window(key))
    got = [c.align("thndhain" + end) for end in ("", ".", ",", "...", "&&&", ".\n\nthndhain", "'s", "&&&.")]
    assert len(set(made)) == len(made) <= 12 and None not in got


def test_parts_give_the_alignment_of_whole_words(monkeypatch):
    c, pick = A.Aligner(*A.default_vocabularies()), random.Random(3)
    texts = [" ".join("".join(pick.choices([*PARTS, ".", ",", "'s", "&&&", "\n", "  ", "7", "日", "_"], k=pick.randint(1, 9))) for _ in range(30)) for _ in range(200)]
    got = [c.align(t) for t in texts]
    monkeypatch.setattr(A, "MEMO_CHARS", 0)
    for t, g in zip(texts, got, strict=True):
        c.words.clear()
        whole = A.ByteLevel.cut(c.a, t, " "), c.b.encode_each(t)
        assert g[:2] == (len(whole[0]) // 4, len(whole[1]) // 4) and (g[2], g[3]) == c._window(whole)[:2]
