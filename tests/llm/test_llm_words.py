"""Words, marks and special strings of the tokenizers: the ids are those of a plain call over the whole text."""

import random
import struct

import pyarrow as pa
import pytest

from tickflow.llm import op3_bpe as o3
from tickflow.llm import op4_records as o4

#: Letters whose normal form ends in a combining mark, and others around them.
LETTERS = "İIıiक़य़ড়ঢ়য়ਲ਼ਸ਼ଡ଼ଢ଼གྷཀྵיִKΣςß가é́ñ日ก한ﬁ"
WORDS = [*LETTERS, "İKİ", "ŞEHRİ", "BİRİNCİ", "क़िला", "a", "Oldu", "THE", "12", "'s", "İ'", "İ̇", "😀"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(o4.TOKENIZER)
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def ids(packed):
    return [list(struct.unpack(f"<{len(p) // 4}I", p)) for p in packed]


def test_probes(plain):
    texts = ["İKİ, üç", "ŞEHRİ. Sonra", "BİRİNCİ! oldu", "क़। ढ़, य़!", "ড়, ঢ়! য়."]
    assert ids(o4.Encoder().encode(texts)) == plain(texts)


def test_latin_texts(plain):
    """Texts of one character class after another, which take the way of pieces."""
    chars = [chr(c) for c in range(0x180) if c != 0x130]
    rng = random.Random(6)
    texts = ["".join(rng.choices([*chars, *"abc'st  \n.,!"], k=60)) for _ in range(20_000)]
    texts += [f"{c}{d}a{c}1{d}.{c} {d}'s{c}" for c in chars for d in "aZ1.' \xa0"]
    encoder = o4.Encoder()
    for at in range(0, len(texts), 2000):
        assert ids(encoder.encode(texts[at : at + 2000])) == plain(texts[at : at + 2000])


def test_special_strings_are_as_the_plain_call_has_them(plain):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>", "<|endoftext", "a <| b |> c", "<|EndOfText|> İ!"]
    got = ids(o4.Encoder().encode(texts))
    assert got == plain(texts) and 49407 in got[0]


def test_random_strings(plain):
    rng = random.Random(3)
    texts = []
    for _ in range(30_000):
        word = lambda: "".join(rng.choices(WORDS, k=rng.randint(1, 3))) + rng.choice(["", "", rng.choice(o4.MARKS) * rng.randint(1, 3)])
        texts.append(rng.choice([" ", "\n", "  ", "\t", " "]).join(word() for _ in range(rng.randint(1, 5))))
    encoder = o4.Encoder()
    for at in range(0, len(texts), 1000):
        batch = texts[at : at + 1000]
        assert ids(encoder.encode(batch)) == plain(batch)


def test_every_character_before_marks(plain):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"{c}, a{c}! {c}{c}.b {c}" for c in chars[i : i + 200]) for i in range(0, len(chars), 200)]
    encoder = o4.Encoder()
    for at in range(0, len(texts), 300):
        batch = texts[at : at + 300]
        assert ids(encoder.encode(batch)) == plain(batch)


@pytest.mark.parametrize("module", [o3, o4])
def test_generations(module, monkeypatch, plain):
    """Words that leave the memory and come back have the ids they had."""
    monkeypatch.setattr(module, "MEMORY", 40)
    encoder, fresh = module.Encoder(), module.Encoder()
    rng = random.Random(4)
    texts = [" ".join(f"W{'ord' * rng.randint(0, 60)}{rng.choice(['', '!', ', x'])}" for _ in range(30)) for _ in range(60)]
    got = [encoder.encode([t])[0] for t in texts]
    assert got == [module.Encoder().encode([t])[0] for t in texts] and not any(fresh.old)
    assert any(encoder.old) and len(encoder.held) < 40 + 31


def test_generations_are_bounded_by_characters(monkeypatch, plain):
    """Words of a script without blanks are lines: few entries, many characters."""
    monkeypatch.setattr(o4, "MEMORY_CHARACTERS", 4000)
    encoder, rng = o4.Encoder(), random.Random(7)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(500)) for _ in range(40)]
    for text in [*texts, *texts]:
        assert ids(encoder.encode([text])) == plain([text])
        kept = [encoder.held, encoder.parts, *encoder.old]
        assert sum(len(word) for words in kept for word in words) <= 2 * (4000 + 2 * 500)


def test_concatenated_pieces():
    pieces = {i: p for p, i in o3.load_ranks(o3.RANKS).items()}
    rng = random.Random(5)
    rows = [[rng.randrange(50_000) for _ in range(rng.randint(0, 40))] for _ in range(50)] + [None, [], [7]]
    whole = pa.array(rows, pa.list_(pa.int32()))
    want = [b"".join(pieces[i] for i in r or []) for r in rows]
    assert o3.concatenated(whole).to_pylist() == want
    assert o3.concatenated(whole.slice(5, 20)).to_pylist() == want[5:25]
    assert o3.concatenated(whole.slice(50, 2)).to_pylist() == [b"", b""]
    with pytest.raises((ValueError, pa.ArrowException)):
        o3.concatenated(pa.array([[60_000]], pa.list_(pa.int32())))
