import hashlib
import struct

import pytest

from proofline.llm import word_bpe as W

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def model():
    return W.load_model(public.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def both(model):
    return W.Codec(model), tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))


def same(both, text):
    own, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids, repr(text)
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(text)


EDGES = [
    "", " ", "\n\t", "Hello World's it'S 42 ...", "<|endoftext|>", "a<|startoftext|>B<|endoftext|><|endoftext|>c", "<|EndOfText|>", "<|endoftext|",
    "a" * 3000, "ab" * 900, "!" * 700, "漢字" * 99, "éé", "́x", "ΟΔΟΣ ΟΔΟΣ.", "İstanbul DŽ ẞ", "x\x1cy\x1d z", "\x00", "a\xa0b c　d\x85e",
    "'ll 'VE don't I'M", "１２ ٣٤ ½ Ⅷ", "\U0001f600\U0001f468‍\U0001f469", "ᲉꟋ\U00010d50՘", "ꙮ ᚠᛇ กขค",
]


@pytest.mark.parametrize("text", EDGES)
def test_edges(both, text):
    same(both, text)


def test_every_letter(both):
    for begin in range(0, 0x110000, 16):
        if 0xD800 <= begin < 0xE000 or 0x20000 <= begin < 0xE0000 or begin >= 0xE0200:
            continue
        same(both, " ".join(f"a{chr(c)}b{chr(c)}" for c in range(begin, begin + 16)))


def test_random_texts(both, rng):
    letters = "abcdefgh tTsS'mM\n\t<|>éÉüÄ漢̧́Σς0123.,!-_\x1c\x85\xa0"
    for _ in range(4000):
        same(both, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))))


def test_scan_and_heap_agree(both, rng):
    own, _ = both
    for _ in range(300):
        raw = bytes(rng.choice(b"abetinsxz'.") for _ in range(rng.randint(1, 90)))
        ids = [own.inner[b] for b in raw[:-1]] + [own.last[raw[-1]]]
        assert own.scanned(list(ids)) == own.queued(list(ids))


def test_memory_of_words_is_bounded(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(W, "REMEMBERED", 5)
    text = " ".join(f"word{i} again" for i in range(50))
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    fresh = W.Known(own.encode_stretch)
    for i in range(50):
        fresh[f"word{i}"]
    assert len(fresh) <= 6 and len(fresh.older) <= 5


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        W.Codec(open(public.path("word_bpe_49k.json"), "rb").read().replace(b'"NFC"', b'"NFD"'))


def test_digests(documents, both, model):
    _, library = both
    long = "Many words, " * 30000
    rows = [(1, "Hello  World\n"), (1, "Hello  World\n"), (2, None), (None, ""), (3, long)]
    got = W.digests(documents(*rows), model).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "Hello  World\n", 3: long}.get(r.doc_id, "")
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_columns_stay(documents, model):
    df = documents((1, "Ab cd")).withColumnRenamed("key", "ids")
    got = W.encode(df, model)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "hash", "ids"]
    row = W.decode(got, model, text="text").first()
    assert row.text == "ab</w> cd</w>" and row.hash == 7
    assert W.encode_decode(df, model).columns == ["doc_id", "lang", "source", "n_chars", "hash", "ids", "decoded"]
    assert W.encode(df.limit(0), model).count() == 0 and W.digests(df.limit(0), model).count() == 0
