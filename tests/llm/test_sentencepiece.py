import hashlib

import pytest

from proofline.llm import sentencepiece_bpe as S

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    path = tokenizers.path("piece_bpe_32k.model")
    return S.Codec(S.load_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)


EDGES = ["", " ", "\n", "<s>", "<0x0A>", "a" * 3000, "abcd" * 900, "漢" * 99, "▁", "a▁b", "\x00", "é́😀ſ", "   x   ", "\t tab\r\n"]


@pytest.mark.parametrize("text", EDGES + [" " * n for n in range(2, 40)] + ["x" + " " * n + "ß " for n in range(20)])
def test_edges(both, text):
    own, library = both
    ids = own.encode(text)
    assert ids == library.encode(text) and own.decode(ids) == library.decode(ids)


def test_random_texts(both, rng):
    own, library = both
    letters = "ab ▁▁  the\n\t<>éü漢字😀\x00Zß0123.,"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        ids = own.encode(text)
        assert ids == library.encode(text), text
        assert own.decode(ids) == library.decode(ids), text


def test_memory_of_words_is_bounded(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(S, "REMEMBERED", 5)
    text = " ".join(f"word{i} again" for i in range(50))
    assert own.encode(text) == library.encode(text) and len(own.known) <= 6


def test_digests(documents, both):
    _, library = both
    rows = [(1, "Hello  world\n"), (1, "Hello  world\n"), (2, None), (None, "")]
    got = S.digests(documents(*rows), S.load_model(tokenizers.path("piece_bpe_32k.model"))).collect()
    for r in got:
        ids = library.encode("Hello  world\n" if r.doc_id == 1 else "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert len(got) == 4


def test_other_columns_stay(documents):
    model = S.load_model(tokenizers.path("piece_bpe_32k.model"))
    df = documents((1, "ab")).withColumnRenamed("key", "ids")
    assert S.encode(df, model).columns == ["doc_id", "text", "lang", "source", "n_chars", "hash", "ids"]
    assert S.encode(df.limit(0), model).count() == 0
    both = S.encode_decode(df, model)
    assert both.columns == ["doc_id", "lang", "source", "n_chars", "hash", "ids", "decoded"] and both.first().decoded == "ab"
    row = S.decode(S.encode(df, model), model, text="text").first()
    assert row.text == "ab" and row.hash == 7


def test_pairs_are_judged_from_what_is_known_of_each_piece(both, rng, monkeypatch):
    """The pair test says what the merging rule says, without merging the two pieces anew."""
    own = S.Codec(S.load_model(tokenizers.path("piece_bpe_32k.model")))
    pieces = list(own.piece)
    pairs = [(rng.choice(pieces), rng.choice(pieces)) for _ in range(2000)]
    for whole in rng.sample(pieces, 2000):
        text = own.piece[whole]
        pairs += [(own.id[text[:k]], own.id[text[k:]]) for k in range(1, len(text)) if text[:k] in own.id and text[k:] in own.id]
    expected = []
    for a, b in pairs:
        parts = [own.piece[a], own.piece[b]]
        expected.append((own.merged("".join(parts)) == parts, own.merged(parts[1]) == parts[1:]))
    monkeypatch.setattr(own, "merged", None)
    assert [(own.allowed(a, b), own.allowed(-1, b)) for a, b in pairs] == expected
    assert {e[0] for e in expected} == {True, False}
