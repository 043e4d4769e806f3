import random

import pytest

pytest.importorskip("tokenizers")
from tokenizers import Tokenizer, models  # noqa: E402

from quillon.llm import unigram  # noqa: E402


def library_count(pieces, text):
    """Pieces by the library, an unknown run counted by its UTF-8 bytes."""
    lib = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    n = 0
    for i, (a, b) in zip((e := lib.encode(text)).ids, e.offsets):
        n += len(text[a:b].encode()) if i == 0 else 1
    return n


def test_random_vocabularies_with_ties():
    rng = random.Random(5)
    for trial in range(60):
        letters = "abc▁é\n"
        pieces = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): float(rng.choice([-1, -2, -2, -3, -4.5 if trial % 2 else -4])) for _ in range(25)}
        own = unigram.UnigramCounter(pieces.items())
        for _ in range(20):
            text = "".join(rng.choice("abc é\nxß") for _ in range(rng.randint(1, 30)))
            assert own.count(text) == library_count(list(pieces.items()), "▁" + text.replace(" ", "▁")), (pieces, text)


def test_public_vocabulary():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=unigram.default_path())
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(3, sp.get_piece_size()) if not sp.is_byte(i)]
    own = unigram.counter(unigram.default_path())
    assert own.runs is not None
    for text in ["Hello world", "  many   spaces here ", "naïve 漢字 🙂\n\nnew line", "x" * 300, "Ünïcödé straße " * 40]:
        assert own.count(text) == library_count(pieces, "▁" + text.replace(" ", "▁"))


def test_runs_without_byte_fallback():
    own = unigram.UnigramCounter([("a", -1.0), ("▁", -1.0)], byte_fallback=False)
    assert own.count("zza") == 3  # the space, one unknown run, a


def test_frame(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a b")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in unigram.token_counts(docs).collect()) == [0, 0, 2]
    assert unigram.token_counts(docs.limit(0)).count() == 0
