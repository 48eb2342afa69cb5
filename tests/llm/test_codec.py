import hashlib
import random
import time
from functools import lru_cache

import pytest
import sentencepiece
from cytofold.llm.piece_codec import PieceCodec, encode_documents
from cytofold.llm.queries import tokenizer
from hypothesis import given, settings, strategies as st



@lru_cache
def pair():
    return PieceCodec(tokenizer()), sentencepiece.SentencePieceProcessor(model_file=tokenizer())


@pytest.fixture
def both():
    return pair()


PARTS = ["  ", "   ", " ", "\n", "\t", "\r", "a", "the", "▁", "é", "ß", "日本", "🙂", "́", "1", "23", "\x00", "ing", "tion", "ll", "//", "---", "�", "한", "<0x0A>", "<s>", ".", ",", "(", "“", "€"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=40).map("".join)))
def test_like_the_library(text):
    codec, sp = pair()
    text = text.encode("utf-8", "replace").decode()
    ids = sp.encode(text)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == sp.decode(ids)
    n, a, b, found = codec.digest(text)
    assert (n, a, b, found) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), ids)


def test_any_ids_decode_alike(both):
    codec, sp = both
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(0, 258)]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == sp.decode(ids)


def test_long_runs(both):
    codec, sp = both
    for text in (" " * 1000 + "x" + " " * 37, "a" * 3000, "=" * 777, "ab" * 2000, "\n" * 50):
        assert codec.encode(text) == sp.encode(text)


def test_a_very_long_unit(both):
    """Time grows with the text, not with its square."""
    text = "abcdefgh" * 200_000
    began = time.time()
    ids = both[0].encode(text)
    assert time.time() - began < 20
    assert ids == both[1].encode(text)
    assert both[0].decode(ids) == text


def test_a_full_memory_changes_nothing(both):
    small = PieceCodec(tokenizer(), kept=5)
    for text in ("the cat sat on the mat. " * 20, "ünïcode wörds äre hërë " * 9):
        assert small.encode(text) == both[1].encode(text)
        assert small.digest(text) == both[0].digest(text)


def test_tokens_of_a_segmentation_are_compatible(both):
    codec = both[0]
    assert codec.split("▁international") == codec.merged("▁international")


def test_marks_and_letters_are_units_of_their_own(both):
    """No piece holds a letter beside a mark, so a word with marks is found as the word: fewer units are split."""
    codec, sp = both
    assert codec.units("end. end!!! (end) 2². x²..") == ["▁end", ".", "▁end", "!!!", "▁(", "end", ")", "▁2².", "▁x².."]
    for text in ("x²..", "².", "²", "a².b²..c", ".²", "..²..", "▁².", "(²)", "²\n²."):
        assert codec.encode(text) == sp.encode(text)


def test_neighbours_are_those_that_merging_leaves_apart(both):
    """Undoing the merges at the border says the same as merging both tokens' text anew."""
    codec, _ = both
    rng = random.Random(8)
    tokens = [codec.ids[s] for s in codec.finder]
    starts = {}
    for i in tokens:
        starts.setdefault(codec.text[i][0], []).append(i)
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(10_000)]
    pairs += [(i, rng.choice(starts.get(codec.text[i][-1], tokens))) for i in rng.sample(tokens, 10_000)]
    pairs += [(i, rng.choice(tokens)) for i in codec.odd] + [(rng.choice(tokens), i) for i in codec.odd] + [(i, i) for i in rng.sample(tokens, 2000)]
    for left, right in pairs:
        a, b = codec.text[left], codec.text[right]
        assert codec._stay(left, right) == (codec.merged(a + b) == [a, b]), (a, b)


def test_invented_words(both):
    """Words that need steps back, each met once."""
    codec, sp = both
    rng = random.Random(12)
    syllables = ["er", "on", "tion", "sch", "th", "qu", "ß", "é", "ción", "ing", "en", "aux", "w", "h", "ll"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", ",", "%%%", "!"]) for _ in range(5000)]
    assert codec.encode(" ".join(words)) == sp.encode(" ".join(words))


def test_rows(spark, both):
    rows = spark.createDataFrame([(1, "hello world", 5), (2, None, 6), (3, "", 7), (1, "hello world", 5)], "doc_id bigint, text string, n_tokens int")
    got = sorted((r.doc_id, r.n_tokens, r.ids) for r in encode_documents(rows, tokenizer(), keep_ids=True).collect())
    ids = both[1].encode("hello world")
    assert got == [(1, len(ids), ids), (1, len(ids), ids), (2, 0, []), (3, 0, [])]
    assert encode_documents(rows.limit(0), tokenizer()).count() == 0
