"""Separators that Python splits at and the vocabulary doesn't."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lintfleet.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("mark", [chr(c) for c in [*range(1, 33), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]])
def test_chunks_give_the_ids_of_the_whole_text(mark):
    whole, ids = Tokenizer.from_file(VOCABULARY), packing.TextIds(VOCABULARY)
    texts = [f"ab{mark}cd", f"ab {mark} cd", f"{mark}It's{mark}{mark}12 ü{mark}x\x1cy{mark}", mark]
    flat, at = ids.of(texts, 0)
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert flat[a:b].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0], text


@pytest.mark.parametrize("cached", [packing.CACHED, 50])
def test_any_characters_and_small_caches(cached):
    """Letters that change with case or composition, special tokens, and texts far longer than a batch, whatever the cache forgets."""
    rng = random.Random(cached)
    pool = [chr(c) for c in [*range(1, 0x3000), *range(0x1F600, 0x1F640), *range(0xAC00, 0xAC80)]]
    some = ["a", "b", "'", "1", "\u0301", "\u0130", "ﬁ", "<", "|", ">", "\x1c", "\x85", "\u200b", "²", "ſ", " ", "ß", "Σ"]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["a <|endoftext|> b<|startoftext|> <|endoftext|><|endoftext|>", "", "x" * 5000, "Word " * 3000, "'s's 'sam we'll'd ''s !'s 1'T don'RE'v'", "'", "'s", "a'r", "\x00\x01'll\x7f"]
    texts += ["".join(rng.choice("'strevmld !1 ") for _ in range(30)) for _ in range(400)]
    whole, ids = Tokenizer.from_file(VOCABULARY), packing.TextIds(VOCABULARY, cached)
    for _ in range(2):
        for first in range(0, len(texts), 100):
            flat, at = ids.of(texts[first : first + 100], 0)
            got = [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
            assert got == [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in texts[first : first + 100]]


def test_batches_are_cut_by_characters():
    batch = packing.pa.record_batch({"doc_id": list(range(7))})
    cut = list(packing.bounded([(batch, ["ab", "", "abcdefgh", "a", "a", "abc", ""]), (batch.slice(0, 0), [])], 4))
    assert [(b.column(0).to_pylist(), t) for b, t in cut] == [([0, 1], ["ab", ""]), ([2], ["abcdefgh"]), ([3, 4], ["a", "a"]), ([5, 6], ["abc", ""])]
