"""Token files: what a worker does with a word that it knows, and words at the borders of the byte classes."""

import itertools
import random
import sys

import public_tokenizers
from tokenizers import Tokenizer

from textguard.llm import tokenfiles

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_known_words_cost_no_python_call_each():
    coder, draw, calls = tokenfiles.Words(WORDS), random.Random(6), []
    texts = [" ".join(f"{draw.choice('abcdefgh')}'s{draw.randrange(1000)}," for _ in range(300)) for _ in range(20)]
    known = coder.encode(texts)
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event.endswith("call") else None)
    try:
        again = coder.encode(texts)
    finally:
        sys.setprofile(None)
    assert [x.tolist() for x in again] == [x.tolist() for x in known]
    assert len(calls) < 0.1 * len({u for t in texts for u in t.split()})


def test_a_full_table_keeps_the_words_at_hand(monkeypatch):
    monkeypatch.setattr(tokenfiles, "KEPT", 50)
    learned = []
    monkeypatch.setattr(tokenfiles.Words, "_learn", lambda self, words, f=tokenfiles.Words._learn: (learned.extend(words), f(self, words))[1])
    coder, word = tokenfiles.Words(WORDS), lambda i: "x" + chr(97 + i // 26) + chr(97 + i % 26)
    first, second = " ".join(map(word, range(60))), " ".join(map(word, range(50, 70)))
    coder.encode([first])
    coder.encode([second])
    assert sorted(learned) == sorted(map(word, range(70))) and len(coder.word) == 20


def test_words_at_borders_equal_the_library():
    library, coder = Tokenizer.from_file(WORDS), tokenfiles.Words(WORDS)
    ends = ["'", "s", "re", "r", "ve", "ll", "l", "'d", ".", "é", "×", "ł", "7", " ", "\n", "\xa0", "²", "ÿ"]
    texts = ["".join(x) for n in range(1, 4) for x in itertools.product(ends, repeat=n)]
    texts += ["".join(chr(a) + "a" + chr(a) + "'" for a in range(lo, lo + 16)) for lo in range(0, 0x180, 16)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in coder.encode(texts)] == want
    # Each text by itself too: nothing follows from its neighbours.
    assert [coder.encode([t])[0].tolist() for t in texts[:400]] == want[:400]
    for some in ([], [None], [""], ["\n", None, " "], ["<|endoftext|>"]):
        assert [x.tolist() for x in coder.encode(some)] == [library.encode(t or "", add_special_tokens=False).ids for t in some]
