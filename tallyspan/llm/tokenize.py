"""Token ids of texts from a public vocabulary file.

Words repeat far more than texts, so each worker keeps the ids of words it has seen and the tokenizer
only sees new ones. The file's own rules stay in force: a text with anything that the quick path
doesn't cover goes through the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Latin text up to here composes to itself and lower-cases character by character.
LAST = 0x17F
#: Words whose ids a worker remembers at most; then it starts anew.
REMEMBERED = 1 << 19


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def char_class(test) -> str:
    return "".join(f"\\u{c:04x}" for c in range(LAST + 1) if test(chr(c)))


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, as ``encode(text, add_special_tokens=False)`` gives them.

    For vocabularies with an end-of-word mark whose pre-tokenizer is contractions, runs of letters,
    single digits and runs of other signs (word_bpe_49k.json).
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        letter = char_class(lambda c: unicodedata.category(c)[0] == "L")
        number = char_class(lambda c: unicodedata.category(c)[0] == "N")
        space = r"\t\n\x0b\x0c\r\x20\x85\xa0"
        # fixed value: the vocabulary file's own pre-tokenizer pattern, its classes spelt out
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+").findall
        self.beyond = re.compile(rf"[^\x00-\u{LAST:04x}]").search
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                raw, a = ids.astype("<u4").tobytes(), 0
                for w, b in zip(part, cuts.tolist()):
                    self.known[w] = raw[4 * a : 4 * b]
                    a = b
            else:
                for w in part:
                    self.known[w] = self.whole(w)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if not text:
                out.append(b"")
            elif "<|" in text or self.beyond(text):
                out.append(self.whole(text))
            else:
                words = self.split(text.lower())
                try:
                    out.append(b"".join([self.known[w] for w in words]))
                except KeyError:
                    distinct = set(words)
                    self.learn([w for w in distinct if w not in self.known])
                    if any(w not in self.known for w in distinct):  # a fresh start lost some
                        self.learn(list(distinct))
                    out.append(b"".join([self.known[w] for w in words]))
        return out


_made: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process."""
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
