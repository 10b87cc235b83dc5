"""Token ids of whole texts with a public tokenizer, from inside tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
# Words whose ids a Python worker remembers from text to text; beyond this it starts afresh.
CACHED_WORDS = 400_000
# Marks that may follow a word, and letters that are one code point in any normal form and case.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class WordEncoder:
    """Ids of texts for a tokenizer that drops white space and so never joins words over it.

    Equal words are encoded once.  A word of letters and then ASCII marks is its stem's ids and those
    of the run of marks, and its letters are looked up in lower case: the tokenizer lower-cases and
    splits punctuation from letters in any case.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        # Strings of special tokens in a text get their ids; they hold no white space.
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        # Ids that end a word, where the tokenizer marks these by a suffix.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab() if suffix else {}
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def stem(self, word: bytes) -> tuple[bytes, bytes]:
        """A word as one of lower-case letters and the marks at its end, or whole."""
        stem = word.rstrip(MARKS)
        if stem.isalpha():
            return stem.lower(), word[len(stem) :]
        if stem and not stem.isascii() and LETTERS.fullmatch(text := stem.decode("utf-8", "surrogatepass")):
            return text.lower().encode(), word[len(stem) :]
        return word, b""

    def learn(self, new: Sequence[bytes]) -> None:
        """Encode words that are not known yet."""
        known = self.known
        cut = [(w, *self.stem(w)) for w in new]
        stems = {s for _, s, _ in cut if s not in known}
        self.join([s for s in stems if s.isalpha() or LETTERS.fullmatch(s.decode("utf-8", "surrogatepass"))])
        texts = list({x for _, *both in cut for x in both if x and x not in known})
        for s, e in zip(texts, self.tokenizer.encode_batch_fast([x.decode("utf-8", "surrogatepass") for x in texts], add_special_tokens=False), strict=True):
            known[s] = np.array(e.ids, np.uint32).tobytes()
        for w, s, marks in cut:
            if w not in known:
                known[w] = known[s] + (known[marks] if marks else b"")

    def join(self, stems: Sequence[bytes]) -> None:
        """Encode words of ``LETTERS`` as one text, which takes half the time, and cut its ids after those that
        end a word.  Unless each word has one such id they are left to the caller."""
        if not stems:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(stems).decode("utf-8")], add_special_tokens=False)[0].ids, np.uint32)
        if len(ids) and ids.max() >= len(self.ends):
            return
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(stems) or cuts[-1] != len(ids):
            return
        cuts, raw, begin = (4 * cuts).tolist(), ids.tobytes(), 0
        for s, end in zip(stems, cuts, strict=True):
            self.known[s] = raw[begin:end]
            begin = end

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text; none for a null text."""
        # Bytes split at ASCII white space only; other spaces are left to the tokenizer.
        words = (text or "").encode("utf-8", "surrogatepass").split()
        # Between texts only: the words of one text stay until it is encoded.
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if new := [w for w in set(words) if w not in self.known]:
            self.learn(new)
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text, without special ones; 0 if it is null."""

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for batch in texts:
            yield pd.Series([len(enc.encode(t)) for t in batch], dtype="int64")

    return counted(text)
