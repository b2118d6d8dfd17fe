"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence

import numpy as np

from shotlake.llm.common import worker_cache

# fixed value: white space as the byte-level pre-tokeniser sees it
SPACE = r"\t-\r \x85\xa0  -     　"
# the pre-tokeniser never joins what these stretches part, so ids of a text are those of its stretches in a row: a word of
# Latin letters before space or punctuation, else all up to the next space, and runs of space
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
STRETCH = re.compile(rf" ?[{LETTER}]+(?=[{SPACE}.,;:!?\"'()|]|\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PLAIN = re.compile(rf" ?[{LETTER}]+")
MOST_CACHED = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def tokenizer_file(name: str) -> str:
    """The path of a vocabulary file; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteLevel:
    """A byte-level BPE tokenizer file; `encode` gives the ids of each text as little-endian bytes."""

    def __init__(self, file: str):
        # Spark runs a task on each core; the library's own threads would only contend with them
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(file))
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = byte_letters()

    def _ids(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.dtype.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of stretches. A plain word is one pre-token, so the library's BPE model can take it as it is."""
        code, tokenize, letters = "H" if self.dtype.itemsize == 2 else "I", self.tokenizer.model.tokenize, self.letters
        out, other = {}, []
        for w in words:
            if PLAIN.fullmatch(w):
                spelled = w.replace(" ", letters[32]) if w.isascii() else "".join([letters[b] for b in w.encode()])
                out[w] = array(code, [t.id for t in tokenize(spelled)]).tobytes()
            else:
                other.append(w)
        out.update(zip(other, self._ids(other)))
        return [out[w] for w in words]

    def _learn(self, words: list[str]) -> None:
        """Put `words` into the cache. A full cache becomes the older one, from which words in use come back."""
        if len(self.cache) > MOST_CACHED:
            self.cache, self.older = {}, self.cache
        cache, older, new = self.cache, self.older, []
        for w in words:
            if w not in cache:
                if w in older:
                    cache[w] = older[w]
                else:
                    cache[w] = b""
                    new.append(w)
        cache.update(zip(new, self._word_ids(new)))

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif any(s in text for s in self.special):  # these strings cut a text at other places
                out += self._ids([text])
            else:
                words = STRETCH.findall(text)
                try:
                    out.append(b"".join(map(self.cache.__getitem__, words)))
                except KeyError:
                    self._learn(words)
                    out.append(b"".join(map(self.cache.__getitem__, words)))
        return out


def byte_level(file: str) -> ByteLevel:
    """The tokenizer of this worker."""
    held = worker_cache("tokenizers")
    if file not in held:
        held[file] = ByteLevel(file)
    return held[file]


class Ranked(ByteLevel):
    """A file of ranks for tiktoken, with the same pre-tokeniser."""

    def __init__(self, file: str):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        with open(tokenizer_file(file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokenizer = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special, self.cache, self.older = [], {}, {}

    def _word_ids(self, words: list[str]) -> list[bytes]:
        return self._ids(words)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.tokenizer.encode_ordinary(t), self.dtype).tobytes() for t in texts]


def ranked(file: str) -> Ranked:
    held = worker_cache("tokenizers")
    if file not in held:
        held[file] = Ranked(file)
    return held[file]
