"""Token ids of whole texts by a public byte-level BPE, with a bounded cache of words."""

from __future__ import annotations

import json
import re

import numpy as np

#: Words kept at once in a worker, some 200 bytes each; past it the cache starts anew.
CACHE_WORDS = 250_000
#: Longer words aren't kept.
CACHE_CHARS = 48

_OTHER_SPACE = re.compile(r"[^\S\n]")
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranked(path: str):
    """The vocabulary of a tokenizer file as ranks, which encode a single word several times as fast; the ids are the same.

    None where the ids don't follow the order of the merges, so that they aren't ranks, or the words aren't split alike.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte-level alphabet writes as themselves
    byte = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(sorted({*range(256)} - {*own}))}
    split, vocab = model["pre_tokenizer"], model["model"]["vocab"]
    merged = ["".join(x.split(" ") if isinstance(x, str) else x) for x in model["model"]["merges"]]
    if split.get("type") != "ByteLevel" or not split.get("use_regex") or [vocab[x] for x in merged] != [*range(256, 256 + len(merged))]:
        return None
    ranks = {bytes(byte[c] for c in x): i for x, i in vocab.items() if i < 256 + len(merged)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Unsplittable(Exception):
    pass


class Encoder(dict):
    """Maps a word to the ids of a blank and the word, as little-endian unsigned 32-bit bytes.

    A byte-level BPE never merges across a blank that follows ink, so a text is the concatenation of what lies
    between its blanks if each part begins with ink and has no white space but line ends. All other texts are encoded in
    one piece.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.ranks = ranked(path)
        special = [] if plain else [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or _OTHER_SPACE.search(word):
            raise Unsplittable
        ids = self.ranks.encode_to_numpy(" " + word, disallowed_special=()).tobytes() if self.ranks else self.whole(" " + word)
        if len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of the text as bytes; none for null."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not first or _OTHER_SPACE.search(first) or self.special and self.special.search(text):
            return self.whole(text)
        if len(self) > CACHE_WORDS:
            self.clear()
        try:
            ids = b"".join(map(self.__getitem__, rest))
        except Unsplittable:
            return self.whole(text)
        return self.whole(first) + ids


def encoder(path: str, plain: bool = False) -> Encoder:
    """One for each worker process and vocabulary."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = Encoder(path, plain)
    return _ENCODERS[path, plain]
