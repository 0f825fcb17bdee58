"""Ids of a tokenizers file whose words are encoded apart from each other.

Texts of plain Latin characters are split here and new words are encoded in one call for many; all others
go to the library whole, so the ids are the library's in any case.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable
from itertools import batched

from .common import HELD

#: Characters for which lower case, white space and normal form C need no library.
OTHER = re.compile(r"[^\x09-\x0D\x20-\x7E\xA1-\xAC\xAE-įı-ňŊ-ž]")


def _of_category(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


#: The file's own splitting rule, for these characters.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_of_category('L')}]+|[{_of_category('N')}]|[^\\x09-\\x0D\\x20{_of_category('L')}{_of_category('N')}]+")
WORD_END = "</w>"
MEMO, LONG = 400_000, 40


def packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


_loaded: dict[str, tuple] = {}
HELD.append(_loaded)


def _load(path: str) -> tuple:
    """Tokenizer, ids of words met so far, those met again, packed ids, and whether an id ends a word."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        ends, codes = [False] * (max(vocabulary.values()) + 1), [i.to_bytes(4, "little") for i in range(max(vocabulary.values()) + 1)]
        for token, i in vocabulary.items():
            ends[i] = token.endswith(WORD_END)
        _loaded[path] = tokenizer, {}, set(), codes, ends
    return _loaded[path]


def _learn(words: list[str], known: dict[str, bytes], tokenizer, codes: list[bytes], ends: list[bool]) -> None:
    """One library call for many words: a word's ids go up to one that ends a word."""
    at, own = 0, []
    for i in tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids:
        own.append(codes[i])
        if ends[i]:
            known[words[at]] = b"".join(own)
            at, own = at + 1, []
    if at != len(words) or own:
        raise ValueError("the file's words do not end in tokens of their own")


def word_ids(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to ids (little-endian unsigned 32-bit), as by ``encode(text, add_special_tokens=False)``."""

    def encode(texts: list[str]) -> list[bytes]:
        # few texts at once: their words stay in the processor's cache
        return [ids for part in batched(texts, 8) for ids in encode_few(part)]

    def encode_few(texts: tuple[str, ...]) -> list[bytes]:
        tokenizer, known, again, codes, ends = _load(path)
        plain = ["<|" not in t and OTHER.search(t) is None for t in texts]
        words = [WORDS.findall(t.lower()) if p else None for t, p in zip(texts, plain, strict=True)]
        all_words = set().union(*[w for w in words if w])
        fresh = all_words.difference(known)
        if len(known) + len(fresh) > MEMO:  # words that came only once go
            kept = {w: known[w] for w in again if w in known} if len(again) < MEMO // 2 else {}
            known.clear()
            known.update(kept)
            again.clear()
            fresh = all_words.difference(known)
        again.update(all_words.difference(fresh))
        for part in batched(sorted(fresh), 4096):
            _learn(list(part), known, tokenizer, codes, ends)
        out = [b"".join(map(known.__getitem__, w)) if w is not None else packed(tokenizer.encode(t, add_special_tokens=False).ids) for t, w in zip(texts, words, strict=True)]
        for word in [w for w in fresh if len(w) > LONG]:  # long words are not kept
            del known[word]
        return out

    return encode
