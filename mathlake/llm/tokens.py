"""Whole texts to token ids with the tokenizers library, every distinct word encoded once per worker."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by a worker, beyond which those met only once are forgotten, and bytes of text looked up together. Both only
#: trade memory for speed, about 250 MB a worker here.
MOST_WORDS, TOGETHER = 600_000, 4 << 20
#: The same for stages that share an executor with large JVM stages, about 130 MB.
SMALL_MEMO = (300_000, 1 << 20)
#: Words of letters alone that are encoded in one call.
JOINED = 200
TAILS = b".,;:!?"


def letters(word: bytes) -> bool:
    """Whether the tokenizer sees a word as one run of letters; its lower case decides, as that is what it reads."""
    return word.isalpha() or not word.isascii() and word.decode("utf-8", "replace").lower().isalpha()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes documents word by word with one tokenizer file.

    Only for tokenizers that drop white space and never join across it (the word-level BPE here): then a text's ids are
    its words' ids in a row. Words are cut at ASCII white space and lower-cased in A-Z first, as the tokenizer itself
    lower-cases them; all other characters reach it as they are. The library looks for its special tokens before it
    lower-cases: texts that hold such a string in any case go to it whole.
    """

    def __init__(self, path: str, most_words: int = MOST_WORDS, together: int = TOGETHER):
        self.most_words, self.together = most_words, together
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The same merges for words of the letters a-z alone, which need no normalising and no search for word parts.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.tokenizer.model.end_of_word_suffix
        if not suffix:
            raise ValueError("this tokenizer does not mark word ends")
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.marks = dict(zip(TAILS, self._encode([chr(c) for c in TAILS]), strict=True))
        self._set([], np.empty(0, np.uint32), np.empty(0, np.int64))

    def _set(self, words: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.code: dict[bytes, int] = {}
        self.flat = np.empty(1 << 20, np.uint32)
        self.start, self.length, self.hits = (np.zeros(1 << 18, np.int64) for _ in range(3))
        self.used = 0
        self._add(words, flat, lengths)

    def _add(self, words: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        """Keeps words whose ids stand one after the other in flat."""
        n, end = len(self.code), self.used + len(flat)
        while len(self.flat) < end:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while len(self.start) < n + len(words):
            self.start, self.length, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.hits))
        self.flat[self.used : end] = flat
        self.length[n : n + len(words)] = lengths
        self.start[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.code.update(zip(words, range(n, n + len(words)), strict=True))
        self.used = end

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and where each word's end."""
        lengths = self.length[codes]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.start[codes] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)], ends

    def _forget(self) -> None:
        kept = np.flatnonzero(self.hits[: len(self.code)] > 1)[: self.most_words // 2]
        words = list(self.code)
        flat, _ = self._gather(kept)
        self._set([words[i] for i in kept.tolist()], flat, self.length[kept])

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_letters(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Words of letters alone: many in a call, cut where a token ends a word."""
        out: dict[bytes, list[int]] = {}
        for tokenizer, part in ((self.plain, [w for w in words if w.isascii()]), (self.tokenizer, [w for w in words if not w.isascii()])):
            groups = [part[i : i + JOINED] for i in range(0, len(part), JOINED)]
            for group, found in zip(groups, tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
                ids = found.ids
                cuts = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
                if len(cuts) == len(group) and cuts[-1] == len(ids):
                    at = 0
                    for w, cut in zip(group, cuts, strict=True):
                        out[w] = ids[at:cut]
                        at = cut
                else:
                    out.update(zip(group, self._encode([w.decode() for w in group]), strict=True))
        return out

    def _learn(self, words: list[bytes]) -> None:
        fresh, tailed, others, code = [], [], [], self.code
        for w in words:
            if not w:  # what white space at an end leaves
                others.append(w)
                continue
            if w.isalpha():
                fresh.append(w)
                continue
            stem = w[:-1]
            if w[-1] in TAILS and (stem.isalpha() or letters(stem)):
                tailed.append(w)
                if stem not in code:
                    fresh.append(stem)
            elif letters(w):
                fresh.append(w)
            else:
                others.append(w)
        found = self._encode_letters(list(dict.fromkeys(fresh)))
        found.update(zip(others, self._encode([w.decode("utf-8", "replace") for w in others]), strict=True))
        for w in tailed:
            stem = found.get(w[:-1])
            if stem is None:
                at = code[w[:-1]]
                stem = self.flat[self.start[at] : self.start[at] + self.length[at]].tolist()
            found[w] = stem + self.marks[w[-1]]
        ids = [found[w] for w in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(words, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)

    def ids(self, text: bytes, end_id: int | None = None) -> np.ndarray:
        """The ids of a whole text, then end_id."""
        return next(self.stream(pa.array([text.decode("utf-8", "replace")]), end_id))

    def stream(self, texts: pa.Array, end_id: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each text (null: none) and end_id."""
        texts = texts.cast(pa.string()).fill_null("")
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // self.together
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield from self._look_up(texts.slice(a, b - a), end_id)

    def _look_up(self, texts: pa.Array, end_id: int | None) -> Iterator[np.ndarray]:
        """Words are cut and made distinct outside Python; only the distinct ones are asked for."""
        low = pc.ascii_lower(texts)
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.match_substring(low, token).to_numpy(zero_copy_only=False)
        whole = dict(zip(np.flatnonzero(odd).tolist(), self._encode(texts.filter(pa.array(odd)).to_pylist()), strict=True)) if odd.any() else {}
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(odd), "", low) if whole else low)
        table = split.flatten().dictionary_encode()
        words = table.dictionary.cast(pa.binary()).to_pylist()
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            if len(self.code) + len(missing) > self.most_words and self.code:
                self._forget()
                codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
                missing = np.flatnonzero(codes < 0)
            codes[missing] = len(self.code) + np.arange(len(missing))
            self._learn([words[i] for i in missing.tolist()])
        self.hits[codes] += 1
        flat, ends = self._gather(codes[table.indices.to_numpy()])
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            yield np.concatenate([np.array(whole[i], np.uint32) if i in whole else flat[a:b], tail])


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, most_words: int = MOST_WORDS, together: int = TOGETHER) -> WordEncoder:
    """One encoder per worker process and setting."""
    key = (path, most_words, together)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]
