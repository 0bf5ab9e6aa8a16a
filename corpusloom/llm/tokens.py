"""Batched tokenization with the tokenizers library: each distinct word is encoded once and its ids are kept.

For a vocabulary whose pre-tokenizer drops white space and joins nothing over it (the default one), the ids of a text are the ids
of its white-space-separated pieces in a row. Pieces are cut at ASCII white space only. Of a piece that is Latin letters with
ASCII punctuation behind them, both parts are kept apart, since letters and symbols never share a token there; all other pieces
go to the tokenizer as they are.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words whose ids a worker keeps (about 200 bytes each); beyond it the memory is emptied and filled anew.
CACHE_WORDS = 500_000

#: Letters that stand alone in normal form C, and punctuation behind them.
_SIMPLE = r"^(?P<body>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"

_cache: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions first[i], ..., first[i] + count[i] - 1 for all i in a row."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


class BatchTokenizer:
    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        path = path or default_path()
        self.tokenizer = Tokenizer.from_file(path)
        # For words of lower-case letters the normalizer and the pattern of the pre-tokenizer change nothing.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.reset()

    @classmethod
    def of(cls, path: str | None) -> "BatchTokenizer":
        """One per worker process."""
        if path not in _cache:
            _cache[path] = cls(path)
        return _cache[path]

    def reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.ids = np.zeros(1 << 16, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32)
        self.count = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        k, n = len(self.index), len(ids)
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(words) > len(self.count):
            self.count, self.first = (np.concatenate([x, np.zeros_like(x)]) for x in (self.count, self.first))
        self.ids[self.used : self.used + n] = ids
        self.count[k : k + len(words)] = counts
        self.first[k : k + len(words)] = self.used + np.cumsum(counts) - counts
        self.used += n
        self.index.update(zip(words, range(k, k + len(words)), strict=True))

    def _learn(self, words: list[str], simple: bool) -> None:
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            if simple:
                lines = [" ".join(part[i : i + 100]) for i in range(0, len(part), 100)]
                ids = np.concatenate([np.array(e.ids, np.int64) for e in self.letters.encode_batch_fast(lines, add_special_tokens=False)])
                last = np.flatnonzero(self.ends[ids])
                assert len(last) == len(part), "the vocabulary does not mark the ends of words"
                counts = np.diff(np.concatenate([[-1], last]))
            else:
                got = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                ids = np.array([i for x in got for i in x], np.int64)
                counts = np.array([len(x) for x in got], np.int64)
            self._add(part, ids, counts)

    def _numbers(self, words: pa.Array, simple: np.ndarray) -> np.ndarray:
        """The number of each word; simple: which of them are lower-case letters only."""
        coded = words.dictionary_encode()
        distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            plain = np.zeros(len(distinct), bool)
            plain[code[simple]] = True
            for kind in (True, False):
                some = new[plain[new] == kind]
                number[some] = len(self.index) + np.arange(len(some))
                self._learn([distinct[k] for k in some.tolist()], kind)
        return number[code]

    def _parts(self, pieces: pa.Array) -> np.ndarray:
        """For each piece the numbers of its two parts, letters (or all of it) and the punctuation behind."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        found = pc.extract_regex(pieces, _SIMPLE)
        simple = pc.is_valid(found)
        body = pc.if_else(simple, pc.utf8_lower(pc.struct_field(found, "body")), pieces)
        tail = pc.if_else(simple, pc.struct_field(found, "tail"), "")
        simple = simple.to_numpy(zero_copy_only=False)
        return np.stack([self._numbers(body, simple), self._numbers(tail, np.zeros(len(simple), bool))], 1).ravel()

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text's ids); null texts count as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        pieces = pc.ascii_split_whitespace(texts)
        coded = pieces.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        parts = self._parts(coded.dictionary)
        n_ids = self.count[parts]
        flat = self.ids[spread(self.first[parts], n_ids)]
        n_ids = n_ids.reshape(-1, 2).sum(1)
        first = np.cumsum(n_ids) - n_ids
        code = coded.indices.to_numpy(zero_copy_only=False)
        count = n_ids[code]
        out = flat[spread(first[code], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        bounds = pieces.offsets.to_numpy(zero_copy_only=False)
        at = total[bounds - bounds[0]]
        if end_id is None:
            return out, at
        at = at + np.arange(len(texts) + 1)
        full = np.empty(len(out) + len(texts), out.dtype)
        keep = np.ones(len(full), bool)
        keep[at[1:] - 1] = False
        full[keep] = out
        full[~keep] = end_id
        return full, at
