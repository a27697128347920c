"""Token ids of whole texts, by the ``tokenizers`` library with a word cache.

Both kinds of pre-tokenizer met here never let a token cross a border between a
character that is not white space and a single blank or line feed. So the ids of a
text are the ids of its words in order; distinct words are looked up once for some
megabytes of text, and the ids of their pre-tokens are kept in a bounded cache per Python worker. Texts with other white space than single blanks and
line feeds between words, or with the string of a special token, are encoded
whole; so are all texts under a tokenizer of another kind.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Entries of each generation of the cache of pre-tokens; a full one becomes the old generation, whose
#: entries move back when they are asked for.
CACHE_ENTRIES = 150_000
#: Text that is encoded at once.
_TEXT_BYTES = 3 << 20
#: Longer words are not kept.
_KEPT_CHARS = 48

_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_DROPPED = _CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = _CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII_DROPPED = re.compile(_CONTRACTIONS + r"|[a-z]+|[0-9]|[^\sa-z0-9]+")
_ASCII_BYTES = re.compile(_CONTRACTIONS + r"| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_LATIN_DROPPED, _LATIN_BYTES = regex.compile(_DROPPED), regex.compile(_BYTES)
#: White space other than single blanks and line feeds between words; a NUL.
_ODD_SPACE = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The usual words: Latin letters, with a blank before or a mark behind. Their lower case is the same everywhere.
_USUAL, _MARK = r"\A ?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?\z", r"[.,;:!?]\z"
#: Below this, printable characters have no other normal form and the same lower case everywhere.
_LATIN_END = "\u0250"


def _byte_letters() -> dict[int, str]:
    """The letter of each byte: printable bytes are their own, the others follow from 256 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, key):
        found = self.old.pop(key, None)
        if found is None:
            found = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        if len(key) <= _KEPT_CHARS:
            self[key] = found
        return found


class WordTokenizer:
    """Encodes texts with the tokenizer of a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.id_bytes = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.kind = self._kind(spec)
        self.pre_tokens = _Cache(lambda x: self._model_ids(self._mapped(x)))

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = lambda x: x.get("type") == "ByteLevel" and not x.get("add_prefix_space")
        if spec.get("post_processor") or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
            return "other"
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens") or []):
            return "other"
        if plain(pre) and pre.get("use_regex", True) and normalizer is None:
            return "bytes"
        steps = pre.get("pretokenizers", [])
        if len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("invert") and plain(steps[1]):
            pattern = steps[0]["pattern"].get("Regex")
            norms = [x["type"] for x in (normalizer or {}).get("normalizers", [])]
            if pattern == _DROPPED and norms == ["NFC", "Replace", "Lowercase"]:
                return "dropped"
        return "other"

    @staticmethod
    def _mapped(pre_token: str) -> str:
        """The letters of the bytes, as the vocabulary has them."""
        if pre_token.isascii():
            word = pre_token[1:] if pre_token[:1] == " " else pre_token
            if " " not in word:
                return pre_token if word is pre_token else _LETTERS[32] + word
        return pre_token.encode().decode("latin-1").translate(_LETTERS)

    def _model_ids(self, pre_token: str) -> bytes:
        found = self.tokenize(pre_token)
        return self.id_bytes[found[0].id] if len(found) == 1 else b"".join([self.id_bytes[t.id] for t in found])

    def _word_ids(self, word: str) -> bytes:
        t, dropped = self.tokenizer, self.kind == "dropped"
        if not word.isprintable() or (not word.isascii() and max(word) >= _LATIN_END):
            text = t.normalizer.normalize_str(word) if t.normalizer else word
            return b"".join([self._model_ids(x) for x, _ in t.pre_tokenizer.pre_tokenize_str(text)])
        if word.isascii():
            pre = _ASCII_DROPPED.findall(word.lower()) if dropped else _ASCII_BYTES.findall(word)
        else:
            pre = _LATIN_DROPPED.findall(word.lower()) if dropped else _LATIN_BYTES.findall(word)
        return b"".join(map(self.pre_tokens.__getitem__, pre))

    def _pieces(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of some pieces, and for each of the distinct words the numbers of its two pieces; piece 0 is empty."""
        known, of = [b""], np.zeros((len(words), 2), np.int64)
        usual = pc.match_substring_regex(words, _USUAL)
        rest = np.nonzero(~usual.to_numpy(zero_copy_only=False))[0]
        of[rest, 0] = np.arange(1, len(rest) + 1)
        known += [self._word_ids(w) for w in words.take(pa.array(rest)).to_pylist()]
        usual = words.filter(usual)
        marked = pc.match_substring_regex(usual, _MARK)
        core = pc.if_else(marked, pc.utf8_slice_codeunits(usual, 0, -1), usual)
        mark = pc.if_else(marked, pc.utf8_slice_codeunits(usual, -1), "")
        own = np.setdiff1d(np.arange(len(words)), rest, assume_unique=True)
        for column, part in ((0, pc.utf8_lower(core) if self.kind == "dropped" else core), (1, mark)):
            part = part.dictionary_encode()
            of[own, column] = part.indices.to_numpy(zero_copy_only=False) + len(known)
            known += [self.pre_tokens[x] if x else b"" for x in part.dictionary.to_pylist()]
        return known, of

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text, encoded whole by the library."""
        return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, self.dtype)

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of each text's.

        The distinct words of the texts are cut into letters and a mark by Arrow, the distinct pieces are
        looked up once each, and the ids follow by numpy.
        """
        texts = pc.fill_null(texts, "")
        whole = np.ones(len(texts), bool)
        if self.kind != "other":
            odd = _ODD_SPACE if self.kind == "bytes" else "\x00"
            pattern = "|".join([odd, *[re.escape(x) for x in self.special]])
            whole = pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts)
        if self.kind == "bytes":  # words keep the blank before them, line feeds stand alone
            plain = pc.replace_substring(pc.replace_substring(plain, " ", "\x00 "), "\n", "\x00\n\x00")
            split = pc.split_pattern(plain, "\x00")
        else:
            split = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        known, of = self._pieces(words.dictionary)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        starts = np.cumsum(lengths) - lengths
        codes = of[words.indices.to_numpy(zero_copy_only=False)].ravel()
        taken = lengths[codes]
        ends = np.cumsum(taken)
        flat = np.repeat(starts[codes] - ends + taken, taken)
        flat += np.arange(len(flat))
        ids = np.frombuffer(b"".join(known), self.dtype)[flat]
        word_ends = np.concatenate(([0], 2 * np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))
        counts = np.diff(np.concatenate(([0], ends))[word_ends])
        if whole.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.nonzero(whole)[0]:
                parts[i] = self.encode(texts[int(i)].as_py())
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts


_LOADED: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    """The tokenizer of this Python process; its cache serves all tasks of the process."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def encoder(path: str, end_id: int):
    """A function from batches of (doc_id, text) to batches of ``doc_id`` and ``ids`` (little-endian unsigned
    32-bit integers, ``end_id`` last), for ``mapInArrow``. Null text is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            # some megabytes of text at a time, but at least one document
            group = np.cumsum(sizes, dtype=np.int64) // _TEXT_BYTES
            cuts = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), batch.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                part = batch.slice(at, to - at)
                ids, counts = tokenizer.encode_many(part.column(1))
                ends = np.cumsum(counts + 1)
                out = np.full(int(ends[-1]) if len(ends) else 0, end_id, "<u4")
                own = np.ones(len(out), bool)
                own[ends - 1] = False
                out[own] = ids
                offsets = np.concatenate(([0], 4 * ends)).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([part.column(0), data], ["doc_id", "ids"])
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with less

    return run


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id`` and ``ids`` of every row, in the order of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encoder(path, end_id), f"doc_id {kind}, ids binary")
