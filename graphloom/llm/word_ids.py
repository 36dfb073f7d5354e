"""Ids of whole texts by a tokenizers file, each distinct chunk of text encoded once per worker.

Only files whose normalizer and pre-tokenizer are the ones below are taken: the cuts rely on them.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphloom.llm.common import expand, gather, use

# Text is cut at ASCII white space. The tokenizer's pattern drops white space and never reaches across it, its normalizer maps character
# by character, and composition never joins a mark to white space, so the cut changes no id.
#: Bytes that either generation of a worker's cache may hold, by estimate; only time depends on it.
_CACHE_BYTES = 32_000_000


#: Closing marks. The tokenizer's pattern separates them from an ASCII letter or digit before them.
_TAIL = '.,!?;:|$%&*#"()'


def _parts(chunks: pa.StringArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct parts, numbers of the chunks' parts, ends of each chunk's run): a chunk is cut before its closing marks if an ASCII letter or digit stands there; ASCII in lower case, as the normalizer makes it."""
    base = pc.ascii_rtrim(chunks, characters=_TAIL)
    size, whole = (np.asarray(pc.binary_length(x)).astype(np.int64) for x in (base, chunks))
    cut = np.asarray(pc.ascii_is_alnum(pc.utf8_slice_codeunits(base, -1, None))) & (size < whole)
    head = pc.if_else(pa.array(cut), base, chunks)
    head = pc.if_else(pc.string_is_ascii(head), pc.ascii_lower(head), head).dictionary_encode()
    offsets = np.frombuffer(chunks.buffers()[1], "<i4", len(chunks) + 1, 4 * chunks.offset).astype(np.int64)
    marks = gather(np.frombuffer(chunks.buffers()[2] or b"", np.uint8), (offsets[:-1] + size)[cut], (whole - size)[cut])
    ends = np.concatenate([[0], np.cumsum((whole - size)[cut])]).astype("<i4")
    tail = pa.StringArray.from_buffers(int(cut.sum()), pa.py_buffer(ends), pa.py_buffer(marks)).dictionary_encode()
    run_ends = np.cumsum(1 + cut)
    numbers = np.empty(int(run_ends[-1]) if len(run_ends) else 0, np.int64)
    numbers[run_ends - 1 - cut] = head.indices.to_numpy()
    numbers[run_ends[cut] - 1] = len(head.dictionary) + tail.indices.to_numpy()
    return head.dictionary.to_pylist() + tail.dictionary.to_pylist(), numbers, run_ends


#: Fixed by the tokenizer: composition, white space to one space, lower case; then these pre-tokens, each ended by a piece with the suffix.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SUFFIX = "</w>"
#: Words of these letters alone are one pre-token each.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+\Z")


class _Tokenizer:
    """The library's tokenizer, and which ids end a pre-token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        split = read["pre_tokenizer"]["pretokenizers"][0] if (read["pre_tokenizer"] or {}).get("type") == "Sequence" else {}
        kinds = [n["type"] for n in (read["normalizer"] or {}).get("normalizers", [])]
        if kinds != _NORMALIZERS or split.get("pattern") != {"Regex": _PATTERN} or read["model"].get("end_of_word_suffix") != _SUFFIX or read["model"]["type"] != "BPE" or read["post_processor"]:
            raise ValueError(f"{path} does not cut words as this encoder expects")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.ends = np.zeros(max(read["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for piece, i in read["model"]["vocab"].items() if piece.endswith(_SUFFIX)]] = True

    def batch(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids as little-endian unsigned 32-bit integers."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """The same for words that match _PLAIN, as one text whose ids are cut where pre-tokens end."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Encoder:
    """encode(texts) gives each text's ids as a uint32 array, as encode_batch(add_special_tokens=False) of the library would."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        """Forget what is cached, and the tokenizer, which is read again when next needed."""
        self.tokenizer, self.known, self.before, self.held = None, {}, {}, 0

    def __len__(self) -> int:
        return self.tokenizer is not None

    def _learn(self, parts: list[str]) -> None:
        """Have the ids of all these parts in known."""
        if self.held > _CACHE_BYTES:  # what is used again moves on to the new generation, so that frequent parts stay
            self.before, self.known, self.held = self.known, {}, 0
        known, before = self.known, self.before
        plain, other = [], []
        for c in parts:
            if c not in known:
                if c in before:
                    known[c] = before[c]
                else:
                    (plain if _PLAIN.match(c) else other).append(c)
                self.held += 200 + 2 * len(c)
        self.tokenizer = self.tokenizer or _Tokenizer(self.path)
        for new, encoded in ((plain, self.tokenizer.words), (other, self.tokenizer.batch)):
            for a in range(0, len(new), 4_000):
                some = new[a : a + 4_000]
                known.update(zip(some, encoded(some), strict=True))

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Chunks and their parts are told apart by Arrow, so that Python sees each distinct part of the batch once; numpy then puts their ids together."""
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        coded = cut.flatten().dictionary_encode()
        parts, numbers, run_ends = _parts(coded.dictionary)
        self._learn(parts)
        own = list(map(self.known.__getitem__, parts))
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own))) // 4
        by_chunk, part_ends = expand(ends, np.frombuffer(b"".join(own), "<u4"), numbers)
        ids, chunk_ends = expand(np.concatenate([[0], part_ends])[run_ends], by_chunk, coded.indices.to_numpy())
        offsets = cut.offsets.to_numpy()
        bounds = np.concatenate([[0], chunk_ends])[offsets - offsets[0]].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """One for a worker's life; caches of other operators are emptied."""
    own = _encoder(path)
    use(own)
    return own
