"""Token ids of whole texts by a public tokenizer, inside tasks.

A BPE file whose pre-tokenizer drops white space gives each white-space-free run of a text ids that depend on that run
alone, so ``RunEncoder`` has the tokenizers library encode each distinct run once and keeps its ids as bytes; a text's
ids are those of its runs, joined.  The pre-tokenizer cuts runs further, into letters, single digits and marks, and small
and capital letters are one, so runs of plain letters and marks are cut likewise first and share the ids of their parts.  A text is cut at ASCII white space only; any other white space stays inside a run and
is left to the library.
"""

from __future__ import annotations

import os
import re
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
#: Runs that can be taken apart before they are encoded: Latin letters, digits and marks but the apostrophe, which the
#: pre-tokenizer joins to what follows; no white space, no letter whose small one is two code points, none that combine.
_PLAIN = r"^[!-&(-~\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{17f}]+$"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class RunEncoder:
    """Text to ids as little-endian unsigned 32-bit bytes; equal to encoding the whole text at once."""

    def __init__(self, path: str, limit: int = 200_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.limit, self.longest = limit, longest
        added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = added or "$^"  # runs that hold an added token are not taken apart

    def _encode(self, runs: list[str], together: int = 256) -> list[bytes]:
        """Ids of each run.  Runs are encoded ``together`` in one text, then told apart by where each token starts."""
        groups = [runs[i : i + together] for i in range(0, len(runs), together)]
        out: list[bytes] = []
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
            starts = np.fromiter(map(itemgetter(0), e.offsets), np.int64, len(e.ids))
            cuts = (4 * np.searchsorted(starts, ends)).tolist()
            ids, at = np.array(e.ids, dtype="<u4").tobytes(), 0
            for cut in cuts:
                out.append(ids[at:cut])
                at = cut
        return out

    def _ids_of(self, runs: list[str]) -> list[bytes]:
        """Ids of different runs or parts of runs, of which those that are not long are kept."""
        if len(self.known) > self.limit:
            self.known = {}
        found = list(map(self.known.get, runs))
        new = [i for i, ids in enumerate(found) if ids is None]
        for long in (False, True):
            at = [i for i in new if (len(runs[i]) > self.longest) == long]
            made = self._encode([runs[i] for i in at], 1 if long else 256)
            for i, ids in zip(at, made):
                found[i] = ids
            if not long:
                self.known.update(zip([runs[i] for i in at], made))
        return found

    def _pool(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different runs in one array, and where each run's begin and how many they are."""
        plain = pc.and_not(pc.match_substring_regex(runs, _PLAIN), pc.match_substring_regex(runs, self.added))
        some = pc.replace_substring_regex(pc.utf8_lower(runs.filter(plain)), r"([^\pL\pN]+|\pN)", r" \1 ")
        parts, ends = _split(some)
        parts = parts.dictionary_encode()
        made, reached = _gathered(*_joined(self._ids_of(parts.dictionary.to_pylist())), parts.indices.to_numpy())
        whole = plain.to_numpy(zero_copy_only=False)
        others, first, sizes = _joined(self._ids_of(runs.filter(pc.invert(plain)).to_pylist()))
        starts, counts = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        starts[whole], counts[whole] = reached[ends[:-1]], np.diff(reached[ends])
        starts[~whole], counts[~whole] = len(made) + first, sizes
        return np.concatenate((made, others)), starts, counts

    def encode_many(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text; null counts as empty.  Equal runs of all the texts, and equal parts of them, are looked up once."""
        if not len(texts):
            return []
        runs, ends = _split(pc.fill_null(pa.array(texts, pa.string()), ""))
        runs = runs.dictionary_encode()
        whole, reached = _gathered(*self._pool(runs.dictionary), runs.indices.to_numpy())
        whole, cuts = whole.tobytes(), (4 * reached[ends]).tolist()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of all texts, and before which each text begins and the last one ends."""
    split = pc.ascii_split_whitespace(texts)
    ends = split.offsets.to_numpy()
    return split.values.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, sizes


def _gathered(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of entries ``at`` one after another, and how many come before each entry and in all."""
    counts = sizes[at]
    reached = np.concatenate(([0], np.cumsum(counts)))
    return pool[np.repeat(first[at] - reached[:-1], counts) + np.arange(reached[-1])], reached


_encoders: dict[str, RunEncoder] = {}


def encoder(path: str) -> RunEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]


def text_groups(texts: list[str | None], chars: int = 2_000_000):
    """Index ranges of consecutive texts that hold about ``chars`` characters, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def array_groups(texts: pa.Array, size: int = 2_000_000):
    """Index ranges of consecutive texts that hold about ``size`` bytes, one text at least."""
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = held[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(held, before + size, side="right")))
        yield start, end
        start = end
