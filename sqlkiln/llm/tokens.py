"""Byte-level BPE ids of whole texts, encoded once per distinct space-delimited chunk."""

from __future__ import annotations

import re
from array import array
from itertools import compress
from operator import not_

import numpy as np

END_ID = 2                      # the id that ends every document
CACHE_CHUNKS = 500_000          # chunks a worker remembers; common ones come early, so a full cache just stays
CACHE_CHARS = 48                # longer chunks are encoded, not remembered

# A run of letters and what follows it: the pre-tokenizer parts the two, too.
_STEM = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~\n'].*)", re.S)


class ChunkEncoder:
    """Texts to ids (little-endian uint32 bytes), equal to encoding each whole text.

    The byte-level pre-tokenizer always starts a new piece at a space that a
    non-space follows, and pieces are encoded independently; so a text's ids
    are those of its chunks between such spaces, in a row. Natural words
    repeat, so most chunks come from the cache; of a new one, the word and the
    punctuation behind it often do. Texts in which a space meets
    other white space or ends the text are encoded whole, and so are those that
    hold an added token's string, which the library maps to that token.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        vocab = self.tok.get_vocab()
        self.vocab_size = max(vocab.values()) + 1
        self.starts = np.zeros(self.vocab_size, bool)      # ids whose bytes begin with a space
        self.starts[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}                  # what stands behind a word, without a space before it

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str], into: dict[str, bytes]) -> None:
        """Ids of ``chunks`` (no spaces inside), each as it reads after a space."""
        for at in range(0, len(chunks), 4096):
            part = chunks[at:at + 4096]
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.starts[ids])
            if len(cuts) != len(part):
                into.update(zip(part, self._whole([" " + c for c in part])))
                continue
            raw, ends = ids.tobytes(), np.append(cuts[1:], len(ids)) * 4
            for chunk, a, b in zip(part, (cuts * 4).tolist(), ends.tolist()):
                into[chunk] = raw[a:b]

    def _new(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not known, each as it reads after a space."""
        whole, split = set(), {}
        for c in chunks:
            m = _STEM.fullmatch(c)
            if m:
                split[c] = m.groups()
                if m[1] not in self.known:
                    whole.add(m[1])
            else:
                whole.add(c)
        new: dict[str, bytes] = {}
        self._learn(list(whole), new)
        rest = list({tail for _, tail in split.values() if tail not in self.tails})
        tails = dict(zip(rest, self._whole(rest)))
        for c, (stem, tail) in split.items():
            new[c] = (self.known.get(stem) or new[stem]) + (self.tails.get(tail) or tails[tail])
        if len(self.tails) < CACHE_CHUNKS // 4:
            self.tails.update((t, ids) for t, ids in tails.items() if len(t) <= CACHE_CHARS)
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        marked = [any(a in t for a in self.added) for t in texts]
        if not any(marked):
            return self._chunked(texts)
        whole = iter(self._whole([t for t, m in zip(texts, marked) if m]))
        plain = iter(self._chunked([t for t, m in zip(texts, marked) if not m]))
        return [next(whole if m else plain) for m in marked]

    def _chunked(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without an added token's string."""
        known = self.known
        parts = [t.split(" ") for t in texts]
        heads = self._whole([p[0] for p in parts])
        found = [list(map(known.get, p)) for p in parts]          # the first chunk has no space before it: see heads
        missing: set[str] = set()
        for p, f in zip(parts, found):
            missing.update(compress(p, map(not_, f)))
        odd = {c for c in missing if not c or c[0].isspace()}     # a space before white space, or at the end
        missing -= odd
        new = self._new(missing)
        out = []
        for text, head, p, f in zip(texts, heads, parts, found):
            if odd and not odd.isdisjoint(p[1:]):
                out.append(self._whole([text])[0])
                continue
            f[0] = head
            if None in f:
                f = [new[c] if ids is None else ids for c, ids in zip(p, f)]
            out.append(b"".join(f))
        room = CACHE_CHUNKS - len(known)
        if room > 0:
            short = (c for c in new if len(c) <= CACHE_CHARS)
            known.update((c, new[c]) for c, _ in zip(short, range(room)))
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for ``path``, built once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def document_ids(texts, path: str, group_chars: int = 1_000_000):
    """Ids with the end id of each text (null: empty), as uint32 bytes, in order.

    Texts are encoded in groups of about ``group_chars`` so that memory follows
    that and the longest text, not the batch.
    """
    enc, end = encoder(path), np.uint32(END_ID).tobytes()
    group: list[str] = []
    size = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        group.append(text)
        size += len(text)
        if size >= group_chars:
            yield from (ids + end for ids in enc.encode(group))
            group, size = [], 0
    yield from (ids + end for ids in enc.encode(group))
