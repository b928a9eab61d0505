"""Token ids of texts by a public byte-level BPE vocabulary.

The ids are those of ``tokenizers`` with ``byte_bpe_50k.json`` and add_special_tokens=False: none are added, and a special token's string
in a text gives that token's id. That library takes about 0.8 CPU seconds a MB; the same
vocabulary's ranks with tiktoken take a fifth of it and give the same ids (tests/llm/test_packing.py
holds one against the other). On top of that, words are looked up in a bounded table, because
a pre-token never spans the single space before a word.
"""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
#: Words kept in a worker's table; further ones are encoded each time they come.
TABLE_WORDS = 200_000
#: Where words can't be looked up one by one: white space other than single spaces and single newlines.
_AWKWARD = re.compile(r"[^\S \n]|\s\s|[\x1c-\x1f\x85\xa0]")
#: Marks a text's first word, which has no space before it; no other word can begin so.
_FIRST = "\n\n"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str) -> Tokens:
    """One for each worker process."""
    return Tokens(path)


class Tokens:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = {}
        with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as f:
            for line in f:
                piece, rank = line.split()
                ranks[base64.b64decode(piece)] = int(rank)
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        with open(path, encoding="utf-8") as f:
            self.specials = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        #: ids after which a sentence or line ends, and ids that begin with a space
        self.ends, self.spaced = np.zeros((2, max(*ranks.values(), *self.specials.values()) + 1), bool)
        for piece, rank in ranks.items():
            self.ends[rank] = piece.endswith((b".", b"!", b"?", b"\n"))
            self.spaced[rank] = piece.startswith(b" ")
        self.table: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts one after another, and each text's number of ids. Null counts as empty."""
        found = {k: self.special.findall(t) for k, t in enumerate(texts) if t and any(x in t for x in self.specials)}
        if not found:
            return self._encode_plain(texts)
        # what stands between special tokens is encoded by itself
        parts = [self.special.split(t) if k in found else [t] for k, t in enumerate(texts)]
        ids, sizes = self._encode_plain([x for p in parts for x in p])
        upto = np.cumsum(sizes)
        first = np.cumsum([len(p) for p in parts]) - [len(p) for p in parts]
        at = [upto[first[k] + i] for k, names in found.items() for i in range(len(names))]
        ids = np.insert(ids, at, np.array([self.specials[x] for names in found.values() for x in names], np.uint32))
        return ids, np.add.reduceat(sizes, first) + np.array([len(found.get(k, ())) for k in range(len(texts))])

    def _encode_plain(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                parts = [_FIRST + text] if _AWKWARD.search(text) else text.split(" ")
                if len(parts) > 1 or not parts[0].startswith(_FIRST):
                    parts[0] = _FIRST + parts[0]
                words += parts
                counts[k] = len(parts)
        get = self.table.get
        codes = np.array([get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(codes < 0)
        new: dict[str, int] = {}
        where = [new.setdefault(words[i], len(new)) for i in missing]
        ids, sizes = self._encode_words(list(new))
        known = len(self.sizes)
        codes[missing] = np.array(where, np.int64) + known
        all_ids, all_sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        starts = np.cumsum(all_sizes) - all_sizes
        size = all_sizes[codes]
        out = all_ids[np.arange(size.sum()) + np.repeat(starts[codes] - (np.cumsum(size) - size), size)]
        short = [w for w in new if len(w) < 64][: TABLE_WORDS - known]
        if short:
            kept = known + np.array([new[w] for w in short], np.int64)
            size_kept = all_sizes[kept]
            self.ids = np.concatenate([self.ids, all_ids[np.arange(size_kept.sum()) + np.repeat(starts[kept] - (np.cumsum(size_kept) - size_kept), size_kept)]])
            self.sizes = np.concatenate([self.sizes, size_kept])
            self.table.update(zip(short, range(known, known + len(short)), strict=True))
        ends = np.cumsum(counts)
        upto = np.concatenate([[0], np.cumsum(size)])
        return out, upto[ends] - upto[ends - counts]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of words one after another, and each word's number of ids; plain words in one go."""
        got: list[list[int] | None] = [self.plain(w[len(_FIRST) :]) if w.startswith(_FIRST) else self.plain(" ") if not w else None for w in words]
        rest = [k for k, x in enumerate(got) if x is None]
        ids = np.array(self.plain(" " + " ".join(words[k] for k in rest)) if rest else [], np.uint32)
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(rest):
            for k in rest:
                got[k] = self.plain(" " + words[k])
        elif rest:
            for k, a, b in zip(rest, starts, [*starts[1:], len(ids)], strict=True):
                got[k] = ids[a:b]
        sizes = np.array([len(x) for x in got], np.int64)
        return (np.concatenate([np.asarray(x, np.uint32) for x in got]) if got else ids), sizes
