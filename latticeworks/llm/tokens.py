"""Token ids of whole texts by a tokenizer file, with a bounded cache of words.

Files of the two kinds used here split a text at white space before they merge bytes, so a text's ids are those of its
space-separated runs, one after another. Runs repeat a lot, and are kept in a cache. A text whose white space could be
cut elsewhere (a run of it, or some at an end) is encoded as one piece instead.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np

#: Runs longer than this are not cached, and at this many runs the older half goes (about 200 bytes a run), for a fixed bound on memory.
LONGEST_RUN, MOST_RUNS = 40, 1_000_000
#: White space beside white space, or other than spaces and line feeds.
_ODD = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\v", "\f")
#: What some libraries take for white space, and others may not.
_RARE = "\x1c\x1d\x1e\x1f\x85"
_WIDE = re.compile("[\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Encoder:
    """``ids(text)``: the ids as little-endian bytes of the given numpy type."""

    def __init__(self, path: str, dtype: str = "<u4") -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.runs: dict[str, bytes] = {}
        #: Lower-cases, and drops white space.
        self.plain = self._encode(["A  \n B"]) == self._encode(["a b"])
        self.ends = dict(zip(".,", self._encode([".", ","])))
        #: Whether an id is the last of a word, or else the first after a space.
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for x, i in vocabulary.items() if (x.endswith("</w>") if self.plain else x.startswith("\u0120"))]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], together: int = 64) -> list[bytes]:
        """Words of letters alone, encoded together and cut where their ids begin or end."""
        if len(words) < 8:
            return self._encode([x if self.plain else " " + x for x in words])
        out = []
        groups = [words[k : k + together] for k in range(0, len(words), together)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids)
            at = np.flatnonzero(self.edge[ids])
            if len(at) != len(group):  # what the tokenizer takes for more words than one
                out += self._encode([x if self.plain else " " + x for x in group])
                continue
            cuts = (at + 1 if self.plain else np.append(at[1:], len(ids))) * (2 if self.code == "H" else 4)
            data, last = ids.astype("<u2" if self.code == "H" else "<u4").tobytes(), 0
            for to in cuts.tolist():
                out.append(data[last:to])
                last = to
        return out

    def ids(self, text: str) -> bytes:
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. What isn't in the cache is encoded for all of them at once, so texts come in batches of bounded size."""
        whole, heads, cut = [], [], []
        for k, text in enumerate(texts):
            if any(c in text for c in _RARE):
                whole.append(k)
            elif self.plain:
                cut.append((k, (text.lower() if text.isascii() else text).split()))
            elif not text or text[0].isspace() or text[-1].isspace() or any(x in text for x in _ODD) or (not text.isascii() and _WIDE.search(text)):
                whole.append(k)
            else:
                head, *parts = text.replace("\n", " \n").split(" ")
                heads.append(head)
                cut.append((k, parts))
        out = [b""] * len(texts)
        for k, ids in zip(whole, self._encode([texts[k] for k in whole])):
            out[k] = ids
        new = set().union(*(parts for _, parts in cut)).difference(self.runs)
        long = self._learn(new, (x for _, parts in cut for x in parts)) if new else ()
        for (k, parts), first in zip(cut, self._encode(heads) if heads else itertools.repeat(b"")):
            out[k] = first + b"".join(map(self.runs.__getitem__, parts))
        for x in long:
            del self.runs[x]
        return out

    def _learn(self, new: set[str], parts: Iterable[str]) -> list[str]:
        """Add the runs that aren't in the cache; returns those too long to stay."""
        runs = self.runs
        if len(runs) + 2 * len(new) > MOST_RUNS:
            for x in list(itertools.islice(runs, MOST_RUNS // 2)):
                del runs[x]
            new = set(parts).difference(runs)
        # A letter and a mark are apart, unless the letter's lower case or composed form ends in a mark of its own.
        ended = [x for x in new if x[-1] in ".," and (x[-2:-1].isalpha() if x.isascii() else unicodedata.normalize("NFC", x[-2:-1]).lower().isalpha())]
        bare = list((new.difference(ended) | {x[:-1] for x in ended}).difference(runs))
        words, rest = [], []
        for x in bare:
            (words if x.isalpha() and len(x) <= LONGEST_RUN else rest).append(x)
        runs.update(zip(rest, self._encode([x if self.plain or x[0] == "\n" else " " + x for x in rest])))
        runs.update(zip(words, self._words(words)))
        for x in ended:
            runs[x] = runs[x[:-1]] + self.ends[x[-1]]
        return [x for x in itertools.chain(bare, ended) if len(x) > LONGEST_RUN]


@functools.lru_cache(maxsize=2)
def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One encoder a Python worker, file and type, so that its cache serves all the worker's tasks."""
    return Encoder(path, dtype)


def local_path(path: str) -> str:
    """A tokenizer file's place: a path, or the name of one of the installed public files."""
    if os.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)
