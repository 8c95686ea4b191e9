"""Tokenise whole texts by caching what stands between spaces.

The byte-level pre-token pattern lets a space only open a token, so a single space with a non-space
on either side always begins a new token. Texts are cut there; a chunk's ids depend on the chunk
alone and are kept in a two-generation cache of bounded size. Where a text has other runs of spaces
the cut is made only at the safe places, so ids are those of the whole text in every case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

SAFE = re.compile(r"(?<=\S) (?=\S)")
#: A mark behind letters, at the end of a chunk, is a pre-token of its own.
MARKS = ",."


class ChunkCache:
    """``encode_many`` turns strings into little-endian uint32 ids as bytes.

    At most ``2 * limit`` chunks of up to ``longest`` characters are kept; longer ones are encoded
    each time they occur.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 400_000, longest: int = 48):
        self.encode_many, self.limit, self.longest = encode_many, limit, longest
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = dict(zip(MARKS, encode_many(list(MARKS))))

    def encode(self, texts: Iterable[str], step: int = 3_000_000) -> Iterator[bytes]:
        """The ids of each text, in order; works on about ``step`` characters at a time."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= step:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        new, old = self.new, self.old
        get, cut, want = new.get, [], set()
        for t in texts:
            pieces = t.split(" ")
            got = list(map(get, pieces))
            got[0] = b""  # the first piece has no space before it
            gaps, at = [], 0
            try:
                while True:
                    at = got.index(None, at)
                    gaps.append(at)
                    at += 1
            except ValueError:
                pass
            fresh = [pieces[k] for k in gaps]
            head = pieces[0]
            if not head or head[-1].isspace() or not all(fresh) or any(p[0].isspace() or p[-1].isspace() for p in fresh):
                pieces = SAFE.split(t)
                got = list(map(get, pieces))
                gaps = [k for k, v in enumerate(got) if v is None and k]
                fresh = [pieces[k] for k in gaps]
            want.update(fresh)
            cut.append((got, gaps, fresh, pieces[0]))
        miss, stems, local = set(), [], {}
        for p in want:
            if (v := old.get(p)) is not None:
                new[p] = v
            elif p[-1] in MARKS and (q := p[:-1]).isalpha():
                if (v := get(q)) is not None or (v := old.get(q)) is not None:
                    new[p] = v + self.marks[p[-1]]
                else:
                    miss.add(q)
                    stems.append((p, q))
            else:
                miss.add(p)
        if miss:
            miss = list(miss)
            local = dict(zip(miss, self.encode_many([f" {p}" for p in miss])))
            new.update(local if max(map(len, miss)) <= self.longest else {p: v for p, v in local.items() if len(p) <= self.longest})
            for p, q in stems:
                local[p] = local[q] + self.marks[p[-1]]
        heads = self.encode_many([c[3] for c in cut])
        for (got, gaps, fresh, _), head in zip(cut, heads):
            for k, p in zip(gaps, fresh):
                got[k] = local[p] if p in local else new[p]
            got[0] = head
            yield b"".join(got)
        if len(new) > self.limit:
            self.old, self.new = new, {}
