"""Suffix arrays by linear grouping."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order.

    Phase 1 refines groups of suffixes until all members of a group share their Lyndon prefix. Groups are taken in descending
    order; each member looks up, along previous-smaller pointers, the nearest earlier suffix in a smaller group, and those
    found move to new groups just above their own, the more often found the higher. Phase 2 emits the order: from the
    empty suffix upwards, each suffix emitted names the next places of the chain before it. No name is computed twice and
    nothing is sorted recursively.
    """
    n = len(text)
    if not n:
        return []
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n  # of a suffix in order
    group = [0] * n  # the first place of a suffix's group
    size = [0] * n  # by first place
    at = 0
    while at < n:
        end, symbol = at, text[order[at]]
        while end < n and text[order[end]] == symbol:
            place[order[end]] = end
            group[order[end]] = at
            end += 1
        size[at] = end - at
        at = end
    previous = [-1] * n
    high = n
    while high > 0:
        i = order[high - 1]
        low = group[i]
        if low == high - 1:  # most groups end up with one member
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = previous[p]
            previous[i] = p
            high = low
            if p >= 0 and (left := size[g := group[p]] - 1):
                tail = g + left
                q, a = order[tail], place[p]
                order[a], order[tail] = q, p
                place[q], place[p] = a, tail
                size[g], size[tail] = left, 1
                group[p] = tail
            continue
        members = order[low:high]
        members.sort()
        found: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and (g := group[p]) >= low:
                # Members come in text order, so an earlier one has its pointer already.
                p = previous[p]
            previous[i] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        high = low
        if not found:
            continue
        levels: dict[int, list[int]] = {}
        for p, times in found.items():
            levels.setdefault(times, []).append(p)
        for times in sorted(levels, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in levels[times]:
                moved.setdefault(group[p], []).append(p)
            for g, those in moved.items():
                left = size[g] - len(those)
                if not left:
                    continue
                tail = g + size[g]
                for p in those:
                    tail -= 1
                    q, a = order[tail], place[p]
                    order[a], order[tail] = q, p
                    place[q], place[p] = a, tail
                size[g], size[tail] = left, len(those)
                for p in those:
                    group[p] = tail
    out = [-1] * n
    free = group  # each suffix's group start; the next free place is kept at the start itself
    start = list(range(n))
    done = bytearray(n)
    i = -1
    while i < n:
        j = (n if i < 0 else out[i]) - 1
        while j >= 0 and not done[j]:
            g = free[j]
            out[start[g]] = j
            start[g] += 1
            done[j] = 1
            j = previous[j]
        i += 1
    return out


def repeated(pieces: list[bytes], lasts: list[int], length: int, lefts: list[int] | None = None, gram: int = 0) -> list[list[int]]:
    """For each piece, the starts 0..last whose ``length`` bytes start at one of these places of any other piece too. Where all
    windows hold the same ``gram`` bytes at ``lefts``, those count as one symbol that nothing else equals."""
    skip = max(0, gram - 1)
    if skip:
        pieces = [p[:at] + p[at + skip :] for p, at in zip(pieces, lefts, strict=True)]
        length -= skip
    joined = b"\xff".join(pieces)  # windows end inside their piece, so that any separator will do
    text, owner, bases, at = list(joined), [-1] * len(joined), [], 0
    for k, piece in enumerate(pieces):
        bases.append(at)
        owner[at : at + lasts[k] + 1] = [k] * (lasts[k] + 1)
        if skip:
            text[at + lefts[k]] = 256
        at += len(piece) + 1
    hits: list[set[int]] = [set() for _ in pieces]
    before, window = (-1, -1), b""
    for s in suffix_array(text):
        k = owner[s]
        if k < 0:
            continue
        own, d = joined[s : s + length], s - bases[k]
        if own == window and (not skip or d == before[1] + lefts[k] - lefts[before[0]]):
            hits[k].add(d)
            hits[before[0]].add(before[1])
        before, window = (k, d), own
    return [sorted(h) for h in hits]
