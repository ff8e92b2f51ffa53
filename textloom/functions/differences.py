"""Where two texts differ, in time that follows their length: marks and clauses first, then stretches that both have once,
then a search over few edits."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from difflib import SequenceMatcher
from itertools import accumulate

CLAUSE = re.compile("[^。！？；，、\\s]+|[。！？；，、\\s]+")
#: Stretches whose sizes multiply to no more are compared as they are.
SMALL = 250_000
#: Sizes of the stretches that are looked for once in both texts, and how many edits are looked for where there are none. A
#: stretch with more is one change as a whole.
ANCHORS, MOST_EDITS = (32, 8, 3), 600

Change = tuple[int, int, int, int]


def changes(before: str, after: str) -> list[Change]:
    """Stretches ``before[a:b]`` that became ``after[c:d]``, as ``a, b, c, d`` in order. Clauses and the marks between them are
    told first, and characters only inside those that differ."""
    old, new = CLAUSE.findall(before), CLAUSE.findall(after)
    same = [x == y for x, y in zip(old, new, strict=False)]
    if len(old) == len(new) and 2 * sum(same) >= len(same):
        blocks = [(i, i + 1, i, i + 1) for i, equal in enumerate(same) if not equal]
    else:
        blocks = []
        for i, j, k, m in differing(old, new):  # as many on both sides: each with its own; else all with all
            blocks += [(i + n, i + n + 1, k + n, k + n + 1) for n in range(j - i)] if j - i == m - k else [(i, j, k, m)]
    at = [list(accumulate(map(len, parts), initial=0)) for parts in (old, new)]
    out: list[Change] = []
    for i, j, k, m in blocks:
        x, y = at[0][i], at[1][k]
        out += [(x + a, x + b, y + c, y + d) for a, b, c, d in differing(before[x : at[0][j]], after[y : at[1][m]])]
    return out


def differing(a: Sequence, b: Sequence) -> list[Change]:
    """The stretches in which two strings or lists differ, in order. Long ones lose their common ends, are cut at what both
    have once in one order, and are then compared part by part."""
    out: list[Change] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if (j - i) * (m - k) <= SMALL:
            junk = not isinstance(a, str)
            if j - i == m - k and not junk and (swaps := _swaps(a[i:j], b[k:m])) is not None:
                out += [(i + x, i + y, k + x, k + y) for x, y in swaps]
                continue
            out += [(i + w, i + x, k + y, k + z) for kind, w, x, y, z in SequenceMatcher(None, a[i:j], b[k:m], autojunk=junk).get_opcodes() if kind != "equal"]
            continue
        head = _common(a, i, j, b, k, m)
        i, k = i + head, k + head
        tail = _common_end(a, i, j, b, k, m)
        j, m = j - tail, m - tail
        if (j - i) * (m - k) <= SMALL:
            todo.append((i, j, k, m))
            continue
        blocks = next((x for size in (ANCHORS if isinstance(a, str) else (1,)) if (x := _anchors(a[i:j], b[k:m], size))), None)
        if blocks is None:
            blocks = _few_edits(a[i:j], b[k:m])
            if blocks is None:
                out.append((i, j, k, m))
                continue
            at, to = i, k
            for x, y, n in [*blocks, (j - i, m - k, 0)]:
                if at < i + x or to < k + y:
                    out.append((at, i + x, to, k + y))
                at, to = i + x + n, k + y + n
            continue
        at, to = i, k
        for x, y, n in [*blocks, (j - i, m - k, 0)]:
            if at < i + x or to < k + y:
                todo.append((at, i + x, to, k + y))
            at, to = i + x + n, k + y + n
    return sorted(out)


def _swaps(a: str, b: str) -> list[tuple[int, int]] | None:
    """Stretches in which two strings of one length differ place by place, if no old character of these is in ``b`` and no new
    one in ``a``: then what is equal lies between them and SequenceMatcher finds the same. Null otherwise."""
    at = [n for n, (x, y) in enumerate(zip(a, b, strict=True)) if x != y]
    if not {a[n] for n in at}.isdisjoint(b) or not {b[n] for n in at}.isdisjoint(a):
        return None
    out: list[tuple[int, int]] = []
    for n in at:
        out[-1:] = [(out[-1][0], n + 1)] if out and out[-1][1] == n else [*out[-1:], (n, n + 1)]
    return out


def _common(a: Sequence, i: int, j: int, b: Sequence, k: int, m: int) -> int:
    """Length of the common beginning of ``a[i:j]`` and ``b[k:m]``, by comparing ever larger pieces."""
    most, done, step = min(j - i, m - k), 0, 8
    while done < most:
        n = min(step, most - done)
        if a[i + done : i + done + n] == b[k + done : k + done + n]:
            done, step = done + n, min(4 * step, 1 << 14)
        elif n == 1:
            break
        else:
            step = max(1, n // 4)
    return done


def _common_end(a: Sequence, i: int, j: int, b: Sequence, k: int, m: int) -> int:
    most, done, step = min(j - i, m - k), 0, 8
    while done < most:
        n = min(step, most - done)
        if a[j - done - n : j - done] == b[m - done - n : m - done]:
            done, step = done + n, min(4 * step, 1 << 14)
        elif n == 1:
            break
        else:
            step = max(1, n // 4)
    return done


def _once(a: Sequence, size: int) -> dict:
    """Places of the stretches of ``size`` that ``a`` has once."""
    places: dict = {}
    for i in range(len(a) - size + 1):
        stretch = a[i : i + size] if size > 1 else a[i]
        places[stretch] = -1 if stretch in places else i
    return {x: i for x, i in places.items() if i >= 0}


def _anchors(a: Sequence, b: Sequence, size: int) -> list[tuple[int, int, int]]:
    """Equal blocks ``start in a, start in b, length`` from the longest chain of stretches that both have once."""
    other = _once(b, size)
    pairs = [(i, other[x]) for x, i in _once(a, size).items() if x in other]
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before[n] = last[at - 1] if at else -1
        ends[at : at + 1], last[at : at + 1] = [j], [n]
    chain = []
    n = last[-1] if last else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    blocks: list[tuple[int, int, int]] = []
    for i, j in reversed(chain):
        if blocks:
            x, y, n = blocks[-1]
            if i - x == j - y and i <= x + n:
                blocks[-1] = (x, y, i - x + size)
                continue
            over = max(x + n - i, y + n - j, 0)
            if over >= size:
                continue
            blocks.append((i + over, j + over, size - over))
        else:
            blocks.append((i, j, size))
    return blocks


def _few_edits(a: Sequence, b: Sequence, most: int = MOST_EDITS) -> list[tuple[int, int, int]] | None:
    """Equal blocks of a shortest edit script, or null if it needs more than ``most`` insertions and deletions. Furthest places by
    diagonal, kept for each number of edits: ``most`` squared numbers at most, whatever the lengths."""
    n, m = len(a), len(b)
    far = {1: 0}
    trace = []
    for edits in range(most + 1):
        trace.append(far.copy())
        for d in range(-edits, edits + 1, 2):
            if d < -m or d > n:
                continue
            x = far.get(d + 1, -1) if d == -edits or (d != edits and far.get(d - 1, -1) < far.get(d + 1, -1)) else far.get(d - 1, -1) + 1
            if x < 0 or x > n or not 0 <= x - d <= m:
                far.pop(d, None)
                continue
            x += _common(a, x, n, b, x - d, m)
            far[d] = x
            if x == n and x - d == m:
                return _walked(trace, n, m)
        far = {d: x for d, x in far.items() if abs(d) <= edits}
    return None


def _walked(trace: list[dict], n: int, m: int) -> list[tuple[int, int, int]]:
    """The blocks of the script that ends at ``n, m``."""
    blocks: list[tuple[int, int, int]] = []
    x, y = n, m
    for edits in range(len(trace) - 1, -1, -1):
        far, d = trace[edits], x - y
        down = d == -edits or (d != edits and far.get(d - 1, -1) < far.get(d + 1, -1))
        from_d = d + 1 if down else d - 1
        px = far.get(from_d, 0) if edits else 0
        start = px if down or not edits else px + 1
        if x > start:
            blocks.append((start, start - d, x - start))
        x, y = px, px - from_d if edits else 0
    return blocks[::-1]
