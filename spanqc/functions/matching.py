"""The character similarity ratio of two texts, by suffix automata in place of comparing all places with all."""

from __future__ import annotations

from collections import Counter

#: In texts of so many characters or more, a character of more than a hundredth of them (and one) is common: no match begins with it.
COMMON_FROM = 200


def common_characters(text: str) -> frozenset[str]:
    if len(text) < COMMON_FROM:
        return frozenset()
    return frozenset(ch for ch, n in Counter(text).items() if n > len(text) // 100 + 1)


def automaton(text: str, low: int, high: int, common: frozenset[str]) -> tuple[list[dict], list[int], list[int], list[int]]:
    """All parts of ``text[low:high]`` without common characters: of each state its steps, suffix link, longest length, and where it first ended."""
    step: list[dict] = [{}]
    link, longest, ended = [-1], [0], [low]
    last, gap = 0, False
    for at in range(low, high):
        ch: str | int = text[at]
        if ch in common:
            if gap or not last:
                continue
            ch, gap = at, True  # a letter that no text has, so nothing runs across
        else:
            gap = False
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        ended.append(at + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in step[p]:
            step[p][ch] = new
            p = link[p]
        if p >= 0:
            q = step[p][ch]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                ended.append(ended[q])
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(ch) == q:
                    step[p][ch] = twin
                    p = link[p]
        last = new
    return step, link, longest, ended


def longest_match(a: str, b: str, box: tuple[int, int, int, int], common: frozenset[str]) -> tuple[int, int, int]:
    """The longest part that ``a[box[0]:box[1]]`` and ``b[box[2]:box[3]]`` share, the earliest in ``a``, then in ``b``: its places and size.

    It has no common character at first; then it grows over equal neighbours, whatever they are.
    """
    a_low, a_high, b_low, b_high = box
    step, link, longest, ended = automaton(b, b_low, b_high, common)
    i, j, size = a_low, b_low, 0
    state = length = 0
    for at in range(a_low, a_high):
        ch = a[at]
        while state and ch not in step[state]:
            state = link[state]
            length = longest[state]
        if ch in step[state]:
            state, length = step[state][ch], length + 1
            if length > size:
                i, j, size = at + 1 - length, ended[state] - length, length
    while i > a_low and j > b_low and a[i - 1] == b[j - 1]:
        i, j, size = i - 1, j - 1, size + 1
    while i + size < a_high and j + size < b_high and a[i + size] == b[j + size]:
        size += 1
    return i, j, size


def matching_characters(a: str, b: str) -> int:
    """Characters in the longest match, and in those of what is left of it and right of it, and so on."""
    common, found, todo = common_characters(b), 0, [(0, len(a), 0, len(b))]
    while todo:
        box = todo.pop()
        i, j, size = longest_match(a, b, box, common)
        if size:
            found += size
            if box[0] < i and box[2] < j:
                todo.append((box[0], i, box[2], j))
            if i + size < box[1] and j + size < box[3]:
                todo.append((i + size, box[1], j + size, box[3]))
    return found


def similarity_of(a: str | None, b: str | None) -> float:
    """Share of matching characters; null counts as empty, and two empty texts are alike.

    Each match is found in time linear in what it is looked for in; a pair takes as many such rounds as it has matches inside each other.
    """
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    return 2.0 * matching_characters(a, b) / (len(a) + len(b))
