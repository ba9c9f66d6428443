"""Length of the longest common subsequence of two token sequences.

Bit-parallel formulation (Allison & Dix 1986; Hyyrö 2004): a bit vector over
the second sequence, updated once per token of the first, using Python's
arbitrary-precision integers. What both begin and end with is counted off, and
tokens that one side lacks are left out first. The second sequence is gone
through in blocks of ``BLOCK`` tokens; a block hands on one carry bit for each
token of the first. O(|a|·|b|/w) time; memory for |a| carries and the masks of
one block, so a 20,000 x 20,000 token pair stays well below a second.
"""

from __future__ import annotations

from collections.abc import Sequence

BLOCK = 1 << 13


def lcs_length(a: Sequence, b: Sequence, block: int = BLOCK) -> int:
    n, head, tail = min(len(a), len(b)), 0, 0
    while head < n and a[head] == b[head]:
        head += 1
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    both = set(a).intersection(b)
    a, b = [t for t in a if t in both], [t for t in b if t in both]
    if len(a) < len(b):
        a, b = b, a
    length, carries = head + tail, bytearray(len(a))
    for at in range(0, len(b), block):
        masks: dict = {}
        for i, tok in enumerate(b[at:at + block]):
            masks[tok] = masks.get(tok, 0) | (1 << i)
        bits = min(block, len(b) - at)
        v = full = (1 << bits) - 1
        for j, tok in enumerate(a):
            u = v & masks.get(tok, 0)
            total = v + u + carries[j]
            carries[j] = total >> bits
            v = (total | (v - u)) & full
        length += bits - v.bit_count()
    return length


def lcs_length_dp(a: Sequence, b: Sequence) -> int:
    """Textbook dynamic programme; the reference for tests."""
    if not a or not b:
        return 0
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]
