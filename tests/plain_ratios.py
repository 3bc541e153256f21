"""The string ratios written plainly; the library has them as Column expressions."""

from __future__ import annotations


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, with one machine word of bits for each row."""
    if not a or not b:
        return 0
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & place.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_ratio(a: str, b: str) -> float:
    """The best of the ratios of sorted words and of shared words with each side's rest."""
    x, y = sorted(set(a.lower().split())), sorted(set(b.lower().split()))
    both = [w for w in x if w in y]
    rest_x, rest_y = [w for w in x if w not in both], [w for w in y if w not in both]
    if both and (not rest_x or not rest_y):
        return 1.0
    core = " ".join(both)
    p, q = " ".join([*both, *rest_x]), " ".join([*both, *rest_y])
    in_order = indel_ratio(" ".join(sorted(a.lower().split())), " ".join(sorted(b.lower().split())))
    return max(in_order, indel_ratio(p, q), *([indel_ratio(core, p), indel_ratio(core, q)] if both else []))


def partial_ratio(a: str, b: str) -> float:
    """The best Indel ratio of the shorter text with any part of the other that is as long, or shorter at its ends."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return float(not long)
    parts = [long[max(0, i) : i + n] for i in range(1 - n, len(long))]
    return max(indel_ratio(short, p) for p in parts)


def weighted_ratio(a: str, b: str) -> float:
    """The best of several ratios, after the public definition of the weighted one: whole texts; words in any order, for 0.95
    of it; where one is half as long again as the other, parts of it for 0.9, or 0.6 from eight times as long."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    whole = indel_ratio(a, b)
    if longer < 1.5:
        return max(whole, 0.95 * token_ratio(a, b))
    scale = 0.9 if longer < 8 else 0.6
    x, y = set(a.split()), set(b.split())
    words = 1.0 if x & y else partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * words)


def blended_score(query: str, candidate: str) -> float:
    """1 if equal, else 0.7 of the weighted and 0.3 of the partial ratio."""
    a, b = query.lower().strip(), candidate.lower().strip()
    return 1.0 if a == b else 0.7 * weighted_ratio(a, b) + 0.3 * partial_ratio(a, b)
