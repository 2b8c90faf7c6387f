"""String scorers in plain loops, one pair at a time: what the batched ones are held against."""


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit vector per row of the table."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel(a: str, b: str) -> float:
    """Share of characters that insertions and deletions leave: 2 * common / total."""
    total = len(a) + len(b)
    return 1.0 if not total else 2.0 * common_length(a, b) / total


def partial(a: str, b: str) -> float:
    """The best score of the shorter text against any stretch of the longer of its length (shorter at the ends)."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 1.0
    n, best, letters = len(a), 0.0, set(a)
    for start in range(1 - n, len(b)):
        piece = b[max(0, start) : start + n]
        if piece[-1] in letters or piece[0] in letters:
            best = max(best, indel(a, piece))
    if len(a) == len(b):
        for start in range(1 - n, n):
            best = max(best, indel(a[max(0, start) : start + n], b))
    return best


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of: shared words against shared plus own words of either side, and these two against each other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    one, two = (f"{both} {left}".strip(), f"{both} {right}".strip())
    best = indel(one, two)
    return max(best, indel(both, one), indel(both, two)) if both else best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a common start of up to four letters where it is over 0.7."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    used, left = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [b[j] for j in range(m) if used[j]]
    k = len(left)
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    start = 0
    while start < min(4, n, m) and a[start] == b[start]:
        start += 1
    return jaro + start * 0.1 * (1 - jaro) if jaro > 0.7 else jaro
