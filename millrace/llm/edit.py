"""Which pairs of texts are within an edit distance, many pairs at once.

The distance's matrix is walked column by column in a diagonal band, whose
vertical differences are bits of 64-bit words (Myers' algorithm with a sliding
window). A pair of n and m characters with at most K edits never leaves a band
of K + 1 diagonals, so a word does for 63 edits. Words of many pairs are the
lanes of numpy's operations. Pairs are given up once the last diagonal, whose
value never falls, exceeds K. The answer is exact.
"""

import numpy as np

_PAIRS, _COLUMNS = 1024, 32
_ONE = np.uint64(1)


def within(chars: np.ndarray, s: np.ndarray, n: np.ndarray, t: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each pair, whether the texts at s (n characters) and t (m) are at most ``most`` edits apart.

    Characters are code points; 0 and 1 must not occur.
    """
    swap = n > m
    s, n, t, m = np.where(swap, t, s), np.where(swap, m, n), np.where(swap, s, t), np.where(swap, n, m)
    ok = np.zeros(len(s), bool)
    some = np.flatnonzero(m - n <= most)
    if len(chars) and len(some):
        top = int(chars.max())
        chars = chars.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32, copy=False)
    words = most[some] // 64
    some = some[np.lexsort((m[some], words))]
    words = most[some] // 64
    lo = 0
    while lo < len(some):
        # as many pairs of the same number of words as keep the matrices small
        same = int(np.searchsorted(words, words[lo], side="right"))
        hi = lo + max(1, min(same - lo, _PAIRS, (1 << 22) // int(m[some[lo]] + 1)))
        at = some[lo:hi]
        if len(at) < 8 * (words[lo] + 1):
            ok[at] = [_single(chars[s[k] : s[k] + n[k]], chars[t[k] : t[k] + m[k]], int(most[k])) for k in at]
        else:
            ok[at] = _band(chars, s[at], n[at], t[at], m[at], most[at], int(words[lo]) + 1)
        lo = hi
    return ok


def _single(x, y, most):
    """The same for one pair, with one long integer as the column: better where few pairs are alike."""
    n, m = len(x), len(y)
    if not n:
        return m <= most
    where: dict[int, int] = {}
    for k, c in enumerate(x.tolist()):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << n) - 1
    vp, vn, score, top = full, 0, n, 1 << (n - 1)
    for j, c in enumerate(y.tolist(), 1):
        eq = where.get(c, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        score += bool(hp & top) - bool(hn & top)
        if score - (m - j) > most:
            return False
        hp = hp << 1 | 1
        vp = (hn << 1 | ~(d0 | hp)) & full
        vn = d0 & hp & full
    return score <= most


def _rows(chars, start, size, shift, width, blank):
    """Texts as a matrix's rows, each moved right by its shift."""
    out = np.full((len(start), width), blank, chars.dtype)
    row = np.repeat(np.arange(len(start)), size)
    k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, k + shift[row]] = chars[start[row] + k]
    return out


def _band(chars, s, n, t, m, most, w):
    pairs, longest = len(s), int(m.max())
    ok = np.zeros(pairs, bool)
    low = (most + m - n) // 2  # rows that the band has above the main diagonal
    wide = 64 * w
    a = _rows(chars, s, n, low, longest + wide + _COLUMNS, 0)
    b = _rows(chars, t, m, np.zeros(pairs, np.int64), longest + _COLUMNS, 1)
    last = low - (m - n)  # the bit of the diagonal that ends in the corner
    word, bit = last // 64, (last % 64).astype(np.uint64)
    # rows from 1 on begin with a vertical difference of one
    vp = np.stack([np.where(low >= 64 * (k + 1), 0, np.where(low <= 64 * k, -1, np.left_shift(-1, np.clip(low - 64 * k, 0, 63)))).astype(np.int64).view(np.uint64) for k in range(w)])
    vn = np.zeros_like(vp)
    score = np.zeros(pairs, np.int64)
    live, j = np.arange(pairs), 0
    while len(live):
        view = np.lib.stride_tricks.sliding_window_view(a[:, j : j + _COLUMNS + wide - 1], wide, axis=1)
        x = np.packbits(view == b[:, j : j + _COLUMNS, None], axis=-1, bitorder="little").view(np.uint64)
        x = np.ascontiguousarray(x.transpose(1, 2, 0))
        left = m - j
        for k in range(_COLUMNS):
            d0 = _diagonals(x[k], vp, vn)
            hp = vn | ~(d0 | vp)
            hn = d0 & vp
            down = d0 >> _ONE
            if w > 1:
                down[:-1] |= d0[1:] << np.uint64(63)
            vp = hn | ~(down | hp)
            vn = down & hp
            own = d0[0] if w == 1 else d0[word, np.arange(len(live))]
            score += (~(own >> bit) & _ONE).astype(np.int64) * (k < left)
        j += _COLUMNS
        over = score > most
        ok[live[~over & (left <= _COLUMNS)]] = True
        stay = np.flatnonzero(~over & (left > _COLUMNS))
        if len(stay) < len(live):
            live, a, b, vp, vn = live[stay], a[stay], b[stay], vp[:, stay], vn[:, stay]
            score, m, most, word, bit = score[stay], m[stay], most[stay], word[stay], bit[stay]
    return ok


def _diagonals(x, vp, vn):
    """Bits of the rows whose value equals that of the last column's row above."""
    t = x & vp
    if len(x) == 1:
        return ((t + vp) ^ vp) | x | vn
    total, carry = np.empty_like(t), np.zeros(t.shape[1], np.uint64)
    for k in range(len(t)):
        part = t[k] + vp[k]
        total[k] = part + carry
        carry = ((part < t[k]) | (total[k] < part)).astype(np.uint64)
    return (total ^ vp) | x | vn
