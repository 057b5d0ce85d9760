"""Lossless WebP (VP8L) bit streams to pixel arrays and back, with numpy.

``decode`` reads any VP8L image: prefix codes, back-references, the colour cache,
groups of codes, and the predictor, cross-colour, subtract-green and palette
transforms. Where all codes in use have one length each and no reference can
occur, whole blocks of pixels are read at once. ``encode`` writes such images by
default, and on request images that use every feature of the format; ``best`` says
which features make an image small.

Pixels are uint8 arrays (height, width, 4) in the order red, green, blue, alpha.
"""

from __future__ import annotations

import heapq
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np

# Fixed values of the public WebP lossless bitstream specification.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0),
    (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1),
    (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5),
    (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0),
    (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7),
    (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
BLOCK_PIXELS = 1 << 20
SEGMENT_BYTES = 1 << 14  # of the stream that is read at once
STEP_BITS = 18  # that are looked up for the length of a whole token
TOGETHER_BYTES, LEAST_TOGETHER = 1 << 21, 40  # of streams that are read together, and images for which that is worth it
TOGETHER_PIXELS = 1 << 21
WAITING_STEPS = 5  # that a token waits at most whose length is not looked up
LEAST_MATCH, MOST_MATCH = 3, 4096  # pixels of a back-reference
_DISTANCE_X, _DISTANCE_Y = np.array(DISTANCES).T.copy()


def _up(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


class BitReader:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the bit stream ends early")
        first, shift = divmod(self.at, 8)
        self.at += n
        return (int.from_bytes(self.data[first : first + (n + shift + 7) // 8], "little") >> shift) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        first, shift = divmod(self.at, 8)
        return (int.from_bytes(self.data[first : first + (n + shift + 7) // 8], "little") >> shift) & ((1 << n) - 1)


_BIT_REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1)[:, 0]


_REVERSED_16 = (_BIT_REVERSED[np.arange(1 << 16) & 255].astype(np.int64) << 8) | _BIT_REVERSED[np.arange(1 << 16) >> 8]


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bits as they come in the stream, lengths) of a canonical prefix code, shortest codes first."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[used]
    room = 1 << (15 - n)
    return used, _REVERSED_16[(np.cumsum(room) - room) << 1] & ((1 << n) - 1), n


class PrefixCode:
    """A prefix code by its lengths; a lone symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else None
        if len(used) == 0:
            self.single = 0
        self.fixed = 0 if self.single is not None else int(lengths[used[0]]) if (lengths[used] == lengths[used[0]]).all() else None
        if self.single is None and int((1 << (15 - lengths[used])).sum()) != 1 << 15:
            raise ValueError("a prefix code is not complete")
        self.most = 0 if self.single is not None else int(lengths.max(initial=0))
        self._table: np.ndarray | None = None
        self._entries: list[int] | None = None

    def symbols(self) -> np.ndarray:
        """Symbols by the value of their code's bits, first bit highest; only for codes of one length."""
        return np.array([self.single]) if self.single is not None else np.flatnonzero(self.lengths)

    def table(self) -> np.ndarray:
        """By the next ``most`` bits of the stream: 16 times the symbol and the length of its code."""
        if self._table is None:
            if self.single is not None:
                self._table = np.array([self.single << 4])
            else:
                used, _, n = canonical(self.lengths)
                in_order = np.repeat((used << 4) | n, 1 << (self.most - n))
                self._table = in_order[_REVERSED_16[: 1 << self.most] >> (16 - self.most)]
        return self._table

    def entries(self) -> list[int]:
        """``table`` as a list."""
        if self._entries is None:
            self._entries = self.table().tolist()
        return self._entries

    def read(self, bits: BitReader) -> int:
        if self.single is not None:
            return self.single
        found = int(self.table()[bits.peek(self.most)])
        bits.at += found & 15
        if bits.at > bits.end:
            raise ValueError("the bit stream ends early")
        return found >> 4


#: By alphabet, the last codes read: (bits of their description, how many, code).
_known: dict[int, list[tuple[int, int, PrefixCode]]] = {}


def _read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    """The next code; a description that was read before is known by its bits."""
    known = _known.setdefault(alphabet, [])
    for k, (value, n, code) in enumerate(known):
        if bits.at + n <= bits.end and bits.peek(n) == value:
            bits.at += n
            if k > 5:
                known.insert(0, known.pop(k))  # codes that come again stay
            return code
    first = bits.at
    code = _parse_code(bits, alphabet)
    n = bits.at - first
    bits.at = first
    known.insert(0, (bits.read(n), n, code))
    del known[12:]
    return code


def _parse_code(bits: BitReader, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return PrefixCode(lengths)
    own = np.zeros(19, np.int64)
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    coder = PrefixCode(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, mask = coder.table().tolist(), (1 << coder.most) - 1
    found, size, previous = [], 0, 8
    ahead, have, first = 0, 0, bits.at
    while size < alphabet and left:
        left -= 1
        if have < 16:  # a code and its extra bits take 14 at most
            bits.at = first
            ahead, have = bits.peek(512), 512
        s = table[ahead & mask]
        n, s = s & 15, s >> 4
        if s < 16:
            found.append(s)
            size += 1
            previous = s or previous
        else:
            extra, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            many = least + ((ahead >> n) & ((1 << extra) - 1))
            n += extra
            found += [previous if s == 16 else 0] * many
            size += many
        ahead >>= n
        have -= n
        first += n
    bits.at = first
    if bits.at > bits.end:
        raise ValueError("the bit stream ends early")
    if size > alphabet:
        raise ValueError("code lengths run over")
    lengths[:size] = found
    return PrefixCode(lengths)


def _prefix_value(bits: BitReader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _read_block(bits: BitReader, codes: list[PrefixCode], n: int) -> np.ndarray:
    """``n`` literal pixels whose codes have one length each."""
    widths = [codes[k].fixed for k in (GREEN, RED, BLUE, ALPHA)]
    each = sum(widths)
    out = np.empty((n, 4), np.uint8)
    for first in range(0, n, BLOCK_PIXELS):
        m = min(BLOCK_PIXELS, n - first)
        if bits.at + m * each > bits.end:
            raise ValueError("the bit stream ends early")
        byte, shift = divmod(bits.at, 8)
        raw = np.frombuffer(bits.data, np.uint8, (m * each + shift + 7) // 8, byte)
        if set(widths) <= {0, 8}:  # whole bytes, though not at byte borders
            if shift:
                raw = (raw >> shift) | np.append(raw[1:] << (8 - shift), np.uint8(0))
            value = _BIT_REVERSED[raw[: m * each // 8]].reshape(m, -1)
            bits.at += m * each
            at = 0
            for k, channel in ((GREEN, 1), (RED, 0), (BLUE, 2), (ALPHA, 3)):
                if widths[k]:
                    out[first : first + m, channel] = codes[k].symbols().astype(np.uint8)[value[:, at]]
                    at += 1
                else:
                    out[first : first + m, channel] = codes[k].single
            continue
        bit = np.unpackbits(raw, bitorder="little")[shift : shift + m * each].reshape(m, each)
        bits.at += m * each
        at = 0
        for k, channel in ((GREEN, 1), (RED, 0), (BLUE, 2), (ALPHA, 3)):
            if widths[k] == 0:
                out[first : first + m, channel] = codes[k].single
                continue
            symbols = codes[k].symbols().astype(np.uint8)
            # packbits takes the first bit of a code as the highest
            value = np.packbits(bit[:, at : at + widths[k]], axis=1)[:, 0] >> (8 - widths[k])
            out[first : first + m, channel] = symbols[value]
            at += widths[k]
    return out


def _extra_bits(prefix: np.ndarray) -> np.ndarray:
    return np.maximum(prefix - 2, 0) >> 1


def _values(prefix: np.ndarray, extra: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Lengths or distances of prefixes with ``extra`` bits whose value is ``more``."""
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + more) + 1


#: By codes: the bytes that ``_steps`` makes of them, those of the last images last.
_known_steps: dict[tuple, bytes] = {}


def _steps(codes: list[PrefixCode], n: int) -> bytes:
    """By the next bits of the stream: how many of them a literal or a cached colour takes; 0 for references and what is longer.

    Codes that come again, as common ones do, get ``STEP_BITS``; others what an image of ``n`` pixels is worth.
    """
    key = tuple(codes[:4])
    found = _known_steps.pop(key, None)
    if found is None or len(found) < 1 << STEP_BITS:
        most = STEP_BITS if found is not None else min(STEP_BITS, max(8, n.bit_length() + 1))
        ahead = np.arange(1 << most, dtype=np.int32)
        green, red, blue, alpha = (codes[k].table().astype(np.int32) for k in (GREEN, RED, BLUE, ALPHA))
        code = green[ahead & (len(green) - 1)]
        short = code & 15
        size = short
        for table in (red, blue, alpha):
            size = size + (table[(ahead >> size) & (len(table) - 1)] & 15)
        found = np.where(code >= 280 << 4, short, np.where((code < 256 << 4) & (size <= most), size, 0)).astype(np.uint8).tobytes()
    _known_steps[key] = found
    if len(_known_steps) > 8:
        del _known_steps[next(iter(_known_steps))]
    return found


def _padded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a stream with zeros behind them, and the next four of each as a number."""
    raw = np.zeros(len(data) + 36, np.uint8)  # a token takes 73 bits at most
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    wide = raw.astype(np.uint32)
    return raw, (wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24).astype(np.int64)


def _starts(ahead: np.ndarray, p: int, end: int, codes: list[PrefixCode], n: int) -> list[int]:
    """Where the tokens of one stream begin, from bit ``p`` to ``end``."""
    green, red, blue, alpha, distance = (c.entries() for c in codes)
    green_mask, red_mask, blue_mask, alpha_mask, distance_mask = ((1 << c.most) - 1 for c in codes)
    steps, ahead, here = _steps(codes, n), ahead.tolist(), []
    step_mask, put = len(steps) - 1, here.append
    while p < end:
        put(p)
        four = ahead[p >> 3] >> (p & 7)  # 25 bits are the stream's
        if size := steps[four & step_mask]:
            p += size
            continue
        code = green[four & green_mask]
        p += code & 15
        if code < 256 << 4:
            p += red[ahead[p >> 3] >> (p & 7) & red_mask] & 15
            p += blue[ahead[p >> 3] >> (p & 7) & blue_mask] & 15
            p += alpha[ahead[p >> 3] >> (p & 7) & alpha_mask] & 15
        elif code < 280 << 4:
            p += max(code - (258 << 4), 0) >> 5
            code = distance[ahead[p >> 3] >> (p & 7) & distance_mask]
            p += (code & 15) + (max(code - 32, 0) >> 5)
    return [*here, p]


def _starts_together(ahead: np.ndarray, p: np.ndarray, ends: np.ndarray, codes: list[PrefixCode]) -> np.ndarray:
    """Where the tokens of streams of the same codes begin, from bits ``p`` to ``ends``; each stream goes on by a token in a step.

    Tokens whose length ``_steps`` does not know wait for each other.
    """
    steps = np.frombuffer(_steps(codes, 1 << STEP_BITS), np.uint8)
    (green, red, blue, alpha, distance), masks = (c.table() for c in codes), [(1 << c.most) - 1 for c in codes]
    four = lambda q: ahead[q >> 3] >> (q & 7)
    seen = []
    while len(p) >= LEAST_TOGETHER:
        for _ in range(WAITING_STEPS):
            seen.append(p)
            size = steps[four(p) & (len(steps) - 1)]
            p = np.minimum(p + size, ends)
        going = p < ends
        if 4 * np.count_nonzero(going) < 3 * len(p):
            p, ends = p[going], ends[going]
        seen.append(p)
        late = np.flatnonzero(steps[four(p) & (len(steps) - 1)] == 0)
        q = p[late]
        code = green[four(q) & masks[GREEN]]
        q = q + (code & 15)
        ref = np.flatnonzero((code >= 256 << 4) & (code < 280 << 4))
        own = np.flatnonzero(code < 256 << 4)
        r = q[own]
        for table, k in ((red, RED), (blue, BLUE), (alpha, ALPHA)):
            r = r + (table[four(r) & masks[k]] & 15)
        q[own] = r
        r = q[ref] + (np.maximum(code[ref] - (258 << 4), 0) >> 5)
        code = distance[four(r) & masks[DISTANCE]]
        q[ref] = r + (code & 15) + (np.maximum(code - 32, 0) >> 5)
        p = p.copy()
        p[late] = np.minimum(q, ends[late])
    for q, end in zip(p.tolist(), ends.tolist()):
        first = q >> 3
        seen.append(np.array(_starts(ahead[first : (end >> 3) + 16], q & 7, end - 8 * first, codes, 1 << STEP_BITS)[:-1], np.int64) + 8 * first)
    at = np.sort(np.concatenate(seen))
    return at[np.diff(at, prepend=-1) > 0]


def _tokens_at(raw: np.ndarray, at: np.ndarray, codes: list[PrefixCode]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(green symbols, colours of literals, places of references, their lengths and distance codes) of the tokens that begin at these bits."""
    tables, masks = [c.table() for c in codes], [(1 << c.most) - 1 for c in codes]

    def ahead_of(q: np.ndarray) -> np.ndarray:  # 57 bits are the stream's
        return raw[(q >> 3)[:, None] + _EIGHT].view("<i8")[:, 0] >> (q & 7)

    eight = ahead_of(at)
    code = tables[GREEN][eight & masks[GREEN]]
    s, size = code >> 4, code & 15
    back = np.flatnonzero((s >= 256) & (s < 280))
    prefix = s[back] - 256
    extra = _extra_bits(prefix)
    length = _values(prefix, extra, (eight[back] >> size[back]) & ((1 << extra) - 1))
    q = at[back] + size[back] + extra
    code = tables[DISTANCE][ahead_of(q) & masks[DISTANCE]]
    prefix, q = code >> 4, q + (code & 15)
    extra = _extra_bits(prefix)
    far = _values(prefix, extra, ahead_of(q) & ((1 << extra) - 1))
    colour = s << 8
    for k, shift in ((RED, 16), (BLUE, 0)):
        code = tables[k][(eight >> size) & masks[k]]
        colour, size = colour | (code >> 4) << shift, size + (code & 15)
    if masks[ALPHA]:
        return s, colour | (tables[ALPHA][ahead_of(at + size) & masks[ALPHA]] >> 4) << 24, back, length, far
    return s, colour | codes[ALPHA].single << 24, back, length, far


def _read_tokens(bits: BitReader, codes: list[PrefixCode], cache_bits: int, width: int, n: int) -> np.ndarray:
    """``n`` pixels (argb) of one group of codes: literals, back-references and cached colours.

    First it is found where each token of a segment of the stream begins; then all of it are read at once.
    """
    parts, got, tokens = [], 0, 0
    while got < n:
        first = bits.at >> 3
        raw, ahead = _padded(bits.data[first : first + SEGMENT_BYTES + 16])
        *here, after = _starts(ahead, bits.at & 7, min(8 * SEGMENT_BYTES, bits.end - 8 * first), codes, n)
        if not here:
            raise ValueError("the bit stream ends early")
        s, colour, back, length, far = _tokens_at(raw, np.array(here), codes)
        reach = np.ones(len(s), np.int64)
        reach[back] = length
        reach = np.cumsum(reach)
        if got + reach[-1] >= n:  # what follows are the bits that fill the last byte
            last = int(np.searchsorted(reach, n - got))
            if got + reach[last] > n:
                raise ValueError("a back-reference leaves the image")
            after = [*here, after][last + 1]
            some = int(np.searchsorted(back, last + 1))
            s, colour, back, length, far, reach = s[: last + 1], colour[: last + 1], back[:some], length[:some], far[:some], reach[: last + 1]
        got += int(reach[-1])
        parts.append((s, colour, back + tokens, length, far))
        tokens += len(s)
        bits.at = 8 * first + after
        if bits.at > bits.end:
            raise ValueError("the bit stream ends early")
    s, colour, back, length, far = (np.concatenate(x) for x in zip(*parts))
    return _resolved(s, colour, back, length, far, cache_bits, np.array([0]), np.array([width]))


def _read_together(streams: list[BitReader], codes: list[PrefixCode], cache_bits: int, width: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """``_read_tokens`` of images of the same codes, with their widths and numbers of pixels."""
    sizes = np.array([len(bits.data) + 1 for bits in streams])  # a byte between them, as a stream may end at the next one's first bit
    starts = 8 * (np.cumsum(sizes) - sizes)
    p, ends = starts + [bits.at for bits in streams], starts + [bits.end for bits in streams]
    raw, ahead = _padded(b"\0".join(bits.data for bits in streams) + b"\0")
    at = _starts_together(ahead, p, ends, codes)
    image = np.searchsorted(starts, at, side="right") - 1
    at, image = at[at < ends[image]], image[at < ends[image]]
    s, colour, back, length, far = _tokens_at(raw, at, codes)
    size = np.ones(len(at), np.int64)
    size[back] = length
    first = np.searchsorted(image, np.arange(len(streams)))
    reach = np.concatenate([[0], np.cumsum(size)])
    before = reach[:-1] - reach[first][image]  # pixels of the image before the token
    used = before < n[image]
    if (before + size > n[image])[back[used[back]]].any():
        raise ValueError("a back-reference leaves the image")
    if (np.bincount(image[used], size[used], len(streams)) < n).any():
        raise ValueError("the bit stream ends early")
    last = np.cumsum(np.bincount(image[used], minlength=len(streams))) - 1
    kept = used[back]
    at, s, colour, place = at[used], s[used], colour[used], np.cumsum(used) - 1
    if (_ends(ahead, at[last], codes) > ends).any():
        raise ValueError("the bit stream ends early")
    argb = _resolved(s, colour, place[back[kept]], length[kept], far[kept], cache_bits, np.cumsum(n) - n, width)
    return np.split(argb, np.cumsum(n)[:-1])


def _ends(ahead: np.ndarray, at: np.ndarray, codes: list[PrefixCode]) -> np.ndarray:
    """Where the tokens at these bits end."""
    tables, masks = [c.table() for c in codes], [(1 << c.most) - 1 for c in codes]
    four = lambda q: ahead[q >> 3] >> (q & 7)
    code = tables[GREEN][four(at) & masks[GREEN]]
    q = at + (code & 15)
    literal = q
    for k in (RED, BLUE, ALPHA):
        literal = literal + (tables[k][four(literal) & masks[k]] & 15)
    back = q + (np.maximum(code - (258 << 4), 0) >> 5)
    far = tables[DISTANCE][four(back) & masks[DISTANCE]]
    back = back + (far & 15) + (np.maximum(far - 32, 0) >> 5)
    return np.where(code < 256 << 4, literal, np.where(code < 280 << 4, back, q))


_EIGHT = np.arange(8)


def _roots(above: np.ndarray) -> np.ndarray:
    """Where the way from each place ends, if every place names itself or one before it."""
    while True:
        further = above[above]
        if (further == above).all():
            return above
        above = further


def _resolved(s: np.ndarray, colour: np.ndarray, back: np.ndarray, lengths: np.ndarray, distances: np.ndarray, cache_bits: int, firsts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The pixels of the tokens of images that begin at the pixels ``firsts``.

    Every pixel but a literal names one before it that is the same, and so on to a literal.
    """
    above = None
    if len(back):
        size = np.ones(len(s), np.int64)
        size[back] = lengths
        starts = (np.cumsum(size) - size)[back]
        image = np.searchsorted(firsts, starts, side="right") - 1
        short = np.minimum(distances, 120) - 1
        far = np.where(distances > 120, distances - 120, np.maximum(1, _DISTANCE_X[short] + _DISTANCE_Y[short] * widths[image]))
        if (far > starts - firsts[image]).any():
            raise ValueError("a back-reference leaves the image")
        token = np.repeat(np.arange(len(s)), size)
        above = np.arange(len(token))
        ends = np.cumsum(lengths)
        above[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])] -= np.repeat(far, lengths)
        above = _roots(above)
        token = token[above]
        s, colour = s[token], colour[token]
    hit = s >= 280
    if not hit.any():
        return colour.astype("<u4")
    # A hit leaves the cache as it is: it is the same as the pixel before it in its slot; the first of a slot is zero.
    own = np.arange(len(s))
    slot = np.where(hit, s - 280, _slots(colour, cache_bits))
    if len(firsts) > 1:
        slot += np.repeat(np.arange(len(firsts)) << cache_bits, np.diff(firsts, append=len(s)))
    order = np.argsort(slot, kind="stable")
    ordered = slot[order]
    before = np.full(len(s), -1)
    before[order[1:]] = np.where(ordered[1:] == ordered[:-1], order[:-1], -1)
    fresh = hit if above is None else hit & (above == own)  # not copied
    empty = fresh & (before < 0)
    return np.where(empty, 0, colour)[_roots(np.where(fresh & ~empty, before, own if above is None else above))].astype("<u4")


def _slots(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    return ((argb.astype(np.uint32) * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)).astype(np.int64)


@dataclass
class _Head:
    """What stands before the pixels of an image."""

    cache_bits: int
    group_of: np.ndarray | None
    group_bits: int
    groups: list[list[PrefixCode]]
    tokens: bool  # one group of codes that ``_read_tokens`` takes


def _read_image(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    return _read_pixels(bits, _read_head(bits, width, height, main), width, height)


def _read_head(bits: BitReader, width: int, height: int, main: bool) -> _Head:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    group_of, group_bits, n_groups = None, 0, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        which = _read_image(bits, _up(width, group_bits), _up(height, group_bits), False)
        group_of = (which[..., 0].astype(int) << 8) | which[..., 1]
        n_groups = int(group_of.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_read_code(bits, s) for s in sizes] for _ in range(n_groups)]
    one = groups[0]
    tokens = main and group_of is None and (one[GREEN].single is None or (one[GREEN].single < 256 and any(one[k].single is None for k in (RED, BLUE, ALPHA))))
    return _Head(cache_bits, group_of, group_bits, groups, tokens and not _in_block(groups, cache_bits))


def _in_block(groups: list[list[PrefixCode]], cache_bits: int) -> bool:
    one = groups[0]
    return len(groups) == 1 and not cache_bits and all(one[k].fixed is not None and one[k].fixed <= 8 for k in (GREEN, RED, BLUE, ALPHA)) and bool(one[GREEN].symbols().max() < 256)


def _read_pixels(bits: BitReader, head: _Head, width: int, height: int) -> np.ndarray:
    cache_bits, group_of, group_bits, groups = head.cache_bits, head.group_of, head.group_bits, head.groups
    n = width * height
    one = groups[0]
    if _in_block(groups, cache_bits):
        return _read_block(bits, one, n).reshape(height, width, 4)

    if head.tokens:
        return _read_tokens(bits, one, cache_bits, width, n).view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]

    pixels: list[int] = []  # argb
    cache = [0] * (1 << cache_bits) if cache_bits else None
    while len(pixels) < n:
        if group_of is not None:
            y, x = divmod(len(pixels), width)
            one = groups[group_of[y >> group_bits, x >> group_bits]]
        s = one[GREEN].read(bits)
        before = len(pixels)
        if s < 256:
            red, blue, alpha = one[RED].read(bits), one[BLUE].read(bits), one[ALPHA].read(bits)
            pixels.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = _prefix_value(bits, s - 256)
            d = _prefix_value(bits, one[DISTANCE].read(bits))
            if d <= 120:
                dx, dy = DISTANCES[d - 1]
                d = max(1, dx + dy * width)
            else:
                d -= 120
            if d > before or before + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                pixels.append(pixels[-d])
        else:
            pixels.append(cache[s - 280])
        if cache is not None:
            for p in pixels[before:]:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(pixels, "<u4").view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]


def _average(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, top, top_left, top_right):
    """One predictor on int arrays (..., 4)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(-1, keepdims=True), np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        half = mean - top_left
        return np.clip(mean + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255]), np.shape(left))


_NEED_LEFT = {1, 5, 6, 7, 10, 11, 12, 13}


def _modes(tiles: np.ndarray, size_bits: int, width: int, y: int) -> np.ndarray:
    return np.repeat(tiles[y >> size_bits, :, 1] & 15, 1 << size_bits)[:width]


def _undo_predictor(rest: np.ndarray, tiles: np.ndarray, size_bits: int) -> np.ndarray:
    height, width, _ = rest.shape
    out = np.zeros((height, width, 4), np.int64)
    rest = rest.astype(np.int64)
    first = rest[0].copy()
    first[0, 3] += 255
    out[0] = np.cumsum(first, axis=0) & 255  # the first row is predicted from the left
    for y in range(1, height):
        top = out[y - 1]
        row = rest[y].copy()
        row[0] = (row[0] + top[0]) & 255  # the first column from above
        modes = _modes(tiles, size_bits, width, y)
        out[y, 0] = row[0]
        if (modes[1:] == 1).all():
            out[y] = np.cumsum(row, axis=0) & 255
            continue
        right = np.vstack([top[1:], row[:1]])  # right of the last pixel above lies the first of this row
        if not _NEED_LEFT.intersection(modes[1:].tolist()):
            for mode in np.unique(modes[1:]).tolist():
                k = np.flatnonzero(modes == mode)
                k = k[k > 0]
                out[y, k] = (row[k] + _predict(mode, top[k - 1], top[k], top[k - 1], right[k])) & 255
            continue
        for x in range(1, width):
            out[y, x] = (row[x] + _predict(int(modes[x]), out[y, x - 1], top[x], top[x - 1], right[x])) & 255
    return out.astype(np.uint8)


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int32) * c.astype(np.uint8).astype(np.int8).astype(np.int32)) >> 5


def _spread(tiles: np.ndarray, size_bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(tiles, 1 << size_bits, 0), 1 << size_bits, 1)[:height, :width]


def _undo_cross_colour(p: np.ndarray, tiles: np.ndarray, size_bits: int) -> np.ndarray:
    t = _spread(tiles, size_bits, *p.shape[:2])
    out = p.astype(np.int32)
    out[..., 0] = (out[..., 0] + _delta(t[..., 2], p[..., 1])) & 255
    out[..., 2] = (out[..., 2] + _delta(t[..., 1], p[..., 1]) + _delta(t[..., 0], out[..., 0])) & 255
    return out.astype(np.uint8)


def _undo_subtract_green(p: np.ndarray) -> np.ndarray:
    out = p.copy()
    out[..., 0] += p[..., 1]
    out[..., 2] += p[..., 1]
    return out


def _palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def _undo_palette(p: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    packed = _palette_bits(len(table))
    index = p[..., 1].astype(np.int64)
    if packed:
        each = 8 >> packed
        shifts = np.arange(1 << packed) * each
        index = ((index[..., None] >> shifts) & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    colours = np.zeros((256, 4), np.uint8)  # an index past the table is transparent black
    colours[: len(table)] = table
    return colours[index]


def _opened(data: bytes) -> tuple[BitReader, int, int, list[tuple], _Head]:
    """(stream at the pixels, width and height as coded, what undoes the transforms, head of the pixels) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = BitReader(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, coded_width = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            tiles = _read_image(bits, _up(coded_width, size_bits), _up(height, size_bits), False)
            undo.append((_undo_predictor if kind == PREDICTOR else _undo_cross_colour, (tiles, size_bits)))
        elif kind == SUBTRACT_GREEN:
            undo.append((_undo_subtract_green, ()))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_read_image(bits, n, 1, False)[0], axis=0, dtype=np.uint8)
            undo.append((_undo_palette, (table, coded_width)))
            coded_width = _up(coded_width, _palette_bits(n))
    return bits, coded_width, height, undo, _read_head(bits, coded_width, height, True)


def _undone(pixels: np.ndarray, undo: list[tuple]) -> np.ndarray:
    for f, args in reversed(undo):
        pixels = f(pixels, *args)
    return pixels


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) of a lossless WebP file."""
    bits, width, height, undo, head = _opened(data)
    return _undone(_read_pixels(bits, head, width, height), undo)


def decode_many(files: list[bytes]) -> Iterator[np.ndarray]:
    """``decode`` of every file; images of the same codes are read together, of ``TOGETHER_PIXELS`` in all (a file at least)."""
    some, pixels = [], 0
    for data in files:
        size = int.from_bytes(data[21:25], "little")
        n = ((size & 16383) + 1) * ((size >> 14 & 16383) + 1)
        if some and pixels + n > TOGETHER_PIXELS:
            yield from _decoded(some)
            some, pixels = [], 0
        some.append(data)
        pixels += n
    yield from _decoded(some)


def _decoded(files: list[bytes]) -> list[np.ndarray]:
    opened = [_opened(data) for data in files]
    alike: dict[tuple, tuple[list[list[int]], list[int]]] = {}
    for k, (bits, width, height, _, head) in enumerate(opened):
        if head.tokens and len(bits.data) <= SEGMENT_BYTES:
            groups, size = alike.setdefault((*head.groups[0], head.cache_bits), ([[]], [0]))
            if size[0] > TOGETHER_BYTES:
                groups.append([])
                size[0] = 0
            groups[-1].append(k)
            size[0] += len(bits.data)
    out: list[np.ndarray | None] = [None] * len(files)
    for some in (g for groups, _ in alike.values() for g in groups if len(g) >= LEAST_TOGETHER):
        head = opened[some[0]][4]
        width, height = (np.array([opened[k][x] for k in some]) for x in (1, 2))
        found = _read_together([opened[k][0] for k in some], head.groups[0], head.cache_bits, width, width * height)
        for k, argb in zip(some, found):
            _, w, h, undo, _ = opened[k]
            out[k] = _undone(argb.view(np.uint8).reshape(h, w, 4)[..., [2, 1, 0, 3]], undo)
    return [p if p is not None else _undone(_read_pixels(bits, head, width, height), undo) for p, (bits, width, height, undo, head) in zip(out, opened)]


# ---- writing ----


def _as_bits(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lowest ``sizes`` bits of each value, least significant first."""
    parts = []
    for k in range(0, len(values), 1 << 16):  # bounded memory for very long texts
        v, n = values[k : k + (1 << 16)], sizes[k : k + (1 << 16)]
        rest = np.repeat(v, n)
        rest >>= np.arange(len(rest)) - np.repeat(np.cumsum(n) - n, n)
        parts.append(rest.astype(np.uint8) & np.uint8(1))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


class BitWriter:
    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def put_bits(self, bits: np.ndarray) -> None:
        self._flush()
        self.parts.append(bits)

    def _flush(self) -> None:
        if self.values:
            self.parts.append(_as_bits(np.array(self.values, np.int64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def bits(self) -> np.ndarray:
        """All bits so far, one in a byte."""
        self._flush()
        return np.concatenate(self.parts)

    def done(self) -> bytes:
        return np.packbits(self.bits(), bitorder="little").tobytes()


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for ``counts``, at most ``most`` bits (counts are flattened until it fits)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    m = len(used)
    own = counts[used].astype(np.int64)
    while True:
        heap = [c << 16 | k for k, c in enumerate(own.tolist())]  # a node's number in the lowest bits
        heapq.heapify(heap)
        above = [0] * (2 * m - 1)
        for new in range(m, 2 * m - 1):
            a = heapq.heappop(heap)
            b = heap[0]
            heapq.heapreplace(heap, ((a >> 16) + (b >> 16)) << 16 | new)
            above[a & 0xFFFF] = above[b & 0xFFFF] = new
        depth = [0] * (2 * m - 1)
        for k in range(2 * m - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:m]) <= most:
            lengths[used] = depth[:m]
            return lengths
        own = (own >> 1) + 1


@lru_cache(maxsize=64)
def _plain_code(symbols: int, size: int, lone: int | None) -> np.ndarray:
    """Bits that describe a code of one symbol, or of the first 256 at eight bits each."""
    lengths = np.zeros(size, np.int64)
    lengths[lone if lone is not None else slice(0, symbols)] = 1 if lone is not None else 8
    out = BitWriter()
    _put_code(out, lengths)
    return out.bits()


def _put_code(out: BitWriter, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a code and return (stream bits, length) by symbol."""
    values, sizes = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (len(used) == 0 or used[0] < 256):
        out.put(1, 1)
        out.put(0, 1)
        out.put(1, 1)
        out.put(int(used[0]) if len(used) else 0, 8)
        return values, sizes
    out.put(0, 1)
    runs: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    edges = np.flatnonzero(np.diff(lengths, prepend=-1))
    for v, n in zip(lengths[edges].tolist(), np.diff(edges, append=len(lengths)).tolist()):
        if v:
            runs.append((v, 0, 0))
            n -= 1
        while n >= 3:
            m = min(n, 6 if v else 138)
            runs.append((16, m - 3, 2) if v else (17, m - 3, 3) if m < 11 else (18, m - 11, 7))
            n -= m
        runs += [(v, 0, 0)] * n
    described = np.array(runs)
    own = code_lengths(np.bincount(described[:, 0], minlength=19), 7)
    out.put(15, 4)
    for n in own[list(CODE_LENGTH_ORDER)].tolist():
        out.put(n, 3)
    out.put(0, 1)
    own_values, own_sizes = np.zeros(19, np.int64), np.zeros(19, np.int64)
    if np.count_nonzero(own) > 1:
        symbols, code, n = canonical(own)
        own_values[symbols], own_sizes[symbols] = code, n
    described_values = np.column_stack([own_values[described[:, 0]], described[:, 1]])
    out.put_bits(_as_bits(described_values.reshape(-1), np.column_stack([own_sizes[described[:, 0]], described[:, 2]]).reshape(-1)))
    if len(used) > 1:
        symbols, code, n = canonical(lengths)
        values[symbols], sizes[symbols] = code, n
    return values, sizes


def _value_prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra value, extra bits) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    extra = v.bit_length() - 2
    second = (v >> extra) & 1
    return 2 * (extra + 1) + second, v & ((1 << extra) - 1), extra


@dataclass(frozen=True)
class Options:
    """What ``encode`` uses. The default is one eight-bit code for all bytes, which is read in blocks."""

    transforms: tuple[int, ...] = ()
    predictor_mode: int | None = None  # None: every mode in turn, tile by tile
    tile_bits: int = 2
    cache_bits: int = 0
    references: bool = False
    entropy: bool = False  # prefix codes by frequency
    groups: bool = False  # two groups of codes in turn, tile by tile
    common: bool = False  # prefix codes of any text, not of the image's own frequencies
    cross: tuple[int, int, int] | None = None  # green to red, green to blue and red to blue; None: any, tile by tile


@lru_cache(maxsize=64)
def _near(width: int) -> dict[int, int]:
    """The short codes of distances in an image that wide."""
    return {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(DISTANCES)))}


def _matches(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of back-references: from left to right, each to the last place that goes on alike."""
    n = len(argb)
    if n <= LEAST_MATCH:
        return []
    wide = argb.astype(np.uint64)
    key = wide[:-2] | wide[1:-1] << np.uint64(32)
    key = (key ^ key >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93) + wide[2:] * np.uint64(0x9E3779B97F4A7C15)
    low = np.uint64((1 << n.bit_length()) - 1)
    ordered = np.sort(key & ~low | np.arange(len(key), dtype=np.uint64))  # by key, then by place
    order = (ordered & low).astype(np.int64)
    same = np.flatnonzero(ordered[1:] ^ ordered[:-1] <= low)
    before = np.full(len(key), -1)
    before[order[same + 1]] = order[same]
    places = np.flatnonzero(before >= 0)
    out, at = [], 0
    raw = argb.tobytes()
    for k, start in zip(places.tolist(), before[places].tolist()):
        if k < at:
            continue
        most = min(MOST_MATCH, n - k)
        length = min(16, most)
        a, b = raw[4 * k : 4 * (k + length)], raw[4 * start : 4 * (start + length)]
        if a != b:
            other = int.from_bytes(a, "little") ^ int.from_bytes(b, "little")
            length = ((other & -other).bit_length() - 1) >> 5
        elif most > 16:
            other = argb[k : k + most] != argb[start : start + most]
            length = int(other.argmax())
            length = length if other[length] else most
        if length >= LEAST_MATCH:
            out.append((k, length, k - start))
            at = k + length
    return out


def _cached(argb: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each pixel, and whether its colour is there: the last pixel of the slot was the same."""
    slot = _slots(argb, cache_bits)
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    in_order, hit = argb[order], np.zeros(len(argb), bool)
    hit[order[1:]] = in_order[1:] == in_order[:-1]  # equal colours have one slot
    return slot, hit


#: Frequencies of bytes of any text, as everyone knows them of letters; no byte is without a code.
_COMMON = {" ": 900, "e": 500, "t": 375, "a": 325, "o": 310, "i": 285, "n": 285, "s": 260, "r": 250, "h": 250, "d": 175, "l": 165, "c": 125, "u": 120, "m": 100, "w": 90, "f": 90, "g": 85, "y": 80, "p": 75, "b": 60, "v": 40, "k": 35, ".": 50, ",": 50, "\n": 40}
CACHE_BITS = 8  # of an image with common codes
SAVED_BITS = 1 << 13  # what codes of its own must save to be worth their making


@lru_cache(maxsize=16)
def _common_code(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits that describe it, stream bits, length) by symbol of the common code of an alphabet of that size."""
    counts = np.ones(size, np.int64)
    if size >= 256:
        counts[32:127] = 8
        counts[[ord(c) for c in _COMMON]] = list(_COMMON.values())
        counts[128:192] = 6
        counts[256:264] = 16
        counts[280:] = 8
    out = BitWriter()
    values, sizes = _put_code(out, code_lengths(counts, 15))
    return out.bits(), values, sizes


def _outside(n: int, matches: list[tuple[int, int, int]]) -> np.ndarray | slice:
    """Places of the ``n`` pixels outside of ``matches``."""
    if not matches:
        return np.arange(n)
    edge = np.zeros(n + 1, np.int64)
    first, length, _ = np.array(matches).T
    edge[first] += 1
    edge[first + length] -= 1
    return np.flatnonzero(np.cumsum(edge[:-1]) == 0)


def _symbols(argb: np.ndarray, places: np.ndarray, cache_bits: int) -> np.ndarray:
    """Green symbols of the pixels at ``places``, those outside of references."""
    green = (argb >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if cache_bits:
        slot, hit = _cached(argb, cache_bits)
        green[hit] = 280 + slot[hit]
    return green[places]


def _information(counts: np.ndarray) -> float:
    """Bits that symbols of these counts take, and about those of their code."""
    used = int(np.count_nonzero(counts))
    if used <= 1:
        return 0.0
    n = int(np.add.reduce(counts))
    if n < len(_N_LOG_N):
        return float(_N_LOG_N[n] - np.add.reduce(_N_LOG_N[counts])) + 5 * used
    c = counts[counts > 0].astype(np.float64)
    return n * math.log2(n) - float((c * np.log2(c)).sum()) + 5 * used


_N_LOG_N = np.arange(1 << 14) * np.log2(np.maximum(1, np.arange(1 << 14)))


def _prefixes(matches: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Of the lengths and distances of ``matches``: prefix, extra value, extra bits; short codes of distances left out."""
    return (np.array([_value_prefix(m[1]) for m in matches]), np.array([_value_prefix(m[2] + 120) for m in matches])) if matches else None


def _costs(argb: np.ndarray, places: np.ndarray, symbols: np.ndarray, prefixes: tuple[np.ndarray, np.ndarray] | None, cache_bits: int) -> tuple[float, float]:
    """About the bits of an image with these features: with codes of its own, and (if there is one alpha) with common codes."""
    literal = argb[places[symbols < 256]].astype(np.int64)
    green = np.bincount(symbols, minlength=280 + (1 << cache_bits if cache_bits else 0))
    bits, own_codes, bits_common = 0.0, 0.0, 0.0
    if prefixes:
        lengths, far = prefixes
        green[256:280] += np.bincount(lengths[:, 0], minlength=24)
        bits = float(lengths[:, 2].sum() + far[:, 2].sum())
        own_codes = _information(np.bincount(far[:, 0]))
        bits_common = bits + 5.2 * len(lengths)
    channels = np.bincount(np.concatenate([literal & 255, (literal >> 16 & 255) + 256]), minlength=512)
    own_codes += _information(green) + _information(channels[:256]) + _information(channels[256:])
    size = _common_code(256)[2]
    bits_common += float((green * _common_code(len(green))[2]).sum() + (channels.reshape(2, 256) * size).sum())
    alpha = literal >> 24
    if len(alpha) and (alpha != alpha[0]).any():
        return bits + own_codes + _information(np.bincount(alpha)), np.inf
    return bits + own_codes, bits_common + _common_bits(len(green))


@lru_cache(maxsize=16)
def _common_bits(size: int) -> int:
    """Bits that describe the common codes of an image with a green alphabet of that size."""
    return sum(len(_common_code(k)[0]) for k in (size, 256, 256, 40))


def _argb(p: np.ndarray) -> np.ndarray:
    return p.reshape(-1, 4)[:, [2, 1, 0, 3]].copy().view("<u4")[:, 0]


def _tokens_of(argb: np.ndarray, o: Options) -> tuple:
    """(pixels, back-references, their prefixes, places outside of them, green symbols there)."""
    matches = _matches(argb) if o.references else []
    places = _outside(len(argb), matches)
    return argb, matches, _prefixes(matches), places, _symbols(argb, places, o.cache_bits)


def _put_image(out: BitWriter, p: np.ndarray, o: Options, main: bool, tokens: tuple | None = None) -> None:
    height, width, _ = p.shape
    n = width * height
    plain = not (o.entropy or o.common or o.references or o.cache_bits or o.groups) or not main
    cache_bits = 0 if plain else o.cache_bits
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    grouped = main and o.groups
    if main:
        out.put(int(grouped), 1)
        if grouped:
            out.put(0, 3)  # tiles of four
            th, tw = _up(height, 2), _up(width, 2)
            which = np.zeros((th, tw, 4), np.uint8)
            which[..., 1] = np.add.outer(np.arange(th), np.arange(tw)) & 1
            _put_image(out, which, Options(), False)
    flat = p.reshape(n, 4)
    if plain:
        single = [bool((flat[:, c] == flat[0, c]).all()) for c in (1, 0, 2, 3)]
        for c, one in zip((1, 0, 2, 3), single):
            out.put_bits(_plain_code(256, 280 if c == 1 else 256, int(flat[0, c]) if one else None))
        out.put_bits(_plain_code(0, 40, 0))
        kept = [c for c, one in zip((1, 0, 2, 3), single) if not one]
        if kept:  # the code of a byte is the byte, highest bit first
            out.put_bits(np.unpackbits(flat[:, kept].reshape(-1)))
        return
    argb, matches, prefixes, places, symbols = tokens or _tokens_of(_argb(p), o)
    literal = symbols < 256
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    near = _near(width)
    far = [_value_prefix(near.get(d, d + 120)) for _, _, d in matches]
    if matches:
        at = np.array([m[0] for m in matches])
        length_code, far_code = prefixes[0], np.array(far)
        every, back = np.concatenate([places, at]), np.concatenate([symbols, 256 + length_code[:, 0]])
    else:
        every, back = places, symbols
    if not grouped:
        pixels, group = argb[places[literal]].astype(np.int64), None
        counts = lambda: [np.bincount(back, minlength=sizes[GREEN]), *(np.bincount(pixels >> k & 255, minlength=256) for k in (16, 0, 24)), np.bincount(far_code[:, 0], minlength=40) if matches else np.zeros(40, np.int64)]
        if o.common:
            for k in (GREEN, RED, BLUE):
                out.put_bits(_common_code(sizes[k])[0])
            out.put_bits(_plain_code(0, 256, int(flat[0, 3])))
            out.put_bits(_common_code(40)[0])
            one = [_common_code(sizes[k])[1:] for k in (GREEN, RED, BLUE)] + [None, _common_code(40)[1:]]
        else:
            one = [_put_code(out, code_lengths(x, 15) if x.any() else x) for x in counts()]
        # All bits of a token are one number: 62 at most.
        value, bits = one[GREEN][0][back], one[GREEN][1][back]
        own = np.flatnonzero(literal)
        own_value, own_bits = value[own], bits[own]
        for k, shift in ((RED, 16), (BLUE, 0), (ALPHA, 24))[: 2 if o.common else 3]:  # a lone alpha takes no bits
            c = pixels >> shift & 255
            own_value |= one[k][0][c] << own_bits
            own_bits += one[k][1][c]
        value[own], bits[own] = own_value, own_bits
        if matches:
            m = len(places)
            for more, size in (length_code[:, 1:].T, (one[DISTANCE][0][far_code[:, 0]], one[DISTANCE][1][far_code[:, 0]]), far_code[:, 1:].T):
                value[m:] |= more << bits[m:]
                bits[m:] += size
            order = np.argsort(every)
            value, bits = value[order], bits[order]
        out.put_bits(_as_bits(value, bits))
        return
    rest = flat[places].astype(np.int64)
    group = which[(every // width) >> 2, (every % width) >> 2, 1].astype(np.int64)
    m = len(places)
    codes = []
    for g in range(2):
        if o.common:
            known = [_common_code(x) for x in (sizes[GREEN], 256, 256)]
            for k in known:
                out.put_bits(k[0])
            lone = np.zeros(256, np.int64)
            lone[int(flat[0, 3])] = 1
            codes.append([k[1:] for k in known] + [_put_code(out, lone)])
            known = _common_code(40)
            out.put_bits(known[0])
            codes[0].append(known[1:])
            continue
        lit = literal & (group[:m] == g)
        counts = [np.bincount(back[group == g], minlength=sizes[GREEN]), *(np.bincount(rest[lit, c], minlength=256) for c in (0, 2, 3))]
        counts.append(np.bincount(far_code[group[m:] == g, 0], minlength=40) if matches else np.zeros(40, np.int64))
        codes.append([_put_code(out, code_lengths(x, 15) if x.any() else x) for x in counts])
    table = lambda k, part: np.stack([c[k][part] for c in codes])
    values, bits = np.zeros((len(every), 4), np.int64), np.zeros((len(every), 4), np.int64)
    values[:, 0], bits[:, 0] = table(GREEN, 0)[group, back], table(GREEN, 1)[group, back]
    own = np.flatnonzero(literal)
    for column, (k, channel) in enumerate(((RED, 0), (BLUE, 2), (ALPHA, 3)), 1):
        values[own, column], bits[own, column] = table(k, 0)[group[own], rest[own, channel]], table(k, 1)[group[own], rest[own, channel]]
    if matches:
        values[m:, 1], bits[m:, 1] = length_code[:, 1], length_code[:, 2]
        values[m:, 2], bits[m:, 2] = table(DISTANCE, 0)[group[m:], far_code[:, 0]], table(DISTANCE, 1)[group[m:], far_code[:, 0]]
        values[m:, 3], bits[m:, 3] = far_code[:, 1], far_code[:, 2]
        order = np.argsort(every)
        values, bits = values[order], bits[order]
    out.put_bits(_as_bits(values.reshape(-1), bits.reshape(-1)))


def _predicted(p: np.ndarray, tiles: np.ndarray, size_bits: int) -> np.ndarray:
    q = p.astype(np.int64)
    height, width, _ = q.shape
    guess = np.zeros_like(q)
    guess[0, 0] = (0, 0, 0, 255)
    guess[0, 1:] = q[0, :-1]
    guess[1:, 0] = q[:-1, 0]
    if height > 1 and width > 1:
        modes = _spread(tiles[..., 1] & 15, size_bits, height, width)[1:, 1:]
        left, top, top_left = q[1:, :-1], q[:-1, 1:], q[:-1, :-1]
        top_right = np.concatenate([q[:-1, 2:], q[1:, :1]], axis=1)  # right of the last pixel above lies the first of this row
        for mode in np.unique(modes).tolist():
            at = modes == mode
            guess[1:, 1:][at] = _predict(mode, left[at], top[at], top_left[at], top_right[at])
    return ((q - guess) & 255).astype(np.uint8)


#: Predictors that are undone row by row.
_BY_ROWS = (1, 2, 3, 4, 8, 9)


def _fitted(p: np.ndarray) -> tuple[tuple[int, int, int], float]:
    """Multipliers of the cross-colour transform that leave the least squares, and the greater share of a channel's squares that they take."""
    green, red, blue = (c - c.mean() for c in p.reshape(-1, 4)[:, [1, 0, 2]].T.astype(np.int8).astype(np.float64))
    product = lambda a, b: float((a * b).sum())  # noqa: E731 - a dot product would start threads of its own
    spread = product(green, green)
    if not spread:
        return (0, 0, 0), 0.0
    with_red, with_blue = product(green, red), product(green, blue)
    share = max(x * x / (spread * product(c, c)) if x else 0.0 for x, c in ((with_red, red), (with_blue, blue)))
    to_red, to_blue = (min(127, max(-128, round(32 * x / spread))) for x in (with_red, with_blue))
    return (to_red & 255, to_blue & 255, 0), share


_OFFSETS = np.arange(4) * 256


def _channels(p: np.ndarray) -> float:
    """About the bits of all pixels as literals."""
    c = np.bincount((p.reshape(-1, 4) + _OFFSETS).reshape(-1))
    c = c[c > 0].astype(np.float64)
    n = p.size // 4
    return 4 * n * float(np.log2(n)) - float((c * np.log2(c)).sum()) + 5 * len(c)


def best(pixels: np.ndarray) -> Options:
    """The features that make ``pixels`` small, by the information of what they leave."""
    return _chosen(pixels)[0]


def _chosen(pixels: np.ndarray) -> tuple[Options, np.ndarray, list[tuple], tuple | None]:
    """(options, what their transforms leave, the transforms, the tokens as ``_tokens_of`` gives them).

    Transforms are compared where they may save: subtract-green and fitted cross-colour multipliers where channels go together
    (a fourth of the squares at least; a weaker fit saves less than a quarter of a bit), predictors where a fourth of the pixels
    hold as they are, a palette where each colour comes twice. Then come back-references, a colour cache, and
    codes of the image's own where these save more than ``SAVED_BITS`` over common ones.
    """
    argb = _argb(pixels)
    n, width = len(argb), pixels.shape[1]
    plain, trials = (Options(), pixels, []), []
    cross, share = _fitted(pixels)
    if share > 0.25:
        trials += [Options(transforms=(SUBTRACT_GREEN,)), Options(transforms=(CROSS_COLOUR,), cross=cross, tile_bits=9)]
    if max(np.count_nonzero(argb[d:] == argb[:-d]) if 0 < d < n else 0 for d in (1, width, width - 1, width + 1)) > n / 4:
        trials += [Options(transforms=(PREDICTOR,), predictor_mode=k, tile_bits=9) for k in _BY_ROWS]
    chosen = plain
    if trials:
        least = _channels(pixels)
        for o in trials:
            q, described = _transformed(pixels, o)
            cost = _channels(q)
            if cost < least:
                chosen, least = (o, q, described), cost
    forms = [plain] if chosen is plain else [plain, chosen]
    if len(set(argb[:320].tolist())) <= 256 and len(set(argb[:1024].tolist())) <= 256 and 2 * (colours := len(np.unique(argb))) <= min(n, 512):
        o = Options(transforms=(PALETTE,))
        forms.append((o, *_transformed(pixels, o)))
    out, lowest = None, np.inf
    for o, q, described in forms:
        own = argb if q is pixels else _argb(q)
        matches = _matches(own)
        places, prefixes = _outside(len(own), matches), _prefixes(matches)
        extra = 24 * colours if o.transforms == (PALETTE,) else 0
        for cache_bits in (0, CACHE_BITS):
            symbols = _symbols(own, places, cache_bits)
            by_own, by_common = _costs(own, places, symbols, prefixes, cache_bits)
            for cost, entropy in ((by_common, False), (by_own + SAVED_BITS, True)):
                if cost + extra < lowest:
                    lowest = cost + extra
                    out = replace(o, entropy=entropy, common=not entropy, cache_bits=cache_bits, references=bool(matches)), q, described, (own, matches, prefixes, places, symbols)
    flat = pixels.reshape(-1, 4)
    return out if lowest < 8 * n * int((flat != flat[0]).any(0).sum()) + 1000 else (*plain, None)


def encode_small(pixels: np.ndarray) -> bytes:
    """``encode`` with the options that ``best`` names."""
    return _written(pixels, *_chosen(pixels))


def _transformed(p: np.ndarray, o: Options) -> tuple[np.ndarray, list[tuple]]:
    """What the transforms leave, and of each its kind, the bits of a tile's side and its own image."""
    described = []
    for kind in o.transforms:
        size_bits = o.tile_bits
        shape = (_up(p.shape[0], size_bits), _up(p.shape[1], size_bits), 4)
        if kind == PREDICTOR:
            tiles = np.zeros(shape, np.uint8)
            tiles[..., 1] = (np.arange(shape[0] * shape[1]) % 14).reshape(shape[:2]) if o.predictor_mode is None else o.predictor_mode
            p = _predicted(p, tiles, size_bits)
        elif kind == CROSS_COLOUR:
            tiles = np.random.default_rng(shape[1]).integers(0, 256, shape, np.uint8)
            if o.cross is not None:
                tiles[:] = (o.cross[2], o.cross[1], o.cross[0], 255)
            t, q = _spread(tiles, size_bits, *p.shape[:2]), p.astype(np.int32)
            q[..., 0] -= _delta(t[..., 2], p[..., 1])
            q[..., 2] -= _delta(t[..., 1], p[..., 1]) + _delta(t[..., 0], p[..., 0])
            p = (q & 255).astype(np.uint8)
        elif kind == SUBTRACT_GREEN:
            tiles, p = None, p.copy()
            p[..., 0] -= p[..., 1]
            p[..., 2] -= p[..., 1]
        else:
            table, index = np.unique(_argb(p), return_inverse=True)
            if len(table) > 256:
                raise ValueError("more than 256 colours")
            tiles = table.astype("<u4").view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]]
            packed = _palette_bits(len(table))
            wide = np.zeros((p.shape[0], _up(p.shape[1], packed) << packed), np.int64)
            wide[:, : p.shape[1]] = index.reshape(p.shape[:2])
            green = (wide.reshape(p.shape[0], -1, 1 << packed) << (np.arange(1 << packed) * (8 >> packed))).sum(-1)
            p = np.zeros((*green.shape, 4), np.uint8)
            p[..., 1], p[..., 3] = green, 255
        described.append((kind, size_bits, tiles))
    return p, described


def encode(pixels: np.ndarray, options: Options = Options()) -> bytes:
    """A lossless WebP file of ``pixels`` (height, width, 4), each side 1 to 16384."""
    return _written(pixels, options, *_transformed(pixels, options), None)


def _written(pixels: np.ndarray, options: Options, p: np.ndarray, described: list[tuple], tokens: tuple | None) -> bytes:
    height, width, _ = pixels.shape
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int((pixels[..., 3] != 255).any()), 1)
    out.put(0, 3)
    for kind, size_bits, own in described:
        out.put(1, 1)
        out.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            out.put(size_bits - 2, 3)
            _put_image(out, own, Options(), False)
        elif kind == PALETTE:
            out.put(len(own) - 1, 8)
            _put_image(out, np.diff(own, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)[None], Options(), False)
    out.put(0, 1)
    _put_image(out, p, options, True, tokens)
    body = out.done()
    size = len(body)
    body += b"\0" * (size & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", size) + body
