"""Personal data: exact patterns, and a character BiLSTM with a CRF that adds spans to them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
HIDDEN, WINDOW, CONTEXT = 8, 160, 16
STRIDE = WINDOW - 2 * CONTEXT
#: Windows that run in step; with WINDOW and HIDDEN this bounds a task's memory.
STEP_WINDOWS = 2_048
#: Bounds of the training sample: documents (those whose ids hash lowest), pieces cut from each,
#: whatever its length, windows made of the pieces, and steps over the windows.
TRAIN_DOCS, TRAIN_PIECES, TRAIN_WINDOWS, TRAIN_STEPS = 200, 15, 3_000, 240
#: Spans that the model adds have so many characters at least.
LEAST = 7
PAD, OTHER = 129, 128

# The four patterns.  Each can begin only where a run of its first characters begins
# or where the match before it ended, which the lookbehinds state; so no text takes quadratic time.
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_EMAIL_ON = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_AT = re.compile(r"@|\bat\b")
_NOT_DIGIT = re.compile(r"[^0-9]")
_NUMBERS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        m = (at and _EMAIL_ON.match(text, at)) or _EMAIL.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; kinds by their place in KINDS.  Failing matches are dropped, not retried."""
    text = text or ""
    if not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def symbols(text: str) -> np.ndarray:
    """Code points; all from U+0080 on are one symbol."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), OTHER).astype(np.uint8)


@dataclass
class Tagger:
    """Per direction: input (130, 4H), recurrence (H, 4H), gates in the order i, f, o, g; output (2H, 5); bias; moves (5, 5)."""

    wx: list[np.ndarray]
    u: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.wx, *self.u, self.out, self.bias, self.moves]

    @staticmethod
    def of(a: list[np.ndarray]) -> Tagger:
        return Tagger(list(a[0:2]), list(a[2:4]), *a[4:])


def fresh(seed: int = 0, hidden: int = HIDDEN) -> Tagger:
    rng, n = np.random.default_rng(seed), len(KINDS) + 1
    wx = [rng.normal(0, 0.3, (PAD + 1, 4 * hidden)) for _ in range(2)]
    for w in wx:
        w[:, hidden : 2 * hidden] += 1.0
    return Tagger(wx, [rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)) for _ in range(2)], rng.normal(0, 0.3, (2 * hidden, n)), np.zeros(n), np.zeros((n, n)))


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(wx: np.ndarray, u: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (T, B, H) of one direction over x (B, T), with what the way back needs."""
    b, t_max = x.shape
    h_n = u.shape[0]
    h, c = np.zeros((b, h_n)), np.zeros((b, h_n))
    hs, kept = np.empty((t_max, b, h_n)), []
    for t in range(t_max):
        z = wx[x[:, t]] + h @ u
        s, g = _sig(z[:, : 3 * h_n]), np.tanh(z[:, 3 * h_n :])
        i, f, o = s[:, :h_n], s[:, h_n : 2 * h_n], s[:, 2 * h_n :]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        kept.append((h, c, i, f, o, g, tc))
        h, c = o * tc, c2
        hs[t] = h
    return hs, kept


def _back(u: np.ndarray, x: np.ndarray, kept: list, dh_all: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h_n = u.shape[0]
    dwx, du = np.zeros((PAD + 1, 4 * h_n)), np.zeros_like(u)
    dh, dc = np.zeros((x.shape[0], h_n)), np.zeros((x.shape[0], h_n))
    for t in range(len(kept) - 1, -1, -1):
        h, c, i, f, o, g, tc = kept[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        du += h.T @ dz
        np.add.at(dwx, x[:, t], dz)
        dh, dc = dz @ u.T, dc * f
    return dwx, du


def loss_and_gradient(m: Tagger, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of labels y (B, T) under the CRF, and its gradient by arrays()."""
    b, t_max = x.shape
    back = x[:, ::-1]
    hf, kf = _run(m.wx[0], m.u[0], x)
    hb, kb = _run(m.wx[1], m.u[1], back)
    h = np.concatenate([hf, hb[::-1]], 2)
    e = h @ m.out + m.bias  # (T, B, L)
    n = e.shape[2]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]

    def lse(v: np.ndarray, axis: int) -> np.ndarray:
        top = v.max(axis, keepdims=True)
        return (np.log(np.exp(v - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for t in range(1, t_max):
        alpha[t] = lse(alpha[t - 1][:, :, None] + m.moves, 1) + e[t]
    for t in range(t_max - 2, -1, -1):
        beta[t] = lse(m.moves + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = lse(alpha[-1], 1)
    rows = np.arange(b)
    gold = sum(e[t][rows, y[:, t]] for t in range(t_max)) + m.moves[y[:, :-1], y[:, 1:]].sum(1)
    de = np.exp(alpha + beta - z[None, :, None])
    dm = np.zeros((n, n))
    for t in range(1, t_max):
        dm += np.exp(alpha[t - 1][:, :, None] + m.moves + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
    for t in range(t_max):
        de[t][rows, y[:, t]] -= 1
    np.add.at(dm, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
    dh = de @ m.out.T
    h_n = m.u[0].shape[0]
    df = _back(m.u[0], x, kf, dh[:, :, :h_n])
    db = _back(m.u[1], back, kb, dh[::-1, :, h_n:])
    grads = [df[0], db[0], df[1], db[1], np.einsum("tbh,tbl->hl", h, de), de.sum((0, 1)), dm]
    return float((z - gold).mean()), [g / b for g in grads]


def train(x: np.ndarray, y: np.ndarray, steps: int = TRAIN_STEPS, batch: int = 96, seed: int = 0, hidden: int = HIDDEN) -> Tagger | None:
    """Adam on random batches of labelled windows; None, which tags nothing, where there are none."""
    if not len(x):
        return None
    rng, model = np.random.default_rng(seed), fresh(seed, hidden)
    first = second = None
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        _, grads = loss_and_gradient(model, x[pick], y[pick])
        norm = np.sqrt(sum((g * g).sum() for g in grads))
        grads = [g * min(1.0, 25.0 / norm) for g in grads]
        first = [0.1 * g for g in grads] if first is None else [0.9 * a + 0.1 * g for a, g in zip(first, grads, strict=True)]
        second = [0.001 * g * g for g in grads] if second is None else [0.999 * a + 0.001 * g * g for a, g in zip(second, grads, strict=True)]
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        new = [p - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8) for p, a, b in zip(model.arrays(), first, second, strict=True)]
        model = Tagger.of(new)
    return model


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng: np.random.Generator) -> str:
    """16 digits that pass luhn()."""
    head = _digits(rng, 15)
    return head + next(d for d in "0123456789" if luhn(head + d))


def hidden_span(rng: np.random.Generator, word: str) -> tuple[int, str]:
    """A made-up span of one of the kinds in a form that the patterns do not know."""
    kind, d = int(rng.integers(0, 4)), lambda n: _digits(rng, n)
    word = re.sub(r"[^a-z]", "", word.lower()) or "name"
    if kind == 0:
        at, dot = [" at ", " [at] ", "(at)"][rng.integers(0, 3)], [" dot ", " [dot] ", "."][rng.integers(0, 3)]
        return 0, f"{word}{['', '.' + d(2), '_' + d(1)][rng.integers(0, 3)]}{at}{['mail' + d(1), 'post', 'web'][rng.integers(0, 3)]}{dot}example{dot}{['com', 'org', 'net'][rng.integers(0, 3)]}"
    if kind == 1:
        return 1, ["[.]", "(.)", " . "][rng.integers(0, 3)].join(str(rng.integers(1, 256)) for _ in range(4))
    if kind == 2:
        n = _card(rng)
        return 2, [".", "/", "  "][rng.integers(0, 3)].join(n[i : i + 4] for i in range(0, 16, 4))
    a, b, c = d(3), d(3), d(4)
    return 3, [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}"][rng.integers(0, 4)]


def plain_span(rng: np.random.Generator, word: str) -> tuple[int, str]:
    """A made-up span in a form of the patterns."""
    kind, d = int(rng.integers(0, 4)), lambda n: _digits(rng, n)
    word = re.sub(r"[^a-z]", "", word.lower()) or "name"
    if kind == 0:
        return 0, f"{word}{['', '.' + d(2), '_' + d(1)][rng.integers(0, 3)]}@{['mail' + d(1), 'post', 'web'][rng.integers(0, 3)]}.example.{['com', 'org', 'net'][rng.integers(0, 3)]}"
    if kind == 1:
        return 1, ".".join(str(rng.integers(1, 256)) for _ in range(4))
    if kind == 2:
        n = _card(rng)
        return 2, ["", " ", "-"][rng.integers(0, 3)].join(n[i : i + 4] for i in range(0, 16, 4))
    return 3, [f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}"][rng.integers(0, 2)]


def _decoy(rng: np.random.Generator) -> str:
    """Numbers and codes that are no personal data, numbers of 16 digits that fail luhn() among them."""
    hexes = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 40))
    card = _card(rng)
    wrong = card[:15] + str((int(card[15]) + int(rng.integers(1, 10))) % 10)
    day = f"{rng.integers(1990, 2040)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    return [
        f'token = "{hexes}"', str(rng.integers(0, 100_000)), f"{rng.integers(1, 20)}.{rng.integers(0, 20)}", str(rng.integers(1900, 2100)), f"v{rng.integers(0, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 9)}",
        f"{rng.integers(1, 999)},{rng.integers(100, 999)}.00", wrong, " ".join(wrong[i : i + 4] for i in range(0, 16, 4)), day, f"{day} {rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}:{rng.integers(0, 60):02d}",
        f"at {rng.integers(1, 12)} dot {rng.integers(1, 99)}", "looked at the dot on the line",
    ][rng.integers(0, 12)]


def pieces_of(text: str, n: int = TRAIN_PIECES) -> list[tuple[str, bytes]]:
    """n pieces of WINDOW characters of a text of any length and their labels (0 or kind + 1) by the patterns, some near spans."""
    rng, spans = np.random.default_rng(len(text)), base_spans(text)
    out = []
    for _ in range(n if text else 0):
        near = spans and rng.random() < 0.4
        at = max(0, spans[rng.integers(0, len(spans))][0] - int(rng.integers(0, STRIDE))) if near else int(rng.integers(0, max(1, len(text) - STRIDE)))
        piece, marks = text[at : at + WINDOW], np.zeros(WINDOW, np.uint8)
        for a, kind, b in spans:
            marks[max(0, a - at) : max(0, min(WINDOW, b - at))] = kind + 1
        out.append((piece, marks[: len(piece)].tobytes()))
    return out


def labelled_windows(pieces: list[tuple[str, bytes]], n: int = TRAIN_WINDOWS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the pieces with their labels; in two of three a made-up span or a decoy is put."""
    rng = np.random.default_rng(seed)
    n = n if pieces else 0
    xs, ys = np.full((n, WINDOW), PAD, np.uint8), np.zeros((n, WINDOW), np.uint8)
    for k in range(n):
        piece, labels = pieces[rng.integers(0, len(pieces))]
        marks = np.frombuffer(labels, np.uint8)
        gap = piece.find(" ", int(rng.integers(0, WINDOW)))
        if gap >= 0 and rng.random() < 2 / 3 and not marks[gap]:
            word, which = piece[:gap].rsplit(" ", 1)[-1], rng.random()
            kind, put = hidden_span(rng, word) if which < 0.5 else plain_span(rng, word) if which < 0.7 else (-1, _decoy(rng))
            piece = f"{piece[: gap + 1]}{put}{piece[gap:]}"
            marks = np.concatenate([marks[: gap + 1], np.full(len(put), kind + 1, np.uint8), marks[gap:]])
        start = int(rng.integers(0, CONTEXT)) if rng.random() < 0.1 else 0  # some windows start with padding, as those at a text's beginning do
        piece = piece[: WINDOW - start]
        xs[k, start : start + len(piece)] = symbols(piece)
        ys[k, start : start + len(piece)] = marks[: len(piece)]
    return xs, ys


def held_out_quality(model: Tagger | None, pieces: list[tuple[str, bytes]], n: int = 400, seed: int = 1) -> tuple[float, float]:
    """(precision, recall) of the added spans on pieces into each of which a made-up span that the patterns miss, or a decoy, is put."""
    rng, decoder = np.random.default_rng(seed), Decoder(model) if model else None
    right = added = planted = 0
    for _ in range(n if pieces else 0):
        piece = pieces[rng.integers(0, len(pieces))][0]
        gap = max(0, piece.find(" ", int(rng.integers(0, max(1, len(piece) // 2)))))
        kind, put = hidden_span(rng, piece[:gap].rsplit(" ", 1)[-1]) if rng.random() < 0.5 else (-1, _decoy(rng))
        text = f"{piece[: gap + 1]}{put}{piece[gap:]}"
        base = base_spans(text)
        new = set(reconcile(text, base, decoder.tag([text])[0] if decoder else [])) - set(base)
        hit = [s for s in new if s[1] == kind and s[0] < gap + 1 + len(put) and gap + 1 < s[2]]
        right, added, planted = right + len(hit), added + len(new), planted + (kind >= 0)
    return right / max(added, 1), right / max(planted, 1)


class Decoder:
    """Fast decoding of many windows in step, in single precision."""

    def __init__(self, m: Tagger) -> None:
        h = m.u[0].shape[0]
        half = np.r_[np.full(3 * h, 0.5), np.ones(h)]  # one tanh serves all gates: sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        self.wx = [np.ascontiguousarray((w * half).T, np.float32) for w in m.wx]
        self.u = [np.ascontiguousarray((u * half).T, np.float32) for u in m.u]
        self.out = [np.ascontiguousarray(m.out[:h].T, np.float32), np.ascontiguousarray(m.out[h:].T, np.float32)]
        self.bias, self.moves, self.h = m.bias.astype(np.float32), m.moves.astype(np.float32), h
        #: By so much at most can one move gain on staying outside.
        self.gain = float(m.moves.max() - m.moves[0, 0])

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(T, L, B) scores for windows x (T, B)."""
        t_max, b = x.shape
        h_n, e = self.h, np.empty((t_max, len(self.bias), b), np.float32)
        z, r, c, a = np.empty((4 * h_n, b), np.float32), np.empty((4 * h_n, b), np.float32), np.empty((h_n, b), np.float32), np.empty((h_n, b), np.float32)
        part = np.empty((len(self.bias), b), np.float32)
        for side in (0, 1):
            wx, u, out = self.wx[side], self.u[side], self.out[side]
            c[:], h = 0, np.zeros((h_n, b), np.float32)
            for t in range(t_max) if side == 0 else range(t_max - 1, -1, -1):
                np.take(wx, x[t], axis=1, out=z, mode="clip")
                np.matmul(u, h, out=r)
                z += r
                np.tanh(z, out=z)
                s = z[: 3 * h_n]
                s *= 0.5
                s += 0.5
                c *= z[h_n : 2 * h_n]
                np.multiply(z[:h_n], z[3 * h_n :], out=a)
                c += a
                np.tanh(c, out=a)
                np.multiply(z[2 * h_n : 3 * h_n], a, out=h)
                if side == 0:
                    np.matmul(out, h, out=e[t])
                else:
                    np.matmul(out, h, out=part)
                    e[t] += part
        e += self.bias[:, None]
        return e

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Viterbi labels (B, T) for windows x (B, T)."""
        out = np.zeros(x.shape, np.uint8)
        for at in range(0, len(x), STEP_WINDOWS):
            e = self.emissions(np.ascontiguousarray(x[at : at + STEP_WINDOWS].T).astype(np.intp))
            # where outside leads everywhere by more than any move can gain, the best path stays outside
            close = np.flatnonzero((e[:, 1:].max(1) - e[:, 0]).max(0) + max(self.gain, 0.0) >= 0)
            if len(close):
                out[at + close] = self._viterbi(e[:, :, close])
        return out

    def _viterbi(self, e: np.ndarray) -> np.ndarray:
        t_max, n, b = e.shape
        best, come = e[0], np.empty((t_max, n, b), np.uint8)
        for t in range(1, t_max):
            s = best[:, None, :] + self.moves[:, :, None]
            come[t] = s.argmax(0)
            best = s.max(0) + e[t]
        path = np.empty((b, t_max), np.uint8)
        path[:, -1] = best.argmax(0)
        for t in range(t_max - 1, 0, -1):
            path[:, t - 1] = come[t][path[:, t], np.arange(b)]
        return path

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Model spans (start, kind, end) of whole texts.

        Windows overlap by CONTEXT on either side; each character's label is that of the window
        whose middle holds it, and spans are the runs of equal labels over the whole text.
        """
        rows = [-(-len(t) // STRIDE) for t in texts]
        x = np.full((sum(rows), WINDOW), PAD, np.uint8)
        at = 0
        for text, n in zip(texts, rows, strict=True):
            if n:
                padded = np.full(n * STRIDE + 2 * CONTEXT, PAD, np.uint8)
                padded[CONTEXT : CONTEXT + len(text)] = symbols(text)
                x[at : at + n] = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]
                at += n
        found, at = self.labels(x)[:, CONTEXT : CONTEXT + STRIDE], 0
        out = []
        for text, n in zip(texts, rows, strict=True):
            flat = found[at : at + n].ravel()[: len(text)]
            at += n
            spans = []
            if flat.any():
                edge = np.flatnonzero(np.diff(flat)) + 1
                starts, ends = np.r_[0, edge], np.r_[edge, len(flat)]
                spans = [(int(a), int(flat[a]) - 1, int(b)) for a, b in zip(starts, ends, strict=True) if flat[a]]
            out.append(spans)
        return out


def plausible(text: str, kind: int) -> bool:
    """What a span of a kind must have beyond the model's word: an "at"; four numbers up to 255; 14 to 19 digits that pass luhn(); 7 to 15 digits."""
    if kind == 0:
        return bool(_AT.search(text))
    numbers = _NUMBERS.findall(text)
    if kind == 1:
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    digits = "".join(numbers)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def reconcile(text: str, base: list[tuple[int, int, int]], model: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the model spans that touch none of them, trimmed of what is no letter, digit or bracket.

    Of the latter those stay that have LEAST characters and are plausible().
    """
    out, i = list(base), 0
    for a, kind, b in model:
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        while i < len(base) and base[i][2] <= a:
            i += 1
        if b - a >= LEAST and not any(s < b and a < e for s, _, e in base[max(0, i - 4) : i + 4]) and plausible(text[a:b], kind):
            out.append((a, kind, b))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def sample(docs: DataFrame, n: int = TRAIN_DOCS, salt: int = 5) -> list[tuple[str, bytes]]:
    """Pieces of the n documents whose ids and texts hash lowest: n * TRAIN_PIECES of WINDOW characters at most.

    Texts of any length take part, and are cut where they are; only pieces go to the driver.  Of
    rows that repeat one is taken; null and empty texts give no pieces.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(salt), "doc_id", "text").alias("h")).where(F.length("text") > 0)
    total = rows.count()
    if not total:
        return []
    # hashes are even: about 2 n of the rows lie below this, and n of them at least but for a chance of e ** (-n / 4)
    below = -(2**63) + min(2**64 - 1, int(2**64 * 2 * n / total))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, k, *piece) for h, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k, piece in enumerate(pieces_of(text.as_py()))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())], names=["h", "k", "piece", "marks"])

    some = rows.where(F.col("h") <= below).groupBy("h").agg(F.first("text").alias("text"))
    got = sorted((r.h, r.k, r.piece, bytes(r.marks)) for r in some.mapInArrow(cut, "h long, k int, piece string, marks binary").collect())
    hashes = sorted({h for h, *_ in got})[:n]
    return [(piece, marks) for h, _, piece, marks in got if h <= hashes[-1]]


def fit(docs: DataFrame) -> Tagger | None:
    """Trains on windows of a bounded sample of documents (see sample()), labelled by the patterns and by made-up spans.

    None, which adds no spans, where no document has a text.
    """
    return train(*labelled_windows(sample(docs)))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """Per row: doc_id, numbers of base spans by kind, base_sha256, all spans, and how many the model added.

    Whole texts are searched; offsets are code points.  A null or empty text has no spans.  Rows
    that repeat are searched each; columns other than doc_id and text are not read.  Without a
    model the base spans are all; an empty table gives an empty result.
    """
    arrays = model.arrays() if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Tagger.of(arrays)) if arrays else None
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                texts, size = [], 0
                while at + len(texts) < len(ids) and size < 4 * STEP_WINDOWS * STRIDE:
                    texts.append(column[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                rows = []
                for text, added in zip(texts, decoder.tag(texts) if decoder else [[]] * len(texts), strict=True):
                    base = base_spans(text)
                    every = reconcile(text, base, added) if added else base
                    kinds = [k for _, k, _ in base]
                    rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at : at + len(texts)], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64())],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
