"""Personal data: fixed rules for four kinds, and a character-level BiLSTM-CRF that adds spans the rules miss."""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, index in KINDS

# The base rules of the four kinds.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]", re.IGNORECASE)
_DIGIT = re.compile(r"[0-9]")
_SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by start and then kind. Linear in the text, also on long runs of digits or letters.

    An e-mail is found from its @: the local part is what stands before it, back to the last match.
    An address of a host can only begin where a run of digits begins, as a later start in the same
    run fails or succeeds with it.
    """
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        before = text[last:at]
        start = last + len(before.rstrip(_LOCAL))
        last = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            last = m.end()
        at = text.find("@", last)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.groups()):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37:
                digits = re.sub("[^0-9]", "", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(m.group().count, "0123456789")) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


# --- the model -----------------------------------------------------------------------------------

LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WINDOW, STRIDE = 72, 24
#: Ids of characters: ASCII as it is, then other letters, other signs, and the filler after a text's end.
LETTER, SIGN, FILLER = 128, 129, 130
_FORBIDDEN = -1e4


def char_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = np.where(codes < 128, codes, LETTER).astype(np.int16)
    for i in np.flatnonzero(codes >= 128):
        if not text[i].isalpha():
            ids[i] = SIGN
    return ids


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, one LSTM in each direction, a linear layer and CRF transitions, all in numpy."""

    def __init__(self, hidden: int = 16, embed: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": draw(FILLER + 1, embed) * 3, "out": draw(2 * hidden, LABELS), "out_b": np.zeros(LABELS, np.float32), "trans": np.zeros((LABELS, LABELS), np.float32), "first": np.zeros(LABELS, np.float32)}
        for d in "fb":
            self.p |= {f"wx{d}": draw(embed, 4 * hidden), f"wh{d}": draw(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1  # forget gates start open
        self.mask = np.zeros((LABELS, LABELS), np.float32)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.mask[:, inside] = _FORBIDDEN
            self.mask[[inside - 1, inside], inside] = 0
        self.first_mask = np.zeros(LABELS, np.float32)
        self.first_mask[2::2] = _FORBIDDEN

    def _lstm(self, x, d: str, keep: bool):
        p, n, t, h = self.p, x.shape[0], x.shape[1], self.hidden
        given = x @ p[f"wx{d}"] + p[f"b{d}"]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, tape = np.empty((n, t, h), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            g = given[:, i] + state @ p[f"wh{d}"]
            gates = _sigmoid(g[:, : 3 * h])
            new = np.tanh(g[:, 3 * h :])
            old_cell, old_state = cell, state
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            squashed = np.tanh(cell)
            state = gates[:, 2 * h :] * squashed
            out[:, i] = state
            if keep:
                tape.append((i, gates, new, old_cell, squashed, old_state))
        return out, tape

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.p["emb"][ids]
        f, tape_f = self._lstm(x, "f", keep)
        b, tape_b = self._lstm(x, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["out"] + self.p["out_b"], (x, both, tape_f, tape_b)

    def viterbi(self, ems: list[np.ndarray]) -> list[np.ndarray]:
        """The best label path of each sequence of emissions (places by labels); sequences can differ in length."""
        trans = self.p["trans"] + self.mask
        order = sorted(range(len(ems)), key=lambda i: -len(ems[i]))
        size = np.array([len(ems[i]) for i in order])
        flat = np.concatenate([ems[i] for i in order])
        start = np.cumsum(size) - size
        back = np.zeros((len(flat), LABELS), np.int8)
        best = flat[start] + self.p["first"] + self.first_mask
        last = np.empty(len(order), np.int64)
        for t in range(1, int(size[0]) + 1):
            n = int(np.searchsorted(-size, -t))  # sequences that go on; the longest come first
            last[n : len(best)] = best[n:].argmax(1)
            if not n:
                break
            all_ = best[:n, :, None] + trans
            at = start[:n] + t
            back[at] = all_.argmax(1)
            best = all_.max(1) + flat[at]
        path = np.empty(len(flat), np.int64)
        now = last.copy()
        for t in range(int(size[0]) - 1, -1, -1):
            n = int(np.searchsorted(-size, -t))
            path[start[:n] + t] = now[:n]
            now[:n] = back[start[:n] + t, now[:n]]
        out: list = [None] * len(ems)
        for i, a, n in zip(order, start, size, strict=True):
            out[i] = path[a : a + n]
        return out

    def step(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the labels, and its gradients."""
        em, (x, both, tape_f, tape_b) = self.emissions(ids, True)
        em = em.astype(np.float64)
        n, t, _ = em.shape
        trans, first = (self.p["trans"] + self.mask).astype(np.float64), (self.p["first"] + self.first_mask).astype(np.float64)
        lse = lambda a, ax: (m := a.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(a - m).sum(ax))
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0] + first
        for i in range(1, t):
            alpha[:, i] = lse(alpha[:, i - 1][:, :, None] + trans, 1) + em[:, i]
        for i in range(t - 2, -1, -1):
            beta[:, i] = lse(trans + (em[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        d_em = np.exp(alpha + beta - z[:, None, None])
        d_first = d_em[:, 0].sum(0)
        d_trans = np.zeros_like(trans)
        for i in range(1, t):
            d_trans += np.exp(alpha[:, i - 1][:, :, None] + trans + (em[:, i] + beta[:, i])[:, None, :] - z[:, None, None]).sum(0)
        rows, cols = np.arange(n)[:, None], np.arange(t)[None, :]
        score = em[rows, cols, gold].sum() + first[gold[:, 0]].sum() + trans[gold[:, :-1], gold[:, 1:]].sum()
        d_em[rows, cols, gold] -= 1
        np.subtract.at(d_first, gold[:, 0], 1)
        np.subtract.at(d_trans, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        d_em = (d_em / n).astype(np.float32)
        grads = {"trans": np.where(self.mask < 0, 0, d_trans / n).astype(np.float32), "first": np.where(self.first_mask < 0, 0, d_first / n).astype(np.float32)}
        grads["out"] = np.einsum("nth,ntl->hl", both, d_em)
        grads["out_b"] = d_em.sum((0, 1))
        d_both = d_em @ self.p["out"].T
        d_x = self._back(x, "f", tape_f, d_both[:, :, : self.hidden], grads) + self._back(x, "b", tape_b, d_both[:, :, self.hidden :], grads)
        grads["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grads["emb"], ids.ravel(), d_x.reshape(-1, d_x.shape[2]))
        return float((z.sum() - score) / n), grads

    def _back(self, x, d: str, tape, d_out, grads):
        p, h = self.p, self.hidden
        n = x.shape[0]
        d_given = np.zeros((n, x.shape[1], 4 * h), np.float32)
        d_state, d_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        d_wh = np.zeros_like(p[f"wh{d}"])
        for i, gates, new, old_cell, squashed, old_state in reversed(tape):
            d_state = d_state + d_out[:, i]
            d_cell = d_cell + d_state * gates[:, 2 * h :] * (1 - squashed**2)
            raw = np.concatenate([d_cell * new, d_cell * old_cell, d_state * squashed], 1) * gates * (1 - gates)
            g = np.concatenate([raw, d_cell * gates[:, :h] * (1 - new**2)], 1)
            d_given[:, i] = g
            d_wh += old_state.T @ g
            d_state, d_cell = g @ p[f"wh{d}"].T, d_cell * gates[:, h : 2 * h]
        grads[f"wh{d}"] = d_wh
        grads[f"wx{d}"] = np.einsum("nte,ntg->eg", x, d_given)
        grads[f"b{d}"] = d_given.sum((0, 1))
        return d_given @ p[f"wx{d}"].T


def labelled_windows(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    """n made-up windows with labelled spans: the four kinds as the rules know them and in the other ways people write them,
    among invented words, numbers, dates, versions and secrets that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda lo=1, hi=9: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéäöüñß" if rng.random() < 0.1 else "etaoinshrdlucmwfgypbvk") for _ in range(rng.randint(lo, hi)))

    def card() -> str:
        d = rng.choice("3456") + digits(14)
        d = next(d + c for c in "0123456789" if luhn(d + c))
        return rng.choice(["", "", " ", "-", ".", "/"]).join(d[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        name = word(2, 8) + rng.choice(["", ".", "_", "+", "-"]) + rng.choice([word(1, 5), digits(2)])
        host, tld = word(3, 8) + rng.choice(["", digits(1)]), rng.choice(["com", "org", "net", "de", "fr", "es", "io"])
        sign, dot = rng.choice([("@", ".")] * 4 + [(" (at) ", "."), (" [at] ", "."), ("(at)", "."), ("[at]", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) ")])
        return name + sign + host + rng.choice(["", dot + word(3, 6)]) + dot + tld

    def host() -> str:
        if rng.random() < 0.75:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        parts = [format(rng.randrange(1 << 16), "x") for _ in range(8)]
        at = rng.randint(1, 5)
        return ":".join(parts) if rng.random() < 0.5 else ":".join(parts[:at]) + "::" + ":".join(parts[at + 2 :])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rng.randint(30, 49)} {a} {b}{c}", f"+{rng.randint(1, 99)}-{a}-{b}-{c}"])

    def other() -> str:
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 40)))
        return rng.choice([digits(rng.randint(1, 8)), f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"password={hexes}", f'token = "{hexes}"', f"{digits(3)},{digits(3)}", f"({rng.randint(1, 99)})", f"@{word()}", f"{rng.randint(1, 23)}:{rng.randint(10, 59)}", f"#{digits(5)}", f"{digits(2)}%", f"© {rng.randint(1990, 2026)}", f"src{digits(2)}", f"look (at) {word()}"])

    makers = (email, host, card, phone)
    texts, labels = [], np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            u = rng.random()
            if u < 0.14:
                k = rng.randrange(len(KINDS))
                value = makers[k]()
                spans.append((len(text), len(text) + len(value), k))
                text += value
            elif u < 0.24:
                text += other()
            else:
                w = word()
                text += w.capitalize() if rng.random() < 0.15 else w
            text += rng.choice([" ", " ", " ", " ", ", ", ". ", ".\n", " | ", ": "])
        cut = rng.randrange(max(1, len(text) - WINDOW)) if rng.random() < 0.5 else 0
        window = text[cut : cut + WINDOW]
        for s, e, k in spans:
            s, e = s - cut, e - cut
            if s < WINDOW and e > 0:
                a = max(0, s)
                labels[i, a : min(e, WINDOW)] = 2 + 2 * k
                labels[i, a] = 1 + 2 * k
        texts.append(window)
    return texts, labels


@functools.lru_cache(maxsize=2)
def trained(n: int = 2400, epochs: int = 9, hidden: int = 16, seed: int = 7, rate: float = 0.01) -> Tagger:
    """The tagger after `epochs` rounds of Adam over `n` labelled windows. Depends on its parameters alone, on no corpus."""
    texts, labels = labelled_windows(n, seed)
    ids = np.stack([_filled(char_ids(t)) for t in texts])
    model, rng, size = Tagger(hidden, seed=seed), np.random.default_rng(seed), 48
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, steps = 0, epochs * (n // size)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n - size + 1, size):
            rows = order[at : at + size]
            _, grads = model.step(ids[rows], labels[rows])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            step += 1
            now = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                g = g * min(1, 5 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def _filled(ids: np.ndarray) -> np.ndarray:
    out = np.full(WINDOW, FILLER, np.int16)
    out[: len(ids)] = ids
    return out


_AT = re.compile(r"@|\s?[(\[]at[)\]]\s?", re.IGNORECASE)
_V6 = re.compile(r"(?=(?:[^:]*:){2})[0-9a-fA-F]{1,4}(?:::?[0-9a-fA-F]{1,4}){2,7}")
_MAIL = re.compile(r"[\w.+%-]+(?:@|\s?[(\[]at[)\]]\s?)[\w-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?)[\w-]+)+", re.IGNORECASE)
_CALL = re.compile(r"[+(]?[0-9][0-9 ().-]*[0-9]")
_PAYS = re.compile(r"[0-9]+(?:[ ./-][0-9]+)*")


def plausible(value: str, kind: int) -> bool:
    """Whether a span of the model has the build of its kind; every kind has a digit, an @ or a bracketed at."""
    n = sum(c in "0123456789" for c in value)
    if kind == 0:
        return bool(_MAIL.fullmatch(value))
    if kind == 1:
        return bool(_V6.fullmatch(value)) and n > 0
    if kind == 2:
        return bool(_PAYS.fullmatch(value)) and 14 <= n <= 19 and luhn(re.sub("[^0-9]", "", value))
    return bool(_CALL.fullmatch(value)) and 9 <= n <= 15 and bool(re.search("[ ().-]", value))


def windows_of(text: str, base: list[Span]) -> list[int]:
    """Starts of the windows that hold a trigger outside the base spans, or a part of the word around one. Windows start at multiples of STRIDE."""
    out, i, last = [], 0, max(0, len(text) - WINDOW)
    ends = -(-last // STRIDE)
    seen = word_end = -1
    for m in _TRIGGER.finditer(text):
        at = m.start()
        while i < len(base) and base[i][1] <= at:
            i += 1
        if i < len(base) and base[i][0] <= at:
            continue
        if at >= word_end:  # the word around the trigger
            word = at
            while word > max(0, word_end) and not text[word - 1].isspace():
                word -= 1
            after = _SPACE.search(text, at)
            word_end = after.start() if after else len(text)
        lo, hi = max(seen + 1, -(-(min(word, at) - WINDOW + 1) // STRIDE)), min((word_end - 1) // STRIDE, ends)
        out += range(max(0, lo), hi + 1)
        seen = max(seen, hi)
    return [w * STRIDE for w in out]


def reconcile(found: list[tuple[int, int, int, float]], base: list[Span]) -> list[Span]:
    """Of the windows' spans the set without overlaps, also with base spans, of the greatest total score (ties: fewer, earlier)."""
    best: dict[tuple[int, int, int], float] = {}
    cover = sorted((s, e) for s, e, _ in base)
    starts = [s for s, _ in cover]
    import bisect

    far, most = [], 0
    for _, e in cover:
        most = max(most, e)
        far.append(most)
    for s, e, k, v in found:
        i = bisect.bisect_left(starts, e)
        if not (i and far[i - 1] > s):
            best[s, e, k] = max(v, best.get((s, e, k), 0.0))
    items = sorted(best.items(), key=lambda x: (x[0][1], x[0]))
    ends = [x[0][1] for x in items]
    total, take = [0.0], []
    for i, ((s, _, _), v) in enumerate(items):
        j = bisect.bisect_right(ends, s, 0, i)
        take.append(j if total[j] + v > total[i] else -1)
        total.append(max(total[i], total[j] + v))
    out, i = [], len(items)
    while i:
        if take[i - 1] < 0:
            i -= 1
        else:
            out.append(items[i - 1][0])
            i = take[i - 1]
    return out[::-1]


def runs_of(starts: list[int], length: int) -> list[tuple[int, int, list[int]]]:
    """(from, to, windows): stretches of a text that overlapping windows cover without a gap."""
    out: list[tuple[int, int, list[int]]] = []
    for w in starts:
        if out and w < out[-1][1]:
            out[-1] = (out[-1][0], min(w + WINDOW, length), [*out[-1][2], w])
        else:
            out.append((w, min(w + WINDOW, length), [w]))
    return out


#: The weight of a place's scores in a window: what stands in the middle knows most of what is around it.
_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def decoded(stretches: list[tuple[str, int, int, list[int]]], model: Tagger, batch: int = 512) -> list[tuple[np.ndarray, np.ndarray]]:
    """(path, scores) of each stretch (text, from, to, windows): windows' scores are averaged place by place, and one path is decoded over the whole stretch."""
    ems = [np.zeros((b - a, LABELS), np.float32) for _, a, b, _ in stretches]
    mass = [np.zeros((b - a, 1), np.float32) for _, a, b, _ in stretches]
    where = [(i, w) for i, x in enumerate(stretches) for w in x[3]]
    for at in range(0, len(where), batch):
        part = where[at : at + batch]
        em, _ = model.emissions(np.stack([_filled(char_ids(stretches[i][0][w : w + WINDOW])) for i, w in part]))
        for r, (i, w) in enumerate(part):
            _, a, b, _ = stretches[i]
            n = min(w + WINDOW, b) - w
            ems[i][w - a : w - a + n] += em[r, :n] * _WEIGHT[:n, None]
            mass[i][w - a : w - a + n] += _WEIGHT[:n, None]
    ems = [e / m for e, m in zip(ems, mass, strict=True)]
    return list(zip(model.viterbi(ems), ems, strict=True)) if ems else []


def find(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans and all spans, both by start and then kind.

    A span may be of any length. Where a path's span touches the end of its stretch, and the text goes on, windows are
    added there and the stretch is decoded again, so that neither length nor place decides what is found.
    """
    bases = [base_spans(t) for t in texts]
    found: list[list] = [[] for _ in texts]
    todo = {i: w for i, t in enumerate(texts) if (w := windows_of(t, bases[i]))}
    step = 1
    while todo:
        stretches = [(i, a, b, ws) for i, w in todo.items() for a, b, ws in runs_of(w, len(texts[i]))]
        more: dict[int, set[int]] = {}
        for i in todo:
            found[i] = []
        for (i, a, b, ws), (path, em) in zip(stretches, decoded([(texts[i], a, b, ws) for i, a, b, ws in stretches], model), strict=True):
            text = texts[i]
            if path[0] > 0 and a > 0:
                more.setdefault(i, set()).update(range(max(0, ws[0] - step * STRIDE), ws[0], STRIDE))
            if path[-1] > 0 and b < len(text):
                more.setdefault(i, set()).update(range(ws[-1] + STRIDE, min(ws[-1] + step * STRIDE, -(-max(0, len(text) - WINDOW) // STRIDE) * STRIDE) + 1, STRIDE))
            starts = np.flatnonzero(path % 2 == 1)
            for t in starts:
                u = t + 1
                while u < len(path) and path[u] == path[t] + 1:
                    u += 1
                s, e = a + int(t), a + int(u)
                score = float((em[np.arange(t, u), path[t:u]] - em[t:u, 0]).sum())
                if score <= 0 or (s > 0 and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum()):
                    continue
                # the kind that the scores of these places favour, of those that the value can be
                likely = sorted(range(len(KINDS)), key=lambda k: (2 * k + 1 != path[t], -float(em[t, 1 + 2 * k] + em[t + 1 : u, 2 + 2 * k].sum())))
                k = next((k for k in likely if plausible(text[s:e], k)), None)
                if k is not None:
                    found[i].append((s, e, k, score))
        todo, step = {i: sorted({*todo[i], *new}) for i, new in more.items()}, 2 * step
    out = []
    for i, base in enumerate(bases):
        added = reconcile(found[i], base) if found[i] else []
        out.append((base, sorted(base + added, key=lambda x: (x[0], x[2])) if added else base))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in capitals in brackets; spans that overlap become one, of the first kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        s, e, k = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, spans[i][1])
            i += 1
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join(out) + text[at:] if out else text


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted_text): personal data of every whole text.

    The counts and the digest are of the base rules' spans; `spans` has these and what the model adds.
    Null texts count as empty and have no spans; repeated rows repeat; an empty table stays empty;
    other columns are left out. Offsets are code points, ends exclusive.
    """
    model = model or trained()

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "t"):
                texts = common.column(part, "t").to_pylist()
                rows = find(texts, model)
                counts = [pa.array([sum(x[2] == k for x in base) for base, _ in rows], pa.int64()) for k in range(len(KINDS))]
                digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows])
                spans = pa.array([joined(all_) for _, all_ in rows], pa.string())
                clean = pa.array([redacted(t, all_) for t, (_, all_) in zip(texts, rows, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([common.column(part, id_col), *counts, digests, spans, clean], [id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "redacted_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select(F.col(id_col), common.text_of(text_col).alias("t")).mapInArrow(common.released(run), f"`{id_col}` {kind}, {counts}, base_sha256 string, spans string, redacted_text string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", model: Tagger | None = None) -> DataFrame:
    """The table with personal data in its texts replaced; all rows and columns stay, null texts stay null, lengths follow the text."""
    model = model or trained()
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, text_col):
                texts = common.column(part, text_col).to_pylist()
                rows = find([t or "" for t in texts], model)
                clean = [None if t is None else redacted(t, all_) for t, (_, all_) in zip(texts, rows, strict=True)]
                made = {text_col: pa.array(clean, pa.string())}
                if length_col in names:
                    old = common.column(part, length_col)
                    made[length_col] = pa.array([o.as_py() if c == t else len(c) for o, c, t in zip(old, clean, texts, strict=True)], old.type)
                yield pa.RecordBatch.from_arrays([made.get(n, common.column(part, n)) for n in names], names)

    return docs.mapInArrow(common.released(run), docs.schema)
