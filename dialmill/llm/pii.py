"""Personal data: exact base patterns, and spans added by a character BiLSTM with CRF transitions.

The base finds emails, IP addresses, card and phone numbers by their patterns, whole text by whole text. The model, a
numpy bidirectional LSTM over character classes with a linear-chain CRF on top, is trained from labelled spans and
reads overlapping windows over every place of a text that holds a digit or an at sign (no kind can do without one).
Windows are decoded one by one; their spans are then reconciled over the whole text: of overlapping candidates the set
with the largest total score stays. Base spans always stay, and model spans that touch one are dropped.

Defined cases: null text is an empty text, without spans; texts are read whole; repeated rows get equal results; an
empty table gives an empty result; clashing column names are replaced; offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialmill.runtime import bound_batches, tidy, without

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SEED_CHAR = re.compile(r"[0-9@]")
WINDOW, STRIDE, REACH, CERTAIN, DECODED = 96, 48, 40, 0.9, 256


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind in the order of KINDS."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:  # the leftmost match that ends in this @ starts where the run of local characters starts
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    if SEED_CHAR.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


# --- characters -----------------------------------------------------------------------------------------------------

MARKS = "@.-+ ()_%/:,;\n\"'=#"
N_CLASSES = 8 + len(MARKS)
N_TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point below 65,536: 0 padding, 1 digit, 2 to 5 letters by case and alphabet, 6 space, 7 other."""
    table = np.full(1 << 16, 7, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if "0" <= c <= "9":
            table[i] = 1
        elif c in MARKS:
            table[i] = 8 + MARKS.index(c)
        elif c.isalpha():
            table[i] = 2 + 2 * (i > 127) + c.isupper()
        elif c.isspace():
            table[i] = 6
    return table


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return char_classes()[np.minimum(codes, 0xFFFF)]


# --- model ----------------------------------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - m).sum(axis, keepdims=True)) + m).squeeze(axis)


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, save: bool = True) -> tuple[np.ndarray, list]:
    """Hidden states (n, t, h) of inputs (n, t, e), and, with save, what the backward pass needs."""
    n, t, _ = x.shape
    size = u.shape[0]
    h, c = np.zeros((n, size)), np.zeros((n, size))
    pre = x @ w + b
    out, saved = np.empty((n, t, size)), []
    for k in range(t):
        z = pre[:, k] + h @ u
        i, f, o, g = sigmoid(z[:, :size]), sigmoid(z[:, size : 2 * size]), sigmoid(z[:, 2 * size : 3 * size]), np.tanh(z[:, 3 * size :])
        last_c, last_h = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, k] = h
        if save:
            saved.append((i, f, o, g, last_c, tc, last_h))
    return out, saved


def lstm_back(x: np.ndarray, w: np.ndarray, u: np.ndarray, saved: list, d_out: np.ndarray) -> tuple[np.ndarray, ...]:
    n, t, _ = x.shape
    size = u.shape[0]
    dh, dc = np.zeros((n, size)), np.zeros((n, size))
    dz_all, du = np.empty((n, t, 4 * size)), np.zeros_like(u)
    for k in reversed(range(t)):
        i, f, o, g, last_c, tc, last_h = saved[k]
        dh = dh + d_out[:, k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * last_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz_all[:, k] = dz
        du += last_h.T @ dz
        dh, dc = dz @ u.T, dc * f
    return dz_all @ w.T, np.einsum("nte,ntz->ez", x, dz_all), du, dz_all.sum((0, 1))


class Tagger:
    """Embedding, one LSTM in each direction, a linear layer, and CRF transitions."""

    def __init__(self, size: int = 12, width: int = 8, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        cell = lambda: [r.normal(0, 0.3, (width, 4 * size)), r.normal(0, 0.3, (size, 4 * size)), np.zeros(4 * size)]
        self.p = [r.normal(0, 0.5, (N_CLASSES, width)), *cell(), *cell(), r.normal(0, 0.3, (2 * size, N_TAGS)), np.zeros(N_TAGS), np.zeros((N_TAGS, N_TAGS))]

    def emissions(self, x: np.ndarray, save: bool = True) -> tuple[np.ndarray, tuple]:
        e = self.p[0][x]
        left, saved_l = lstm(e, *self.p[1:4], save)
        right, saved_r = lstm(e[:, ::-1], *self.p[4:7], save)
        both = np.concatenate([left, right[:, ::-1]], 2)
        return both @ self.p[7] + self.p[8], (e, both, saved_l, saved_r)

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log Z, tag probabilities (n, t, k), and the forward and backward tables."""
        n, t, k = scores.shape
        trans = self.p[9]
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0]
        for j in range(1, t):
            alpha[:, j] = scores[:, j] + logsumexp(alpha[:, j - 1, :, None] + trans, 1)
        for j in reversed(range(t - 1)):
            beta[:, j] = logsumexp(trans + (scores[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
        z = logsumexp(alpha[:, -1], 1)
        return z, np.exp(alpha + beta - z[:, None, None]), alpha, beta

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood of tag sequences y, and its gradients."""
        scores, (e, both, saved_l, saved_r) = self.emissions(x)
        n, t, k = scores.shape
        z, prob, alpha, beta = self.marginals(scores)
        rows, cols = np.arange(n)[:, None], np.arange(t)[None]
        gold = scores[rows, cols, y].sum(1) + self.p[9][y[:, :-1], y[:, 1:]].sum(1)
        d = prob.copy()
        d[rows, cols, y] -= 1
        pair = np.exp(alpha[:, :-1, :, None] + self.p[9] + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        d, pair = d / n, pair / n
        d_both = d @ self.p[7].T
        size = self.p[2].shape[0]
        de_l, *left = lstm_back(e, self.p[1], self.p[2], saved_l, d_both[:, :, :size])
        de_r, *right = lstm_back(e[:, ::-1], self.p[4], self.p[5], saved_r, d_both[:, ::-1, size:])
        de = np.zeros_like(self.p[0])
        np.add.at(de, x, de_l + de_r[:, ::-1])
        return float((z - gold).mean()), [de, *left, *right, np.einsum("nth,ntk->hk", both, d), d.sum((0, 1)), pair]

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam over shuffled batches; the loss of each round."""
        r = np.random.default_rng(seed)
        m, v, step, losses = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0, []
        for k in range(rounds):
            order, total = r.permutation(len(x)), 0.0
            for a in range(0, len(x), batch):
                part = order[a : a + batch]
                loss, grads = self.gradients(x[part], y[part])
                total += loss * len(part)
                step += 1
                for i, g in enumerate(grads):
                    g = np.clip(g, -1, 1)
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                    self.p[i] = self.p[i] - rate * 0.85**k * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
            losses.append(total / len(x))
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag sequences by Viterbi, and each tag's probability; DECODED windows at a time, so memory is bounded."""
        parts = [self.best_tags(x[a : a + DECODED]) for a in range(0, len(x), DECODED)] or [self.best_tags(x)]
        return np.concatenate([tags for tags, _ in parts]), np.concatenate([prob for _, prob in parts])

    def best_tags(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores, _ = self.emissions(x, save=False)
        n, t, k = scores.shape
        best, back = scores[:, 0], np.zeros((n, t, k), np.int8)
        for j in range(1, t):
            step = best[:, :, None] + self.p[9]
            back[:, j] = step.argmax(1)
            best = scores[:, j] + step.max(1)
        tags = np.zeros((n, t), np.int64)
        tags[:, -1] = best.argmax(1)
        for j in reversed(range(1, t)):
            tags[:, j - 1] = back[np.arange(n), j, tags[:, j]]
        prob = self.marginals(scores)[1]
        return tags, np.take_along_axis(prob, tags[:, :, None], 2)[:, :, 0]


# --- labelled spans -------------------------------------------------------------------------------------------------


def invented(n: int, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled snippets from a seeded generator: prose around personal data, and look-alikes that are none."""
    r = random.Random(seed)
    syllables = "the ing er on de la un ment ö é ß ñ que and of ar ti schen tion".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(2, 6)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = num(r.choice([13, 14, 15, 15, 15, 18]))
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([d, d, "-".join(re.findall(".{1,4}", d)), " ".join(re.findall(".{1,4}", d))])

    make = {
        "email": lambda: word() + r.choice(["", ".", "_", "-"]) + r.choice([word(), num(2)]) + "@" + word() + r.choice(["", num(1)]) + r.choice([".example.com", ".org", ".net", ".example.co.uk"]),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+{r.randint(1, 99)} {num(3)} {num(3)} {num(4)}", f"+{r.randint(1, 99)}-{num(3)}-{num(3)}-{num(4)}", f"+{num(11)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{r.randint(1, 9)} ({num(3)}) {num(3)} {num(4)}", f"0{num(2)} {num(4)} {num(4)}"]),
    }
    fake = [lambda: num(r.randint(1, 5)), lambda: f"{r.randint(1900, 2030)}-{num(2)}-{num(2)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 32, 40]))), lambda: "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: f"@{word()}", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(3)}.{num(2)}", lambda: f"{num(3)} {num(3)}", lambda: f"password={num(6)}", lambda: f"{num(2)} {num(1)} {num(3)} {num(2)}"]
    out = []
    for _ in range(n):
        text, spans = prose() + " ", []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.72:
                kind = r.choice(KINDS)
                item = make[kind]()
                spans.append((kind, len(text), len(text) + len(item)))
            else:
                item = r.choice(fake)()
            text += item + r.choice([" ", ", ", ". ", "\n"]) + prose() + " "
        out.append((text, spans))
    return out


def windows(text: str) -> list[int]:
    """Starts of the windows that cover every digit and at sign with REACH characters around, STRIDE apart."""
    out, end = [], -1
    for m in SEED_CHAR.finditer(text):
        i = m.start()
        if i + REACH > end:
            start = max(0, i - REACH) if i - REACH > end - STRIDE else end - STRIDE
            out.append(start)
            end = start + WINDOW
    return out


def cut(x: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, x.dtype)
    part = x[start : start + WINDOW]
    out[: len(part)] = part
    return out


def tags_of(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


def train(labelled: list[tuple[str, list[tuple[str, int, int]]]], **how) -> Tagger:
    """A tagger from (text, spans) examples; deterministic."""
    xs, ys = [], []
    for text, spans in labelled:
        x, y = classes(text), tags_of(len(text), spans)
        for w in windows(text) or [0]:
            xs.append(cut(x, w))
            ys.append(cut(y, w))
    model = Tagger()
    model.losses = model.fit(np.array(xs), np.array(ys), **how)
    return model


@lru_cache(maxsize=1)
def default_model() -> Tagger:
    return train(invented(1000))


# --- application ----------------------------------------------------------------------------------------------------


def plausible(kind: str, s: str) -> bool:
    """The exact check that follows a decoded span."""
    d = len(digits_of(s))
    return {"email": "@" in s[1:-1], "ip": s.count(".") == 3 and d >= 4, "card": 13 <= d <= 19 and luhn(digits_of(s)), "phone": 9 <= d <= 15}[kind]


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The non-overlapping set of (start, end, kind, score) with the largest total score times length, over a whole text."""
    best: dict[tuple[int, int, int], float] = {}
    for a, b, k, s in found:
        best[a, b, k] = max(s, best.get((a, b, k), 0))
    items = sorted(best.items(), key=lambda x: (x[0][1], x[0]))
    ends = [x[0][1] for x in items]
    total, take = [0.0], []
    for i, ((a, b, _), s) in enumerate(items):
        j = bisect_right(ends, a, 0, i)
        with_it = total[j] + s * (b - a)
        take.append((with_it > total[i], j))
        total.append(max(total[i], with_it))
    out, i = [], len(items)
    while i:
        good, j = take[i - 1]
        if good:
            out.append(items[i - 1][0])
            i = j
        else:
            i -= 1
    return out[::-1]


def model_spans(model: Tagger, texts: list[str], most: int = 2048) -> list[list[tuple[str, int, int]]]:
    """Spans that the model sees in each text."""
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    queue: list[tuple[int, int, int, np.ndarray]] = []

    def flush() -> None:
        if not queue:
            return
        tags, prob = model.decode(np.array([q[3] for q in queue]))
        for (t, start, n, _), own, p in zip(queue, tags, prob, strict=True):
            for b in np.flatnonzero(own % 2):
                k, e = int(own[b]) // 2, b + 1
                while e < WINDOW and own[e] == own[b] + 1:
                    e += 1
                inner = (b > 0 or start == 0) and (e < WINDOW or start + WINDOW >= n)
                if inner and p[b:e].mean() >= CERTAIN and p[b:e].min() >= 0.5 and start + e <= n:
                    found[t].append((start + int(b), start + int(e), k, float(p[b:e].mean())))
        queue.clear()

    for t, text in enumerate(texts):
        if (starts := windows(text)):
            x = classes(text)
            for s in starts:
                queue.append((t, s, len(text), cut(x, s)))
                if len(queue) >= most:
                    flush()
    flush()
    return [[(KINDS[k], a, b) for a, b, k in reconcile(f) if plausible(KINDS[k], text[a:b])] for f, text in zip(found, texts, strict=True)]


def find_spans(model: Tagger, texts: list[str | None]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    texts = [t or "" for t in texts]
    out = []
    for text, more in zip(texts, model_spans(model, texts), strict=True):
        base = base_spans(text)
        added = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)] if more else []
        out.append((base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


def said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, model: Tagger, text_col: str = "text", keep: list[str] | None = None, masked: bool = False) -> DataFrame:
    """docs' columns (or keep) with n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans.

    With masked, text_col holds the text with its spans replaced.
    """
    own = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kept = [c for c in without(docs, [*own, "__t"]).columns if keep is None or c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("__t").to_pylist()
                both = find_spans(shared.value, texts)
                cols = dict(zip(part.schema.names[:-1], part.columns[:-1], strict=True))
                if masked:
                    cols[text_col] = pa.array([t if t is None else mask(t, s) for t, (_, s) in zip(texts, both, strict=True)], pa.string())
                for kind in KINDS:
                    cols[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in base) for base, _ in both], pa.int64())
                cols["base_sha256"] = pa.array([hashlib.sha256(said(base).encode()).hexdigest() for base, _ in both], pa.string())
                cols["spans"] = pa.array([said(s) for _, s in both], pa.string())
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    bound_batches(docs.sparkSession)
    src = docs.select(*kept, F.col(text_col).alias("__t"))
    fields = src.drop("__t").schema.fields
    schema = T.StructType([*fields, *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return src.mapInArrow(tidy(run), schema)
