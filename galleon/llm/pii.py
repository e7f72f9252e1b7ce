"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The base spans are those of the patterns below. The tagger is trained in numpy, in one task, from labelled spans:
base spans in windows of at most SAMPLE documents, EACH windows of a document from anywhere in its whole text, and
made-up personal data (also in spellings that the patterns don't know: dotted cards, numbers without a plus, [.] in
addresses, (at) in mail) and look-alikes (keys, versions, dates, plain numbers) set into those windows. Every kind of
personal data here has a digit, an @ or an (at), so only text around these, wherever it stands, is cut into overlapping windows. The
windows' scores are added up with weights that fall towards their edges, and one Viterbi search over each whole
stretch decides: windows can't disagree. Decoded spans that touch no base span, fit their kind and have a mean
probability of SURE or more are added.

Null and empty texts have no spans (the digest is that of an empty string). Repeated rows are each searched. Very
long texts are searched whole. No row meets another, so no key can be hot.
"""

from __future__ import annotations

import hashlib
import io
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from galleon.llm.base import fitted, mapped, table

#: Documents whose windows the tagger learns from, at most; windows of each, at most; characters of a window.
SAMPLE, EACH, LEARNED = 300, 8, 120
KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches in time linear in the text: an address is found by its @, and no number is begun in its middle.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
TRIGGER = re.compile(r"[0-9@]+|[(\[]at[)\]]")
HIDDEN, WINDOW, MARGIN, SURE = 20, 96, 24, 0.8
EXAMPLES, EPOCHS = 2800, 10
TAGS = 1 + 2 * len(KINDS)
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

SIGNS = {c: i + 5 for i, c in enumerate("@.-+() _%/:=\"'\n,;#[]")}
CLASSES = 5 + len(SIGNS) + 1
ASCII = np.array([SIGNS.get(chr(c)) or (1 if chr(c).isdigit() else 2 if chr(c).islower() else 3 if chr(c).isupper() else CLASSES - 1) for c in range(128)])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind, then start."""
    return [(k, a, b) for k, kind in enumerate(KINDS) for a, b in places(kind, text) if valid(kind, text[a:b])]


def places(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """The places of the kind's base pattern, leftmost and non-overlapping."""
    if kind != "email":
        yield from (m.span() for m in (NUMBERS if kind == "ip" else BASE[kind]).finditer(text))
        return
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, ASCII[np.minimum(c, 127)], 4)


# --- the tagger ---------------------------------------------------------------------------------------------------


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, p = HIDDEN, {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * h))
        p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        p[f"b{d}"] = np.concatenate((np.zeros(h), np.ones(h), np.zeros(2 * h)))
    p["out"], p["bias"], p["trans"] = rng.normal(0, 0.2, (2 * h, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS))
    return p


def emissions(x: np.ndarray, p: dict, keep: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """Scores of the tags (T, B, K) of codes (B, T), the hidden states behind them, and what learning needs if it is kept.

    Both directions run side by side; the backward one reads the codes from the end.
    """
    n, t = x.shape
    given = np.stack((p["xf"][x.T] + p["bf"], p["xb"][x.T[::-1]] + p["bb"]), axis=1)  # (T, 2, B, 4H)
    inner = np.stack((p["hf"], p["hb"]))
    h, c = np.zeros((2, n, HIDDEN), given.dtype), np.zeros((2, n, HIDDEN), given.dtype)
    states, saved = np.empty((t, 2, n, HIDDEN), given.dtype), []
    for k in range(t):
        z = given[k] + h @ inner
        s = 1 / (1 + np.exp(-np.clip(z[..., : 3 * HIDDEN], -30, 30)))
        g = np.tanh(z[..., 3 * HIDDEN :])
        i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
        last, c = c, f * c + i * g
        th = np.tanh(c)
        if keep:
            saved.append((h, last, i, f, o, g, th))
        h = o * th
        states[k] = h
    both = np.concatenate((states[:, 0], states[::-1, 1]), axis=2)
    return (both @ p["out"] + p["bias"]).astype(np.float64), both, saved


def back(x: np.ndarray, grad: np.ndarray, saved: list, p: dict, g: dict) -> None:
    """Adds the gradients of both directions, given those of the hidden states (T, B, 2H)."""
    n, t = x.shape
    ahead = np.stack((grad[:, :, :HIDDEN], grad[::-1, :, HIDDEN:]), axis=1).astype(p["hf"].dtype)
    turned = np.stack((p["hf"].T, p["hb"].T))
    kind = turned.dtype
    dh, dc = np.zeros((2, n, HIDDEN), kind), np.zeros((2, n, HIDDEN), kind)
    dz, before = np.empty((t, 2, n, 4 * HIDDEN), kind), np.empty((t, 2, n, HIDDEN), kind)
    for k in range(t - 1, -1, -1):
        before[k], last, i, f, o, u, th = saved[k]
        dh = dh + ahead[k]
        dc = dc + dh * o * (1 - th**2)
        dz[k] = np.concatenate((dc * u * i * (1 - i), dc * last * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - u**2)), axis=2)
        dh, dc = dz[k] @ turned, dc * f
    for side, d, codes_ in ((0, "f", x.T), (1, "b", x.T[::-1])):
        flat = dz[:, side].reshape(t * n, -1)
        g[f"x{d}"] += np.eye(CLASSES, dtype=kind)[codes_.reshape(-1)].T @ flat
        g[f"h{d}"] += before[:, side].reshape(t * n, -1).T @ flat
        g[f"b{d}"] += flat.sum(0)


def lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def marginals(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of the tags at each place (T, B, K), and the forward and backward sums and the total behind them."""
    t = len(e)
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for k in range(1, t):
        a[k] = e[k] + lse(a[k - 1][:, :, None] + trans, 1)
    for k in range(t - 2, -1, -1):
        b[k] = lse(trans + (e[k + 1] + b[k + 1])[:, None, :], 2)
    z = lse(a[-1], 1)
    return np.exp(a + b - z[None, :, None]), a, b, z


def crf(e: np.ndarray, tags: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the CRF's negative log-likelihood by emissions (T, B, K) and transitions, and its value."""
    t, n, _ = e.shape
    ge, a, b, z = marginals(e, trans)
    gt = np.zeros_like(trans)
    for k in range(1, t):
        gt += np.exp(a[k - 1][:, :, None] + trans + (e[k] + b[k])[:, None, :] - z[:, None, None]).sum(0)
    rows = np.arange(n)
    gold = np.zeros(n)
    for k in range(t):
        ge[k, rows, tags[:, k]] -= 1
        gold += e[k, rows, tags[:, k]]
        if k:
            np.add.at(gt, (tags[:, k - 1], tags[:, k]), -1)
            gold += trans[tags[:, k - 1], tags[:, k]]
    return ge, gt, float((z - gold).mean())


def viterbi(e: np.ndarray, trans: np.ndarray) -> list[int]:
    score, back_ = e[0], []
    for k in range(1, len(e)):
        all_ = score[:, None] + trans
        back_.append(all_.argmax(0))
        score = all_.max(0) + e[k]
    path = [int(score.argmax())]
    for b in reversed(back_):
        path.append(int(b[path[-1]]))
    return path[::-1]


def made_up(r: random.Random) -> tuple[str, int | None]:
    """A piece of personal data and its kind, or a look-alike and None."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    name = lambda: "".join(x.capitalize() if r.random() < 0.2 else x for x in (w(1, 8), r.choice(["", "", ".", "_", "-"]), r.choice(["", w(1, 8), d(r.randint(1, 4))])))
    pick = r.randint(0, 15)
    if pick <= 2:
        host = r.choice([".", "-"]).join(w(2, 8) for _ in range(r.randint(1, 2))) + r.choice(["", "", d(1)])
        return f"{name()}{r.choice(['@', '@', '(at)', '[at]', ' (at) ', ' [at] ', ' @ '])}{host}.{r.choice(['com', 'org', 'net', 'de', 'io', 'fr', 'example.com', 'co.uk', w(2, 4)])}", 0
    if pick <= 5:
        return r.choice([".", ".", "[.]", " . ", "(.)"]).join(str(r.randint(0, 255)) for _ in range(4)), 1
    if pick <= 8:
        x = r.choice("23456") + d(r.choice([12, 13, 14, 14, 14, 14, 17]))
        x += next(c for c in "0123456789" if luhn(x + c))
        sizes = r.choice([[4] * 5, [4] * 5, [4, 6, 5, 4], [19], [r.randint(2, 6) for _ in range(9)]])
        at = [0, *(sum(sizes[: k + 1]) for k in range(len(sizes)) if sum(sizes[: k + 1]) < len(x)), len(x)]
        return r.choice([" ", "-", ".", "/"]).join(x[a:b] for a, b in zip(at, at[1:], strict=False)), 2
    if pick <= 11:
        groups = [d(n) for n in r.choice([(3, 3, 4), (3, 3, 4), (2, 4, 4), (3, 4, 4), (3, 2, 2, 3), (5, 6), (4, 7), (2, 2, 2, 2, 2)])]
        code = r.choice(["", "", f"+{d(r.randint(1, 3))}", f"00{d(2)}"])
        if r.random() < 0.3:
            groups[0] = f"({groups[0]})"
        sep, last = r.choice([" ", " ", "-", "-", ".", "/"]), r.choice([" ", "-", "."])
        last = sep if r.random() < 0.7 else last
        if code.startswith("+") and r.random() < 0.2:
            return code + d(10), 3
        return (code + r.choice(["", sep, " "]) if code else "") + (r.choice(["", " "]) if groups[0][0] == "(" else sep).join([groups[0], last.join(groups[1:])]), 3
    return r.choice([d(r.randint(1, 6)), f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"v{d(1)}.{d(1)}.{d(2)}", f"{r.randint(1900, 2030)}", f"{r.randint(1900, 2030)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{r.randint(1900, 2030)}", f"{d(2)}/{d(2)}/{r.randint(1900, 2030)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(2)}:{d(2)}", "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 32, 40]))), f"password={w(2, 4)}{d(2)}", f"@{w(3, 9)}", f"{w(2, 5)}{d(3)}", f"${d(2)},{d(3)}.{d(2)}", f"{d(3)}-{d(4)}", f"{d(2)}-{d(3)}", f"{d(r.randint(7, 12))}", f"{d(3)} {d(3)}", f"{d(2)} (at) {d(2)}", f"{w(3, 6)} (at) {w(2, 5)} "]), None


def tagged(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    x, y = codes(text), np.zeros(len(text), int)
    for k, a, b in spans:
        y[a:b], y[a] = 2 + 2 * k, 1 + 2 * k
    return x, y


def windows(text: str, n: int = EACH, size: int = LEARNED) -> list[str]:
    """Up to n windows from anywhere in the whole text, every other one around a digit or an @ if there is any."""
    r, hits = random.Random(len(text)), [m.start() for m in TRIGGER.finditer(text)]
    out = []
    for k in range(n if len(text) > size else 1):
        at = r.choice(hits) - r.randint(5, size // 2) if k % 2 and hits else r.randint(0, max(0, len(text) - size))
        out.append(text[max(0, at) : max(0, at) + size])
    return out


def fit(ids: list[int], found: list[bytes], label: list[int]) -> bytes:
    """Trains the tagger on windows of 64 characters of the given ones; Adam, fixed seeds."""
    r, rng, size = random.Random(11), np.random.default_rng(11), 64
    plain = [t.decode("utf-8", "replace") for t in found if t] or ["some words stand here and there in a line of text that goes on for a while"]
    xs, ys = [], []
    for n in range(EXAMPLES):
        text = r.choice(plain)
        at = r.randint(0, max(0, len(text) - size))
        around = text[at : at + size].ljust(size, " ")
        if n % 4 == 0 and (hit := TRIGGER.search(text, at)):
            a = max(0, hit.start() - r.randint(5, 40))
            around = text[a : a + size].ljust(size, " ")
            x, y = tagged(around, sorted(base_spans(around), key=lambda s: s[1]))
        else:
            around = TRIGGER.sub("", around).ljust(size, "e")
            piece, kind = made_up(r)
            cut = r.randint(0, size)
            left, right = around[:cut] + r.choice([" ", " ", " ", ": ", "(", '"', "\n"]), r.choice([" ", " ", ". ", ", ", "\n", ")", '"', ";"]) + around[cut:]
            whole, a = left + piece + right, len(left)
            shift = max(0, min(a + len(piece) - size + r.randint(0, 20), a - 2)) if a + len(piece) > size else 0
            spans = [] if kind is None else [(kind, a - shift, min(size, a - shift + len(piece)))]
            x, y = tagged(whole[shift : shift + size].ljust(size, " "), [s for s in spans if s[1] >= 0])
        xs.append(x)
        ys.append(y)
    x, y = np.array(xs), np.array(ys)
    p = {q: w.astype(np.float32) for q, w in start_weights(rng).items()}
    m, v, k = {q: np.zeros_like(w) for q, w in p.items()}, {q: np.zeros_like(w) for q, w in p.items()}, 0
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 100)):
            e, both, saved = emissions(x[rows], p, True)
            ge, gt, _ = crf(e, y[rows], p["trans"])
            ge, gt = ge / len(rows), gt / len(rows)
            g = {q: np.zeros_like(w) for q, w in p.items()}
            ge = ge.astype(np.float32)
            g["trans"], g["bias"] = gt.astype(np.float32), ge.sum((0, 1))
            g["out"] = both.reshape(-1, 2 * HIDDEN).T @ ge.reshape(-1, TAGS)
            back(x[rows], ge @ p["out"].T, saved, p, g)
            norm, k = np.sqrt(sum((w**2).sum() for w in g.values())), k + 1
            for q in p:
                w = g[q] * min(1.0, 5.0 / norm)
                m[q], v[q] = 0.9 * m[q] + 0.1 * w, 0.99 * v[q] + 0.01 * w**2
                p[q] -= 0.02 * (1 if epoch < EPOCHS // 2 else 0.5 if epoch < EPOCHS - 3 else 0.2) * (m[q] / (1 - 0.9**k)) / (np.sqrt(v[q] / (1 - 0.99**k)) + 1e-8)
    out = io.BytesIO()
    np.savez(out, **{q: w.astype(np.float32) for q, w in p.items()})
    return out.getvalue()


def train(docs: DataFrame, rows: int = SAMPLE) -> bytes:
    """The tagger, from at most EACH windows of LEARNED characters of each document of a bounded sample, chosen by a hash
    of their ids. The windows are drawn in the documents' own tasks; the ids alone are broadcast."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = [x.encode() for x in windows(t or "")]
                yield {"doc_id": [i] * len(w), "text": w, "label": [0] * len(w)}

    drawn = mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id"), step, "doc_id long, text binary, label int")
    # repeated ids don't make it more
    return fitted(drawn.orderBy(F.xxhash64("text"), "doc_id").limit(rows * EACH), fit)


def stretches(text: str) -> list[tuple[int, int]]:
    """Text around digits and @, merged where the surroundings meet."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def added(text: str, base: list[tuple[int, int, int]], p: dict) -> list[tuple[int, int, int]]:
    """Spans that the tagger finds beside the base spans."""
    out = []
    weight = 1 - np.abs(np.linspace(-0.95, 0.95, WINDOW))
    for a, b in stretches(text):
        if all(any(s <= m.start() + a and m.end() + a <= e for _, s, e in base) for m in TRIGGER.finditer(text[a:b])):
            continue  # base spans hold every digit and @ here, and nothing may touch them
        x = codes(text[a:b])
        starts = list(range(0, max(1, len(x) - WINDOW // 2), WINDOW // 2))
        grid = np.full((len(starts), WINDOW), SIGNS[" "])
        for i, s in enumerate(starts):
            part = x[s : s + WINDOW]
            grid[i, : len(part)] = part
        total, mass = np.zeros((len(x), TAGS)), np.zeros(len(x))
        for lo in range(0, len(starts), 256):
            e = emissions(grid[lo : lo + 256], p)[0]
            for i, s in enumerate(starts[lo : lo + 256]):
                n = min(WINDOW, len(x) - s)
                total[s : s + n] += e[:n, i] * weight[:n, None]
                mass[s : s + n] += weight[:n]
        total /= mass[:, None]
        path = viterbi(total, p["trans"])
        if max(path) == 0:
            continue
        prob = marginals(total[:, None], p["trans"])[0][:, 0]
        i = 0
        while i < len(path):
            if path[i] % 2 == 1:
                kind, j = (path[i] - 1) // 2, i + 1
                while j < len(path) and path[j] == path[i] + 1:
                    j += 1
                found = text[a + i : a + j]
                if prob[range(i, j), path[i:j]].mean() >= SURE and fits(KINDS[kind], found) and not any(s < a + j and a + i < e for _, s, e in base):
                    out.append((kind, a + i, a + j))
                i = j
            else:
                i += 1
    return out


#: What a decoded span must look like to be of its kind at all; numbers are checked as the base spans are.
SHAPES = {
    "email": re.compile(r"[^\s@()\[\]]+ ?(?:@|[(\[]at[)\]]) ?[^\s@()\[\]]+\.[^\s@()\[\]]*[A-Za-z0-9]"),
    "ip": re.compile(r"[0-9]+(?: ?[(\[]?\.[)\]]? ?[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[ ./-]?[0-9])+"),
    "phone": re.compile(r"[+(]?[0-9][ ().0-9/-]+[0-9]"),
}


def fits(kind: str, found: str) -> bool:
    """Whether a decoded span can be of its kind at all."""
    if not SHAPES[kind].fullmatch(found):
        return False
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return valid("ip", re.sub(r"[^0-9.]", "", found))
    if kind == "phone":
        return 10 <= len(digits) <= 15 and len(digits) < len(found)
    return valid(kind, found)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def all_spans(text: str, p: dict) -> tuple[list, list]:
    if not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + added(text, base, p))


def load(model: bytes) -> dict:
    return dict(np.load(io.BytesIO(model)).items())


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, and all spans (kind:start:end in code points)."""
    model = train(docs)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        p = load(model)
        for b in batches:
            rows = [all_spans(t or "", p) for t in b.column("text").to_pylist()]
            out = {f"n_{kind}": [sum(s[0] == k for s in base) for base, _ in rows] for k, kind in enumerate(KINDS)}
            yield {"doc_id": b.column("doc_id"), **out, "base_sha256": [hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in rows], "spans": [spelled(x) for _, x in rows]}

    return mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), step, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by its first span's kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by [KIND]; a null text stays null, n_chars follows the new text."""
    model, schema = train(docs), docs.schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model)
        for b in batches:
            new = [t if t is None or not (s := all_spans(t, p)[1]) else masked(t, s) for t in b.column("text").to_pylist()]
            cols = {n: b.column(n) for n in b.schema.names} | {"text": pa.array(new, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) if t is not None and t is not o else n for t, o, n in zip(new, b.column("text").to_pylist(), b.column("n_chars").to_pylist(), strict=True)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in b.schema.names], names=b.schema.names)

    return docs.mapInArrow(step, schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
